"""The training-data pipeline: each stage is one operator, written to Parquet and read by the next.

A stage takes the documents that its predecessor kept and returns those that it keeps, with all columns of ``documents``; the
last returns their tokens. Decisions are made per row: rows that repeat a ``doc_id`` with different texts are judged one by one, and
of rows with the same ``doc_id`` and text one is left. Of copies of a text without ``doc_id`` one is left by exact dedup, which does not
compare them with rows that have an id; near dedup and decontamination judge rows without ``doc_id`` as all others. Where the
smallest id decides, the first text of a repeated id counts by it, and all its other texts and rows without id come after the ids.

All stages run in one application, whose executors and Python workers keep the most memory that any batch needed. Unless the session
has a limit for Arrow batches, the stages therefore set one of ``BATCH_BYTES``, which then holds for the session.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papersheaf.llm import bpe, decontaminate, exact, minhash, toxicity
from papersheaf.llm.queries import table, tokenizer_source, training_labels
from papersheaf.llm.tables import measured
from papersheaf.session import materialized

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

ORACLE_SQL = None  # a trained model, signatures and a tokenizer are beyond SQL
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def _in_small_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def limited(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH_LIMIT, None) is None:
            spark.conf.set(BATCH_LIMIT, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return limited


def _rows(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row in ``_row``: its id, or a hash above the usual ids for further texts of an id and for no id."""
    text = F.coalesce("text", F.lit(""))
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    repeated = materialized(ids)
    first = docs.join(measured(repeated, 16), "doc_id").groupBy("doc_id").agg(F.min(F.xxhash64(text)).alias("_first"))
    known = docs.join(measured(materialized(first), 24), "doc_id", "left")
    mixed = F.xxhash64(F.lit("row"), "doc_id", text).bitwiseAND((1 << 61) - 1) + F.lit(1 << 62)
    own = F.col("doc_id").isNotNull() & (F.col("_first").isNull() | (F.col("_first") == F.xxhash64(text)))
    return known.select(*(docs[c] for c in docs.columns), F.when(own, F.col("doc_id")).otherwise(mixed).alias("_row"))


def _named(rows: DataFrame) -> DataFrame:
    """What the operators judge: each row by its key."""
    return rows.select(F.col("_row").alias("doc_id"), "text")


def _kept(rows: DataFrame, judged: DataFrame, stays: Column) -> DataFrame:
    """``rows``, less their key, without those that ``judged`` names by their key and that do not stay."""
    gone = materialized(judged.filter(~stays).select(F.col("doc_id").alias("_row")).distinct())
    return rows.join(measured(gone, 16), "_row", "left_anti").drop("_row")


def _one_of_equal(rows: DataFrame) -> DataFrame:
    """One of the rows with the same key, the first by its other columns."""
    repeated = materialized(rows.groupBy("_row").agg(F.count("*").alias("n")).filter("n > 1").select("_row"))
    if repeated.isEmpty():
        return rows
    several = rows.join(measured(repeated, 16), "_row", "left_semi").select(rows.columns)
    first = several.groupBy("_row").agg(F.min(F.struct(*(F.col(c) for c in rows.columns if c != "_row"))).alias("first"))
    rest = rows.join(measured(repeated, 16), "_row", "left_anti").select(rows.columns)
    return rest.unionByName(first.select("_row", "first.*"))


@_in_small_batches
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose severity model, trained on the marked ones, does not reject them."""
    return toxicity.accepted(docs, toxicity.fit(docs, training_labels(spark, sf_dir)))


@_in_small_batches
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest row of each group of equal texts."""
    rows = _one_of_equal(_rows(docs))
    found = exact.groups(rows.select(F.when(F.col("doc_id").isNotNull(), F.col("_row")).alias("doc_id"), "text"))
    return _kept(rows, found.filter("doc_id is not null"), F.col("kept")).select(docs.columns)


@_in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates: five words, a similarity of 0.8."""
    rows = _rows(docs)
    return _kept(rows, minhash.near_duplicates(_named(rows), width=5, percent=80), F.col("kept")).select(docs.columns)


@_in_small_batches
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share less than a twentieth of their words with benchmark items."""
    rows = _rows(docs)
    found = decontaminate.contamination(_named(rows), table(spark, sf_dir, "benchmark"))
    return _kept(rows, found, ~F.col("contaminated")).select(docs.columns)


@_in_small_batches
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of the remaining documents."""
    found = bpe.encode(docs, tokenizer_source())
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
