"""Exact duplicates by combining equal texts in three skew-safe steps.

Texts are equal when they are identical without white space. Rows of equal text are combined inside their task, then in
salted groups, then over the salts. The whole text is part of the grouping key at every step, so a digest never decides
alone. A text shared by a third of all rows reaches a salted group as one row per task, and the last step as one row per
salt. The winner of a group is one decimal number (length, then smaller id), so the steps are plain hash aggregates.

Defined results: null text counts as empty; all texts of white space alone are equal to it. Of rows with the same text, length
and ``doc_id``, all are kept. A row without ``doc_id`` stays only if it is the longest, after any row with an id of that length;
``keep_id`` is then null. Other columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE_SPACE = " \t\n\x0b\f\r"
SALTS = 32
IDS = Decimal(10**20)  # above the number of 64-bit ids
TOP = Decimal(2**63)


def without_space(text: Column) -> Column:
    return reduce(lambda left, char: F.replace(left, F.lit(char)), WHITE_SPACE, text)


def _rank(doc_id: Column, text: Column) -> Column:
    """Larger for longer texts, then for smaller ids; an id of null comes last."""
    order = F.coalesce(F.lit(TOP) - doc_id.cast("decimal(20,0)"), F.lit(0))
    return (F.char_length(text).cast("decimal(10,0)") * F.lit(IDS) + order).cast("decimal(38,0)")


def groups(documents: DataFrame, salts: int = SALTS, digest_digits: int = 64) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per row of ``documents``.

    ``digest_digits`` shortens the digest that rows are grouped by, to test that colliding digests do no harm.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("plain", without_space(F.col("text")))
    rows = rows.withColumn("text_sha256", F.sha2("plain", 256))
    key = [F.substring("text_sha256", 1, digest_digits).alias("digest"), "text_sha256"]
    # names a text in the final join: beside the digest a second hash and the size
    key += [F.xxhash64("plain").alias("second"), F.octet_length("plain").alias("bytes")]

    ranked = rows.select(
        F.col("plain"),
        *key,
        _rank(F.col("doc_id"), F.col("text")).alias("rank"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"),
    )
    salted = ranked.groupBy("digest", "salt", "plain").agg(
        F.max("rank").alias("rank"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("second", "bytes"))
    )
    whole = salted.groupBy("digest", "plain").agg(
        F.max("rank").alias("rank"), F.sum("n").alias("group_size"), *(F.first(c).alias(c) for c in ("second", "bytes"))
    )
    order = F.col("rank") % F.lit(IDS)
    keep_id = F.when(order > 0, (F.lit(TOP) - order).cast("bigint"))
    winners = whole.select("digest", "second", "bytes", keep_id.alias("keep_id"), "group_size")
    return (
        rows.select("doc_id", *key)
        .join(winners, ["digest", "second", "bytes"])
        .select(
            "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
        )
    )
