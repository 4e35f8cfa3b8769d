"""The registered queries against SQL and the pipeline against plain code."""

import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
import corpus_pipeline
from papersheaf.llm import queries, toxicity
from tests.llm.helpers import documents
from tests.llm.test_decontaminate import plain as scan
from tests.llm.test_exact import plain as equal
from tests.llm.test_near import plain as near

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    database = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert check.compare(got, database.execute(queries.ORACLES[name]).df()) == "ok"


def test_everything_is_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES)
    assert numbers == list(range(1, 11))
    assert {"pipeline", *queries.QUERIES} <= set(entry.queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]


def test_pipeline_equals_plain_code(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(table, queries.training_labels(spark, SF))
    toxic = {r.doc_id for r in toxicity.score(table, model).filter("toxic").collect()}
    rows = [(r.doc_id, r.text) for r in table.collect() if r.doc_id not in toxic]
    kept = {r[0] for r in equal(rows) if r[3]}
    rows = [r for r in rows if r[0] in kept]
    kept = {i for i, (_, label) in near(rows, 5, 80).items() if i == label}
    rows = [r for r in rows if r[0] in kept]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r[0] for r in scan(rows, items, 13) if not r[5]}
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows if i in kept)
    assert all(len(r.ids) == 4 * r.n_tokens for r in got)


def test_stages_take_odd_rows(spark):
    docs = documents(spark, [(None, "a b c d e f"), (1, None), (1, None), (2, ""), (3, "a b c d e f"), (4, "a b c d e f")])
    docs = docs.withColumn("extra", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.filter("false"), SF).count() == 0
    left = {r.doc_id for r in corpus_pipeline.exact_dedup(spark, docs, SF).collect()}
    assert left == {None, 1, 3}


def test_stages_decide_by_row(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 200").orderBy("item_id").first().text
    plain = " ".join(f"p{k}" for k in range(60))
    near = plain + " more"
    other = " ".join(f"o{k}" for k in range(60))
    rows = [(1, other), (1, item), (None, item), (2, plain), (2, plain), (2, near), (None, near), (3, plain), (3, "its own text")]
    docs = documents(spark, rows)

    def left(stage, docs):
        return sorted(((r.doc_id, r.text) for r in stage(spark, docs, SF).collect()), key=str)

    want = [r for r in rows if r[1] != item]
    assert left(corpus_pipeline.decontaminated, docs) == sorted(want, key=str)
    got = left(corpus_pipeline.exact_dedup, docs.repartition(5))
    assert sum(t == plain for _, t in got) == 1 and {(3, "its own text"), (1, other), (1, item)} <= set(got)
    assert len(set(got)) == len(got)
    got = left(corpus_pipeline.near_dedup, documents(spark, list(dict.fromkeys(rows))))
    assert sum(t in (plain, near) for _, t in got) == 1 and {(1, other), (1, item), (3, "its own text")} <= set(got)
    assert sum(t == item for _, t in got) == 1


def test_stages_bound_the_batches_of_workers(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 100_000).alias("text")).coalesce(1)
    before = spark.conf.get(corpus_pipeline.BATCH_LIMIT, None)
    try:
        spark.conf.unset(corpus_pipeline.BATCH_LIMIT)
        corpus_pipeline.encoded(spark, docs, SF)
        assert docs.mapInArrow(sizes, "n bigint").agg(F.max("n")).first()[0] < 2 * corpus_pipeline.BATCH_BYTES
        spark.conf.set(corpus_pipeline.BATCH_LIMIT, "1m")
        corpus_pipeline.encoded(spark, docs, SF)
        assert spark.conf.get(corpus_pipeline.BATCH_LIMIT) == "1m"
    finally:
        spark.conf.unset(corpus_pipeline.BATCH_LIMIT)
        if before is not None:
            spark.conf.set(corpus_pipeline.BATCH_LIMIT, before)
