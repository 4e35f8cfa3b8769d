"""Held-out accuracy of the trained models, and their odd rows."""

import pytest

from papersheaf.llm import linear, quality, toxicity
from papersheaf.llm.queries import QUERIES
from tests.llm.helpers import clashing, documents

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def held_out(spark, rows, mark):
    labels = {r.doc_id: r[mark] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return [(r, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]


def test_quality_of_unseen_documents(spark):
    rows = QUERIES["op2_quality"](spark, SF).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    known = held_out(spark, rows, "quality")
    assert sum(r.predicted == mark for r, mark in known) >= 0.97 * len(known)


def test_toxicity_of_unseen_documents(spark):
    rows = QUERIES["op10_toxicity"](spark, SF).collect()
    known = held_out(spark, rows, "toxic")
    clean, toxic = ([r for r, mark in known if mark == m] for m in (0, 1))
    assert sum(r.toxic for r in clean) <= 0.01 * len(clean)
    assert sum(r.toxic for r in toxic) >= 0.75 * len(toxic)
    assert all(0 <= r.severity <= 3 and 0 <= r.grade <= 3 and r.toxic == (r.score >= 0.5) for r in rows)
    mean = lambda rows: sum(r.severity for r in rows) / len(rows)
    assert mean(toxic) > mean(clean) + 1


@pytest.mark.parametrize("model", [quality, toxicity])
def test_odd_rows(spark, model):
    rows = [(None, "good words here"), (1, None), (1, ""), (2, "bad bad"), (2, "bad bad"), (3, "x " * 50_000), (4, "good words")]
    table = clashing(documents(spark, rows))
    labels = [(4, 1, 0), (2, 0, 1), (2, None, None), (None, 1, 0), (9, 1, 0), (1, 1, 0), (2, 0, 0)]
    labels = spark.createDataFrame(labels, LABELS)
    fitted = model.fit(table, labels)
    got = model.score(table, fitted).collect()
    assert len(got) == len(rows) and sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and len({r.score for r in got if r.doc_id == 2}) == 1
    assert model.score(documents(spark, []), fitted).count() == 0
    none = model.fit(table, labels.filter("false"))
    assert len(none) == 0 and len({round(r.score, 6) for r in model.score(table, none).collect()}) == 1
    if model is toxicity:
        kept = toxicity.accepted(table, fitted)
        assert kept.columns == table.columns
        assert kept.count() == sum(not r.toxic for r in got)


def test_sample_is_bounded(spark):
    table = documents(spark, [(k, "a") for k in range(2000)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(2000)], LABELS)
    assert linear.sample(table, labels, "quality", 5000).count() == 2000
    assert 150 < linear.sample(table, labels, "quality", 200).count() < 260


def test_sample_takes_all_of_many_labels(spark):
    table = spark.range(30_000).selectExpr("id AS doc_id", "'a' AS text")
    labels = spark.range(30_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality", "0 AS toxic")
    assert linear.sample(table, labels, "quality").count() == 30_000
