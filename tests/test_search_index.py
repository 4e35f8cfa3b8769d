"""Searches through the index against a full scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from papersheaf.operators import search_index, similarity
from papersheaf.plans import queries
from papersheaf.session import fresh_folder
from tests.test_vectors import frame


def asked_of(spark, x):
    return frame(spark, x).withColumnRenamed("doc_id", "query_id")


def rows_of(found):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.similarity, 9)) for r in found.collect())


def grouped(seed, n, k, d, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, d))
    return centres[rng.integers(0, k, n)] + rng.normal(scale=spread, size=(n, d)), rng


@pytest.mark.parametrize("unit, limit", [(False, 1 << 26), (True, 1 << 26), (True, 3000)])
def test_equals_a_full_scan(spark, unit, limit):
    x, rng = grouped(7, 400, 12, 8, 0.1)
    x[300:330] = x[4]  # ties
    asked = x[::31] + rng.normal(scale=0.05, size=x[::31].shape)
    if unit:
        x, asked = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, asked))
    rows, path = frame(spark, x), fresh_folder(spark, "index")
    cells = search_index.build_index(rows, path)
    found, read = search_index.search_index(asked_of(spark, asked), path, 5, limit)
    want = similarity.find_most_similar(asked_of(spark, asked), rows, 5)
    assert rows_of(found) == rows_of(want)
    total = cells.count()
    share = read.select(F.avg(F.size("cells")) / total).first()[0]
    assert share < 0.5
    assert all(len(r.cells) == len(set(r.cells)) for r in read.collect())


def test_no_groups_at_all(spark):
    """Nothing can be left out here, and nothing may be lost."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(150, 20))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    path = fresh_folder(spark, "index")
    search_index.build_index(frame(spark, x), path, cells=10)
    found, _ = search_index.search_index(asked_of(spark, x[:20]), path, 7)
    assert rows_of(found) == rows_of(similarity.find_most_similar(asked_of(spark, x[:20]), frame(spark, x), 7))


def test_fewer_rows_than_asked_for(spark):
    x, _ = grouped(3, 4, 2, 3, 0.1)
    path = fresh_folder(spark, "index")
    search_index.build_index(frame(spark, x), path)
    found, _ = search_index.search_index(asked_of(spark, x[:2]), path, 9)
    assert rows_of(found) == rows_of(similarity.find_most_similar(asked_of(spark, x[:2]), frame(spark, x), 9))


def test_empty_table(spark):
    path = fresh_folder(spark, "index")
    rows = frame(spark, np.eye(3)).limit(0)
    assert search_index.build_index(rows, path).count() == 0
    found, read = search_index.search_index(asked_of(spark, np.eye(3)), path)
    assert found.count() == 0


def test_benchmark_texts_read_less_than_half(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.embed_letters(queries.texts(spark, sf_dir).select("doc_id", "full_text"), "full_text").select("doc_id", "embedding").persist()
    asked = queries.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("full_text"))
    asked = queries.embed_letters(asked, "full_text").select("query_id", "embedding").persist()
    path = fresh_folder(spark, "index")
    cells = search_index.build_index(rows, path)
    found, read = search_index.search_index(asked, path)
    best = lambda table: sorted((r.query_id, r["rank"], round(r.similarity, 9)) for r in table.collect())
    assert best(found) == best(similarity.find_most_similar(asked, rows))
    assert read.select(F.avg(F.size("cells"))).first()[0] < cells.count() / 2
