"""The Bloom filter cascade and the host rules."""

import pytest
from pyspark.sql import functions as F

from papersheaf.llm import queries, urls


@pytest.mark.parametrize("limit", [32 * 1024 * 1024, 300])
def test_cascade_is_exact_for_the_universe(spark, limit):
    universe = spark.range(6000).select(F.concat(F.lit("h"), "id").alias("key"))
    listed = universe.filter("xxhash64(key) % 9 = 0")
    cascades = urls.build(listed, universe, limit_bytes=limit)
    assert (len(cascades) > 1) == (limit == 300)
    assert any(len(c.levels) > 1 for c in cascades)
    judged = urls.contains(universe.withColumn("word", F.lit(1)), F.col("key"), cascades)
    assert judged.columns == ["key", "word", "listed"]
    assert judged.count() == 6000
    assert judged.filter("listed").select("key").exceptAll(listed).isEmpty()
    assert judged.filter("listed").count() == listed.count()


def test_nothing_listed_and_nothing_known(spark):
    universe = spark.createDataFrame([("a",), (None,)], "key string")
    none = universe.filter("false")
    assert [r.listed for r in urls.contains(universe, F.col("key"), urls.build(none, universe)).collect()] == [False, False]
    assert urls.contains(none, F.col("key"), urls.build(universe, universe)).count() == 0
    assert {r.key: r.listed for r in urls.contains(universe, F.col("key"), urls.build(universe, universe)).collect()}["a"]


CASES = [
    ("http://WWW.Example.com/en/x?y", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
    ("http://a.example.com/de/#z", "a.example.com", "/de/", "com/", "allow"),
    ("x://example.com", "example.com", "", None, "allow"),
    ("x://notnet/es/", "notnet", "/es/", None, "allow"),
    ("x://b.net/es/1://c", "b.net", "/es/1://c", "net/es/", "block"),
    ("x://casino-win.org/en/", "casino-win.org", "/en/", None, "block"),
    ("x://casinos.org?q=/en/", "casinos.org", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def test_urls_are_split_and_judged(spark, tmp_path):
    rows = [(k, case[0], "x") for k, case in enumerate(CASES)]
    rows += [(None, CASES[0][0], None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: tuple(r)[1:] for r in queries.op1_urls(spark, str(tmp_path)).collect()}
    assert [got[k] for k in range(len(CASES))] == [case[1:] for case in CASES]
    assert got[None] == CASES[0][1:]


def test_shards_give_one_answer_and_leave_the_driver_alone(spark, monkeypatch):
    """From 1 to many forced shards: equal rows, and nothing is loaded to the driver beyond one shard."""
    universe = spark.range(5000).select(F.concat(F.lit("h"), "id").alias("key"))
    listed = universe.filter("xxhash64(key) % 7 = 0")
    rows = universe.selectExpr("key", "1 AS _key", "2 AS first", "3 AS second", "4 AS shard", "5 AS level", "6 AS salt", "'x' AS row", "'y' AS listed")
    hot = spark.range(4000).selectExpr("'h3' AS key").join(rows, "key")
    one = urls.contains(rows.union(hot), F.col("key"), urls.build(listed, universe))
    loaded, load = [], urls._loaded
    monkeypatch.setattr(urls, "_loaded", lambda levels: loaded.append(1) or load(levels))
    cascades = urls.build(listed, universe, limit_bytes=80)
    many = urls.contains(rows.union(hot), F.col("key"), cascades)
    assert len(cascades) >= 13 and not loaded
    assert many.columns == one.columns == [c for c in rows.columns if c != "listed"] + ["listed"]
    assert many.count() == 9000 and one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()
    assert many.filter("listed").select("key").distinct().count() == listed.count()
    sizes = [8 * sum(len(level.words) for level in cascade.levels) for cascade in cascades]
    assert max(sizes) <= 3 * 80 and sum(sizes) <= 1.5 * urls.expected_bytes(listed.count(), 5000 - listed.count()) + 24 * len(sizes)


def test_the_expected_size_holds_all_levels(spark):
    universe = spark.range(200000).select(F.concat(F.lit("h"), "id").alias("key"))
    listed = universe.filter("xxhash64(key) % 50 = 0")
    cascade = next(iter(urls.build(listed, universe)))
    size = 8 * sum(len(level.words) for level in cascade.levels)
    assert 0.9 < size / urls.expected_bytes(listed.count(), 200000 - listed.count()) < 1.1
