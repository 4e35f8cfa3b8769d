import random
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from papersheaf import organize_documents
from papersheaf.operators import embedding, organize
from papersheaf.plans import pipeline, queries
from papersheaf.session import clear_scratch, fresh_folder, materialized, scratch_folder, shared_folder
from papersheaf.sources import cache, reports


def assignments(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, document_name string, cluster_id int")


def inventory(spark, rows):
    return spark.createDataFrame(rows, "path string, length bigint")


def place_one_by_one(rows):
    """Folders filled in order of name and id, each file taking the first free name."""
    taken, result = set(), {}
    for doc_id, folder, name in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        path, counter = PurePosixPath(folder) / name, 1
        original = path
        while str(path) in taken:
            path = original.with_name(f"{original.stem}_{counter}{original.suffix}")
            counter += 1
        taken.add(str(path))
        result[doc_id] = str(path)
    return result


@pytest.mark.parametrize("seed", range(3))
def test_conflicts_match_sequential_placement(spark, seed):
    rng = random.Random(seed)
    names = ["a.pdf", "a_1.pdf", "a_2.pdf", "a_1_1.pdf", "a_1_2.pdf", "a_3_1_1.pdf", "a_01.pdf", "a_0.pdf", "b", "b_1", "a"]
    rows = [(i, f"clusters/c{rng.randrange(2)}", rng.choice(names)) for i in range(150)]
    placed = spark.createDataFrame(rows, "doc_id bigint, cluster_dir string, file_name string").repartition(4)
    got = {r.doc_id: r.destination_path for r in organize.resolve_conflicts(placed).collect()}
    assert len(set(got.values())) == len(rows)
    assert got == place_one_by_one(rows)


def test_names_with_many_numbers_at_the_end(spark):
    """Each name is the parent of the next; the plan does not grow with their number."""
    names = ["a" + "_1" * k + ".pdf" for k in range(13)]
    rows = [(i, "clusters/c0", name) for i, name in enumerate(names * 2)]
    placed = spark.createDataFrame(rows, "doc_id bigint, cluster_dir string, file_name string")
    found = organize.resolve_conflicts(placed)
    assert {r.doc_id: r.destination_path for r in found.collect()} == place_one_by_one(rows)
    two = organize.resolve_conflicts(placed.filter("length(file_name) < 10"))
    scans = [len(table._jdf.queryExecution().optimizedPlan().collectLeaves().toList().mkString("\n").split("\n")) for table in (found, two)]
    assert scans[0] <= scans[1] + 2


def test_one_name_holding_most_rows(spark):
    rows = spark.range(2000).select(
        F.col("id").alias("doc_id"), F.lit("clusters/c").alias("cluster_dir"), F.lit("scan.pdf").alias("file_name")
    )
    got = organize.resolve_conflicts(rows)
    assert got.select("destination_path").distinct().count() == 2000
    assert got.filter("doc_id = 1999").first().destination_path == "clusters/c/scan_1999.pdf"


def test_sources(spark):
    files = inventory(spark, [("/in/a.pdf", 1), ("/in/x/b.pdf", 2), ("/in/y/b.pdf", 3), ("/else/c.pdf", 4), ("/in/y/d.pdf", 5)])
    rows = assignments(spark, [(1, "a.pdf", 0), (2, "b.pdf", 0), (3, "/else/c.pdf", 0), (4, "y/d.pdf", 0), (5, "no.pdf", 0)])
    got = {r.doc_id: (r.source_path, r.length) for r in organize.resolve_sources(rows, files, "/in").collect()}
    assert got == {1: ("/in/a.pdf", 1), 2: ("/in/x/b.pdf", 2), 3: ("/else/c.pdf", 4), 4: ("/in/y/d.pdf", 5), 5: (None, None)}


def test_manifest_and_summary(spark):
    files = inventory(spark, [("/in/a.pdf", 1048576), ("/in/x/b.pdf", 10486)])
    rows = assignments(spark, [(1, "a.pdf", 0), (2, "b.pdf", 1), (3, "gone.pdf", 1), (4, "a.pdf", 0)])
    names = spark.createDataFrame([(0, "My: topic")], "cluster_id int, name string")
    manifest = organize.placement_manifest(rows, files, names, "/in", "/out")
    got = {r.doc_id: r for r in manifest.collect()}
    assert got[1].destination_path == "/out/clusters/cluster_0_My_ topic/a.pdf"
    assert got[4].destination_path == "/out/clusters/cluster_0_My_ topic/a_1.pdf"
    assert got[2].destination_path == "/out/clusters/cluster_1/b.pdf"
    assert (got[1].file_size_mb, got[2].file_size_mb) == (1.0, 0.01)
    assert not got[3].success and got[3].error == "Source file not found: gone.pdf"
    assert organize.organize_summary(manifest).first() == (4, 3, 1, 75.0)
    assert organize.organize_summary(manifest.limit(0)).first() == (0, 0, 0, 0.0)


def test_report_lists_ten_files_and_counts_the_rest(spark):
    rows = assignments(spark, [(i, f"f{i:02}.pdf", 0) for i in range(13)] + [(99, "gone.pdf", 1)])
    files = inventory(spark, [(f"/in/f{i:02}.pdf", 10) for i in range(13)])
    manifest = organize.placement_manifest(rows, files, directory="/in")
    lines = [r.line for r in organize.readable_report(rows, manifest, None, "/out", "now").collect()]
    assert lines[lines.index("Cluster 0") :] == [
        "Cluster 0", "   Size: 13 (92.9%)", "   Members:", *[f"     - f{i:02}.pdf" for i in range(10)],
        "     and 3 others", "Cluster 1", "   Size: 1 (7.1%)", "   Members:", "     - gone.pdf",
        "Files not placed (1)", "-" * 25, "   - gone.pdf: Source file not found: gone.pdf",
    ]


def test_tables_match_on_identity(spark):
    records = spark.createDataFrame(
        [(1, "a.pdf", 1, 10, True), (2, "a.pdf", 0, 0, False), (3, "c.pdf", 2, 5, True)],
        "doc_id bigint, filename string, page_count int, word_count int, success boolean",
    )
    rows = assignments(spark, [(1, "a.pdf", 7), (3, "c.pdf", 8)])
    names = spark.createDataFrame([(7, "Seven")], "cluster_id int, name string")
    got = {tuple(r) for r in organize.document_table(records, rows, names).collect()}
    assert got == {
        ("a.pdf", "Seven", 1, 10, "Success"),
        ("a.pdf", None, 0, 0, "Failed"),
        ("c.pdf", "Cluster_8", 2, 5, "Success"),
    }
    lines = [r.line for r in organize.listing_summary(rows, names).collect()]
    assert lines[3:5] == ["Documents: 2", "Clusters: 2"]
    assert lines[8:] == ["Seven", "-" * 40, "  • a.pdf", "Cluster 8", "-" * 40, "  • c.pdf"]
    summary = rows.withColumn("intra_cluster_similarity", F.lit(0.5))
    stats = organize.cluster_statistics(summary, names).orderBy("cluster_id").collect()
    assert [(r.name, r.file_count, r.percentage, r.avg_cluster_similarity) for r in stats] == [
        ("Seven", 1, 50.0, 0.5),
        ("Cluster 8", 1, 50.0, 0.5),
    ]


def test_organize_documents_writes_folders_and_reports(spark):
    rows = assignments(spark, [(1, "red_cat.pdf", 0), (2, "red_dog.pdf", 0), (3, "gone.pdf", 1)])
    files = inventory(spark, [("/in/red_cat.pdf", 3), ("/in/red_dog.pdf", 3)])
    contents = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id bigint, text string")
    base = fresh_folder(spark, "organized")
    done = organize_documents(rows, base, files, "/in", contents=contents)
    assert done.summary().first().successful_operations == 2
    assert dict(done.cluster_names.collect()) == {0: "red_2files", 1: "group_1_1files"}
    written = spark.read.parquet(done.report_paths["clusters"])
    assert {(r.cluster_dir, r.file_name, r.text) for r in written.collect()} == {
        ("cluster_0_red_2files", "red_cat.pdf", "one"),
        ("cluster_0_red_2files", "red_dog.pdf", "two"),
    }
    assert "/organized_2" in done.report_paths["text"]
    text = [r.value for r in spark.read.text(done.report_paths["text"]).collect()]
    assert "Not placed: 1" in text and text[0] == "Report on the sorted documents"
    table = spark.read.option("header", True).csv(done.report_paths["breakdown"])
    assert table.count() == 3 and table.columns == ["doc_id", "document_name", "cluster_id"]
    metadata = spark.read.json(done.report_paths["metadata"]).first()
    assert (metadata.total_files_processed, metadata.operation_type) == (3, "copy")
    assert reports.run_folder("/x/", with_timestamp=False) == "/x"


def test_cache_embeds_each_missing_text_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def model():
        def predict(batch):
            import numpy as np

            calls.add(len(batch))
            return np.array([[float(len(t)), 1.0] for t in batch], dtype="float32")

        return predict

    def embed(rows, column):
        return embedding.embed_with_model(rows, model, column, normalize=False)

    path = fresh_folder(spark, "cache")
    first = spark.createDataFrame([(1, "aa"), (2, "bbb"), (3, "aa")], "doc_id bigint, full_text string")
    got = cache.incremental_embed(first, embed, path, "m")
    assert {(r.doc_id, r.embedding[0]) for r in got.collect()} == {(1, 2.0), (2, 3.0), (3, 2.0)}
    assert calls.value == 2
    more = first.unionByName(spark.createDataFrame([(4, "c")], first.schema))
    assert cache.incremental_embed(more, embed, path, "m").count() == 4
    assert calls.value == 3
    assert cache.incremental_embed(first, embed, path, "other model").count() == 3
    assert calls.value == 5


def test_overlapping_runs_leave_each_key_once(spark):
    path = fresh_folder(spark, "cache")
    rows = spark.createDataFrame([(1, "aa"), (2, "bbb"), (3, "aa")], "doc_id bigint, full_text string")
    more = rows.unionByName(spark.createDataFrame([(4, "c")], rows.schema))

    def embed(found, column):
        return found.withColumn("embedding", F.array(F.length(column).cast("float")))

    def overtaken(found, column):
        assert cache.incremental_embed(rows, embed, path, "m").count() == 3  # commits while the outer run is at work
        return embed(found, column)

    got = cache.incremental_embed(more, overtaken, path, "m")
    assert sorted((r.doc_id, r.embedding[0]) for r in got.collect()) == [(1, 2.0), (2, 3.0), (3, 2.0), (4, 1.0)]
    cached = cache.read_cache(spark, path, "m")
    assert cached.count() == cached.select("cache_key").distinct().count() == 3
    version, tables = cache.latest_manifest(spark, path)
    assert version == len(tables) == 2

    # two writers that have read the same manifest: the later one leaves out what the earlier one has brought
    vectors = materialized(spark.createDataFrame([("x", [1.0]), ("y", [2.0])], cache.CACHE))
    cache.commit(spark, path, vectors, "m", version)
    after = cache.commit(spark, path, vectors, "m", version)
    assert after.count() == 5 and cache.latest_manifest(spark, path)[0] == 4
    assert cache.read_cache(spark, path, "m2").count() == 0

    # a name that is taken is not taken over
    cache._written(spark, f"{path}/manifests/draft", "[]")
    assert not cache._renamed(spark, f"{path}/manifests/draft", f"{path}/manifests/4.json")


def test_unwritable_cache_only_warns(spark, tmp_path):
    (tmp_path / "file").write_text("x")  # no folder can be made below a file

    def embed(rows, column):
        return rows.withColumn("embedding", F.array(F.length(column).cast("float")))

    rows = spark.createDataFrame([(1, "aa"), (2, "bbb")], "doc_id bigint, full_text string")
    with pytest.warns(UserWarning, match="not written"):
        got = cache.incremental_embed(rows, embed, str(tmp_path / "file" / "cache"), "m")
    assert {(r.doc_id, r.embedding[0]) for r in got.collect()} == {(1, 2.0), (2, 3.0)}


def test_texts_to_clusters(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    done = pipeline.cluster_texts(rows, 3, dimensions=64)
    assert done.points.count() == rows.count()
    assert done.points.select("cluster_id").distinct().count() == 3


def test_scratch_lies_in_the_shared_folder(spark):
    assert scratch_folder(spark).startswith(shared_folder(spark))
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_folder(spark) == configured.rstrip("/")


def test_scratch_can_be_cleared(spark):
    kept = materialized(spark.range(3))
    assert kept.count() == 3
    clear_scratch(spark)
    with pytest.raises(Exception, match="does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(kept.inputFiles()[0])


def test_rows_of_tables_in_parts(spark, tmp_path):
    for name in queries.SCANNED:
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        rows = rows.limit(0) if name == "benchmark" else rows
        rows.repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r.filename: r.n_rows for r in queries.scanned_rows(spark, str(tmp_path)).collect()}
    want = {f"{name}.parquet": spark.read.parquet(str(tmp_path / f"{name}.parquet")).count() for name in queries.SCANNED}
    assert got == want and got["benchmark.parquet"] == 0
