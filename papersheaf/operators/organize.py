"""The placement manifest, its statistics and the report tables.

Lists of documents are kept as rows, never as one array per cluster: a cluster may hold most of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersheaf.functions import names, ranking
from papersheaf.operators.metrics import cluster_sizes
from papersheaf.session import materialized

REPORT_FILES = 10


def _with_names(rows: DataFrame, cluster_names: DataFrame | None) -> DataFrame:
    if cluster_names is None:
        return rows.withColumn("name", F.lit(None).cast("string"))
    return rows.join(cluster_names.select("cluster_id", "name"), "cluster_id", "left")


def _label(prefix: str) -> Column:
    return F.coalesce("name", F.concat(F.lit(prefix), F.col("cluster_id").cast("string")))


def cluster_directories(
    assignments: DataFrame, cluster_names: DataFrame | None = None, output_dir: str | None = None
) -> DataFrame:
    """``(cluster_id, cluster_dir)``: ``clusters/cluster_id[_name]``, made safe for file systems."""
    clusters = _with_names(assignments.select("cluster_id").distinct(), cluster_names)
    folder = names.sanitize_name(F.concat_ws("_", F.lit("cluster"), F.col("cluster_id").cast("string"), "name"))
    root = "clusters/" if output_dir is None else f"{output_dir.rstrip('/')}/clusters/"
    return clusters.select("cluster_id", F.concat(F.lit(root), folder).alias("cluster_dir"))


def resolve_sources(assignments: DataFrame, inventory: DataFrame, directory: str = "") -> DataFrame:
    """Add ``source_path`` and ``length``: exact path below the directory, else same base name, else the literal path.

    ``inventory`` has unique ``path`` and ``length``. Of several files with one base name the smallest
    path is taken. Each lookup is an equality join against unique keys, so a name shared by many
    documents can be split by adaptive execution.
    """
    root = directory.rstrip("/")
    prefix = F.concat(F.lit(root + "/"), F.col("document_name")) if root else F.col("document_name")
    files = inventory.select("path", "length")
    by_name = files.groupBy(names.basename(F.col("path")).alias("_base")).agg(
        F.min(F.struct("path", "length")).alias("_named")
    )

    def known(alias: str) -> DataFrame:
        return files.select(F.col("path").alias(f"{alias}_path"), F.col("length").alias(f"{alias}_length"))

    found = assignments.join(known("_exact"), F.col("_exact_path") == prefix, "left").join(
        by_name, F.col("_base") == F.col("document_name"), "left"
    )
    path, length = [F.col("_exact_path"), F.col("_named.path")], [F.col("_exact_length"), F.col("_named.length")]
    if root:
        found = found.join(known("_literal"), F.col("_literal_path") == F.col("document_name"), "left")
        path.append(F.col("_literal_path"))
        length.append(F.col("_literal_length"))
    return found.select(
        *[F.col(c) for c in assignments.columns],
        F.coalesce(*path).alias("source_path"),
        F.coalesce(*length).alias("length"),
    )


def resolve_conflicts(placed: DataFrame) -> DataFrame:
    """Add ``destination_path``, unique within each folder, for ``doc_id, cluster_dir, file_name``.

    Files are placed in order of name, then ``doc_id``. The first of a name keeps it and later ones
    become ``stem_1``, ``stem_2`` and so on, unless that name is taken. A name ``stem_j`` can only be
    taken by the files called ``stem``, which come first, so it is decided from the number of files per
    name: level by level for names like ``a_1_2``, without visiting the files one by one.
    """
    keys = ["cluster_dir", "file_name"]
    ending = r"^(.+)_([1-9][0-9]*)$"
    stem, suffix = names.stem(F.col("file_name")), names.extension(F.col("file_name"))
    groups = (
        placed.groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .withColumn("_parent", F.concat(F.regexp_extract(stem, ending, 1), suffix))
        .withColumn("_index", F.regexp_extract(stem, ending, 2).try_cast("bigint"))
        .withColumn("taken", F.lit(0))
    )
    groups = materialized(groups)
    # names whose parent is a name too; the number of ``taken`` is right for those without one from the start
    names_only = groups.select("cluster_dir", F.col("file_name").alias("_parent"))
    open_names = materialized(groups.join(names_only, ["cluster_dir", "_parent"], "left_semi"))
    known = groups.select(*keys, "n", "taken")
    while not open_names.isEmpty():
        reach = known.select("cluster_dir", F.col("file_name").alias("_parent"), (F.col("n") - 1 + F.col("taken")).alias("_reach"))
        found = open_names.join(reach, ["cluster_dir", "_parent"])
        found = found.select(*keys, "n", (F.col("_reach") >= F.col("_index")).cast("int").alias("now"), "taken")
        changed = materialized(found.filter("now <> taken").select(*keys, F.col("now")))
        if changed.isEmpty():
            break
        known = materialized(known.join(changed, keys, "left").select(*keys, "n", F.coalesce("now", "taken").alias("taken")))
        open_names = materialized(open_names.drop("taken").join(known.select(*keys, "taken"), keys))
    start = known.select(*keys, (F.col("taken") - 1).alias("start"))
    ranked = ranking.rank_within(placed, keys, "doc_id", "_index", start)
    index = F.col("_index")
    renamed = F.when(index == 0, F.col("file_name")).otherwise(
        F.concat(stem, F.lit("_"), index.cast("string"), suffix)
    )
    return ranked.withColumn("destination_path", F.concat_ws("/", "cluster_dir", renamed)).drop("_index")


def placement_manifest(
    assignments: DataFrame,
    inventory: DataFrame,
    cluster_names: DataFrame | None = None,
    directory: str = "",
    output_dir: str | None = None,
) -> DataFrame:
    """One row per document: where it comes from, where it goes, or why it cannot be placed."""
    folders = cluster_directories(assignments, cluster_names, output_dir)
    rows = resolve_sources(assignments.select("doc_id", "document_name", "cluster_id"), inventory, directory)
    found = rows.filter(F.col("source_path").isNotNull()).join(folders, "cluster_id")
    placed = resolve_conflicts(found.withColumn("file_name", names.basename(F.col("source_path"))))
    missing = rows.filter(F.col("source_path").isNull())
    good = placed.select(
        "doc_id",
        "document_name",
        "cluster_id",
        F.lit(True).alias("success"),
        F.lit("copied").alias("operation"),
        "source_path",
        "destination_path",
        names.megabytes(F.col("length")).alias("file_size_mb"),
        F.lit(None).cast("string").alias("error"),
    )
    failed = missing.select(
        "doc_id",
        "document_name",
        "cluster_id",
        F.lit(False).alias("success"),
        F.lit(None).cast("string").alias("operation"),
        F.lit(None).cast("string").alias("source_path"),
        F.lit(None).cast("string").alias("destination_path"),
        F.lit(None).cast("double").alias("file_size_mb"),
        F.concat(F.lit("Source file not found: "), "document_name").alias("error"),
    )
    return good.unionByName(failed)


def organize_summary(manifest: DataFrame) -> DataFrame:
    """One row: files processed, successes, failures and the success rate in percent."""
    counted = manifest.agg(
        F.count("*").alias("total_files_processed"),
        F.count_if("success").alias("successful_operations"),
        F.count_if(~F.col("success")).alias("failed_operations"),
    )
    rate = F.try_divide(F.col("successful_operations"), F.col("total_files_processed")) * 100
    return counted.withColumn("success_rate", F.coalesce(rate, F.lit(0.0)))


def cluster_statistics(assignments: DataFrame, cluster_names: DataFrame | None = None) -> DataFrame:
    """Per cluster: name, file count, percentage and, where the summary has it, its inner similarity."""
    stats = cluster_sizes(assignments).withColumnRenamed("size", "file_count")
    if "intra_cluster_similarity" in assignments.columns:
        similarity = assignments.groupBy("cluster_id").agg(
            F.any_value("intra_cluster_similarity").alias("avg_cluster_similarity")
        )
        stats = stats.join(similarity, "cluster_id", "left")
    return _with_names(stats, cluster_names).withColumn("name", _label("Cluster "))


def cluster_files(assignments: DataFrame, cluster_names: DataFrame | None = None) -> DataFrame:
    """The files of each cluster, one row per file, with the statistics of the cluster."""
    return assignments.select("cluster_id", "document_name").join(
        cluster_statistics(assignments, cluster_names), "cluster_id"
    )


def readable_report(
    assignments: DataFrame,
    manifest: DataFrame,
    cluster_names: DataFrame | None = None,
    output_dir: str = "",
    timestamp: str = "",
    operation: str = "Copy",
) -> DataFrame:
    """The text report as ordered lines: ``(section, cluster_id, part, item, line)``.

    Sections are 0 heading and totals, 1 clusters with their first ten documents, 2 failures. Only the
    first ten documents of a cluster are ranked; the rest is counted.
    """
    order = ["section", "cluster_id", "part", "item"]

    def line(rows: DataFrame, section: int, part: Column | int, item: Column | str, text: Column) -> DataFrame:
        return rows.select(
            F.lit(section).alias("section"),
            (F.col("cluster_id") if section == 1 else F.lit(0)).cast("int").alias("cluster_id"),
            (part if isinstance(part, Column) else F.lit(part)).cast("int").alias("part"),
            (item if isinstance(item, Column) else F.lit(item)).alias("item"),
            text.alias("line"),
        )

    totals = organize_summary(manifest)
    heading = [
        F.lit("Report on the sorted documents"),
        F.lit("=" * 50),
        F.lit(f"Written: {timestamp}"),
        F.lit(f"Folder: {output_dir}"),
        F.lit(f"Placed by: {operation}"),
        F.lit("All files"),
        F.lit("-" * 25),
        F.format_string("Files: %d", "total_files_processed"),
        F.format_string("Placed: %d", "successful_operations"),
        F.format_string("Not placed: %d", "failed_operations"),
        F.format_string("Share placed: %.1f%%", "success_rate"),
        F.lit("Clusters"),
        F.lit("-" * 25),
    ]
    head = totals.select(F.posexplode(F.array(*heading)).alias("part", "text"))
    stats = cluster_statistics(assignments.select("cluster_id", "document_name"), cluster_names)
    first = ranking.top_per_key(
        assignments.select("cluster_id", "doc_id", "document_name"),
        ["cluster_id"],
        [F.asc("document_name"), F.asc("doc_id")],
        REPORT_FILES,
    )
    failed = manifest.filter(~F.col("success"))
    failures = F.col("failed_operations")
    parts = [
        line(head, 0, F.col("part"), "", F.col("text")),
        line(stats, 1, 0, "", F.col("name")),
        line(stats, 1, 1, "", F.format_string("   Size: %d (%.1f%%)", "file_count", "percentage")),
        line(stats, 1, 2, "", F.lit("   Members:")),
        line(first, 1, 2 + F.col("rank"), "", F.concat(F.lit("     - "), "document_name")),
        line(
            stats.filter(F.col("file_count") > REPORT_FILES),
            1,
            3 + REPORT_FILES,
            "",
            F.format_string("     and %d others", F.col("file_count") - REPORT_FILES),
        ),
        line(totals.filter(failures > 0), 2, 0, "", F.format_string("Files not placed (%d)", failures)),
        line(totals.filter(failures > 0), 2, 1, "", F.lit("-" * 25)),
        line(
            failed,
            2,
            2,
            F.concat_ws(" ", "document_name", F.col("doc_id").cast("string")),
            F.concat(F.lit("   - "), "document_name", F.lit(": "), "error"),
        ),
    ]
    report = parts[0]
    for rows in parts[1:]:
        report = report.unionByName(rows)
    return report.orderBy(*order)


def breakdown_table(assignments: DataFrame, cluster_names: DataFrame | None = None) -> DataFrame:
    """``(cluster_id, line)`` with ``name: count files (pct%)`` for the console."""
    return cluster_statistics(assignments, cluster_names).select(
        "cluster_id", F.format_string("%s: %d files (%.1f%%)", "name", "file_count", "percentage").alias("line")
    )


def document_table(documents: DataFrame, assignments: DataFrame, cluster_names: DataFrame | None = None) -> DataFrame:
    """Document, cluster name, pages, words and status, matched on ``doc_id``.

    A document without a vector has no cluster and no cluster name.
    """
    rows = documents.join(assignments.select("doc_id", "cluster_id"), "doc_id", "left")
    return _with_names(rows, cluster_names).select(
        F.col("filename").alias("document"),
        F.when(F.col("cluster_id").isNotNull(), _label("Cluster_")).alias("cluster"),
        F.col("page_count").alias("pages"),
        F.col("word_count").alias("words"),
        F.when(F.col("success"), "Success").otherwise("Failed").alias("status"),
    )


def cluster_listing(assignments: DataFrame, cluster_names: DataFrame | None = None) -> DataFrame:
    """``(cluster_id, cluster, document_name)``, one row per document."""
    return _with_names(assignments.select("cluster_id", "document_name"), cluster_names).select(
        "cluster_id", _label("Cluster_").alias("cluster"), "document_name"
    )


def listing_summary(assignments: DataFrame, cluster_names: DataFrame | None = None) -> DataFrame:
    """Totals and the documents of every cluster as ordered text lines, sorted across partitions."""
    clusters = _with_names(assignments.select("cluster_id").distinct(), cluster_names)
    totals = assignments.agg(
        F.count("*").alias("documents"), F.count_distinct("cluster_id").alias("clusters")
    )
    bar = "=" * 60
    heading = [
        F.lit(bar),
        F.lit("Documents by cluster"),
        F.lit(bar),
        F.format_string("Documents: %d", "documents"),
        F.format_string("Clusters: %d", "clusters"),
        F.lit(bar),
        F.lit("Listing"),
        F.lit(bar),
    ]
    empty = F.lit(0).cast("int")
    head = totals.select(F.posexplode(F.array(*heading)).alias("part", "line")).select(
        F.lit(0).alias("section"), empty.alias("cluster_id"), "part", F.lit("").alias("item"), "line"
    )
    titles = clusters.select(
        F.lit(1).alias("section"),
        "cluster_id",
        F.posexplode(F.array(_label("Cluster "), F.lit("-" * 40))).alias("part", "line"),
    ).select("section", "cluster_id", "part", F.lit("").alias("item"), "line")
    listed = assignments.select(
        F.lit(1).alias("section"),
        "cluster_id",
        F.lit(2).alias("part"),
        F.concat_ws(" ", "document_name", F.col("doc_id").cast("string")).alias("item"),
        F.concat(F.lit("  • "), "document_name").alias("line"),
    )
    return head.unionByName(titles).unionByName(listed).orderBy("section", "cluster_id", "part", "item")


def archive_paths(assignments: DataFrame, cluster_names: DataFrame | None = None) -> DataFrame:
    """``(doc_id, archive_path)`` for a download archive."""
    return _with_names(assignments.select("doc_id", "document_name", "cluster_id"), cluster_names).select(
        "doc_id", names.archive_path(_label("Cluster_"), F.col("document_name")).alias("archive_path")
    )


def organization_plan(assignments: DataFrame, themes: DataFrame) -> DataFrame:
    """One row per document: folder, theme, document and the number of documents in the folder."""
    sizes = assignments.groupBy("cluster_id").agg(F.count("*").alias("count"))
    folders = sizes.join(themes.select("cluster_id", F.col("name").alias("theme")), "cluster_id", "left").withColumn(
        "folder_name", F.concat_ws("_", F.lit("cluster"), F.col("cluster_id").cast("string"), "theme")
    )
    return assignments.select("cluster_id", "document_name").join(folders, "cluster_id")
