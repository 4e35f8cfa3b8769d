"""Sinks: reports, documents placed per cluster, and the organisation plan."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersheaf.operators import organize

MAX_ROWS_PER_FILE = 1_000_000


def run_folder(base: str, with_timestamp: bool = True) -> str:
    """``base/organized_YYYYMMDD_HHMMSS``, or the base itself."""
    if not with_timestamp:
        return base.rstrip("/")
    return f"{base.rstrip('/')}/organized_{datetime.now():%Y%m%d_%H%M%S}"


def write_reports(
    folder: str,
    assignments: DataFrame,
    manifest: DataFrame,
    cluster_names: DataFrame | None = None,
    operation: str = "copy",
    mode: str = "errorifexists",
) -> dict[str, str]:
    """Write the summary as JSON tables, the text report and the clustering table as CSV.

    The manifest is read several times, so pass a written one. The JSON summary is one small table each for totals and cluster statistics and one row per file for
    the listings, so that its size never rests on one task.
    """
    timestamp = datetime.now().isoformat()
    paths = {
        "metadata": f"{folder}/reports/organization_summary/metadata",
        "cluster_summary": f"{folder}/reports/organization_summary/cluster_summary",
        "files": f"{folder}/reports/organization_summary/cluster_files",
        "organized": f"{folder}/reports/organization_summary/organized_files",
        "failed": f"{folder}/reports/organization_summary/failed_files",
        "text": f"{folder}/reports/organization_summary_txt",
        "breakdown": f"{folder}/reports/cluster_breakdown",
    }
    totals = organize.organize_summary(manifest).select(
        F.lit(timestamp).alias("timestamp"),
        F.lit(folder).alias("output_directory"),
        F.lit(operation).alias("operation_type"),
        "*",
    )
    totals.write.mode(mode).json(paths["metadata"])
    organize.cluster_statistics(assignments, cluster_names).write.mode(mode).json(paths["cluster_summary"])
    organize.cluster_listing(assignments, cluster_names).write.mode(mode).json(paths["files"])
    manifest.filter("success").write.mode(mode).json(paths["organized"])
    manifest.filter("not success").write.mode(mode).json(paths["failed"])
    report = organize.readable_report(assignments, manifest, cluster_names, folder, timestamp, operation.title())
    report.select("line").write.mode(mode).text(paths["text"])
    assignments.write.mode(mode).option("header", True).csv(paths["breakdown"])
    return paths


def write_clustered(
    documents: DataFrame, folder: str, format: str = "parquet", mode: str = "errorifexists"
) -> str:
    """Write documents with ``cluster_dir`` into one folder per cluster below ``folder``.

    Nothing is moved to one writer per cluster: each task writes its share of every folder, and a file
    holds at most ``MAX_ROWS_PER_FILE`` rows.
    """
    last = F.substring_index("cluster_dir", "/", -1)
    path = f"{folder.rstrip('/')}/clusters"
    (
        documents.withColumn("cluster_dir", last)
        .write.mode(mode)
        .option("maxRecordsPerFile", MAX_ROWS_PER_FILE)
        .partitionBy("cluster_dir")
        .format(format)
        .save(path)
    )
    return path


def write_plan(
    folder: str, assignments: DataFrame, themes: DataFrame, scores: DataFrame | None = None, mode: str = "errorifexists"
) -> str:
    """Write the organisation plan as JSON: one row per document, and the quality block beside it."""
    path = f"{folder.rstrip('/')}/reports/organization_plan"
    organize.organization_plan(assignments, themes).write.mode(mode).json(f"{path}/cluster_details")
    if scores is not None:
        scores.write.mode(mode).json(f"{path}/clustering_quality")
    return path
