"""Column expressions over file and cluster names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that file systems refuse.
INVALID_CHARACTERS = '<>:"/\\|?*'


def sanitize_name(name: Column) -> Column:
    """Replace refused characters by ``_``, merge and trim underscores, shorten beyond 50 characters."""
    replaced = F.translate(name, INVALID_CHARACTERS, "_" * len(INVALID_CHARACTERS))
    merged = F.regexp_replace(F.regexp_replace(replaced, "_+", "_"), "^_|_$", "")
    return F.when(F.length(merged) > 50, F.concat(F.substring(merged, 1, 47), F.lit("..."))).otherwise(merged)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Last suffix with its dot, ``''`` for none or for a leading-dot name."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]+$", "$1")


def archive_path(cluster_name: Column, document_name: Column) -> Column:
    """``folder/document`` with brackets dropped and spaces turned to ``_`` in the folder."""
    return F.concat_ws("/", F.translate(cluster_name, " ()", "_"), document_name)


def quality_band(silhouette: Column) -> Column:
    return (
        F.when(silhouette > 0.5, "Excellent")
        .when(silhouette > 0.3, "Good")
        .when(silhouette > 0.1, "Fair")
        .otherwise("Poor")
    )


def megabytes(length: Column) -> Column:
    return F.round(length / F.lit(1024 * 1024), 2)
