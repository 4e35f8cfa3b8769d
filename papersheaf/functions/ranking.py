"""Exact ranks and top rows that do not put one large group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICES = 256


def rank_within(
    rows: DataFrame, keys: list[str], order: str, name: str, start: DataFrame | None = None, slices: int = SLICES
) -> DataFrame:
    """``row_number()`` per key in the order of a unique column, safe for a key holding most rows.

    The order column is cut into slices of about equal size (bounds from one approximate
    percentile aggregate), rows are numbered inside ``(key, slice)`` and shifted by the sizes of the
    key's earlier slices, of which there are at most ``slices``. The result is exact whatever the
    bounds are. Identities that are not numeric are ordered by their hash, then by value. ``start`` adds
    its column of that name to the ranks of a key; it joins the slice sizes, not the rows.
    """
    numeric = isinstance(rows.schema[order].dataType, T.NumericType)
    position: Column = F.col(order) if numeric else F.xxhash64(F.col(order))
    shares = [i / slices for i in range(1, slices)]
    bounds = rows.agg(F.percentile_approx(position, shares, 10 * slices).alias("b")).scalar()
    sliced = (
        rows.withColumn("_bounds", bounds)
        .withColumn("_slice", F.size(F.filter("_bounds", lambda b: b < position)))
        .drop("_bounds")
    )

    local = Window.partitionBy(*keys, "_slice").orderBy(position, F.col(order))
    numbered = sliced.withColumn("_local", F.row_number().over(local))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_shift", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    if start is not None:
        shifts = shifts.join(start.select(*keys, "start"), keys).withColumn("_shift", F.col("_shift") + F.col("start"))
        shifts = shifts.drop("start")
    return (
        numbered.join(shifts, [*keys, "_slice"])
        .withColumn(name, F.col("_shift") + F.col("_local"))
        .drop("_slice", "_local", "_shift")
    )


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of every key.

    Spark turns a bounded ``row_number`` into a group limit that runs before the shuffle, so a
    task receives at most ``n`` rows of a key from each input partition.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
