"""Choosing the number of clusters.

A score table has one row per ``k`` with ``inertia, silhouette, davies_bouldin, calinski_harabasz``.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersheaf.functions import vectors
from papersheaf.operators import agglomerative as agg
from papersheaf.operators import blocks, kmeans, metrics
from papersheaf.operators import dbscan as density
from papersheaf.session import materialized, spread_rows

MAX_CLUSTERS = 10
MIN_CLUSTERS = 2
SWEEP_RESTARTS = 20
SWEEP_MAX_ITER = 500
ACCEPTED_SILHOUETTE = 0.25
SCORES = "k int, inertia double, silhouette double, davies_bouldin double, calinski_harabasz double"


def sweep_range(n: int, max_clusters: int = MAX_CLUSTERS, min_clusters: int = MIN_CLUSTERS) -> list[int]:
    """The ks to try for ``n`` documents; empty when there are too few."""
    upper = min(max_clusters, n - 1, max(2, int(math.sqrt(n / 2))))
    return list(range(min_clusters, upper + 1))


def k_sweep(
    points: DataFrame,
    max_clusters: int = MAX_CLUSTERS,
    min_clusters: int = MIN_CLUSTERS,
    seed: int = kmeans.SEED,
    restarts: int = SWEEP_RESTARTS,
    max_iter: int = SWEEP_MAX_ITER,
) -> DataFrame:
    """The score table. All ks and restarts share each pass over the data, and so do the measures."""
    spark = points.sparkSession
    n = points.count()
    ks = sweep_range(n, max_clusters, min_clusters)
    if not ks:
        return spark.createDataFrame([], SCORES)
    fits = kmeans.fit_many(points, ks, seed, restarts, max_iter)
    labelled = label_all(spread_rows(points), fits).persist()
    try:
        rows = labelled.select("doc_id", "embedding", F.posexplode("labels").alias("_i", "cluster_id"))
        k_of = F.array(*[F.lit(k) for k in ks])
        rows = rows.withColumn("k", F.element_at(k_of, F.col("_i") + 1)).drop("_i")
        found = rows.groupBy("k").agg(F.count_distinct("cluster_id").alias("found"))
        scores = (
            found.join(metrics.silhouette_cosine(rows, "k"), "k")
            .join(metrics.davies_bouldin(rows, "k"), "k")
            .join(metrics.calinski_harabasz(rows, "k"), "k")
            .collect()  # one row per k
        )
    finally:
        labelled.unpersist()
    table = []
    for row in sorted(scores, key=lambda r: r.k):
        measured = (row.silhouette_cosine, row.davies_bouldin, row.calinski_harabasz)
        table.append((row.k, float(fits[row.k].inertia), *(measured if row.found > 1 else (-1.0, math.inf, 0.0))))
    return spark.createDataFrame(table, SCORES)


def label_all(points: DataFrame, fits: dict[int, kmeans.KMeansFit]) -> DataFrame:
    """Add ``labels``, the nearest centre under every fit in order of k, without copying vectors."""
    shared = points.sparkSession.sparkContext.broadcast([fits[k].centers for k in sorted(fits)])
    id_type = points.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, embedding array<double>, labels array<int>"
    out = blocks.arrow_schema(points, schema)

    def scan(batches):
        for batch in batches:
            x = blocks.matrix(batch.column("embedding"))
            if len(x):
                labels = np.stack([blocks.squared_distances(x, c).argmin(1) for c in shared.value], axis=1)
                offsets = np.arange(len(x) + 1) * labels.shape[1]
                listed = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), pa.array(labels.ravel().astype(np.int32))
                )
                columns = [batch.column("doc_id"), batch.column("embedding"), listed]
                yield from pa.table(columns, names=out.names).cast(out).to_batches()

    return points.select("doc_id", vectors.doubles(F.col("embedding")).alias("embedding")).mapInArrow(scan, schema)


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def normalize_scores(scores: DataFrame, column: str, higher_better: bool, name: str) -> DataFrame:
    """Min-max to 0-1, inverted where lower is better; infinite becomes the worst finite value; all equal 0.5."""
    value = _finite(F.col(column).cast("double"))
    limits = scores.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high")).alias("l")).scalar()
    worst = F.col("_l.low") if higher_better else F.col("_l.high")
    share = F.try_divide(F.coalesce(value, worst) - F.col("_l.low"), F.col("_l.high") - F.col("_l.low"))
    scaled = share if higher_better else 1 - share
    return scores.withColumn("_l", limits).withColumn(name, F.coalesce(scaled, F.lit(0.5))).drop("_l")


def elbow_distances(scores: DataFrame, x: str = "k", y: str = "inertia") -> DataFrame:
    """Each row's distance to the chord from the first to the last point, on axes scaled to 0-1."""
    limits = scores.agg(
        F.struct(
            F.min(x).alias("x0"),
            F.max(x).alias("x1"),
            F.min(y).alias("low"),
            F.max(y).alias("high"),
            F.min_by(y, x).alias("first"),
            F.max_by(y, x).alias("last"),
        ).alias("l")
    ).scalar()

    def scaled(value: Column, low: str, high: str) -> Column:
        return F.coalesce(
            F.try_divide((value - F.col(low)).cast("double"), (F.col(high) - F.col(low)).cast("double")), F.lit(0.0)
        )

    px, py = scaled(F.col(x), "_l.x0", "_l.x1"), scaled(F.col(y), "_l.low", "_l.high")
    start = scaled(F.col("_l.first"), "_l.low", "_l.high")
    rise = scaled(F.col("_l.last"), "_l.low", "_l.high") - start
    # the chord runs from (0, start) by (1, rise)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px + (py - start) * rise) / (1 + rise * rise)))
    distance = F.sqrt((px - t) * (px - t) + (py - start - t * rise) * (py - start - t * rise))
    return scores.withColumn("_l", limits).withColumn("distance", distance).drop("_l")


def elbow_point(scores: DataFrame, x: str = "k", y: str = "inertia") -> DataFrame:
    """One row ``elbow_k``: the farthest point from the chord, the first of equals; the first k below three rows."""
    picked = F.max_by(x, F.struct(F.round("distance", 12), -F.col(x)))
    return elbow_distances(scores, x, y).agg(F.when(F.count("*") < 3, F.min(x)).otherwise(picked).alias("elbow_k"))


def composite_score(scores: DataFrame) -> DataFrame:
    """Normalised measures and their weighted sum for every k."""
    rows = normalize_scores(scores, "silhouette", True, "silhouette_norm")
    rows = normalize_scores(rows, "davies_bouldin", False, "davies_bouldin_norm")
    rows = normalize_scores(rows, "calinski_harabasz", True, "calinski_harabasz_norm")
    # Weights of separation, compactness, variance ratio and elbow.
    return (
        rows.withColumn("_elbow", elbow_point(scores).scalar())
        .withColumn(
            "composite_score",
            0.35 * F.col("silhouette_norm")
            + 0.30 * F.col("davies_bouldin_norm")
            + 0.25 * F.col("calinski_harabasz_norm")
            + 0.10 * F.when(F.col("k") == F.col("_elbow"), 1.0).otherwise(0.5),
        )
        .drop("_elbow")
    )


def best_k(scores: DataFrame) -> DataFrame:
    """One row: the k each measure would choose, and the composite choice; ties go to the smallest k."""

    def first_best(column: Column) -> Column:
        return F.max_by("k", F.struct(column, -F.col("k")))

    return (
        composite_score(scores)
        .agg(
            first_best(F.col("silhouette")).alias("silhouette_k"),
            first_best(-F.col("davies_bouldin")).alias("davies_bouldin_k"),
            first_best(F.col("calinski_harabasz")).alias("calinski_harabasz_k"),
            first_best(F.round("composite_score", 12)).alias("composite_k"),
        )
        .withColumn("elbow_k", elbow_point(scores).scalar())
        .select("elbow_k", "silhouette_k", "davies_bouldin_k", "calinski_harabasz_k", "composite_k")
    )


def validate_separation(scores: DataFrame, k: Column | int, accepted: float = ACCEPTED_SILHOUETTE) -> DataFrame:
    """One row ``final_k``: the proposed k, or a smaller one with a better silhouette when separation is poor.

    Candidates run from ``max(2, k - 2)`` down to above ``max(1, k - 5)``; the sweep has measured them.
    """
    proposed = k if isinstance(k, Column) else F.lit(k)
    rows = scores.withColumn("_k", proposed)
    own = F.max(F.when(F.col("k") == F.col("_k"), F.col("silhouette")))
    candidate = (F.col("k") <= F.greatest(F.lit(2), F.col("_k") - 2)) & (
        F.col("k") > F.greatest(F.lit(1), F.col("_k") - 5)
    )
    rank = F.struct(F.col("silhouette"), F.col("k"))  # the search runs downwards and replaces only by better
    return rows.agg(
        F.max("_k").alias("_k"),
        own.alias("_own"),
        F.max(F.when(candidate & (F.col("silhouette") > -1), rank)).alias("_best"),
    ).select(
        F.when((F.col("_own") < accepted) & (F.col("_best.silhouette") > F.col("_own")), F.col("_best.k"))
        .otherwise(F.col("_k"))
        .alias("final_k")
    )


def choose_k(points: DataFrame, seed: int = kmeans.SEED, restarts: int = SWEEP_RESTARTS) -> int:
    """The number of clusters found by sweep, composite score and separation check."""
    scores = k_sweep(points, seed=seed, restarts=restarts)
    chosen = validate_separation(scores, best_k(scores).select("composite_k").scalar()).first()
    if chosen is None or chosen.final_k is None:
        return 1
    return int(chosen.final_k)


def evaluate_k_range(
    points: DataFrame, ks: list[int], algorithm: str = "kmeans", seed: int = kmeans.SEED, **options
) -> DataFrame:
    """One row per k below the number of documents: both scores, inertia and clusters found. All ks share one pass over pairs."""
    spark = points.sparkSession
    n = points.count()
    usable = [k for k in ks if k < n]
    schema = (
        "k int, silhouette_score double, calinski_harabasz_score double, inertia double, n_clusters_found bigint"
    )
    if not usable:
        return spark.createDataFrame([], schema)
    ks = sorted(usable)
    inertias: dict[int, float | None] = dict.fromkeys(ks)
    if algorithm == "kmeans":
        fits = kmeans.fit_many(points, ks, seed, **options)
        inertias = {k: float(fits[k].inertia) for k in ks}
        labelled = label_all(points, fits)
    elif algorithm in ("agglomerative", "dbscan"):
        if algorithm == "agglomerative":
            cuts = agg.agglomerative_cuts(points, ks, **options)
            named = [cuts[k].select("doc_id", F.lit(k).alias("k"), "cluster_id") for k in ks]
            listed = F.transform(F.array_sort(F.collect_list(F.struct("k", "cluster_id"))), lambda x: x["cluster_id"])
            labels = reduce(DataFrame.unionByName, named).groupBy("doc_id").agg(listed.alias("labels"))  # one entry for each k
        else:
            found = density.dbscan(points, **options)
            labels = found.select("doc_id", F.array_repeat("cluster_id", len(ks)).alias("labels"))
        labelled = points.select("doc_id", "embedding").join(labels, "doc_id")
    else:
        raise ValueError(f"no algorithm named {algorithm!r}")
    labelled = materialized(labelled)
    silhouettes = {row.position: row.silhouette_euclidean for row in metrics.silhouettes_by_clustering(labelled).collect()}
    rows = labelled.select("doc_id", "embedding", F.posexplode("labels").alias("position", "cluster_id"))
    found = rows.groupBy("position").agg(F.count_distinct("cluster_id").alias("found"))
    spread = {row.position: row for row in found.join(metrics.calinski_harabasz(rows, "position"), "position").collect()}
    table = [(k, silhouettes[i], spread[i].calinski_harabasz, inertias[k], spread[i].found) for i, k in enumerate(ks)]
    return spark.createDataFrame(table, schema)  # one row a k


def best_per_metric(evaluation: DataFrame) -> DataFrame:
    """The best k by silhouette and by Calinski-Harabasz."""
    return evaluation.agg(
        F.max_by("k", F.struct("silhouette_score", -F.col("k"))).alias("best_silhouette_k"),
        F.max_by("k", F.struct("calinski_harabasz_score", -F.col("k"))).alias("best_calinski_harabasz_k"),
    )
