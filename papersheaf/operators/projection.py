"""Two-dimensional projection of vectors by centred principal components."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, PCAModel, StandardScaler, StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersheaf.functions import vectors


class Projection:
    """A fitted projection; the largest loading of every component is positive.

    Spark's PCA does not centre rows on transform, so a scaler does that first.
    """

    def __init__(self, scaler: StandardScalerModel, pca: PCAModel):
        self.scaler = scaler
        self.pca = pca
        loadings = pca.pc.toArray()
        self.signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])])

    @classmethod
    def fit(cls, points: DataFrame, components: int = 2) -> Projection:
        prepared = _as_vector(points, "embedding")
        first = prepared.select("_vector").first()
        dimension = len(first[0]) if first else 0
        scaler = StandardScaler(withMean=True, withStd=False, inputCol="_vector", outputCol="_centred").fit(prepared)
        k = max(1, min(components, dimension))
        return cls(scaler, PCA(k=k, inputCol="_centred", outputCol="_scores").fit(scaler.transform(prepared)))

    def transform(self, rows: DataFrame, column: str = "embedding") -> DataFrame:
        """Add ``x`` and ``y``; ``y`` is 0 when there is one component only."""
        scored = self.pca.transform(self.scaler.transform(_as_vector(rows, column)))
        values = vector_to_array("_scores")
        y = values[1] * float(self.signs[1]) if len(self.signs) > 1 else F.lit(0.0)
        return (
            scored.withColumn("x", values[0] * float(self.signs[0]))
            .withColumn("y", y)
            .drop("_vector", "_centred", "_scores")
        )

    def explained_variance(self, rows: DataFrame) -> DataFrame:
        """Share of each component and the running total."""
        return explained_variance(rows.sparkSession, self.pca.explainedVariance)


def _as_vector(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("_vector", array_to_vector(vectors.doubles(F.col(column))))


def explained_variance(spark, shares: DenseVector) -> DataFrame:
    values = [float(v) for v in shares]
    totals = np.cumsum(values)
    rows = [(i + 1, v, float(totals[i])) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "component int, explained_variance_ratio double, cumulative double")


def pca_project(points: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``(doc_id, x, y)`` with any further columns of ``keep``.

    One document lies at the origin and two lie at (0, 0) and (1, 0), in id order.
    """
    columns = ["doc_id", *(keep or [])]
    few = [row.doc_id for row in points.select("doc_id").orderBy("doc_id").limit(3).collect()]
    if len(few) < 3:
        later = F.lit(few[1]) if len(few) == 2 else F.lit(None)
        x = F.when(F.col("doc_id") == later, 1.0).otherwise(0.0)
        return points.select(*columns, x.alias("x"), F.lit(0.0).alias("y"))
    return Projection.fit(points).transform(points).select(*columns, "x", "y")


def project_centers(points: DataFrame, centers: DataFrame) -> DataFrame:
    """Cluster centres in the projection fitted on the documents."""
    return Projection.fit(points).transform(centers, "center").select("cluster_id", "x", "y")


def cluster_ellipses(projected: DataFrame) -> DataFrame:
    """Per cluster of two or more documents: centre, axes ``2 * sqrt(eigenvalue)`` and angle in degrees.

    The eigenvalues of the 2x2 sample covariance are taken in descending order.
    """
    moments = (
        projected.groupBy("cluster_id")
        .agg(
            F.count("*").alias("n"),
            F.avg("x").alias("center_x"),
            F.avg("y").alias("center_y"),
            F.var_samp("x").alias("a"),
            F.var_samp("y").alias("c"),
            F.covar_samp("x", "y").alias("b"),
        )
        .filter("n > 1")
    )
    half = (F.col("a") + F.col("c")) / 2
    root = F.sqrt((F.col("a") - F.col("c")) * (F.col("a") - F.col("c")) / 4 + F.col("b") * F.col("b"))
    return moments.select(
        "cluster_id",
        "n",
        "center_x",
        "center_y",
        (2 * F.sqrt(half + root)).alias("width"),
        (2 * F.sqrt(F.greatest(half - root, F.lit(0.0)))).alias("height"),
        F.degrees(0.5 * F.atan2(2 * F.col("b"), F.col("a") - F.col("c"))).alias("angle"),
    )
