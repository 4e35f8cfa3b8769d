"""The whole run: documents to vectors, clusters, names, manifest and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersheaf.functions import text
from papersheaf.functions.binding import once
from papersheaf.operators import (
    agglomerative,
    dbscan,
    documents,
    embedding,
    kmeans,
    metrics,
    naming,
    organize,
    projection,
    select_k,
)
from papersheaf.session import materialized
from papersheaf.sources import reports

ALGORITHMS = ("kmeans", "dbscan", "agglomerative")


@dataclass
class Clustering:
    """A finished clustering: ``points`` has ``doc_id, embedding, cluster_id``."""

    algorithm: str
    points: DataFrame
    centers: DataFrame | None
    n_clusters: int | None
    scored: bool = True

    @property
    def assignments(self) -> DataFrame:
        return self.points.select("doc_id", "cluster_id")

    def scores(self) -> DataFrame:
        """One row with both quality scores, null for a single document."""
        if not self.scored:
            return self.points.sparkSession.createDataFrame(
                [(None, None)], "silhouette_score double, calinski_harabasz_score double"
            )
        return metrics.silhouette_euclidean(self.points).select(
            F.col("silhouette_euclidean").alias("silhouette_score"),
            metrics.calinski_harabasz(self.points).scalar().alias("calinski_harabasz_score"),
        )

    def info(self) -> DataFrame:
        rows = metrics.cluster_info(self.points, self.algorithm)
        if self.scored:
            return rows
        unknown = F.lit(None).cast("double")
        return rows.withColumn("silhouette_score", unknown).withColumn("calinski_harabasz_score", unknown)

    def summary(self, document_names: DataFrame) -> DataFrame:
        """``document_names`` has ``doc_id, document_name``."""
        named = self.assignments.join(document_names, "doc_id")
        return metrics.cluster_summary(named, self.points, self.centers)

    def projected(self) -> DataFrame:
        return projection.pca_project(self.points, ["cluster_id"])


class DocumentClusterer:
    """Clusters vectors with a chosen algorithm; ``n_clusters=None`` lets the data decide.

    Further options: ``eps`` and ``min_samples`` for DBSCAN, ``linkage`` for agglomerative clustering.
    """

    def __init__(self, algorithm: str = "kmeans", n_clusters: int | None = None, random_state: int = 42, **options):
        if algorithm not in ALGORITHMS:
            raise ValueError(f"no algorithm named {algorithm!r}, only {', '.join(ALGORITHMS)}")
        self.algorithm = algorithm
        self.n_clusters = n_clusters
        self.random_state = random_state
        self.options = options

    def fit(self, points: DataFrame, auto_tune: bool = True) -> Clustering:
        """No rows give no rows; one row is cluster 0 without scores; k is kept below the number of rows."""
        vectors = points.select("doc_id", "embedding")
        n = vectors.count()
        if n <= 1:
            single = vectors.withColumn("cluster_id", F.lit(0))
            return Clustering(self.algorithm, single, None, n, scored=False)
        k = self.n_clusters
        if self.algorithm != "dbscan":
            if k is None:
                if not auto_tune:
                    raise ValueError(f"{self.algorithm} needs n_clusters when auto_tune is off")
                k = select_k.choose_k(vectors, self.random_state)
            k = max(1, n - 1) if k >= n else k
        centers = None
        if self.algorithm == "kmeans":
            labels, centers = kmeans.kmeans(vectors, k, self.random_state, **self.options)
        elif self.algorithm == "dbscan":
            labels = dbscan.dbscan(vectors, **self.options)
        else:
            labels = agglomerative.agglomerative(vectors, k, **self.options)
        labelled = vectors.join(labels.select("doc_id", "cluster_id"), "doc_id")
        return Clustering(self.algorithm, materialized(labelled), centers, k)

    def fit_predict(self, points: DataFrame, auto_tune: bool = True) -> DataFrame:
        """``(doc_id, cluster_id)``."""
        return self.fit(points, auto_tune).assignments


def cluster_documents(
    points: DataFrame, algorithm: str = "kmeans", n_clusters: int | None = None, **options
) -> Clustering:
    return DocumentClusterer(algorithm, n_clusters, **options).fit(points)


def prepare_documents(rows: DataFrame, text_field: str = "text") -> DataFrame:
    """Raw single-text documents to cleaned records ready for embedding: no shuffle."""
    cleaned = rows.select("*", once(text.clean_text(F.col(text_field))).alias("full_text"))
    return cleaned.withColumns(
        {
            "word_count": text.count_words(F.col("full_text")),
            "char_count": text.count_chars(F.col("full_text")),
            "success": F.lit(True),
        }
    )


def cluster_texts(
    rows: DataFrame, n_clusters: int | None, text_field: str = "text", dimensions: int = embedding.DIMENSIONS
) -> Clustering:
    """Clean, embed and cluster raw texts; documents without text have no vector and no cluster."""
    usable = documents.embeddable_documents(prepare_documents(rows, text_field))
    embedded = materialized(embedding.embed_documents(usable, dimensions=dimensions))
    return cluster_documents(embedded, n_clusters=n_clusters)


@dataclass
class Organization:
    """The manifest of a run with its names and, once written, its report paths."""

    manifest: DataFrame
    cluster_names: DataFrame
    report_paths: dict[str, str]

    def summary(self) -> DataFrame:
        return organize.organize_summary(self.manifest)


def organize_documents(
    assignments: DataFrame,
    output_dir: str,
    inventory: DataFrame,
    directory: str = "",
    cluster_names: DataFrame | None = None,
    contents: DataFrame | None = None,
    with_timestamp: bool = True,
    create_summary: bool = True,
) -> Organization:
    """Plan the placement of ``(doc_id, document_name, cluster_id)``, and write documents and reports.

    Names default to file-name keywords. ``contents`` holds ``doc_id`` and whatever is to be written
    into the cluster folders; files are copied, never moved.
    """
    folder = reports.run_folder(output_dir, with_timestamp)
    if cluster_names is None:
        cluster_names = naming.filename_names(assignments)
    manifest = materialized(
        organize.placement_manifest(assignments, inventory, cluster_names, directory, folder)
    )
    paths = {}
    if contents is not None:
        placed = manifest.filter("success").select(
            "doc_id",
            F.regexp_replace("destination_path", "/[^/]*$", "").alias("cluster_dir"),
            F.substring_index("destination_path", "/", -1).alias("file_name"),
        )
        paths["clusters"] = reports.write_clustered(placed.join(contents, "doc_id"), folder)
    if create_summary:
        paths.update(reports.write_reports(folder, assignments, manifest, cluster_names))
    return Organization(manifest, cluster_names, paths)
