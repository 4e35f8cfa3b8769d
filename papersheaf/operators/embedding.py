"""Texts to unit vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import IDF, HashingTF, IDFModel, Normalizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papersheaf.functions import text, vectors
from papersheaf.session import materialized

DIMENSIONS = 384
BATCH_SIZE = 32


def _term_counts(documents: DataFrame, text_field: str, dimensions: int, max_words: int | None, keep: tuple[str, ...]) -> DataFrame:
    body = F.col(text_field) if max_words is None else text.first_n_words(F.col(text_field), max_words)
    token = F.lit(f"({text.LETTER_OR_DIGIT}+)")
    tokens = documents.select(*keep, F.regexp_extract_all(F.lower(body), token, F.lit(1)).alias("_words"))
    return HashingTF(numFeatures=dimensions, inputCol="_words", outputCol="_tf").transform(tokens).drop("_words")


@dataclass
class TextEmbedder:
    """Hashed TF-IDF in the space of the documents it was fitted on; other texts can be placed in it."""

    idf: IDFModel
    dimensions: int
    max_words: int | None

    def transform(self, rows: DataFrame, text_field: str = "full_text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """``keep`` and ``embedding ARRAY<FLOAT>`` of unit length."""
        return self.weighted(_term_counts(rows, text_field, self.dimensions, self.max_words, keep), keep)

    def weighted(self, counted: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        weighted = self.idf.transform(counted)
        unit = Normalizer(p=2.0, inputCol="_tfidf", outputCol="_unit").transform(weighted)
        return unit.select(*keep, vector_to_array("_unit", "float32").alias("embedding"))


def fit_embedder(
    documents: DataFrame, text_field: str = "full_text", dimensions: int = DIMENSIONS, max_words: int | None = None
) -> TextEmbedder:
    """An embedder whose inverse frequencies come from all ``documents``."""
    counted = _term_counts(documents, text_field, dimensions, max_words, ())
    return TextEmbedder(IDF(inputCol="_tf", outputCol="_tfidf").fit(counted), dimensions, max_words)


def embed_documents(
    documents: DataFrame,
    text_field: str = "full_text",
    dimensions: int = DIMENSIONS,
    max_words: int | None = None,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Hashed TF-IDF vectors of unit length, computed by Spark alone: ``keep`` and ``embedding ARRAY<FLOAT>``.

    Whole texts are read unless the caller names a number of leading words, ``max_words``. Term counts are written once, so that
    texts are read and split only once although the inverse frequencies need a pass of their own.
    """
    counted = materialized(_term_counts(documents, text_field, dimensions, max_words, keep))
    model = TextEmbedder(IDF(inputCol="_tf", outputCol="_tfidf").fit(counted), dimensions, max_words)
    return model.weighted(counted, keep)


def embed_with_model(
    documents: DataFrame,
    make_predict_fn: Callable,
    text_field: str = "full_text",
    batch_size: int = BATCH_SIZE,
    max_words: int | None = None,
    normalize: bool = True,
) -> DataFrame:
    """Vectors from the caller's model, loaded once per worker and run on batches inside the tasks.

    A model that accepts no more than so many words is given ``max_words``; by default it gets whole texts.
    """
    predict = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    body = F.col(text_field) if max_words is None else text.first_n_words(F.col(text_field), max_words)
    embedded = documents.withColumn("embedding", predict(body))
    if normalize:
        embedded = l2_normalize(embedded)
    return embedded


def l2_normalize(points: DataFrame, vector: str = "embedding") -> DataFrame:
    return points.withColumn(vector, vectors.l2_normalize(F.col(vector)).cast("array<float>"))


def join_embeddings(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Documents with ready vectors, matched on ``doc_id``."""
    return documents.join(embeddings.select("doc_id", "embedding"), "doc_id")


def embedding_statistics(points: DataFrame) -> DataFrame:
    """One row: documents, dimension, minimum, maximum, mean and population deviation of all values.

    Every vector is folded inside its row, so no row per value is made.
    """
    values = vectors.doubles(F.col("embedding"))
    folded = points.select(
        F.size("embedding").alias("d"),
        F.array_min(values).alias("low"),
        F.array_max(values).alias("high"),
        vectors.total(values).alias("s"),
        vectors.squared_norm(values).alias("q"),
    )
    sums = folded.agg(
        F.count("*").alias("n_documents"),
        F.max("d").alias("dimension"),
        F.min("low").alias("min_value"),
        F.max("high").alias("max_value"),
        F.sum("d").alias("n"),
        F.sum("s").alias("s"),
        F.sum("q").alias("q"),
    )
    mean = F.try_divide(F.col("s"), F.col("n"))
    spread = F.try_divide(F.col("q"), F.col("n")) - mean * mean
    return sums.select(
        "n_documents",
        "dimension",
        "min_value",
        "max_value",
        mean.alias("mean_value"),
        F.sqrt(F.greatest(spread, F.lit(0.0))).alias("std_value"),
    )


def histogram(values: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed; empty bins are absent."""
    limits = values.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high")).alias("l")).scalar()
    limited = values.select(F.col(column).alias("v"), limits.alias("l"))
    position = F.floor(F.try_divide(bins * (F.col("v") - F.col("l.low")), F.col("l.high") - F.col("l.low")))
    return (
        limited.withColumn("bin", F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1)).cast("int"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )


def embedding_histogram(points: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(points.select(F.explode(vectors.doubles(F.col("embedding"))).alias("value")), "value", bins)


def leading_dimensions(points: DataFrame, dimensions: int = 50) -> DataFrame:
    """Long table of the first dimensions, for a heat map."""
    first = F.slice("embedding", 1, dimensions)
    return points.select("doc_id", F.posexplode(first).alias("dimension", "value"))
