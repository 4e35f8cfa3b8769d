"""Quality of texts by logistic regression on hashed word n-grams, trained with FTRL updates.

Tokens are runs of letters and digits, lower-cased, and runs of other signs. Features are single tokens, pairs and triples of
neighbours, pairs and triples of token shapes (case, digits, sign run, repetition of the previous token), hashed into a fixed
number of buckets and weighted by their share of the text, so length is no feature by itself.

The model is fitted on a bounded sample of labelled rows (``max_rows``): each shard of the sample is trained in its own task
and the models are averaged. Scoring reads every whole text.

Defined results: a text without tokens, null included, has the score of the intercept alone. Without labels all scores are 0.5.
Rows are scored one by one, repeated ones alike; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersheaf.llm import linear, words

KINDS = np.full(256, 2, np.uint8)
KINDS[words.alphanumeric()] = 1
KINDS[words.SPACE] = 0
SCALE = 20.0  # of the shares of a text


def features(texts: pa.Array) -> linear.Features:
    data, offsets = words.utf8(texts)
    found = words.split(data, offsets, KINDS)
    hashed = words.hashes(found, lower=True)
    owner = found.documents()
    first = data[found.starts]
    last = data[found.ends - 1]
    upper = (first >= ord("A")) & (first <= ord("Z"))
    shape = np.where(KINDS[first] == 2, 3, np.where((first >= ord("0")) & (first <= ord("9")), 4, np.where(upper, 1, 0)))
    shape = np.where(upper & (last >= ord("A")) & (last <= ord("Z")) & (found.ends - found.starts > 1), 2, shape)
    again = np.zeros(len(hashed), bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])
    shapes = words.mix(np.where(shape == 3, hashed, shape.astype(np.uint64) + np.uint64(7) + (again * 16).astype(np.uint64)))
    parts = [(hashed, owner)]
    for series in (hashed, shapes):
        for width in (2, 3):
            if len(series) >= width:
                inside = owner[: len(series) - width + 1] == owner[width - 1 :]
                parts.append((words.windows(series, width)[inside], owner[: len(series) - width + 1][inside]))
    return linear.gathered(parts, len(offsets) - 1, linear.BITS)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = linear.SAMPLE_ROWS) -> np.ndarray:
    """Weights of all buckets, then the intercept."""
    size = 1 << linear.BITS

    def train(texts: pa.ChunkedArray, marks: np.ndarray) -> np.ndarray:
        rows = [(at, SCALE * counts / max(1, counts.sum())) for at, counts in linear.training_rows(texts, features)]
        model = linear.Ftrl(size + 1, rate=0.3, l1=0.1, l2=0.01)
        for _ in range(linear.PASSES):
            for (at, values), mark in zip(rows, marks):
                at, values = np.append(at, size), np.append(values, 1.0)
                weights = model.weights(at)
                error = linear.sigmoid(weights @ values) - mark
                model.update(at, error * values, weights)
        return model.weights()

    return linear.fit_shards(linear.sample(documents, labels, label, max_rows), train)


def score(documents: DataFrame, model: np.ndarray) -> DataFrame:
    """``(doc_id, score)`` for each row; 1 is the better end."""
    weights = model if len(model) else np.zeros((1 << linear.BITS) + 1, np.float32)
    shared = documents.sparkSession.sparkContext.broadcast(weights)  # of fixed size

    def columns(texts: pa.Array) -> dict:
        found = features(texts)
        dots = SCALE * found.sums(shared.value[:-1]) / np.maximum(1, found.counts())
        return {"score": linear.sigmoid(dots + shared.value[-1])}

    return linear.scored(documents, columns, "score double")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """The rows kept from training: every third by a checksum of the id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
