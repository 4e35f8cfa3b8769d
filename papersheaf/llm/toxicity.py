"""Severity of toxic language by cumulative-link ordinal regression on sparse text features.

Grades 0..K-1 are ordered: P(grade > k) = sigmoid(w.x - t_k) with one weight vector for all thresholds t_0 < t_1 < ... A text's
expected severity is the sum of these probabilities, and it is rejected where P(grade > 0) >= 0.5. Features are its words and
their first four to eight bytes, hashed, so that new endings of a known stem count; weights are trained with FTRL
updates on the likelihood, which leaves most of them at zero.

Where only a toxic mark of 0 or 1 is given, ``graded`` makes grades of it: 0 for unmarked texts, and for marked ones 1, 2 or 3 by
the number of markers in them, features that are far more frequent in marked texts of the same training shard.

Defined results: a text without words, null included, has the severity of the thresholds alone. Without labels every
severity is 0. Rows are scored one by one, repeated ones alike; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from papersheaf.llm import linear, words

KINDS = words.alphanumeric().astype(np.uint8)
STEMS = (4, 5, 6, 7, 8)  # bytes
GRADES = 4
MARKERS = (12, 36)  # from so many marker features on, grade 2 and grade 3; a word has up to six
MARKER_ODDS = 3.0
MOST = 3  # a feature counts at most so often in a text
GAP = 0.05


def features(texts: pa.Array) -> linear.Features:
    data, offsets = words.utf8(texts)
    found = words.split(data, offsets, KINDS)
    owner = found.documents()
    hashed = words.hashes(found, lower=True)
    parts = [(hashed, owner)]
    lengths = found.ends - found.starts
    for size in STEMS:
        long = np.flatnonzero(lengths > size)
        stem = words.Words(data, found.starts[long], found.starts[long] + size, np.zeros(1, np.int64))
        parts.append((words.mix(words.hashes(stem, lower=True) ^ words.PRIME), owner[long]))
    return linear.gathered(parts, len(offsets) - 1, linear.BITS)


def graded(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> np.ndarray:
    """Grades 0 to 3 for marks of 0 and 1, by the number of marker features."""
    size = 1 << linear.BITS
    seen = np.zeros((2, size))
    for (at, _), mark in zip(rows, toxic):
        seen[int(mark), at] += 1
    totals = np.bincount(toxic.astype(int), minlength=2)[:, None]
    odds = np.log((seen + 0.5) / (totals + 1))
    marker = (odds[1] - odds[0] > MARKER_ODDS) & (seen[1] >= 5)
    markers = np.array([counts[marker[at]].sum() for at, counts in rows])
    return np.where(toxic > 0, 1 + np.searchsorted(MARKERS, markers, side="right"), 0)


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int = GRADES) -> np.ndarray:
    """Weights of all buckets, then the thresholds, by FTRL on the likelihood of the grades."""
    model = linear.Ftrl(1 << linear.BITS, rate=0.2, l1=8.0, l2=0.01)
    thresholds = np.linspace(1.0, 3.0, n_grades - 1)
    moved = np.full(n_grades - 1, 1.0)
    for _ in range(linear.PASSES):
        for (at, counts), grade in zip(rows, grades):
            values = np.minimum(counts, MOST).astype(float)
            weights = model.weights(at)
            edges = np.concatenate([[-np.inf], thresholds, [np.inf]])[[grade, grade + 1]]
            low, high = linear.sigmoid(edges - weights @ values)
            chance = max(high - low, 1e-9)
            model.update(at, (1 - high - low) * values, weights)
            for k, slope in ((grade, -high * (1 - high)), (grade - 1, low * (1 - low))):
                if 0 <= k < n_grades - 1:
                    step = slope / chance
                    moved[k] += step * step
                    thresholds[k] -= 0.2 / np.sqrt(moved[k]) * step
            for k in range(1, n_grades - 1):  # keep the order
                thresholds[k] = max(thresholds[k], thresholds[k - 1] + GAP)
    return np.concatenate([model.weights(), thresholds])


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = linear.SAMPLE_ROWS) -> np.ndarray:
    """The model from a bounded sample of rows marked 0 or 1."""

    def train(texts: pa.ChunkedArray, marks: np.ndarray) -> np.ndarray:
        rows = linear.training_rows(texts, features)
        return fit_rows(rows, graded(rows, marks))

    return linear.fit_shards(linear.sample(documents, labels, label, max_rows), train)


def chances(found: linear.Features, model: np.ndarray, n_grades: int = GRADES) -> np.ndarray:
    """P(grade > k) for each document and threshold; a feature counts up to ``MOST`` times."""
    weights, thresholds = model[: 1 - n_grades], model[1 - n_grades :]
    held = np.flatnonzero(weights[found.index])
    owner = np.repeat(np.arange(len(found)), found.counts())[held]
    key, counts = np.unique(owner * (1 << linear.BITS) + found.index[held], return_counts=True)
    values = weights[key % (1 << linear.BITS)] * np.minimum(counts, MOST)
    dots = np.bincount(key >> linear.BITS, values, len(found))
    return linear.sigmoid(dots[:, None] - thresholds[None, :])


def _shared(documents: DataFrame, model: np.ndarray) -> Broadcast:
    if not len(model):
        model = np.append(np.zeros(1 << linear.BITS, np.float32), np.full(GRADES - 1, 35.0, np.float32))
    return documents.sparkSession.sparkContext.broadcast(model)  # of fixed size


def accepted(documents: DataFrame, model: np.ndarray) -> DataFrame:
    """The rows of ``documents``, with all their columns, that are not rejected."""
    shared, names = _shared(documents, model), documents.columns

    def kernel(batch: pa.RecordBatch) -> dict:
        kept = batch.filter(pa.array(chances(features(batch.column("text")), shared.value)[:, 0] < 0.5))
        return {name: kept.column(k) for k, name in enumerate(names)}

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return words.map_slices(documents, kernel, fields)


def score(documents: DataFrame, model: np.ndarray) -> DataFrame:
    """``(doc_id, severity, grade, score, toxic)``: expected and likeliest grade, P(grade > 0) and the decision."""
    shared = _shared(documents, model)

    def columns(texts: pa.Array) -> dict:
        over = chances(features(texts), shared.value)
        each = -np.diff(np.concatenate([np.ones((len(over), 1)), over, np.zeros((len(over), 1))], axis=1), axis=1)
        return {
            "severity": over.sum(1),
            "grade": each.argmax(1).astype(np.int32),
            "score": over[:, 0],
            "toxic": over[:, 0] >= 0.5,
        }

    return linear.scored(documents, columns, "severity double, grade int, score double, toxic boolean")
