"""Linear models on hashed text features: features of slices, bounded training samples, FTRL updates, sparse scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersheaf.llm import words
from papersheaf.llm.tables import measured
from papersheaf.operators.blocks import arrow_schema

BITS = 18
SHARD_ROWS = 8_000
SAMPLE_ROWS = 32_000
PASSES = 12  # over a shard, whatever its size


@dataclass
class Features:
    """Hashed features of a slice: those of document ``d`` are ``index[bounds[d]:bounds[d + 1]]``, repeats included."""

    index: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """The sum of weights over each document's features: a sparse dot product with counts."""
        total = np.zeros(len(self.index) + 1)
        np.cumsum(weights[self.index], out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def row(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.index[self.bounds[k] : self.bounds[k + 1]], return_counts=True)


def gathered(parts: list[tuple[np.ndarray, np.ndarray]], documents: int, bits: int) -> Features:
    """Features from pairs of hashes and the document of each."""
    hashed = np.concatenate([h for h, _ in parts])
    owner = np.concatenate([d for _, d in parts])
    order = np.argsort(owner, kind="stable")
    index = (hashed[order] >> np.uint64(64 - bits)).astype(np.int64)
    return Features(index, np.searchsorted(owner[order], np.arange(documents + 1)))


Extract = Callable[[pa.Array], Features]


class Ftrl:
    """Per-coordinate follow-the-regularised-leader with both penalties; weights are derived when asked for."""

    def __init__(self, size: int, rate: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.rate, self.beta, self.l1, self.l2 = rate, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.rate + self.l2)

    def update(self, at: np.ndarray, gradient: np.ndarray, weights: np.ndarray) -> None:
        squared = gradient * gradient
        sigma = (np.sqrt(self.n[at] + squared) - np.sqrt(self.n[at])) / self.rate
        self.z[at] += gradient - sigma * weights
        self.n[at] += squared


def sample(documents: DataFrame, labels: DataFrame, label: str, max_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, text, label, shard)`` for a bounded share of the labelled rows, chosen and dealt out by a hash of the id.

    All labelled rows are taken while they are at most ``max_rows``; beyond, each is taken with the same chance, so that about
    ``max_rows`` are. Rows without id, text or label are left out; an id with different labels counts by the larger.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    total = known.count()
    share = min(1.0, max_rows / max(1, total))
    shards = max(1, round(share * total / SHARD_ROWS))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = known.filter(place < F.lit(int(share * (1 << 30))))
    texts = documents.filter("text is not null").select("doc_id", "text")
    rows = texts.join(measured(chosen, 24), "doc_id")
    return rows.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards)).cast("int"))


def fit_shards(rows: DataFrame, fit: Callable[[list[str], np.ndarray], np.ndarray]) -> np.ndarray:
    """The mean of the models that ``fit`` makes from each shard of a sample.

    A shard holds about ``SHARD_ROWS`` rows, and one model of fixed size per shard comes to the driver.
    """
    out = arrow_schema(rows, "rows bigint, model binary")

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        model = fit(table.column("text"), table.column("label").to_numpy())
        words.give_back()
        return pa.table({"rows": [table.num_rows], "model": [model.astype("<f4").tobytes()]}, schema=out)

    models = rows.groupBy("shard").applyInArrow(train, "rows bigint, model binary").collect()
    if not models:
        return np.zeros(0, np.float32)
    shares = np.array([m["rows"] for m in models], float)
    stacked = np.stack([np.frombuffer(m["model"], "<f4") for m in models])
    return (stacked * (shares / shares.sum())[:, None]).sum(0).astype(np.float32)


def training_rows(texts: pa.ChunkedArray, extract: Extract) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct features of each text and how often each occurs, made slice by slice."""
    rows = []
    for part in words.slices(iter(pa.table({"text": texts}).to_batches())):
        found = extract(part.column("text"))
        for k in range(len(found)):
            at, counts = found.row(k)
            rows.append((at.astype(np.int32), counts.astype(np.float32)))
    return rows


def scored(documents: DataFrame, columns: Callable[[pa.Array], dict], schema: str) -> DataFrame:
    """``doc_id`` and the columns that a model gives for each whole text."""

    def kernel(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), **columns(batch.column("text"))}

    return words.map_slices(documents.select("doc_id", "text"), kernel, f"doc_id bigint, {schema}")


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
