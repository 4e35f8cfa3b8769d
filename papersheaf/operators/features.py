"""Cluster features: many near rows as one count, vector sum and sum of squared lengths.

Features add up, so tasks make theirs alone, row by row as rows come, and features of different tasks are put together in the same way
afterwards, near ones in one group. A row joins the nearest feature if the root mean square distance of its members from
their mean stays within ``radius``; otherwise it begins a new one. A task that would hold more than ``max_features`` raises its own radius and
puts its features together anew, so memory is bounded whatever the rows. What is clustered afterwards is the features, by their means
and counts; Ward's heights depend on nothing else. Features of radius 0 are the distinct vectors (as long as they are fewer than
``max_features`` in a task), and their tree is that of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersheaf.functions import vectors
from papersheaf.operators import agglomerative, blocks
from papersheaf.session import materialized

MAX_FEATURES = 4096
GROWTH = 1.5
ROUNDING = 1e-14  # of a squared length, by which equal vectors may seem to differ


class Features:
    """The features of one task or group; each is named by the id that began it."""

    def __init__(self, dimension: int, radius: float, limit: int):
        self.radius, self.limit = radius, limit
        self.names: list = []
        self.n, self.squares = np.zeros(64), np.zeros(64)
        self.sums, self.means = np.zeros((64, dimension)), np.zeros((64, dimension))
        self.lengths = np.zeros(64)
        self.merged: dict = {}  # name of a feature that has joined another one: the other's name

    def add(self, name, n: float, total: np.ndarray, squares: float):
        """Puts a row or a feature in its place and returns the name of the feature that holds it."""
        m = len(self.names)
        if m:
            mean = total / n
            near = int((self.lengths[:m] - 2.0 * (self.means[:m] @ mean)).argmin())
            size, both = self.n[near] + n, self.sums[near] + total
            # the spread around the joint mean, from the two spreads and the distance of the two means
            gap = self.means[near] - mean
            spread = max(0.0, self._spread(near)) + max(0.0, squares - n * float(mean @ mean)) + self.n[near] * n / size * float(gap @ gap)
            if spread <= size * (self.radius**2 + ROUNDING * float(mean @ mean)):
                self._put(near, size, both, self.squares[near] + squares)
                return self.names[near]
        if m == self.limit:
            self._wider()
            return self.add(name, n, total, squares)
        if m == len(self.n):
            for field in ("n", "squares", "sums", "means", "lengths"):
                old = getattr(self, field)
                setattr(self, field, np.concatenate([old, np.zeros_like(old)]))
        self.names.append(name)
        self._put(m, n, total, squares)
        return name

    def _spread(self, k: int) -> float:
        return float(self.squares[k] - self.n[k] * self.lengths[k])

    def _put(self, k: int, n: float, total: np.ndarray, squares: float) -> None:
        self.n[k], self.sums[k], self.squares[k] = n, total, squares
        self.means[k] = total / n
        self.lengths[k] = float(self.means[k] @ self.means[k])

    def _wider(self) -> None:
        """Raises the radius until at least one pair of features has become one."""
        m = len(self.names)
        d = blocks.squared_distances(self.means[:m], self.means[:m], same=True)
        np.fill_diagonal(d, np.inf)
        wide = float(np.sqrt(np.median(d.min(1)))) / 2
        radius = max(self.radius * GROWTH, wide)
        while True:
            fresh = Features(self.sums.shape[1], radius, self.limit)
            merged = {}
            for k, name in enumerate(self.names):
                holder = fresh.add(name, self.n[k], self.sums[k], self.squares[k])
                if holder != name:
                    merged[name] = holder
            if merged:
                break
            radius *= GROWTH
        for field in ("names", "n", "squares", "sums", "means", "lengths", "radius"):
            setattr(self, field, getattr(fresh, field))
        self.merged.update(merged)

    def holder(self, name):
        while name in self.merged:
            name = self.merged[name]
        return name


def _table(out: pa.Schema, held: Features | None, members: list[tuple], links: bool) -> pa.Table:
    """Members, or with ``links`` earlier names, as ``(doc_id, feature)``; features as ``(feature, n, total, squares)``."""
    names = held.names if held is not None else []
    m, k = len(names), len(members)
    columns = {
        "doc_id": [a for a, _ in members] + [None] * m, "feature": [b for _, b in members] + names, "link": [links] * k + [None] * m,
        "n": [None] * k + [int(v) for v in (held.n[:m] if m else [])], "total": [None] * k + (list(held.sums[:m]) if m else []),
        "squares": [None] * k + (held.squares[:m].tolist() if m else []),
    }
    return pa.table({f.name: pa.array(columns[f.name], f.type) for f in out}, schema=out)


def cluster_features(
    points: DataFrame, radius: float, max_features: int = MAX_FEATURES, block_rows: int = blocks.BLOCK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """``(feature, n, total, squares)`` and ``(doc_id, feature)`` for every row. A feature is named by one of its ids."""
    id_type = points.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, feature {id_type}, link boolean, n bigint, total array<double>, squares double"
    out = blocks.arrow_schema(points, schema)

    def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Features | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = blocks.matrix(batch.column("embedding"))
            held = held or Features(x.shape[1], radius, max_features)
            ids = batch.column("doc_id").to_pylist()
            members = [(name, held.add(name, 1.0, row, float(row @ row))) for name, row in zip(ids, x)]
            yield from _table(out, None, members, False).to_batches()
        if held is not None:
            yield from _table(out, held, [(name, held.holder(name)) for name in held.merged], True).to_batches()

    rows = points.select("doc_id", vectors.doubles(F.col("embedding")).alias("embedding"))
    made = materialized(rows.mapInArrow(by_task, schema))
    local = made.filter("link is null").drop("doc_id", "link")
    own = _followed(made.filter("not link").select("doc_id", "feature"), made.filter("link"))

    mean = F.transform("total", lambda v: v / F.col("n"))
    clusters = local.select(
        F.col("feature").alias("doc_id"), mean.alias("embedding"), F.col("n").alias("weight"), "squares",
        F.lit(0.0).alias("bound"), F.lit(0.0).alias("inner"),
    )
    placed = agglomerative.near_groups(clusters, clusters.count(), block_rows)

    def together(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        x, n = blocks.matrix(table.column("embedding")), table.column("weight").to_numpy().astype(float)
        held = Features(x.shape[1], radius, max_features)
        squares = table.column("squares").to_numpy()
        names = table.column("doc_id").to_pylist()
        first = {name: held.add(name, n[k], x[k] * n[k], squares[k]) for k, name in enumerate(names)}
        links = [(name, held.holder(to)) for name, to in first.items()]
        return _table(out, held, [(name, to) for name, to in links if name != to], True)

    joined = materialized(placed.select("doc_id", "embedding", "weight", "squares", "cell").groupBy("cell").applyInArrow(together, schema))
    return joined.filter("link is null").drop("doc_id", "link"), _followed(own, joined.filter("link"))


def _followed(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members with the last name of their feature."""
    to = links.select(F.col("doc_id").alias("feature"), F.col("feature").alias("to"))
    return members.join(to, "feature", "left").select("doc_id", F.coalesce("to", "feature").alias("feature"))


def agglomerative_over_features(
    points: DataFrame, n_clusters: int, radius: float, max_features: int = MAX_FEATURES, block_rows: int = blocks.BLOCK_ROWS
) -> DataFrame:
    """``(doc_id, cluster_id)``: Ward over features, cut at ``n_clusters`` and numbered by size, then id."""
    features, members = cluster_features(points, radius, max_features, block_rows)
    mean = F.transform("total", lambda v: v / F.col("n"))
    state = materialized(features.select(F.col("feature").alias("doc_id"), mean.alias("embedding"), F.col("n").alias("weight")))
    size = blocks.measure(state)
    merges = agglomerative.reducible_merges(state, size, "ward", block_rows)
    labels = agglomerative.cut_labels(state, size, merges, n_clusters).withColumnRenamed("doc_id", "feature")
    return agglomerative.numbered(members.join(labels, "feature").select("doc_id", "label"))
