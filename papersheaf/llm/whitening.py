"""Whitening of embeddings by principal components in mixed precision.

Vectors become whole numbers ``x = floor(64 * c) + 1000000``, so that sums and distances from the mean are exact. The components are the
unit eigenvectors of the covariance of the distinct vectors. The covariance is summed over all tasks, centred first; its eigenvectors are
found in float32 and then corrected by the iterations of Ogita and Aishima, which need matrix products only, in extended precision. Where
eigenvalues lie too close for single vectors to be told apart by the iteration, the small problem inside their common space is
solved by itself and the iteration goes on from there.

What grows with the number of dimensions only (the covariance, the components) is held by the driver; what grows with the
rows is summed by tasks, then in two steps by row of the matrix, so that no step adds up the parts of all tasks at once.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; so are empty vectors and, in a table of
several lengths, all but the longest, which have no common space. ``x`` of entries beyond ``LIMIT`` in size counts as that of the
limit. Equal vectors count once in the fit but every row is returned, whatever its ``vec_id``. Directions without
variance (at most ``NO_VARIANCE`` of the largest, as with fewer vectors than dimensions) give no component, so a table without two distinct
vectors gives no rows. A
deviation beyond 63 bits is null. Equal eigenvalues leave their components free within their common space; one choice holds for all rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersheaf.operators.blocks import arrow_schema
from papersheaf.session import discard, materialized

SCALE, SHIFT = 64, 1_000_000
LIMIT = float(1 << 40)
ROWS = 4096  # of a batch that are multiplied at once
WAYS = 64  # groups of the first of two steps that add up parts
PRECISE = np.longdouble
NO_VARIANCE = 1e-12  # of the largest eigenvalue
STEPS, PATIENCE, EXACT = 40, 3, 1e-18


def whole_numbers(vector: Column) -> Column:
    """``floor(64 * c) + 1000000`` of each entry, exact in doubles and kept in range."""
    bounded = lambda c: F.greatest(F.least(c.cast("double"), F.lit(LIMIT)), F.lit(-LIMIT))
    return F.transform(vector, lambda c: F.floor(bounded(c) * SCALE) + F.lit(SHIFT))


def usable(vector: Column) -> Column:
    """Whether a vector and all its entries are there and finite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at most ``ROWS`` rows and their ``x`` as whole numbers."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            column = part.column("x")
            yield part, column.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _added(parts: DataFrame, dimensions: int) -> np.ndarray:
    """Rows ``(line, way, data)`` added up by line, first within ways: one matrix of ``line`` rows."""
    out = arrow_schema(parts, "line int, data binary")

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(len(group.column("data")[0].as_py()) // 8)
        for data in group.column("data"):
            total += np.frombuffer(data.as_buffer(), np.float64)
        return pa.table([group.column("line").slice(0, 1), [total.tobytes()]], schema=out)

    schema = "line int, data binary"
    first = parts.groupBy("line", "way").applyInArrow(add, schema)
    rows = first.groupBy("line").applyInArrow(add, schema).orderBy("line").collect()  # one row a dimension
    return np.array([np.frombuffer(row.data, np.float64) for row in rows]).reshape(-1, dimensions)


@dataclass
class Fit:
    """What whitening needs: counts and sums of the distinct vectors, components as columns, and their eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def __post_init__(self):
        self.middle = np.array([round(s / self.n) if self.n else 0 for s in self.sums], np.int64)
        self.rest = np.array([(s - self.n * int(m)) / self.n if self.n else 0.0 for s, m in zip(self.sums, self.middle)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x`` less the mean: whole numbers less the rounded mean first, so nothing of it is lost."""
        return (x - self.middle).astype(np.float64) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.eigenvalues))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of ``(n * x - S) ** 2`` of each row, exact."""
        rest = [s - self.n * int(m) for s, m in zip(self.sums, self.middle)]
        apart = x - self.middle
        # the bound in doubles, with a margin, tells whether 64 bits suffice
        bound = (np.abs(apart).max(initial=0) * float(self.n) + max(map(abs, rest), default=0)) ** 2 * max(1, x.shape[1])
        if bound < 2.0**62:
            return ((apart * self.n - np.array(rest, np.int64)) ** 2).sum(1).tolist()
        exact = [sum((self.n * a - r) ** 2 for a, r in zip(row, rest)) for row in apart.tolist()]
        return [value if value < 1 << 63 else None for value in exact]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.asarray(a, PRECISE) @ np.asarray(b, PRECISE)


def _together(values: np.ndarray, gap: float) -> list[slice]:
    """Runs of two or more descending values, each within ``gap`` of the one before."""
    edges = np.flatnonzero(np.concatenate(([True], values[:-1] - values[1:] > gap, [True])))
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:]) if b - a > 1]


def _parts(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, PRECISE]:
    """How far ``x`` is from unit length and right angles, ``x' v x``, the eigenvalues of ``x`` and the bound on what is off."""
    off = np.eye(len(v), dtype=PRECISE) - _product(x.T, x)
    inner = _product(x.T, _product(v, x))
    values = np.diag(inner) / (1 - np.diag(off))
    outside = inner - np.diag(values)
    bound = 2 * (np.linalg.norm(outside.astype(np.float64)) + np.linalg.norm(values.astype(np.float64)) * np.linalg.norm(off.astype(np.float64)))
    return off, inner, values, bound


def eigenvectors(v: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors, as columns, of a symmetric matrix, to double precision.

    The start comes from float32. A step replaces ``x`` by ``x + x e`` with ``e_ij = (s_ij + l_j r_ij) / (l_j - l_i)``, where
    ``r = 1 - x'x`` and ``s = x'vx``; it squares the error of vectors whose eigenvalues stand apart. For eigenvalues nearer to each other
    than the error, ``e_ij = r_ij / 2`` keeps right angles only; their common space then gets accurate, and the matrix inside it, less its
    middle eigenvalue, is solved by the same method and turns the vectors.
    """
    scale = float(np.abs(v).max(initial=0))
    if not scale:
        return np.zeros(len(v)), np.eye(len(v))
    v = np.asarray(v, PRECISE) / scale
    start = np.linalg.eigh(v.astype(np.float32))[1][:, ::-1]
    x = _corrected(v, start.astype(PRECISE), steps)
    values = _parts(v, x)[2]
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x * x).sum(0))[order]
    return (values[order] * scale).astype(np.float64), x.astype(np.float64)


def _corrected(v: np.ndarray, x: np.ndarray, steps: int) -> np.ndarray:
    """The best ``x`` of the steps, which end when none gets better; close eigenvalues are solved among themselves between steps."""
    best, least, since = x, np.inf, 0
    for _ in range(steps):
        off, inner, values, bound = _parts(v, x)
        error = max(float(np.abs(off).max()), float(np.abs(inner - np.diag(values)).max()))
        if error < least:
            best, least, since = x, error, 0
        else:
            since += 1
        if error < EXACT or since == PATIENCE:
            break
        order = np.argsort(-values, kind="stable")
        x, off, inner, values = x[:, order], off[np.ix_(order, order)], inner[np.ix_(order, order)], values[order]
        apart = values[None, :] - values[:, None]
        near = np.abs(apart) <= bound
        x = x + _product(x, np.where(near, off / 2, (inner + values[None, :] * off) / np.where(near, 1, apart)))
        for group in _together(values, float(bound)):
            x[:, group] = _turned(v, x[:, group], float(values[group].mean()))
    return best


def _turned(v: np.ndarray, x: np.ndarray, middle: float) -> np.ndarray:
    """The vectors of close eigenvalues, turned within their common space to the eigenvectors of ``v`` in it."""
    x = x / np.sqrt((x * x).sum(0))
    for _ in range(2):  # right angles to extended precision
        x = x + _product(x, np.eye(x.shape[1], dtype=PRECISE) - _product(x.T, x)) / 2
    inner = _product(x.T, _product(v, x) - middle * x)
    inner = (inner + inner.T) / 2
    size = float(np.abs(inner).max())
    if size < 1e-18:  # equal to all digits: any right-angled vectors of the space are eigenvectors
        return x
    turn = np.linalg.eigh((inner / size).astype(np.float64))[1][:, ::-1].astype(PRECISE)
    for _ in range(2):
        turn = turn + _product(turn, np.eye(len(turn), dtype=PRECISE) - _product(turn.T, turn)) / 2
    return _product(x, turn)


def _sums(fit: DataFrame) -> list[int]:
    """Exact sums of each dimension; whole numbers of a batch stay below 63 bits, the rest are decimals."""
    out = arrow_schema(fit, "line int, total bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _batches(batches):
            yield from pa.table([np.arange(x.shape[1], dtype=np.int32), x.sum(0)], schema=out).to_batches()

    parts = fit.mapInArrow(run, "line int, total bigint")
    rows = parts.groupBy("line").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("line").collect()
    return [int(row.total) for row in rows]


def _moments(fit: DataFrame, dimensions: int, columns, mean: bool = False) -> np.ndarray:
    """The sums over the rows of the products of ``columns(x)``, and in a last line of the columns themselves if asked for."""
    out = arrow_schema(fit, "line int, way int, data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((dimensions + mean, dimensions))
        for _, x in _batches(batches):
            y = columns(x)
            total[:dimensions] += y.T @ y
            if mean:
                total[dimensions] += y.sum(0)
        way = TaskContext.get().partitionId() % WAYS
        lines = [data.tobytes() for data in total]
        yield from pa.table([range(len(lines)), [way] * len(lines), lines], schema=out).to_batches()

    return _added(fit.mapInArrow(run, "line int, way int, data binary"), dimensions)


def fit_components(fit: DataFrame, components: int) -> Fit:
    """The model of distinct vectors, a written table with a column ``x`` of arrays of one length."""
    n, sums = fit.count(), _sums(fit)
    if n < 2:
        return Fit(n, sums, np.zeros((len(sums), 0)), np.zeros(0), 0.0)
    model = Fit(n, sums, np.zeros((len(sums), 0)), np.zeros(0), 0.0)
    covariance = _moments(fit, len(sums), model.centred) / n
    covariance = (covariance + covariance.T) / 2
    values, found = eigenvectors(covariance)
    keep = int((values[:components] > NO_VARIANCE * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    return Fit(n, sums, found[:, :keep], values[:keep], float(np.trace(covariance)))


def identity_error(fit: DataFrame, model: Fit) -> float:
    """The largest entry of the covariance of the whitened distinct vectors less the identity, from a pass over them."""
    k = len(model.eigenvalues)
    moments = _moments(fit, k, model.whitened, mean=True)
    mean = moments[k] / model.n
    return float(np.abs(moments[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = 16) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for each usable row and component.

    Whole numbers are written once; of them the distinct ones are the fit. Grouping is combined in tasks first, so a vector that most
    rows share shrinks before the shuffle.
    """
    spark = embeddings.sparkSession
    schema = (
        f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, "
        "explained double, identity_error double"
    )
    kept = embeddings.filter(usable(F.col("embedding"))).select("vec_id", whole_numbers(F.col("embedding")).alias("x"))
    kept = materialized(kept)
    lengths = [row[0] for row in kept.agg(F.min(F.size("x")), F.max(F.size("x"))).select(F.array("*")).collect()][0]
    if lengths[0] is None:
        return spark.createDataFrame([], schema)
    rows = kept if lengths[0] == lengths[1] else kept.filter(F.size("x") == lengths[1])
    fit = materialized(rows.select("x").distinct())
    model = fit_components(fit, components)
    k = len(model.eigenvalues)
    if not k:
        return spark.createDataFrame([], schema)
    error = identity_error(fit, model)
    discard(fit)
    out = arrow_schema(rows, schema)
    explained = model.eigenvalues / model.trace
    shared = spark.sparkContext.broadcast(model)  # bounded by the square of the dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part, x in _batches(batches):
            m = part.num_rows
            columns = [
                part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n)),
                pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(model.whitened(x).ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield from pa.table(columns, schema=out).to_batches()

    return rows.mapInArrow(run, schema)
