"""k-means in which every pass over the data serves all restarts and all k at once.

The state that travels is small: one vector sum per restart and cluster. Restarts are packed into
passes as far as their centres stay below a byte limit. Starts are drawn from candidates that any row can be among.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersheaf.functions import vectors
from papersheaf.operators import blocks

SEED = 42
RESTARTS = 10
MAX_ITER = 300
TOLERANCE = 1e-4
SEEDING_ROWS = 256  # expected draws of a round, at least
SEEDING_FACTOR = 4  # expected draws of a round, per centre
SEEDING_ROUNDS = 4
LIMIT_BYTES = blocks.TARGET_BYTES
PARTIAL_BYTES = 256 * 1024  # partial sums of one pass that the driver adds up itself, at most: there may be hundreds of passes
TASKS_PER_CORE = 2  # of a pass: each task returns sums for all centres
PASS_CELLS = 1 << 18  # distances that a task holds at a time: they stay in its cache


@dataclass
class KMeansFit:
    """Centres ordered by descending cluster size, with the inertia of the best restart."""

    centers: np.ndarray
    inertia: float
    passes: int

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, [float(v) for v in c]) for i, c in enumerate(self.centers)]
        return spark.createDataFrame(rows, "cluster_id int, center array<double>")


def _chances(x: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) for each row of a matrix, from its values alone, so that it does not depend on the task."""
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
    mixed = np.full(len(x), salt * 2 + 1, np.uint64)
    for column in bits.T:
        mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def candidates(packed: DataFrame, rows: int, wanted: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors to draw starting centres from, with the number of rows nearest to each.

    Every row can become one. About ``wanted`` rows come from an even draw; in each of a few more rounds, about as many
    are drawn with a chance in proportion to their squared distance to those at hand, so rows far from all others
    are found however few they are. The expected number depends on ``wanted`` alone.
    """
    dimension = packed.select("dimension").first()[0]

    def scan(schema: str, known: np.ndarray, each: Callable[[np.ndarray, np.ndarray], dict]) -> DataFrame:
        """``each`` on every slice of rows and their squared distances to ``known``."""
        out = blocks.arrow_schema(packed, schema)
        shared = packed.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in blocks.unpack(batches, max(1, len(shared.value))):
                near = blocks.squared_distances(x, shared.value) if len(shared.value) else np.ones((len(x), 1))
                yield from pa.table(each(x, near), schema=out).to_batches()

        return packed.mapInArrow(run, schema)

    def draw(known: np.ndarray, total: float, number: int, salt: int) -> np.ndarray:
        def drawn(x: np.ndarray, near: np.ndarray) -> dict:
            chosen = x[_chances(x, salt) < number * near.min(1) / total]
            return {"data": [row.tobytes() for row in np.unique(chosen, axis=0)]}

        rows = scan("data binary", known, drawn).distinct().collect()
        return np.frombuffer(b"".join(sorted(r["data"] for r in rows))).reshape(-1, dimension)

    def cost(x: np.ndarray, near: np.ndarray) -> dict:
        return {"cost": [float(near.min(1).sum())]}

    def nearest(x: np.ndarray, near: np.ndarray) -> dict:
        found, n = np.unique(near.argmin(1), return_counts=True)
        return {"candidate": found, "n": n}

    have, number = np.zeros((0, dimension)), wanted
    while not len(have):  # a draw from few rows may find none
        have = draw(have, float(rows), number, seed * 1000)
        number *= 16
    for turn in range(1, SEEDING_ROUNDS):
        total = scan("cost double", have, cost).agg(F.sum("cost")).first()[0]
        if total <= 1e-12 * rows:
            break
        have = np.concatenate([have, draw(have, total, wanted, seed * 1000 + turn)])
    counts = np.zeros(len(have))
    for row in scan("candidate int, n bigint", have, nearest).groupBy("candidate").agg(F.sum("n").alias("n")).collect():
        counts[row["candidate"]] = row["n"]
    return have, counts


def spread_start(candidates: np.ndarray, counts: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Starting centres drawn with probability proportional to the rows at a candidate and its squared distance to those chosen."""
    tries = 2 + int(np.log(k)) if k > 1 else 1
    chosen = [int(rng.choice(len(candidates), p=counts / counts.sum()))]
    nearest = blocks.squared_distances(candidates, candidates[chosen])[:, 0]
    while len(chosen) < k:
        mass = (counts * nearest).sum()
        weights = counts * nearest / mass if mass > 0 else None
        options = rng.choice(len(candidates), size=tries, p=weights)
        gains = np.minimum(nearest, blocks.squared_distances(candidates, candidates[options]).T)
        best = int((gains * counts).sum(1).argmin())
        chosen.append(int(options[best]))
        nearest = gains[best]
    return candidates[chosen]


@dataclass
class Sums:
    """What one pass finds for one set of centres."""

    sizes: np.ndarray
    totals: np.ndarray
    cost: float = 0.0


def _by_size(sets: list[np.ndarray]) -> list[tuple[list[int], int]]:
    """The sets of each number of centres, with that number."""
    return [([r for r, c in enumerate(sets) if len(c) == k], k) for k in sorted({len(c) for c in sets})]


def _assigned(x: np.ndarray, groups: list[tuple[list[int], int]], known: np.ndarray) -> Iterator[tuple]:
    """For each of ``groups`` its sets, the sums of rows and their number by ``(cluster, set)``, and the inertia by set.

    ``known`` has the centres of ``_stacked``. A slice of rows meets all sets of a group at once, one cluster after the other.
    """
    ones = np.ones((len(x), 1))
    whole = np.hstack([x, ones])
    length = (x * x).sum(1)
    d = known @ whole.T
    start = 0
    for members, k in groups:
        some = d[start : start + k * len(members)].reshape(k, len(members), len(x))
        start += k * len(members)
        least = some.min(0)
        member = (some == least).astype(np.float64)
        if member.sum() != least.size:  # centres at equal distance: the first one takes the row
            member = np.equal(some.argmin(0)[None], np.arange(k)[:, None, None]).astype(np.float64)
        sums = member.reshape(-1, len(x)) @ whole
        yield members, sums.reshape(k, len(members), -1), np.maximum(least + length, 0.0).sum(1)


def _stacked(sets: list[np.ndarray], groups: list[tuple[list[int], int]]) -> np.ndarray:
    """One row ``(-2 centre, squared length)`` for each cluster and set of each group: its product with ``(row, 1)`` ranks distances."""
    rows = np.concatenate([np.stack([sets[r] for r in members], axis=1).reshape(k * len(members), -1) for members, k in groups])
    return np.hstack([-2.0 * rows, (rows * rows).sum(1)[:, None]])


def _one_pass(packed: DataFrame, partitions: int, centers: list[np.ndarray]) -> list[Sums]:
    """Assign all rows under every set of centres: cluster sizes, vector sums and inertia of each set."""
    schema = "run int, data binary"  # the sums of a set with the number of rows as last column, then its inertia
    out = blocks.arrow_schema(packed, schema)
    shared = packed.sparkSession.sparkContext.broadcast(centers)

    def table(found: dict[int, np.ndarray]) -> list[pa.RecordBatch]:
        return pa.table([list(found), [sums.tobytes() for sums in found.values()]], names=out.names).cast(out).to_batches()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = shared.value
        groups = _by_size(sets)
        known = _stacked(sets, groups)
        found = [[np.zeros((k, len(members), known.shape[1])), np.zeros(len(members))] for members, k in groups]
        step = max(64, PASS_CELLS // len(known))
        for block in blocks.unpack(batches, len(known)):
            for start in range(0, len(block), step):
                for held, (_, sums, cost) in zip(found, _assigned(block[start : start + step], groups, known)):
                    held[0] += sums
                    held[1] += cost
        for (members, _), (sums, cost) in zip(groups, found):
            yield from table({r: np.append(sums[:, i].ravel(), cost[i]) for i, r in enumerate(members)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for run, data in zip(*(batch.column(c) for c in out.names)):
                sums = np.frombuffer(data.as_buffer())
                found[run.as_py()] = found.get(run.as_py(), 0.0) + sums
        yield from table(found)

    partial = packed.mapInArrow(scan, schema)
    sent = sum(c.size for c in centers) * 8 * partitions
    if partitions > 1 and sent > PARTIAL_BYTES:  # too many partial sums for the driver
        dealt = partial.withColumn("part", F.spark_partition_id()).repartition(-(-sent // LIMIT_BYTES), "run")
        partial = dealt.sortWithinPartitions("run", "part").select(*out.names).mapInArrow(add, schema)  # in the driver's order
    results = [Sums(np.zeros(len(c)), np.zeros(c.shape)) for c in centers]
    for batch in partial.toArrow().to_batches():
        for run, data in zip(*(batch.column(c) for c in out.names)):
            result, values = results[run.as_py()], np.frombuffer(data.as_buffer())
            sums = values[:-1].reshape(len(result.sizes), -1)
            result.sizes += sums[:, -1]
            result.totals += sums[:, :-1]
            result.cost += float(values[-1])
    shared.unpersist()
    return results


def lloyd(packed: DataFrame, starts: list[np.ndarray], max_iter: int, tolerance: float) -> list[KMeansFit]:
    """Lloyd iterations over packed vectors from all starts together; a start leaves the passes once its centres rest.

    A centre that loses all its rows stays where it is.
    """
    centers = [s.copy() for s in starts]
    fits: list[KMeansFit | None] = [None] * len(starts)
    moving = list(range(len(starts)))
    settled: set[int] = set()
    partitions = packed.rdd.getNumPartitions()
    for passes in range(1, max_iter + 2):
        results = _one_pass(packed, partitions, [centers[i] for i in moving])
        after = []
        for i, found in zip(moving, results):
            if i in settled or passes > max_iter:
                order = np.lexsort((*centers[i].T[::-1], -found.sizes))
                fits[i] = KMeansFit(centers[i][order], found.cost, passes)
                continue
            filled = found.sizes > 0
            new = centers[i].copy()
            new[filled] = found.totals[filled] / found.sizes[filled, None]
            if ((new - centers[i]) ** 2).sum() <= tolerance:
                settled.add(i)
            centers[i] = new
            after.append(i)
        moving = after
        if not moving:
            break
    return fits


@dataclass
class Spread:
    """Rows, dimensions and the mean over dimensions of the variance."""

    rows: int
    dimension: int
    variance: float


def _spread(points: DataFrame) -> Spread:
    summary = Summarizer.metrics("count", "variance").summary(array_to_vector(vectors.doubles(F.col("embedding"))))
    row = points.agg(summary.alias("s")).first().s
    sample = float(np.mean(row.variance.toArray()))
    return Spread(row["count"], len(row.variance), sample * (row["count"] - 1) / row["count"])


def _prepared(points: DataFrame, wanted: int) -> DataFrame:
    """Packed vectors in about as many partitions as the work of a pass is worth.

    Large inputs keep their partitions; only inputs with fewer than there are cores are shared out.
    """
    cores = points.sparkSession.sparkContext.defaultParallelism
    have = points.rdd.getNumPartitions()
    if have < min(cores, wanted):
        points = points.repartition(min(cores, wanted))
    return blocks.pack(points).persist()


def fit_many(
    points: DataFrame,
    ks: list[int],
    seed: int = SEED,
    restarts: int = RESTARTS,
    max_iter: int = MAX_ITER,
    tolerance: float = TOLERANCE,
    limit_bytes: int = LIMIT_BYTES,
) -> dict[int, KMeansFit]:
    """The best of ``restarts`` fits, by inertia, for every k."""
    data = _spread(points)
    absolute = tolerance * data.variance
    per_pass = max(1, limit_bytes // max(1, max(ks) * data.dimension * 8))
    centres = max(ks) * min(per_pass, len(ks) * restarts)
    wanted = blocks.tasks_for(float(data.rows) * data.dimension * centres)
    kept = _prepared(points, wanted)
    try:
        used = kept.coalesce(min(wanted, TASKS_PER_CORE * points.sparkSession.sparkContext.defaultParallelism))
        rows, counts = candidates(used, data.rows, max(SEEDING_ROWS, SEEDING_FACTOR * max(ks)), seed)
        runs = [
            (k, spread_start(rows, counts, k, np.random.default_rng([seed, k, r]))) for k in ks for r in range(restarts)
        ]
        best: dict[int, KMeansFit] = {}
        for first in range(0, len(runs), per_pass):
            some = runs[first : first + per_pass]
            for (k, _), fit in zip(some, lloyd(used, [s for _, s in some], max_iter, absolute)):
                if k not in best or fit.inertia < best[k].inertia:
                    best[k] = fit
        return best
    finally:
        kept.unpersist()


def kmeans(
    points: DataFrame,
    k: int,
    seed: int = SEED,
    restarts: int = RESTARTS,
    max_iter: int = MAX_ITER,
    limit_bytes: int = LIMIT_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """``(assignments, centers)``; clusters are numbered by descending size.

    The centres are ``k`` vectors, a size that the caller sets and the data do not change. ``limit_bytes`` bounds the
    centres that share a pass and those that are broadcast for the assignment; the result is the same for any value.
    """
    centers = fit_many(points, [k], seed, restarts, max_iter, limit_bytes=limit_bytes)[k].table(points.sparkSession)
    return kmeans_assign(points, centers, limit_bytes=limit_bytes), centers


def kmeans_assign(
    points: DataFrame, centers: DataFrame, keep_vector: bool = False, limit_bytes: int = LIMIT_BYTES
) -> DataFrame:
    """Nearest centre of every document; equal distances go to the smaller cluster id."""

    def kernel(rows: pa.Table, targets: pa.Table) -> dict:
        targets = targets.sort_by("cluster_id")
        d = blocks.squared_distances(blocks.matrix(rows.column("embedding")), blocks.matrix(targets.column("embedding")))
        label = d.argmin(1)
        result = {
            "doc_id": rows.column("doc_id"),
            "cluster_id": targets.column("cluster_id").to_numpy()[label],
            "distance": np.sqrt(d[np.arange(len(d)), label]),
        }
        return {**result, "embedding": rows.column("embedding")} if keep_vector else result

    id_type = points.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, cluster_id int, distance double"
    best = F.min(F.struct("distance", "cluster_id")).alias("best")
    extra = [F.any_value("embedding").alias("embedding")] if keep_vector else []
    picked = ["doc_id", "best.cluster_id", "best.distance"] + (["embedding"] if keep_vector else [])
    return blocks.against(
        points.select("doc_id", vectors.doubles(F.col("embedding")).alias("embedding")),
        centers.select("cluster_id", F.col("center").alias("embedding")),
        blocks.each(kernel),
        schema + (", embedding array<double>" if keep_vector else ""),
        reduce=lambda parts: parts.groupBy("doc_id").agg(best, *extra).select(*picked),
        limit_bytes=limit_bytes,
    )


def kmeans_step(points: DataFrame, centers: DataFrame, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """One Lloyd update: the mean of the rows nearest to each centre; a centre without rows stays."""
    assigned = kmeans_assign(points, centers, keep_vector=True, limit_bytes=limit_bytes)
    means = assigned.groupBy("cluster_id").agg(
        F.count("*").alias("n"), vector_to_array(Summarizer.mean(array_to_vector("embedding"))).alias("mean")
    )
    return centers.join(means, "cluster_id", "left").select(
        "cluster_id",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("mean", "center").alias("center"),
    )
