"""Bottom-up clustering on a table of clusters.

Ward and average linkage: a merged cluster is never nearer to a third one than the nearer of its two parts was. So all pairs of
clusters that are nearest to each other may merge at once, which gives the same tree as merging one pair at a time, and
the nearest partner of a cluster stays its nearest as long as neither of them merges. So each round only searches for the
clusters that are new or have lost their partner, among all clusters, in tiles of packed blocks; pairs that name each other merge.
Once no more clusters are left than one task searches in some seconds, it merges the rest in the same way, the last ``LAST_ROWS`` in a matrix.

Single linkage: one search finds some nearest rows of every row. Each round adds the shortest edge that leaves each component but the
largest one; only rows whose known neighbours all lie in their own component, and may have more that matter, search again.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papersheaf.functions import ranking
from papersheaf.operators import blocks, metrics
from papersheaf.operators.components import connected_components
from papersheaf.session import discard, materialized

LINKAGES = ("ward", "average", "single")
PIVOTS = 1024
NEAREST = 8
SCARCE = 100
PRODUCTS = (512, 2048)  # rows and clusters of one product of a search
CROWDED = 1 / 32  # of its cells, beyond which single precision tells too little
MEASURED = 1 << 16  # cells measured at once
LAST_ROWS = 5000  # clusters whose heights one task holds: a matrix of 200 MB
LAST_PRODUCTS = 70_000_000_000  # of a search among all clusters that are left to one task


def ward_heights(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The growth of spread, as a distance, that merging clusters with these means and sizes brings."""
    d = blocks.squared_distances(x, y)
    d /= (0.5 / n)[:, None] + (0.5 / m)[None, :]
    return np.sqrt(d, out=d)


def average_heights(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The mean cosine distance between the members of clusters with these means of unit vectors."""
    return 1.0 - x @ y.T


HEIGHTS = {"ward": ward_heights, "average": average_heights}


def _narrowed(x: np.ndarray, y: np.ndarray, kind: type = np.float32) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """``(a, b, lengths, scale)``: ``a @ b <= limit * scale ** 2 - lengths`` holds for all rows within ``limit``, a squared distance.

    Both matrices lie around a common centre, in the precision ``kind`` and with values up to 1; squared lengths are less what rounding may add.
    """
    usable = y[np.isfinite(y).all(1)]
    centre = usable.mean(0) if len(usable) else np.zeros(y.shape[1])
    x, y = x - centre, y - centre
    largest = max(np.abs(v[np.isfinite(v)]).max(initial=0.0) for v in (x, y))
    scale = 1.0 / largest if largest > 0 else 1.0
    x, y = x * scale, y * scale
    share = 1.0 - 4.0 * (x.shape[1] + 8) * float(np.finfo(kind).eps)
    a = np.hstack([-2.0 * x, np.ones((len(x), 1))]).astype(kind)
    b = np.hstack([y, share * (y * y).sum(1)[:, None]]).astype(kind)
    return a, np.ascontiguousarray(b.T), share * (x * x).sum(1), scale


def _nearest_rows(x: np.ndarray, own: np.ndarray, y: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``x`` the ``NEAREST`` rows of ``y`` of other labels, the first of equal ones: rows, places in ``y`` and distances.

    A product of single precision leaves out what is too far for certain; what it leaves is measured by differences, which
    are the same from both ends.
    """
    a, b, lengths, scale = _narrowed(x, y)
    strip, columns = blocks.SLICE_ROWS
    near, at = np.full((len(x), NEAREST), np.inf), np.full((len(x), NEAREST), -1)
    starts = [0, *[s for s in (strip, 4 * strip) if s < len(y)], *range(2 * columns, len(y), 2 * columns)]  # the first ones set limits
    for i in range(0, len(x), strip):
        rows = slice(i, min(i + strip, len(x)))
        some, mine, shift, best, place = x[rows], own[rows], lengths[rows], near[rows], at[rows]
        for j, end in zip(starts, [*starts[1:], len(y)]):
            h = a[rows] @ b[:, j:end]
            if j == 0:
                limit = _limit(h, some, mine, y[:end], other[:end])
            within = (limit * scale * scale - shift + 1e-37).astype(np.float32)
            r, c = np.divmod(np.flatnonzero(h <= within[:, None]), end - j)  # few: faster than by rows and columns
            c += j
            outside = mine[r] != other[c]
            r, c = r[outside], c[outside]
            gap = some[r] - y[c]
            d = (gap * gap).sum(1)
            closer = (d <= limit[r]) & (d < best[r, -1])
            if not closer.any():
                continue
            r, c, d = r[closer], c[closer], d[closer]
            touched = np.unique(r)
            r = np.concatenate([np.repeat(touched, NEAREST), r])
            d, c = np.concatenate([best[touched].ravel(), d]), np.concatenate([place[touched].ravel(), c])
            order = np.lexsort((c, d, r))
            r, d, c = r[order], d[order], c[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            kept = rank < NEAREST
            best[r[kept], rank[kept]], place[r[kept], rank[kept]] = d[kept], c[kept]
            limit = np.minimum(limit, best[:, -1])
    r, k = np.nonzero(np.isfinite(near))
    return r, at[r, k], np.sqrt(near[r, k])


def _limit(h: np.ndarray, x: np.ndarray, own: np.ndarray, y: np.ndarray, other: np.ndarray) -> np.ndarray:
    """A squared distance for each row of ``x`` within which ``NEAREST`` rows of ``y`` of other labels lie, infinite if there are fewer."""
    if len(y) < NEAREST:
        return np.full(len(x), np.inf)
    outside = np.where(own[:, None] == other[None, :], np.inf, h)
    found = np.argpartition(outside, NEAREST - 1, axis=1)[:, :NEAREST]
    gap = x[:, None, :] - y[found]
    d = np.where(np.take_along_axis(outside, found, 1) < np.inf, (gap * gap).sum(2), np.inf)
    return d.max(1)


def _nearest_outside(rows: DataFrame, targets: DataFrame, counts: tuple[int, int], dimension: int, block_rows: int) -> DataFrame:
    """For each of ``rows`` the ``NEAREST`` rows of other labels that are nearest, as ``(doc_id, height, lo, hi, partner)``.

    The order ``(height, lo, hi)`` is the same seen from both ends, so ties cannot form circles; of one row it is that of ``(height, partner)``.
    """
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def kernel(rows: blocks.Block, targets: blocks.Block, same: bool) -> dict:
        targets = blocks.Block(targets.table.sort_by("doc_id"))  # the first of equal heights is the smallest partner
        r, c, height = _nearest_rows(rows.x, rows.column("label"), targets.x, targets.column("label"))
        return {"doc_id": rows.ids[r], "height": height, "partner": targets.ids[c]}

    schema = f"doc_id {id_type}, height double, partner {id_type}"
    fields = ["doc_id", "embedding", "label"]
    found = blocks.rows_with_rows(rows.select(fields), targets.select(fields), counts, dimension, kernel, schema, block_rows)
    nearest = ranking.top_per_key(found, ["doc_id"], [F.asc("height"), F.asc("partner")], NEAREST)
    return nearest.select("doc_id", "height", F.least("doc_id", "partner").alias("lo"), F.greatest("doc_id", "partner").alias("hi"), "partner")


def near_groups(clusters: DataFrame, rows: int, block_rows: int) -> DataFrame:
    """``clusters`` with a new ``cell``: near ones together, about ``block_rows`` in each.

    Clusters go to the nearest of some pivots; crowded pivots are cut by hash, neighbours of few clusters share a cell. At most
    ``PIVOTS`` vectors and counts come to the driver. Bounds become those to any other cluster, which hold for every grouping.
    """
    if rows <= block_rows:
        return clusters.withColumn("cell", F.lit(0)).withColumn("bound", F.lit(float("inf")))
    spark = clusters.sparkSession
    wanted = min(PIVOTS, 2 * -(-rows // block_rows))
    pivots = clusters.select("doc_id", "embedding").orderBy(F.xxhash64("doc_id"), "doc_id").limit(wanted).toArrow()
    centres = blocks.matrix(pivots.column("embedding"))
    shared = spark.sparkContext.broadcast(centres)
    id_type = clusters.schema["doc_id"].dataType.simpleString()
    out = blocks.arrow_schema(clusters, f"doc_id {id_type}, pivot int")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = blocks.squared_distances(blocks.matrix(batch.column("embedding")), shared.value).argmin(1)
            yield from pa.table([batch.column("doc_id"), best.astype(np.int32)], schema=out).to_batches()

    placed = materialized(clusters.select("doc_id", "embedding").mapInArrow(nearest, f"doc_id {id_type}, pivot int"))
    counts = {row.pivot: row.n for row in placed.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    table, cell, held = [], 0, 0
    for pivot in _walk(centres, sorted(counts)):
        parts = -(-counts[pivot] // block_rows)
        if held and held + counts[pivot] > block_rows:
            cell, held = cell + 1, 0
        table.append((pivot, cell, parts))
        cell, held = cell + parts - 1, held + counts[pivot] if parts == 1 else block_rows
    cells = F.broadcast(spark.createDataFrame(table, "pivot int, first int, parts int"))  # at most PIVOTS rows
    share = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    named = placed.join(cells, "pivot").select("doc_id", (F.col("first") + share).alias("cell"))
    return clusters.drop("cell").join(named, "doc_id").withColumn("bound", F.least("bound", "inner"))


def _walk(centres: np.ndarray, present: list[int]) -> Iterator[int]:
    """The pivots in an order that goes from each to the nearest one left."""
    left = np.array(present)
    at = 0
    while len(left):
        yield int(left[at])
        here, left = centres[left[at]], np.delete(left, at)
        if len(left):
            at = int(((centres[left] - here) ** 2).sum(1).argmin())


def _merged_inside(state: DataFrame, linkage: str, number: int) -> DataFrame:
    """All merges that the bounds allow inside each cell, and the clusters that are left with their nearest height inside.

    Rows with ``dead`` are merges, all others clusters.
    """
    id_type = state.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {id_type}, embedding array<double>, weight bigint, cell int, bound double, inner double"
    schema = f"{fields}, dead {id_type}, survivor {id_type}, height double, round bigint"
    out = blocks.arrow_schema(state, schema)
    heights, held = HEIGHTS[linkage], LAST_ROWS

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")  # the first of equal heights is the partner of the smallest id
        ids, x = table.column("doc_id").to_numpy(), blocks.matrix(table.column("embedding")).copy()
        n, bound = table.column("weight").to_numpy().astype(float), table.column("bound").to_numpy().copy()
        cell, merges, first = table.column("cell")[0].as_py(), [], number << 32
        if len(ids) > held and np.isinf(bound).all():
            ids, x, n, merges = _searched(ids, x, n, linkage, held, first)
            first, bound = first + len(merges), bound[: len(ids)]
            if len(ids) > held:  # those without a finite vector
                return tables(ids, x, n, cell, bound, np.full(len(ids), np.inf), merges)
        d = heights(x, n, x, n)
        d = np.triu(d, 1)
        d += d.T
        np.fill_diagonal(d, np.inf)
        alive = np.ones(len(ids), bool)
        best = d.argmin(1)
        at = np.arange(len(ids))
        for step in range(len(ids)):
            near = d[at, best]
            lo = np.flatnonzero(alive & (best[best] == at) & (at < best) & np.isfinite(near))
            lo = lo[near[lo] <= np.minimum(bound[lo], bound[best[lo]])]
            if not len(lo):
                break
            hi = best[lo]
            merges += zip(ids[hi], ids[lo], near[lo], [first + step] * len(lo))
            total = n[lo] + n[hi]
            x[lo] = (n[lo, None] * x[lo] + n[hi, None] * x[hi]) / total[:, None]
            n[lo], bound[lo], alive[hi] = total, np.minimum(bound[lo], bound[hi]), False
            fresh = heights(x[lo], n[lo], x, n)
            fresh[:, ~alive] = np.inf
            fresh[np.arange(len(lo)), lo] = np.inf
            d[lo], d[:, lo] = fresh, fresh.T
            d[np.ix_(lo, lo)] = np.minimum(d[np.ix_(lo, lo)], d[np.ix_(lo, lo)].T)  # the same from both ends
            d[hi], d[:, hi] = np.inf, np.inf
            changed = np.zeros(len(ids), bool)
            changed[lo] = changed[hi] = True
            again = np.flatnonzero(alive & (changed | changed[best]))
            best[again] = d[again].argmin(1)
        left = np.flatnonzero(alive)
        return tables(ids[left], x[left], n[left], cell, bound[left], d[left, best[left]], merges)

    def tables(ids: np.ndarray, x: np.ndarray, n: np.ndarray, cell: int, bound: np.ndarray, inner: np.ndarray, merges: list) -> pa.Table:
        clusters = pa.table(
            {
                "doc_id": ids, "embedding": pa.array(list(x), pa.list_(pa.float64())),
                "weight": n.astype(np.int64), "cell": np.full(len(ids), cell, np.int32),
                "bound": bound, "inner": inner,
            }
        )
        columns = list(zip(*merges)) if merges else [[], [], [], []]
        done = pa.table({name: pa.array(list(c)) for name, c in zip(["dead", "survivor", "height", "round"], columns)})
        full = [pa.table({f.name: t[f.name] if f.name in t.column_names else pa.nulls(len(t), f.type) for f in out}).cast(out) for t in (clusters, done)]
        return pa.concat_tables(full)

    names = ["doc_id", "embedding", "weight", "cell", "bound"]
    return state.select(*names).groupBy("cell").applyInArrow(merge, schema)


def _searched(ids: np.ndarray, x: np.ndarray, n: np.ndarray, linkage: str, last: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Clusters in order of their ids merged in rounds as in ``reducible_merges`` until ``last`` are left, and the merges."""
    best, height, known = np.full(len(ids), -1), np.full(len(ids), np.inf), np.zeros(len(ids), bool)
    merges, ties = [], False
    while len(ids) > last:
        asked = np.flatnonzero(~known)
        best[asked], height[asked], _ = _nearest_clusters((ids[asked], x[asked], n[asked]), (ids, x, n), linkage, ties)
        at = np.arange(len(ids))
        lo = np.flatnonzero((best > at) & (best[best] == at))
        if not len(lo):  # should rounding hide every pair, the shortest of all
            nearest = int(height.argmin())
            if best[nearest] < 0:
                break
            lo, hi = np.array([min(nearest, best[nearest])]), np.array([max(nearest, best[nearest])])
            height[lo] = height[nearest]
        else:
            hi = best[lo]
        merges += zip(ids[hi], ids[lo], height[lo], [number] * len(lo))
        total = n[lo] + n[hi]
        x[lo] = (n[lo, None] * x[lo] + n[hi, None] * x[hi]) / total[:, None]
        n[lo] = total
        ended, alive = np.zeros(len(ids), bool), np.ones(len(ids), bool)
        ended[lo] = ended[hi] = True
        alive[hi] = False
        known = ~ended & ~ended[best] & (best >= 0)
        scarce = len(lo) * SCARCE < alive.sum() and not ties  # many equal heights: all choose again
        ties, number = ties or scarce, number + 1
        left = np.cumsum(alive) - 1
        ids, x, n, best, height, known = ids[alive], x[alive], n[alive], left[best[alive]], height[alive], known[alive] & (not scarce)
    return ids, x, n, merges


def _mixed(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A number for each pair of ids that is the same from both ends, to choose among equal heights."""
    return np.array([zlib.crc32(f"{a}:{b}".encode()) for a, b in zip(lo.tolist(), hi.tolist())], np.int64)


class _Ward:
    """What ``_nearest_clusters`` asks of a linkage. Heights are measured by differences, which are the same from both ends."""

    def __init__(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> None:
        self.x, self.n, self.y, self.m = x, n, y, m

    def products(self, kind: type) -> tuple[np.ndarray, np.ndarray]:
        a, b, self.lengths, self.scale = _narrowed(self.x, self.y, kind)
        return a, b

    def within(self, rows: np.ndarray, height: np.ndarray, least: float, kind: type) -> np.ndarray:
        """What the products of ``rows`` with clusters of ``least`` members or more do not exceed, where the height is not exceeded."""
        growth = 0.5 / self.n[rows] + 0.5 / least
        limit = height * height * growth * (1.0 + 1e-12)
        return (limit * self.scale * self.scale - self.lengths[rows] + 1e-37).astype(kind)

    def heights(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        gap = self.x[r] - self.y[c]
        return np.sqrt((gap * gap).sum(1) / (0.5 / self.n[r] + 0.5 / self.m[c]))


class _Average(_Ward):
    def products(self, kind: type) -> tuple[np.ndarray, np.ndarray]:
        longest = np.sqrt((self.y * self.y).sum(1).max(initial=0.0))
        self.lengths = 4.0 * (self.x.shape[1] + 8) * float(np.finfo(kind).eps) * (1.0 + longest * np.sqrt((self.x * self.x).sum(1)))
        return -self.x.astype(kind), np.ascontiguousarray(self.y.T.astype(kind))

    def within(self, rows: np.ndarray, height: np.ndarray, least: float, kind: type) -> np.ndarray:
        return (height - 1.0 + self.lengths[rows]).astype(kind)

    def heights(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        return 1.0 - (self.x[r] * self.y[c]).sum(1)


def _columns(m: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of clusters in order of their members, with numbers of members that are nearly the same in each."""
    kind = np.where(m < 16, m, 16 + np.floor(np.log(np.maximum(m, 1.0) / 16) / np.log(1.1)))
    cuts = np.flatnonzero(np.diff(kind)) + 1
    for start, end in zip([0, *cuts], [*cuts, len(m)]):
        for j in range(int(start), int(end), PRODUCTS[1]):
            yield j, min(j + PRODUCTS[1], int(end))


def _nearest_clusters(rows: tuple, targets: tuple, linkage: str, ties: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``(ids, means, members)`` the place of its nearest target, in order of their ids, with height and tie-breaker; -1 if there is none.

    Products of single precision leave out what is further for certain than the nearest so far, and those of double precision where
    that leaves too many; the others are measured.
    """
    mine, x, n = rows
    ids, y, m = targets
    own = np.minimum(np.searchsorted(ids, mine), len(ids) - 1)
    own = np.where(ids[own] == mine, own, -1)
    finite = np.flatnonzero(np.isfinite(y).all(1))
    order = finite[np.argsort(m[finite], kind="stable")]
    sorted_at = np.full(len(ids) + 1, -1)
    sorted_at[order] = np.arange(len(order))
    own = sorted_at[own]  # the last one stands for none
    y, m, n = y[order], m[order].astype(float), n.astype(float)
    best, least, mixed = np.full(len(mine), -1), np.full(len(mine), np.inf), np.zeros(len(mine), np.int64)
    if not len(order):
        return best, least, mixed
    narrow, wide = ({"ward": _Ward, "average": _Average}[linkage](x, n, y, m) for _ in range(2))
    a, b = narrow.products(np.float32)
    exact: list[np.ndarray] = []
    columns = list(_columns(m))

    def measured(r: np.ndarray, c: np.ndarray) -> None:
        for s in range(0, len(r), MEASURED):
            some, to = r[s : s + MEASURED], c[s : s + MEASURED]
            h = narrow.heights(some, to)
            keep = h <= least[some]
            some, to, h = some[keep], to[keep], h[keep]
            if not len(some):
                continue
            low = np.full(int(some.max()) - int(some.min()) + 1, np.inf)
            np.minimum.at(low, some - some.min(), h)
            keep = h == low[some - some.min()]
            some, to, h = some[keep], order[to[keep]], h[keep]
            key = np.zeros(len(some), np.int64)
            if ties:
                p, q = mine[some], ids[to]
                key = _mixed(np.where(p > q, q, p), np.where(p > q, p, q))
            first = np.lexsort((to, key, some))
            some, to, h, key = some[first], to[first], h[first], key[first]
            first = np.flatnonzero(np.r_[True, some[1:] != some[:-1]])
            some, to, h, key = some[first], to[first], h[first], key[first]
            same = h == least[some]
            wins = (h < least[some]) | (same & ((key < mixed[some]) | ((key == mixed[some]) & (to < best[some]))))
            some, to, h, key = some[wins], to[wins], h[wins], key[wins]
            best[some], least[some], mixed[some] = to, h, key

    strip, room = PRODUCTS[0], np.empty(PRODUCTS[0] * PRODUCTS[1], np.float32)
    for i in range(0, len(x), strip):
        place = np.arange(i, min(i + strip, len(x)))
        for j, end in columns:
            h = np.matmul(a[place[0] : place[-1] + 1], b[:, j:end], out=room[: len(place) * (end - j)].reshape(len(place), -1))
            here = own[place] - j
            inside = np.flatnonzero((here >= 0) & (here < end - j))
            h[inside, here[inside]] = np.inf
            near = np.flatnonzero(h.min(1) <= narrow.within(place, least[place], m[j], np.float32))
            if not len(near):
                continue
            h, at = h[near], place[near]
            c = h.argmin(1)
            known = np.flatnonzero(h[np.arange(len(near)), c] < np.inf)
            measured(at[known], j + c[known])
            passing = h <= narrow.within(at, least[at], m[j], np.float32)[:, None]
            passing &= h < np.inf
            passing[np.arange(len(near)), c] = False
            if np.count_nonzero(passing) > CROWDED * passing.size:
                if not exact:
                    exact += wide.products(np.float64)
                passing &= exact[0][at] @ exact[1][:, j:end] <= wide.within(at, least[at], m[j], np.float64)[:, None]
            r, c = np.divmod(np.flatnonzero(passing), end - j)
            measured(at[r], j + c)
    return best, least, mixed


def _nearest_of(rows: DataFrame, clusters: DataFrame, counts: tuple[int, int], dimension: int, linkage: str, block_rows: int, ties: bool) -> DataFrame:
    """For each of ``rows`` the nearest other cluster: ``(doc_id, height, mixed, lo, hi, partner)``.

    Of equal heights the smallest partner, or with ``ties`` the pair of the smallest ``mixed``, so that pairs of equal height come from everywhere.
    """
    id_type = clusters.schema["doc_id"].dataType.simpleString()

    def kernel(rows: blocks.Block, targets: blocks.Block, same: bool) -> dict:
        targets = blocks.Block(targets.table.sort_by("doc_id"))  # of equal heights, the first is the smallest partner
        mine, ids = rows.ids, targets.ids
        at, height, mixed = _nearest_clusters((mine, rows.x, rows.column("weight")), (ids, targets.x, targets.column("weight")), linkage, ties)
        found = at >= 0
        mine, partner = mine[found], ids[at[found]]
        swap = mine > partner
        columns = (mine, height[found], mixed[found], np.where(swap, partner, mine), np.where(swap, mine, partner), partner)
        return dict(zip(["doc_id", "height", "mixed", "lo", "hi", "partner"], columns))

    schema = f"doc_id {id_type}, height double, mixed bigint, lo {id_type}, hi {id_type}, partner {id_type}"
    fields = ["doc_id", "embedding", "weight"]
    found = blocks.rows_with_rows(rows.select(fields), clusters.select(fields), counts, dimension, kernel, schema, block_rows)
    best = F.min(F.struct("height", "mixed", "lo", "hi", "partner")).alias("best")
    return found.groupBy("doc_id").agg(best).select("doc_id", "best.*")


def reducible_merges(distinct: DataFrame, size: blocks.Size, linkage: str = "ward", block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """``(dead, survivor, height, round)``, one row per merge; a cluster is named by its smallest id."""
    state, known, rows, merges, number, ties = distinct.select("doc_id", "embedding", "weight"), None, size.rows, [], 0, False
    last = block_rows if block_rows < blocks.BLOCK_ROWS else max(LAST_ROWS, math.isqrt(LAST_PRODUCTS // max(1, size.dimension)))
    while rows > last:
        asked = state if known is None else state.join(known.select("doc_id"), "doc_id", "left_anti")
        counts = (rows if known is None else rows - known.count(), rows)
        found = materialized(_nearest_of(asked, state, counts, size.dimension, linkage, block_rows, ties))
        nearest = found if known is None else known.unionByName(found)
        pairs = materialized(_mutual(nearest, number << 32))
        joined = pairs.count()
        if not joined:  # should rounding hide every pair, the shortest of all
            pairs, joined = materialized(_named(nearest.orderBy("height", "mixed", "lo", "hi").limit(1), number << 32)), 1
        merges.append(pairs)
        ended = pairs.select(F.col("dead").alias("doc_id")).unionByName(pairs.select(F.col("survivor").alias("doc_id")))
        before, state = state, materialized(_merged(state, pairs))
        left = nearest.join(ended, "doc_id", "left_anti").join(ended.withColumnRenamed("doc_id", "partner"), "partner", "left_anti")
        gone = [found] if known is None else [found, known]
        rows, number = rows - joined, number + 1
        scarce = joined * SCARCE < rows and not ties  # many equal heights: all choose again, in an order that differs by pair
        known, ties = (None if scarce else materialized(left.select(*nearest.columns))), ties or scarce
        discard(*gone, *([before] if number > 1 else []))
    if rows > 1:
        whole = state.withColumns({"cell": F.lit(0), "bound": F.lit(float("inf"))})
        done = materialized(_merged_inside(whole, linkage, number))
        merges.append(done.filter("dead is not null").select("dead", "survivor", "height", "round"))
    if not merges:
        return _no_merges(distinct)
    every = materialized(reduce(DataFrame.unionByName, merges))
    discard(*merges)
    return every


def _named(pairs: DataFrame, round_number: int) -> DataFrame:
    return pairs.select(
        F.col("hi").alias("dead"), F.col("lo").alias("survivor"), "height", F.lit(round_number).cast("bigint").alias("round")
    )


def _mutual(nearest: DataFrame, round_number: int) -> DataFrame:
    """Pairs that name each other."""
    ends = nearest.groupBy("lo", "hi").agg(F.count("*").alias("ends"), F.min("height").alias("height"))
    return _named(ends.filter("ends = 2"), round_number)


def _merged(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """The clusters with both ends of each pair as one, under the survivor's id."""
    moves = pairs.select(F.col("dead").alias("doc_id"), F.col("survivor").alias("to"))
    ends = moves.unionByName(pairs.select(F.col("survivor").alias("doc_id"), F.col("survivor").alias("to")))
    rows = clusters.join(ends, "doc_id", "left")
    stays = rows.filter("to is null").select("doc_id", "embedding", "weight")
    parts = rows.filter("to is not null")
    lower = parts.filter("doc_id = to").select("doc_id", "embedding", "weight")
    upper = parts.filter("doc_id <> to").select(F.col("to").alias("doc_id"), F.col("embedding").alias("other"), F.col("weight").alias("more"))
    both = F.col("weight") + F.col("more")
    joined = lower.join(upper, "doc_id").select(
        "doc_id",
        F.zip_with("embedding", "other", lambda a, b: (a * F.col("weight") + b * F.col("more")) / both).alias("embedding"),
        both.alias("weight"),
    )
    return stays.unionByName(joined)


def single_merges(distinct: DataFrame, size: blocks.Size, block_rows: int) -> DataFrame:
    """Edges of a minimum spanning tree as ``(dead, survivor, height, round)``."""
    rows = distinct.select("doc_id", "embedding")
    labels = distinct.select("doc_id", F.col("doc_id").alias("label"))
    near, edges, components, number = None, [], size.rows, 0
    while components > 1:
        labelled = rows.join(labels, "doc_id")
        if near is None:
            near = materialized(_nearest_outside(labelled, labelled, (size.rows, size.rows), size.dimension, block_rows))
            leaving = _leaving(near, labels)
        else:
            largest = labels.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").first().label
            leaving = _leaving(near, labels)
            asked = materialized(_unsure(near, leaving, labels).filter(F.col("label") != F.lit(largest)).select("doc_id"))
            count = asked.count()
            if count:
                again = labelled.join(asked, "doc_id")
                found = materialized(_nearest_outside(again, labelled, (count, size.rows), size.dimension, block_rows))
                before, near = near, materialized(near.join(asked, "doc_id", "left_anti").unionByName(found))
                discard(before, found)
                leaving = _leaving(near, labels)
            leaving = leaving.filter(F.col("label") != F.lit(largest))  # the others' edges reach it
        best = F.min(F.struct("height", "lo", "hi", "other")).alias("best")
        chosen = materialized(leaving.groupBy("label").agg(best).select(F.col("label").alias("owner"), "best.*"))
        edges.append(
            chosen.select(
                F.col("hi").alias("dead"), F.col("lo").alias("survivor"), "height", F.lit(number).cast("bigint").alias("round")
            ).dropDuplicates(["dead", "survivor"])
        )
        joined = connected_components(
            labels.select(F.col("label").alias("id")).distinct(),
            chosen.select(F.col("owner").alias("u"), F.col("other").alias("v")),
        )
        renamed = joined.select(F.col("id").alias("label"), F.col("label").alias("root"))
        labels = materialized(labels.join(renamed, "label").select("doc_id", F.col("root").alias("label")))
        components, number = joined.select("label").distinct().count(), number + 1
    if not edges:
        return _no_merges(distinct)
    return materialized(reduce(DataFrame.unionByName, edges))


def _leaving(near: DataFrame, labels: DataFrame) -> DataFrame:
    """The known edges between different labels, with both labels."""
    others = labels.select(F.col("doc_id").alias("partner"), F.col("label").alias("other"))
    return near.join(labels, "doc_id").join(others, "partner").filter(F.col("label") != F.col("other"))


def _unsure(near: DataFrame, leaving: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that may have a shorter edge out of their label than all known ones of that label.

    A row's unknown edges are no shorter than the longest it knows, if it knows ``NEAREST``, and there are none otherwise.
    """
    knows = near.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("height").alias("bound"))
    out = leaving.groupBy("doc_id").agg(F.min("height").alias("out"))
    shortest = leaving.groupBy("label").agg(F.min("height").alias("shortest"))
    rows = labels.join(knows, "doc_id").join(out, "doc_id", "left").join(shortest, "label", "left")
    none = F.lit(float("inf"))
    return rows.filter((F.col("n") >= NEAREST) & (F.coalesce("out", none) >= F.col("bound")) & (F.col("bound") <= F.coalesce("shortest", none)))


def _no_merges(state: DataFrame) -> DataFrame:
    same = F.col("doc_id")
    return state.select(
        same.alias("dead"), same.alias("survivor"), F.lit(0.0).alias("height"), F.lit(0).cast("bigint").alias("round")
    ).limit(0)


def agglomerative(
    points: DataFrame,
    n_clusters: int,
    linkage: str = "ward",
    block_rows: int = blocks.BLOCK_ROWS,
    tail_clusters: int | None = None,
) -> DataFrame:
    """``(doc_id, cluster_id)`` after cutting the tree at ``n_clusters``, numbered by size, then id.

    ``linkage`` is ``ward`` (Euclidean), ``average`` (mean cosine distance) or ``single`` (Euclidean).
    """
    return next(iter(agglomerative_cuts(points, [n_clusters], linkage, block_rows, tail_clusters).values()))


def agglomerative_cuts(
    points: DataFrame,
    ks: list[int],
    linkage: str = "ward",
    block_rows: int = blocks.BLOCK_ROWS,
    tail_clusters: int | None = None,
) -> dict[int, DataFrame]:
    """Cuts of one tree at several numbers of clusters. ``tail_clusters`` has no effect any more."""
    if linkage not in LINKAGES:
        raise ValueError(f"no linkage named {linkage!r}, only {', '.join(LINKAGES)}")
    if any(k < 1 for k in ks):
        raise ValueError("the number of clusters must be at least 1")
    if linkage == "average":
        points = metrics.unit_points(points, "doc_id")
    distinct = materialized(blocks.distinct_points(points))
    size = blocks.measure(distinct)
    if linkage == "single":
        merges = single_merges(distinct, size, block_rows)
    else:
        merges = reducible_merges(distinct, size, linkage, block_rows)
    return {k: _cut(points, distinct, size, merges, k) for k in ks}


def _cut(points: DataFrame, distinct: DataFrame, size: blocks.Size, merges: DataFrame, k: int) -> DataFrame:
    """Leave out the ``k - 1`` highest merges and label what stays connected.

    Copies of a vector merge first, at height 0; only for more clusters than distinct vectors do the
    largest ids among them stand alone.
    """
    result = cut_labels(distinct, size, merges, k)
    if size.has_copies:
        copies = blocks.copies_of(points, distinct)
        grouped = copies.join(result.withColumnRenamed("doc_id", "rep"), "rep").select("doc_id", "label")
        if k > size.rows:
            alone = materialized(copies.orderBy(F.desc("doc_id")).limit(k - size.rows).select("doc_id"))
            grouped = grouped.join(alone, "doc_id", "left_anti").unionByName(
                alone.withColumn("label", F.col("doc_id"))
            )
        result = result.unionByName(grouped)
    return numbered(result)


def cut_labels(distinct: DataFrame, size: blocks.Size, merges: DataFrame, k: int) -> DataFrame:
    """``(doc_id, label)``: what stays connected without the ``k - 1`` highest merges, named by its smallest id."""
    highest = (
        merges.orderBy(F.desc("height"), F.desc("round"), F.desc("dead"), F.desc("survivor"))
        .limit(min(k, size.rows) - 1)
        .select("dead", "survivor")
    )
    kept = merges.join(highest, ["dead", "survivor"], "left_anti")
    nodes = distinct.select(F.col("doc_id").alias("id"))
    labels = connected_components(nodes, kept.select(F.col("dead").alias("u"), F.col("survivor").alias("v")))
    return labels.withColumnRenamed("id", "doc_id")


def numbered(result: DataFrame) -> DataFrame:
    """``(doc_id, cluster_id)`` of ``(doc_id, label)``: clusters numbered by size, then label."""
    order = Window.orderBy(F.desc("n"), F.asc("label"))  # k rows
    numbers = (
        result.groupBy("label")
        .agg(F.count("*").alias("n"))
        .select("label", (F.row_number().over(order) - 1).alias("cluster_id"))
    )
    return result.join(numbers, "label").select("doc_id", "cluster_id")
