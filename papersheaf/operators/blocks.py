"""Block-wise work over pairs of vectors, and rows against a bounded table of vectors.

Vectors are spread over blocks of a bounded number of rows. Every pair of blocks is one group, whose
distances are matrix products of slices; a kernel returns only what is asked for (pairs beyond a threshold,
sums, nearest rows), so neither all pairs nor a whole cluster ever meet in one place. Blocks come from
a hash of the identity, so a cluster, source or label holding most rows is spread like any other. Blocks are packed tables.
Pairs of the same rows read them again from a written store (``every_pair``); others are shuffled, with no more than
``MAX_BLOCKS`` of them as long as a block fits a task, so that what is shuffled grows with the rows and not with their square.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from papersheaf.functions import vectors
from papersheaf.session import materialized, ship_package

BLOCK_ROWS = 2048
MIN_BLOCKS = 4
CELLS = 128
TARGET_BYTES = 64 * 1024 * 1024
MAX_PARTITIONS = 100_000
TASK_PRODUCTS = 50_000_000
MAX_BLOCKS = 16
BLOCK_BYTES = 16 * 1024 * 1024
PACK_BYTES = 4 * 1024 * 1024
COPIES = 8  # of a slice's vectors that a kernel may hold
SLICE_ROWS = (256, 2048)
TILE_PRODUCTS = 2_000_000_000


@dataclass
class Block:
    """The rows of one block inside a task."""

    table: pa.Table

    def __len__(self) -> int:
        return self.table.num_rows

    @property
    def ids(self) -> np.ndarray:
        return self.column("doc_id")

    @property
    def x(self) -> np.ndarray:
        return matrix(self.table.column("embedding"))

    def column(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a ``(rows, dimensions)`` double matrix."""
    joined = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = joined.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(joined), -1) if len(joined) else flat.reshape(0, 0)


def pack(points: DataFrame) -> DataFrame:
    """Vectors as binary matrices of at most ``PACK_BYTES``, so that repeated passes move bytes instead of elements."""
    schema = "dimension int, data binary"
    out = arrow_schema(points, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                step = max(1, PACK_BYTES // (8 * max(1, len(batch.column(0)[0]))))
                for start in range(0, batch.num_rows, step):
                    x = matrix(batch.column(0).slice(start, step)).astype(np.float32 if single else np.float64)
                    yield from pa.table({"dimension": [x.shape[1]], "data": [x.tobytes()]}).cast(out).to_batches()

    single = points.schema["embedding"].dataType.elementType.typeName() == "float"
    return points.select("embedding").mapInArrow(run, f"{schema}").withColumn("single", F.lit(single))


def unpack(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """The matrices of ``pack`` in slices whose product with ``width`` columns stays below ``TARGET_BYTES``."""
    step = max(1, TARGET_BYTES // (8 * max(1, width)))
    for batch in batches:
        for dimension, data, single in zip(*(batch.column(c) for c in ("dimension", "data", "single"))):
            x = np.frombuffer(data.as_buffer(), np.float32 if single.as_py() else np.float64).reshape(-1, dimension.as_py())
            for start in range(0, len(x), step):
                yield x[start : start + step].astype(np.float64)


def squared_distances(x: np.ndarray, y: np.ndarray, same: bool = False) -> np.ndarray:
    """All squared Euclidean distances; exactly symmetric, with a zero diagonal, for the same rows twice."""
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
    np.maximum(d, 0.0, out=d)
    if same:
        d = np.triu(d, 1)
        d += d.T
    return d


def distinct_points(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per distinct vector (and ``keys``) with its smallest id and the number of copies.

    The grouping is pre-aggregated, so a vector shared by most rows shrinks before the shuffle.
    """
    return points.groupBy(*keys, vectors.doubles(F.col("embedding")).alias("embedding")).agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("weight")
    )


def copies_of(points: DataFrame, distinct: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, rep)`` for every row whose vector also belongs to a smaller id."""
    shared = distinct.filter(F.col("weight") > 1).select(*keys, "embedding", F.col("doc_id").alias("rep"))
    rows = points.select("doc_id", *keys, vectors.doubles(F.col("embedding")).alias("embedding"))
    return rows.join(shared, [*keys, "embedding"]).filter(F.col("doc_id") != F.col("rep")).select("doc_id", "rep")


@dataclass
class Size:
    rows: int
    dimension: int
    weight: int
    max_norm: float

    @property
    def has_copies(self) -> bool:
        return self.weight > self.rows


def measure(distinct: DataFrame) -> Size:
    """Row count, dimension, original rows and longest vector, from one aggregate row."""
    row = distinct.agg(
        F.count("*").alias("rows"),
        F.max(F.size("embedding")).alias("dimension"),
        F.sum("weight").alias("weight"),
        F.max(vectors.squared_norm(F.col("embedding"))).alias("q"),
    ).first()
    return Size(row.rows, row.dimension or 1, row.weight or 0, float(row.q or 0.0) ** 0.5)


def block_count(rows: int, block_rows: int = BLOCK_ROWS) -> int:
    """Blocks of at most about ``block_rows`` rows, and a few even for small data so that all cores work."""
    return max(-(-rows // block_rows), min(MIN_BLOCKS, rows), 1)


def tasks_for(products: float) -> int:
    """Tasks worth starting for so many multiplications: small work is faster in few tasks."""
    return int(max(1, min(products / TASK_PRODUCTS, MAX_PARTITIONS)))


def _partitions(df: DataFrame, row_bytes: float, products: float, groups: int) -> int:
    """Shuffle partitions of about ``TARGET_BYTES``, and one per core as far as the work asks for it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = max(min(cores, tasks_for(products)), row_bytes / TARGET_BYTES)
    return int(max(1, min(groups, MAX_PARTITIONS, wanted)))


def _run_pairs(replicated: DataFrame, key: list[str], kernel: Callable, schema: str, partitions: int) -> DataFrame:
    """Group rows tagged with ``side`` by block pair and hand both sides to the kernel."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        left = Block(table.filter(pa.array(side == 0)))
        right = Block(table.filter(pa.array(side == 1))) if (side == 1).any() else None
        same = bool(table.column("diagonal")[0].as_py())
        if not same and (right is None or len(left) == 0):
            return out.empty_table()
        return pa.table(kernel(left, left if same else right, same)).cast(out)

    out = arrow_schema(replicated, schema)
    return replicated.repartition(partitions, *key).groupBy(*key).applyInArrow(run, schema)


def arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    """The Arrow form of a schema string; also makes sure that the workers can import this package."""
    ship_package(df.sparkSession)
    return to_arrow_schema(StructType.fromDDL(schema))


def wide_rows(rows: int, dimension: int, block_rows: int, most: int | None = None) -> int:
    """``block_rows``, or more where that would make over ``MAX_BLOCKS`` blocks, as far as ``BLOCK_BYTES`` and ``most`` rows allow."""
    allowed = max(1, BLOCK_BYTES // (8 * max(1, dimension)))
    return max(block_rows, min(-(-rows // MAX_BLOCKS), allowed, most or allowed))


def packed_blocks(rows: DataFrame, block_rows: int, dimension: int, tasks: int | None = None) -> DataFrame:
    """``(block, pack, data)``: the rows of each block, named by their column ``block``, as a few packed tables of bounded size.

    Vectors whose values all are of single precision are packed as such. ``tasks`` blocks are packed at once, if given.
    """
    schema = "block int, pack int, data binary"
    out = arrow_schema(rows, schema)

    def pack(table: pa.Table) -> pa.Table:
        block, number = table.column("block")[0].as_py(), table.column("_pack")[0].as_py()
        table = table.drop_columns(["block", "_pack"])
        x = matrix(table.column("embedding"))
        narrow = x.astype(np.float32)
        if (narrow == x).all():
            offsets = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
            at = table.column_names.index("embedding")
            table = table.set_column(at, "embedding", pa.ListArray.from_arrays(offsets, pa.array(narrow.ravel())))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        return pa.table([[block], [number], [sink.getvalue().to_pybytes()]], names=out.names).cast(out)

    packs = -(-block_rows * max(1, dimension) * 8 // PACK_BYTES)
    share = F.pmod(F.xxhash64("doc_id", F.lit("pack")), F.lit(packs)).cast("int")
    dealt = rows.withColumn("_pack", share)
    if tasks is not None:
        dealt = dealt.repartition(min(tasks * packs, MAX_PARTITIONS), "block", "_pack")
    return dealt.groupBy("block", "_pack").applyInArrow(pack, schema)


def _unpacked(data: pa.Scalar) -> pa.Table:
    table = pa.ipc.open_stream(data.as_buffer()).read_all()
    return table.set_column(table.column_names.index("embedding"), "embedding", _doubles(table.column("embedding")))


def _run_tiles(tiles: DataFrame, kernel: Callable, schema: str, partitions: int) -> DataFrame:
    """Hand the two sides of each ``tile`` to the kernel, whose results leave as they come."""

    def results(tile: dict) -> Iterator[pa.RecordBatch]:
        left, right = (Block(pa.concat_tables(side).combine_chunks()) if side else None for side in tile["sides"])
        same = tile["diagonal"]
        if left is None or (right is None and not same):
            return
        found = kernel(left, left if same else right, same)
        for part in [found] if isinstance(found, dict) else found:
            yield from pa.table(part).cast(out).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        for batch in batches:
            tile, side, diagonal = (batch.column(c).to_pylist() for c in ("tile", "side", "diagonal"))
            for k, number in enumerate(tile):
                if held is None or held["tile"] != number:
                    if held is not None:
                        yield from results(held)
                    held = {"tile": number, "diagonal": diagonal[k], "sides": ([], [])}
                held["sides"][side[k]].append(_unpacked(batch.column("data")[k]))
        if held is not None:
            yield from results(held)

    out = arrow_schema(tiles, schema)
    dealt = tiles.select("tile", "side", "diagonal", "data").repartitionById(partitions, F.col("tile").cast("int"))
    return dealt.sortWithinPartitions("tile").mapInArrow(run, schema)


def every_pair(left: DataFrame, right: DataFrame, wanted: Column | None = None) -> DataFrame:
    """All (or the ``wanted``) pairs of a few large rows, without a shuffle: each partition of ``left`` reads those of ``right`` again.

    The pairs of a row of ``left`` and one partition of ``right``, which a task holds, come one after the other.
    """
    return left.join(right.hint("shuffle_replicate_nl"), F.lit(True) if wanted is None else wanted)


def _doubles(column: pa.ChunkedArray) -> pa.ChunkedArray:
    return column.cast(pa.list_(pa.float64()))


def slices(x: np.ndarray, y: np.ndarray, same: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """Slices of the rows of two matrices with their first rows; of the same rows twice, those on and above the diagonal."""
    rows, columns = SLICE_ROWS
    rows = columns if same else rows
    for i in range(0, len(x), rows):
        for j in range(i if same else 0, len(y), columns):
            yield i, j, x[i : i + rows], y[j : j + columns], same and i == j


def self_pairs(
    points: DataFrame,
    kernel: Callable[[Block, Block, bool], dict | Iterator[dict]],
    schema: str,
    size: Size,
    carry: tuple[str, ...] = (),
    within: float | None = None,
    block_rows: int = BLOCK_ROWS,
    cells: int | None = None,
    most: int | None = None,
) -> DataFrame:
    """Run ``kernel(left, right, same)`` once for every unordered pair of blocks, or of the packs of large ones.

    With ``within``, only pairs of rows at most that far apart matter: vectors are first gathered
    around pivot vectors and block pairs whose balls are further apart are left out, which is exact
    by the triangle inequality. ``cells`` sets the number of pivots. Where the limit leaves most pairs in, blocks
    come from the hash. Blocks are widened to at most ``most`` rows.
    """
    columns = ["doc_id", "embedding", *carry]
    if cells is None:
        cells = min(CELLS, size.rows // block_rows) if within is not None else 1
    wide = wide_rows(size.rows, size.dimension, block_rows, most)
    tasks = tasks_for(float(size.rows) * size.rows * size.dimension)
    found = _cells(points.select(*columns), within, cells, wide) if within is not None and cells > 1 else None
    if found is None:
        total = block_count(size.rows, wide)
        placed = points.select(*columns, F.pmod(F.xxhash64("doc_id"), F.lit(total)).cast("int").alias("block"))
        stored = materialized(packed_blocks(placed, wide, size.dimension, min(total, tasks)))
        near = None
    else:
        placed, ranges, total = found
        placed = placed.join(F.broadcast(ranges), "cell")  # at most `cells` rows
        share = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
        placed = placed.select(*columns, (F.col("first_block") + share).alias("block"))
        partners = ranges.select(F.explode(F.expr("sequence(first_block, first_block + blocks - 1)")).alias("block"), "partners")
        stored = materialized(packed_blocks(placed, wide, size.dimension, min(total, tasks)).join(F.broadcast(partners), "block"))  # one row for each block
        near = F.exists("partners", lambda p: (F.col("other") >= p["start"]) & (F.col("other") < p["start"] + p["n"]))

    side = math.ceil(tasks**0.5)  # small work is faster in few tasks
    left = stored.coalesce(side)
    right = stored.select(F.col("block").alias("other"), F.col("pack").alias("other_pack"), F.col("data").alias("other_data")).coalesce(side)
    wanted = (F.col("block") < F.col("other")) | ((F.col("block") == F.col("other")) & (F.col("pack") <= F.col("other_pack")))
    pairs = every_pair(left, right, wanted if near is None else wanted & near)
    return _run_met(pairs.select("block", "pack", "data", "other", "other_pack", "other_data"), kernel, schema)


def _run_met(pairs: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """Hand both sides of each pair of packs to the kernel, whose results leave as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, left = None, None
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in ("block", "pack", "other", "other_pack"))))
            for k, (*own, block, pack) in enumerate(names):
                if own != held:
                    held, left = own, Block(_unpacked(batch.column("data")[k]).combine_chunks())
                same = own == [block, pack]
                found = kernel(left, left if same else Block(_unpacked(batch.column("other_data")[k]).combine_chunks()), same)
                for part in [found] if isinstance(found, dict) else found:
                    yield from pa.table(part).cast(out).to_batches()

    out = arrow_schema(pairs, schema)
    return pairs.mapInArrow(run, schema)


def rows_with_rows(
    rows: DataFrame,
    targets: DataFrame,
    counts: tuple[int, int],
    dimension: int,
    kernel: Callable[[Block, Block, bool], dict | Iterator[dict]],
    schema: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Run ``kernel(some rows, some targets, False)`` so that all ``counts[0]`` rows meet all ``counts[1]`` targets.

    Both sides are cut into few blocks of at most ``BLOCK_BYTES``, as many as the work asks for, and nothing goes through the driver.
    """
    allowed = max(block_rows, BLOCK_BYTES // (8 * max(1, dimension)))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    wanted = min(4 * cores, max(1.0, float(counts[0]) * counts[1] * dimension / TILE_PRODUCTS))
    ratio = counts[0] / max(1, counts[1])
    across = max(-(-counts[0] // allowed), round((wanted * ratio) ** 0.5), 1)
    down = max(-(-counts[1] // allowed), round(wanted / across), 1)

    def side(frame: DataFrame, count: int, total: int, others: int, number: int) -> DataFrame:
        block = F.pmod(F.xxhash64("doc_id"), F.lit(total)).cast("int")
        stored = packed_blocks(frame.withColumn("block", block), -(-count // total), dimension)
        met = stored.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        row, target = ("other", "block") if number else ("block", "other")
        tile = F.col(row).cast("bigint") * F.lit(down) + F.col(target)
        return met.select("data", tile.alias("tile"), F.lit(number).alias("side"), F.lit(False).alias("diagonal"))

    tiles = side(rows, counts[0], across, down, 0).unionByName(side(targets, counts[1], down, across, 1))
    return _run_tiles(tiles, kernel, schema, across * down)


def _cells(points: DataFrame, within: float, cells: int, block_rows: int) -> tuple[DataFrame, DataFrame, int] | None:
    """Rows with their nearest pivot, and for each pivot its blocks and the block ranges near it; none if most pairs are near.

    Only the pivots and one (count, radius) row per pivot come to the driver: ``cells`` rows each.
    """
    spark = points.sparkSession
    ship_package(spark)
    pivots = points.select("doc_id", "embedding").orderBy(F.xxhash64("doc_id"), "doc_id").limit(cells)
    centres = matrix(pivots.toArrow().column("embedding"))
    shared = spark.sparkContext.broadcast(centres)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            d = squared_distances(matrix(table.column("embedding")), shared.value)
            best = d.argmin(1)
            table = table.append_column("cell", pa.array(best.astype(np.int32)))
            far = np.sqrt(d[np.arange(len(d)), best])
            yield from table.append_column("radius", pa.array(far)).to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    assigned = points.mapInArrow(nearest, f"{fields}, cell int, radius double")
    found = {
        row.cell: row
        for row in assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("r")).collect()
    }
    gaps = np.sqrt(squared_distances(centres, centres, same=True))
    slack = 1e-6 * (1.0 + float(np.abs(centres).max()))
    near = lambda a, b: a == b or gaps[a, b] - found[a].r - found[b].r <= within + slack
    if 2 * sum(found[a].n * found[b].n for a in found for b in found if near(a, b)) > sum(row.n for row in found.values()) ** 2:
        return None
    first, blocks = {}, {}
    total = 0
    for cell, row in sorted(found.items()):
        first[cell], blocks[cell] = total, block_count(row.n, block_rows) if len(found) < MIN_BLOCKS else max(
            1, -(-row.n // block_rows)
        )
        total += blocks[cell]
    ranges = [
        (
            cell,
            first[cell],
            blocks[cell],
            [
                (first[other], blocks[other])
                for other in sorted(found)
                if near(cell, other)
            ],
        )
        for cell in sorted(found)
    ]
    schema = "cell int, first_block int, blocks int, partners array<struct<start:int,n:int>>"
    return assigned.drop("radius"), spark.createDataFrame(ranges, schema), total


def cluster_pairs(
    points: DataFrame,
    kernel: Callable[[Block, Block, bool], dict],
    schema: str,
    keys: tuple[str, ...],
    carry: tuple[str, ...] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Like ``self_pairs`` but only for pairs of rows with equal ``keys``.

    A key is cut into as many blocks as its number of rows asks for, so a key holding most rows
    becomes many groups. Kernel output has the key columns in front.
    """
    columns = ["doc_id", "embedding", *carry]
    counted = points.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d"))
    sizes = counted.withColumn("blocks", F.ceil(F.col("n") / F.lit(block_rows)).cast("int"))
    work = sizes.agg(
        F.coalesce(F.sum(F.col("n") * F.col("blocks") * F.col("d") * 8), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(F.col("n").cast("double") * F.col("n") * F.col("d")), F.lit(0.0)).alias("products"),
        F.coalesce(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2), F.lit(0)).alias("groups"),
    ).first()
    sizes = sizes.select(*keys, "blocks")
    placed = points.select(*keys, *columns).join(sizes, list(keys))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    paired = placed.select(
        *keys, *columns, "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")
    )
    replicated = paired.select(
        *keys,
        *columns,
        F.least("block", "other").alias("a"),
        F.greatest("block", "other").alias("b"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"),
        (F.col("block") == F.col("other")).alias("diagonal"),
    )
    partitions = _partitions(points, work.bytes, work.products, int(work.groups))
    return _run_pairs(replicated, [*keys, "a", "b"], kernel, schema, partitions)


Kernel = Callable[[Iterator[pa.Table], pa.Table], Iterator[dict]]


def each(kernel: Callable[[pa.Table, pa.Table], dict]) -> Kernel:
    """A kernel without memory: one result for every slice of rows."""

    def run(slices: Iterator[pa.Table], targets: pa.Table) -> Iterator[dict]:
        for rows in slices:
            yield kernel(rows, targets)

    return run


def cut(table: pa.Table, width: int, dimension: int = 1) -> Iterator[pa.Table]:
    """Slices whose product with ``width`` columns of doubles, and some copies of whose vectors, stay below ``TARGET_BYTES``."""
    step = max(1, TARGET_BYTES // (8 * max(1, width, COPIES * dimension)))
    for start in range(0, table.num_rows, step):
        yield table.slice(start, step)


def against(
    rows: DataFrame,
    targets: DataFrame,
    kernel: Kernel,
    schema: str,
    reduce: Callable[[DataFrame], DataFrame],
    limit_bytes: int = TARGET_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Run ``kernel(slices of rows, targets)`` for all rows against all targets.

    Targets are measured first. Up to ``limit_bytes`` they are broadcast and rows stay where they are.
    Beyond, both sides are cut into blocks, every block of rows meets every chunk of targets in its own
    group, and ``reduce`` joins the results of the chunks with an ordinary aggregate. The first column
    of ``rows`` must identify the row well enough to spread rows over blocks.
    """
    out = arrow_schema(rows, schema)
    n, d = targets.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if n * d * 8 <= limit_bytes:
        shared = rows.sparkSession.sparkContext.broadcast(targets.toArrow())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            if known.num_rows:
                tables = (pa.Table.from_batches([batch]) for batch in batches)
                slices = (piece for table in tables for piece in cut(table, known.num_rows, d))
                for result in kernel(slices, known):
                    yield from pa.table(result).cast(out).to_batches()

        return rows.mapInArrow(scan, schema)

    chunks = -(-(n * d * 8) // limit_bytes)
    row_blocks = block_count(rows.count(), block_rows)
    left = rows.withColumn("_row_block", F.pmod(F.xxhash64(*rows.columns[:1]), F.lit(row_blocks))).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    )
    right = targets.withColumn("_chunk", F.pmod(F.xxhash64(*targets.columns), F.lit(chunks)).cast("int")).withColumn(
        "_row_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(row_blocks - 1).cast("bigint")))
    )

    def run(some_rows: pa.Table, some_targets: pa.Table) -> pa.Table:
        if not some_rows.num_rows or not some_targets.num_rows:
            return out.empty_table()
        some_rows = some_rows.drop_columns(["_row_block", "_chunk"])
        some_targets = some_targets.drop_columns(["_row_block", "_chunk"])
        results = kernel(cut(some_rows, some_targets.num_rows, d), some_targets)
        return pa.concat_tables([pa.table(result).cast(out) for result in results])

    key = ["_row_block", "_chunk"]
    return reduce(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema))
