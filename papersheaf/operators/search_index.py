"""An index on disk for exact top-k search by dot product.

Vectors lie in cells around centres, one folder for each cell, so a search reads only the cells that it needs. What is known of a cell is
its centre, the largest distance of its vectors from there, and the range of their lengths. From that follows an upper bound on the dot
product of a query with any vector of the cell. A search reads the cells with the highest bounds first, until they hold enough
rows; the similarity of the k-th best found there is a lower bound on the answer, and in a second step every other cell whose upper
bound reaches it is read. All cells left out are proven to hold nothing better, so the result is that of a full scan.

A cell table is written last: a folder without it is no index. Centres are at most ``MAX_CELLS`` vectors, whatever the data's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersheaf.functions import ranking, vectors
from papersheaf.operators import blocks, kmeans
from papersheaf.session import materialized

MAX_CELLS = 4096
FITTING_PASSES = 5
FIRST_CELLS = 2  # read in the first step at least
SLACK = 1e-9


def build_index(points: DataFrame, path: str, cells: int | None = None, seed: int = kmeans.SEED) -> DataFrame:
    """Writes ``(doc_id, embedding)`` below ``path`` and returns the cell table ``(cell, n, radius, shortest, longest, center)``.

    ``cells`` is the square root of the number of rows unless given. Centres come from a few passes of k-means; any centres give
    right results, good ones make searches read less.
    """
    spark = points.sparkSession
    rows = points.select("doc_id", vectors.doubles(F.col("embedding")).alias("embedding"))
    n = rows.count()
    wanted = max(1, min(MAX_CELLS, cells or math.isqrt(n), n))
    if n:
        centres = kmeans.fit_many(rows, [wanted], seed, restarts=1, max_iter=FITTING_PASSES)[wanted].centers
    else:
        centres = np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(centres)
    id_type = points.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, embedding array<double>, cell int, far double, length double"
    out = blocks.arrow_schema(rows, schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = blocks.matrix(batch.column("embedding"))
            if len(x):
                d = blocks.squared_distances(x, shared.value)
                best = d.argmin(1)
                far, length = np.sqrt(d[np.arange(len(x)), best]), np.sqrt((x * x).sum(1))
                yield from pa.table([*batch.columns, best.astype(np.int32), far, length], schema=out).to_batches()

    placed = rows.mapInArrow(place, schema)
    # a cell's rows are written by the tasks that hold them; a crowded cell is many files
    placed.write.partitionBy("cell").parquet(f"{path}/rows")
    stored = spark.read.schema(schema).parquet(f"{path}/rows")
    known = stored.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("far").alias("radius"), F.min("length").alias("shortest"), F.max("length").alias("longest")
    )
    centers = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, center array<double>")
    known.join(F.broadcast(centers), "cell").write.parquet(f"{path}/cells")  # at most MAX_CELLS rows
    return spark.read.parquet(f"{path}/cells")


def bounds(queries: np.ndarray, centres: np.ndarray, radius: np.ndarray, shortest: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """An upper bound on the dot product of each query with any vector of each cell.

    Two bounds hold: by Cauchy and Schwarz, ``q.c + |q| r``; and as ``2 q.x = |q|^2 + |x|^2 - |q - x|^2``, with the distance of query and
    vector at least that of query and centre less ``r``. The product of the lengths bounds both.
    """
    length = np.sqrt((queries * queries).sum(1))[:, None]
    by_centre = queries @ centres.T + length * radius
    gap = np.maximum(np.sqrt(blocks.squared_distances(queries, centres)) - radius, 0.0)
    by_distance = (length * length + longest * longest - gap * gap) / 2
    found = np.minimum(np.minimum(by_centre, by_distance), length * np.maximum(longest, shortest))
    return found + SLACK * (1 + length * longest)


def _visits(queries: DataFrame, cells: pa.Table, top_k: int, known: bool) -> DataFrame:
    """``queries`` with the ``cells`` to read: those of the first step, or with ``known`` those that the k-th best ``least`` still asks for."""
    shared = queries.sparkSession.sparkContext.broadcast(cells)  # at most MAX_CELLS rows
    query_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {query_type}, embedding array<double>, cells array<int>"
    out = blocks.arrow_schema(queries, schema)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        column = lambda name: table.column(name).to_numpy()
        centres, ids, n = blocks.matrix(table.column("center")), column("cell"), column("n")
        for batch in batches:
            if not batch.num_rows:
                continue
            high = bounds(blocks.matrix(batch.column("embedding")), centres, column("radius"), column("shortest"), column("longest"))
            order = np.argsort(-high, axis=1, kind="stable")
            held = np.cumsum(n[order], axis=1)
            first = np.maximum((held < top_k).sum(1) + 1, FIRST_CELLS)  # cells in order of bound until they hold enough rows
            chosen = []
            for k, count in enumerate(first):
                if known:
                    least = batch.column("least")[k].as_py()
                    rest = order[k, count:]
                    chosen.append(ids[rest[high[k, rest] >= (-np.inf if least is None else least)]].tolist())
                else:
                    chosen.append(ids[order[k, :count]].tolist())
            columns = [batch.column("query_id"), batch.column("embedding"), pa.array(chosen, pa.list_(pa.int32()))]
            yield from pa.table(columns, schema=out).to_batches()

    names = ["query_id", "embedding", *(["least"] if known else [])]
    return queries.select(names).mapInArrow(choose, schema)


def _best(rows: DataFrame, visits: DataFrame, top_k: int, limit_bytes: int) -> DataFrame:
    """The best rows of each query among the cells that it visits, from each task."""
    id_type, query_type = rows.schema["doc_id"].dataType.simpleString(), visits.schema["query_id"].dataType.simpleString()
    schema = f"query_id {query_type}, doc_id {id_type}, similarity double"

    def kernel(slices: Iterator[pa.Table], asked: pa.Table) -> Iterator[dict]:
        wanted, queries = blocks.matrix(asked.column("embedding")), asked.column("query_id").to_numpy()
        of_cell: dict[int, list[int]] = {}
        for k, cells in enumerate(asked.column("cells").to_pylist()):
            for cell in cells:
                of_cell.setdefault(cell, []).append(k)
        ids: dict[int, np.ndarray] = {}
        sims: dict[int, np.ndarray] = {}
        for part in slices:
            x, docs, cells = blocks.matrix(part.column("embedding")), part.column("doc_id").to_numpy(), part.column("cell").to_numpy()
            for cell in np.unique(cells):
                asking = of_cell.get(int(cell), [])
                if not asking:
                    continue
                here = np.flatnonzero(cells == cell)
                found = wanted[asking] @ x[here].T
                for k, values in zip(asking, found):
                    new_ids = np.concatenate([ids.get(k, docs[:0]), docs[here]])
                    new_sims = np.concatenate([sims.get(k, values[:0]), values])
                    keep = np.lexsort((new_ids, -new_sims))[:top_k]
                    ids[k], sims[k] = new_ids[keep], new_sims[keep]
        for k in ids:
            yield {"query_id": np.repeat(queries[k : k + 1], len(ids[k])), "doc_id": ids[k], "similarity": sims[k]}

    fields = ["doc_id", "embedding", "cell"]
    return blocks.against(rows.select(fields), visits, kernel, schema, reduce=lambda parts: parts, limit_bytes=limit_bytes)


def _read(spark: SparkSession, path: str, schema: str, visits: DataFrame) -> DataFrame:
    """The rows of all cells that any query visits; the other folders are not listed in the scan."""
    asked = sorted(row.cell for row in visits.select(F.explode("cells").alias("cell")).distinct().collect())  # at most MAX_CELLS
    return spark.read.schema(schema).parquet(f"{path}/rows").filter(F.col("cell").isin(asked))


def search_index(
    queries: DataFrame, path: str, top_k: int = 5, limit_bytes: int = blocks.TARGET_BYTES
) -> tuple[DataFrame, DataFrame]:
    """``(query_id, rank, doc_id, similarity)`` as ``similarity.find_most_similar`` gives it, and ``(query_id, cells)`` with the cells read."""
    spark = queries.sparkSession
    cells = spark.read.parquet(f"{path}/cells")
    if cells.isEmpty():  # an index of no rows
        query_type = queries.schema["query_id"].dataType.simpleString()
        none = spark.createDataFrame([], f"query_id {query_type}, doc_id bigint, similarity double, rank int")
        return none, spark.createDataFrame([], f"query_id {query_type}, cells array<int>")
    stored = spark.read.parquet(f"{path}/rows")
    schema = f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, embedding array<double>, cell int"
    asked = materialized(queries.select("query_id", vectors.doubles(F.col("embedding")).alias("embedding")))
    known = cells.toArrow()
    order = [F.desc("similarity"), F.asc("doc_id")]
    first = materialized(_visits(asked, known, top_k, False))
    found = materialized(_best(_read(spark, path, schema, first), first, top_k, limit_bytes))
    ranked = ranking.top_per_key(found, ["query_id"], order, top_k)
    full = ranked.groupBy("query_id").agg(F.when(F.count("*") >= top_k, F.min("similarity")).alias("least"))
    second = materialized(_visits(asked.join(full, "query_id", "left"), known, top_k, True))
    more = _best(_read(spark, path, schema, second), second, top_k, limit_bytes)
    best = ranking.top_per_key(found.unionByName(more), ["query_id"], order, top_k)
    read = first.select("query_id", "cells").unionByName(second.select("query_id", "cells"))
    return best, read.groupBy("query_id").agg(F.flatten(F.collect_list("cells")).alias("cells"))
