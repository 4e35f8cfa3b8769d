"""Near-duplicate documents by min-max hashing, banding and confirmation on full shingle sets.

Every permutation gives two signature values, its minimum and its maximum over the shingles of a document, so a
signature of 128 values takes 64 hash evaluations per shingle. Bands of four values make documents meet in buckets:
a pair at the threshold of 0.8 shares none of the 32 bands with a probability of 5e-8. Candidates are confirmed on
the full sets.

A bucket never becomes a list of all its pairs. Documents with equal sets are one class first. Then each class of a
bucket is compared with the bucket's smallest class, and confirmed links are contracted to components. Pairs of a
bucket that still lie in different components are all compared in a second step, from the members outside its largest
component, so no link between different sets is lost.

Defined results: null text, empty text and text without words have an empty set and link with nothing. A row without
``doc_id`` takes part in no link, has no ``component_id`` and is kept. A ``doc_id`` names one document: sets whose smallest
``doc_id`` is the same are one group, and rows that repeat a kept ``doc_id`` are all kept. Only ``doc_id`` and ``text`` are read, other columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersheaf.llm import words
from papersheaf.llm.tables import measured
from papersheaf.operators.blocks import arrow_schema
from papersheaf.operators.components import connected_components
from papersheaf.session import materialized

PERMUTATIONS = 64
BAND_VALUES = 4
BLOCK = 512
COLUMNS = 4096
SKETCH_AGREEMENT = 96  # of 128 bits; a pair at 0.8 agrees on 115 on average, with a deviation of 3.4


def _multipliers(permutations: int) -> np.ndarray:
    return words.mix(np.arange(1, permutations + 1, dtype=np.uint64) * words.STEP) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    data, offsets = words.utf8(texts)
    found = words.split(data, offsets, ~words.SPACE)
    hashed = words.hashes(found, lower=True)
    full = words.windows(hashed, width)
    sets = []
    for start, stop in zip(found.bounds[:-1], found.bounds[1:]):
        if stop - start >= width:
            sets.append(np.unique(full[start : stop - width + 1]))
        else:
            sets.append(words.windows(hashed[start:stop], int(stop - start)) if stop > start else np.zeros(0, np.uint64))
    return sets


def signatures(documents: DataFrame, width: int = 5, permutations: int = PERMUTATIONS) -> DataFrame:
    """``(doc_id, n_shingles, digest, signature, sketch_a, sketch_b)``; all but the first two null for empty sets.

    ``digest`` names the set, ``signature`` holds the 32-bit minima and maxima, the sketch one bit of each.
    """
    multipliers = _multipliers(permutations)

    def kernel(batch: pa.RecordBatch) -> dict:
        sets = shingle_sets(batch.column("text"), width)
        sizes = np.array([len(s) for s in sets], np.int64)
        some = np.flatnonzero(sizes)
        signed = np.zeros((len(some), 2 * permutations), np.uint32)
        if len(some):
            values = np.concatenate([sets[k] for k in some])
            first = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
            for k, multiplier in enumerate(multipliers):
                permuted = ((values * multiplier) >> np.uint64(32)).astype(np.uint32)
                signed[:, 2 * k] = np.minimum.reduceat(permuted, first)
                signed[:, 2 * k + 1] = np.maximum.reduceat(permuted, first)
        mixed = words.mix(signed[:, :128].astype(np.uint64)) & np.uint64(1)
        packed = np.packbits(np.pad(mixed.astype(np.uint8), ((0, 0), (0, 128 - mixed.shape[1]))), axis=1)
        sketch = packed.reshape(-1).view("<i8").reshape(-1, 2)
        digest, signature, a, b = ([None] * len(sets) for _ in range(4))
        for row, k in enumerate(some):
            digest[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
            signature[k] = signed[row].tobytes()
            a[k], b[k] = int(sketch[row, 0]), int(sketch[row, 1])
        return {
            "doc_id": batch.column("doc_id"), "n_shingles": sizes, "digest": digest, "signature": signature,
            "sketch_a": a, "sketch_b": b,
        }

    schema = "doc_id bigint, n_shingles bigint, digest binary, signature binary, sketch_a bigint, sketch_b bigint"
    return words.map_slices(documents.select("doc_id", "text"), kernel, schema)


def bands(classes: DataFrame, band_values: int = BAND_VALUES) -> DataFrame:
    """``(key, rep)``: one row per class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32)
            grouped = values.reshape(batch.num_rows, -1, band_values).astype(np.uint64)
            keys = np.broadcast_to(np.arange(grouped.shape[1], dtype=np.uint64) + words.PRIME, grouped.shape[:2])
            for k in range(band_values):
                keys = words.mix(keys * words.STEP + grouped[:, :, k])
            ids = np.repeat(batch.column("rep").to_numpy(), grouped.shape[1])
            yield from pa.table({"key": keys.reshape(-1).view(np.int64), "rep": ids}, schema=out).to_batches()

    out = arrow_schema(classes, "key bigint, rep bigint")
    return classes.select("rep", "signature").mapInArrow(run, "key bigint, rep bigint")


def confirmed(pairs: DataFrame, documents: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` with 100 * intersection >= percent * union of their full sets.

    ``pairs`` must be a written table. Only texts that some pair asks for are moved.
    """
    asked = materialized(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = materialized(
        documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(measured(asked, 16), "doc_id")
    )
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    paired = pairs.select("a", "b").join(left, "a").join(right, "b")

    def kernel(batch: pa.RecordBatch) -> dict:
        one = shingle_sets(batch.column("text_a"), width)
        two = shingle_sets(batch.column("text_b"), width)
        common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(one, two)], np.int64)
        total = np.array([len(x) + len(y) for x, y in zip(one, two)], np.int64) - common
        linked = (100 * common >= percent * total) & (total > 0)
        keep = batch.filter(pa.array(linked))
        return {"a": keep.column("a"), "b": keep.column("b")}

    return words.map_slices(paired, kernel, "a bigint, b bigint", text="text_a")


def _comparable(percent: int) -> F.Column:
    """Exact by size; by sketch with an error far below that of the bands."""
    size = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    differing = sum(
        F.bit_count(F.col(f"{name}_a").bitwiseXOR(F.col(f"{name}_b"))) for name in ("sketch_a", "sketch_b")
    )
    return size & (differing <= 128 - SKETCH_AGREEMENT)


def near_duplicates(
    documents: DataFrame,
    width: int = 5,
    percent: int = 80,
    permutations: int = PERMUTATIONS,
    band_values: int = BAND_VALUES,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``documents``."""
    signed = materialized(signatures(documents, width, permutations))
    named = signed.filter("digest is not null and doc_id is not null")
    groups = materialized(named.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    classes = materialized(
        named.withColumnRenamed("doc_id", "rep").join(groups, ["digest", "rep"]).drop("digest").dropDuplicates(["rep", "signature"])
    )
    sizes = classes.select("rep", F.col("n_shingles").alias("n"), "sketch_a", "sketch_b")

    placed = bands(classes, band_values)
    shared = placed.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("members")).filter("members > 1")
    # buckets with the same smallest class are one group, which holds the pairs of each of them
    members = materialized(placed.join(shared.select("key", "pivot"), "key").select("pivot", "rep").distinct())

    def sized(pairs: DataFrame) -> DataFrame:
        a = sizes.select(*(F.col(c).alias(f"{c}_a") for c in sizes.columns)).withColumnRenamed("rep_a", "a")
        b = sizes.select(*(F.col(c).alias(f"{c}_b") for c in sizes.columns)).withColumnRenamed("rep_b", "b")
        return pairs.join(a, "a").join(b, "b").filter(_comparable(percent)).select("a", "b")

    first = members.filter("pivot < rep").select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
    first = materialized(sized(first))
    links = materialized(confirmed(first, documents, width, percent))
    labels = _labels(links)

    # groups that hold several components: everything outside the largest one against everything else
    placed = members.join(labels, "rep", "left")
    placed = materialized(placed.select("pivot", "rep", F.coalesce("label", "rep").alias("label")))
    main = placed.groupBy("pivot", "label").agg(F.count("*").alias("n")).groupBy("pivot")
    main = main.agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("members"), F.count("*").alias("parts"))
    open_rows = materialized(placed.join(main.filter("parts > 1").drop("parts"), "pivot").join(sizes, "rep"))
    if not open_rows.isEmpty():
        links = materialized(links.unionByName(_across(open_rows, documents, width, percent)))
        labels = _labels(links)

    components = groups.join(labels, "rep", "left").select("digest", F.coalesce("label", "rep").alias("component"))
    return (
        signed.select("doc_id", "n_shingles", "digest")
        .join(components, "digest", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _across(rows: DataFrame, documents: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` between components of a group, enough to join all components that have one.

    ``rows`` are written ``(pivot, rep, label, main, members, n, sketch_a, sketch_b)``. Each group is cut into blocks, rows
    outside its main component meet all rows block by block, and a block pair returns a spanning forest, not its pairs.
    """
    asked = materialized(rows.select(F.col("rep").alias("doc_id")).distinct())
    texts = documents.select("doc_id", "text").join(measured(asked, 16), "doc_id")

    def sets(batch: pa.RecordBatch) -> dict:
        found = shingle_sets(batch.column("text"), width)
        return {"rep": batch.column("doc_id"), "shingles": [x.tobytes() for x in found]}

    held = materialized(words.map_slices(texts, sets, "rep bigint, shingles binary"))
    placed = rows.withColumn("blocks", F.ceil(F.col("members") / F.lit(BLOCK)).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).join(held, "rep")
    every = F.explode(F.expr("sequence(0, blocks - 1)"))
    left = placed.filter("label <> main").select("*", F.col("block").alias("x"), every.alias("y"), F.lit(0).alias("side"))
    right = placed.select("*", every.alias("x"), F.col("block").alias("y"), F.lit(1).alias("side"))
    schema = "a bigint, b bigint"
    out = arrow_schema(rows, schema)

    def run(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        one, two = group.filter(pa.array(side == 0)), group.filter(pa.array(side == 1))
        return pa.table(_forest(one, two, percent), schema=out)

    columns = ["pivot", "x", "y", "side", "rep", "label", "n", "sketch_a", "sketch_b", "shingles"]
    return left.unionByName(right).select(*columns).groupBy("pivot", "x", "y").applyInArrow(run, schema)


def _forest(left: pa.Table, right: pa.Table, percent: int) -> dict:
    if not left.num_rows or not right.num_rows:
        return {"a": [], "b": []}
    n, m = (t.column("n").to_numpy().astype(np.int64) for t in (left, right))
    label, other = (t.column("label").to_numpy() for t in (left, right))
    sketches = [np.stack([t.column(c).to_numpy().view(np.uint64) for c in ("sketch_a", "sketch_b")], 1) for t in (left, right)]
    agree = label[:, None] != other[None, :]
    agree &= 100 * np.minimum(n[:, None], m[None, :]) >= percent * np.maximum(n[:, None], m[None, :])
    differing = np.bitwise_count(sketches[0][:, None, :] ^ sketches[1][None, :, :]).sum(2, dtype=np.int64)
    agree &= differing <= 128 - SKETCH_AGREEMENT
    rows, columns = np.flatnonzero(agree.any(1)), np.flatnonzero(agree.any(0))
    if not len(rows):
        return {"a": [], "b": []}
    held = left.column("shingles").to_pylist(), right.column("shingles").to_pylist()
    one = [np.frombuffer(held[0][k], np.uint64) for k in rows]
    two = [np.frombuffer(held[1][k], np.uint64) for k in columns]
    both = np.intersect1d(np.concatenate(one), np.concatenate(two))
    common = np.zeros((len(rows), len(columns)), np.float32)
    for start in range(0, len(both), COLUMNS):
        part = both[start : start + COLUMNS]
        common += _incidence(one, part) @ _incidence(two, part).T
    union = n[rows][:, None] + m[columns][None, :] - common
    linked = agree[np.ix_(rows, columns)] & (100 * common.astype(np.int64) >= percent * union.astype(np.int64))
    i, j = np.nonzero(linked)
    pairs = np.unique(np.stack([label[rows][i], other[columns][j]], 1), axis=0) if len(i) else []
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    kept = []
    for a, b in pairs:
        ra, rb = find(int(a)), find(int(b))
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            kept.append((int(a), int(b)))
    return {"a": [a for a, _ in kept], "b": [b for _, b in kept]}


def _incidence(sets: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(values)), np.float32)
    for row, held in enumerate(sets):
        at = np.searchsorted(values, held)
        at[at == len(values)] = 0
        out[row, at[values[at] == held]] = 1
    return out


def _labels(links: DataFrame) -> DataFrame:
    """``(rep, label)`` of every class that has a link."""
    nodes = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    return connected_components(nodes, edges).withColumnRenamed("id", "rep")
