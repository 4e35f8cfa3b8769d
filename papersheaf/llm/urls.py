"""URL filters: host and path rules, and exact membership in a list of hosts by a Bloom filter cascade.

Level 0 of the cascade holds the listed keys. Level 1 holds the keys of the corpus that level 0 takes for listed ones by mistake,
level 2 the listed keys that level 1 takes for those, and so on until a level makes no mistake. Because the levels are built
over every key of the corpus, the answer is exact for each of them, and rows are judged without a join.

Keys are dealt to shards by hash, as many as all levels of one need to stay within ``limit_bytes``; their sizes follow from
the counted keys of both sides. The levels of all shards are one written table of chunks of words, made in Spark. If there is one shard
within the limit, it is broadcast and rows are judged where they lie. Else rows and levels meet by shard and salt: a task reads the
chunks of one shard and then the shard's rows as a stream, so it holds one shard at a time, no more than that ever comes to the
driver, and a shard with many rows is spread over the salts. The result is the same.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is not listed. Repeated urls
are judged alike. Other columns may have any name; one with the name of the answer is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersheaf.llm.tables import measured
from papersheaf.operators.blocks import arrow_schema
from papersheaf.session import discard, materialized

LIMIT_BYTES = 32 * 1024 * 1024
BITS_PER_KEY = (12, 6)  # of level 0, of the others
HASHES = (8, 4)
CHUNK = 4096  # words of a row of the table of levels
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"^(?s).*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule of ``(verdict, host, path)`` as text, and its verdict; both null if none fits.

    A rule fits its host and all subdomains where the path starts with the rule's. Rules are a short list of parameters.
    """
    ordered = sorted(rules, key=lambda rule: (-len(rule[1] + rule[2]), -len(rule[1])))
    fits = [
        ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path) for _, rule_host, rule_path in ordered
    ]
    name = F.coalesce(F.lit(None).cast("string"), *(F.when(f, F.lit(r[1] + r[2])) for f, r in zip(fits, ordered)))
    verdict = F.coalesce(F.lit(None).cast("string"), *(F.when(f, F.lit(r[0])) for f, r in zip(fits, ordered)))
    return name, verdict


@dataclass
class Level:
    words: np.ndarray
    bits: int
    hashes: int
    seed: int

    def holds(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        held = np.ones(len(first), bool)
        for k in range(self.hashes):
            at = _bit(first, second, k, self.seed, self.bits)
            held &= (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return held


def _bit(first: np.ndarray, second: np.ndarray, k: int, seed: int, bits: int | np.ndarray) -> np.ndarray:
    x = first.view(np.uint64) + np.uint64(64 * seed + k + 1) * (second.view(np.uint64) | np.uint64(1))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(20)) % np.asarray(bits, np.uint64)).astype(np.int64)


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def listed(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Membership of keys given by two hashes: decided by the first level that does not hold the key."""
        answer = np.full(len(first), len(self.levels) % 2 == 1)
        open_rows = np.arange(len(first))
        for number, level in enumerate(self.levels):
            held = level.holds(first[open_rows], second[open_rows])
            answer[open_rows[~held]] = number % 2 == 1
            open_rows = open_rows[held]
        return answer


@dataclass
class Cascades:
    """The cascades of all shards: ``levels`` is a written table ``(shard, level, bits, chunk, at, words)``.

    Iterating over them loads one shard at a time to the driver.
    """

    shards: int
    levels: DataFrame
    limit_bytes: int

    def __len__(self) -> int:
        return self.shards

    def __iter__(self) -> Iterator[Cascade]:
        return (_loaded(self.levels.filter(F.col("shard") == shard)) for shard in range(self.shards))


def _hashed(key: Column, shards: int) -> list[Column]:
    second = F.xxhash64(F.lit("second"), key)
    return [F.xxhash64(key).alias("first"), second.alias("second"), F.pmod(F.xxhash64(second), F.lit(shards)).alias("shard")]


def _sizes(count: np.ndarray, number: int) -> np.ndarray:
    """The bits of a level for ``count`` keys."""
    return np.maximum(64, -(-count * BITS_PER_KEY[min(number, 1)] // 64) * 64)


def expected_bytes(listed: int, other: int) -> float:
    """The size of all levels for these numbers of keys, from the share of keys that a level takes by mistake."""
    first, later = ((1 - math.exp(-h / b)) ** h for b, h in zip(BITS_PER_KEY, HASHES))
    bits = listed * BITS_PER_KEY[0]
    encoded, asked = other * first, float(listed)
    while encoded >= 1:
        bits += encoded * BITS_PER_KEY[1]
        encoded, asked = asked * later, encoded
    return bits / 8


def _map(rows: DataFrame, schema: str, run: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    out = arrow_schema(rows, schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from pa.table(run(batch), schema=out).to_batches()

    return rows.mapInArrow(each, schema)


def _level(keys: DataFrame, counts: DataFrame, number: int) -> DataFrame:
    """The filters of all shards for ``keys (first, second, shard)``, as rows of chunks with the words that are not zero."""
    hashes = HASHES[min(number, 1)]

    def bits(batch: pa.RecordBatch) -> dict:
        first, second, shard, count = (batch.column(c).to_numpy() for c in ("first", "second", "shard", "keys"))
        size = _sizes(count, number)
        at = np.concatenate([_bit(first, second, k, number, size) for k in range(hashes)])
        return {
            "shard": np.tile(shard, hashes), "bits": np.tile(size, hashes),
            "word": at >> 6, "value": (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64),
        }

    numbered = keys.join(measured(counts, 16), "shard").select("first", "second", "shard", "keys")
    rows = _map(numbered, "shard bigint, bits bigint, word bigint, value bigint", bits)
    filled = rows.groupBy("shard", "bits", "word").agg(F.bit_or("value").alias("value"))
    chunk = F.floor(F.col("word") / CHUNK).alias("chunk")
    entry = F.struct((F.col("word") % CHUNK).cast("int").alias("at"), F.col("value"))
    chunks = filled.groupBy("shard", "bits", chunk).agg(F.collect_list(entry).alias("entries"))  # at most CHUNK of them
    return chunks.select(
        "shard", F.lit(number).alias("level"), "bits", "chunk",
        F.col("entries.at").alias("at"), F.col("entries.value").alias("words"),
    )


def _filled(cascade: dict[int, Level], rows: pa.Table | pa.RecordBatch) -> None:
    """Puts rows of the table of levels into the levels of one shard."""
    numbers, sizes, chunks = (rows.column(c).to_pylist() for c in ("level", "bits", "chunk"))
    places, words = rows.column("at"), rows.column("words")
    for k, (number, size, chunk) in enumerate(zip(numbers, sizes, chunks)):
        level = cascade.setdefault(number, Level(np.zeros(0, np.uint64), size, HASHES[min(number, 1)], number))
        if not len(level.words):
            level.words = np.zeros(size // 64, np.uint64)
        at = places[k].values.to_numpy() + chunk * CHUNK
        level.words[at] = words[k].values.to_numpy().view(np.uint64)


def _loaded(levels: DataFrame) -> Cascade:
    """The cascade of one shard on the driver."""
    found: dict[int, Level] = {}
    _filled(found, levels.toArrow().combine_chunks())
    return Cascade([found[k] for k in sorted(found)])


def _judged(rows: DataFrame, schema: str, cascades: Cascades, run: Callable[[pa.RecordBatch, Cascade], dict]) -> DataFrame:
    """``run`` on batches of ``rows (first, second, shard, ..)`` with the cascade of their shard."""
    held = (cascades.levels.select("shard", "level", "bits").distinct().agg(F.sum("bits")).first()[0] or 0) // 8
    if cascades.shards == 1 and held <= cascades.limit_bytes:
        shared = rows.sparkSession.sparkContext.broadcast(_loaded(cascades.levels))
        return _map(rows, schema, lambda batch: run(batch, shared.value))
    out = arrow_schema(rows, schema)
    salts = max(1, -(-rows.sparkSession.sparkContext.defaultParallelism // cascades.shards))
    dealt = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    copies = cascades.levels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = dealt.unionByName(copies, allowMissingColumns=True).repartition(cascades.shards * salts, "shard", "salt")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, levels, cascade = None, {}, Cascade()
        for batch in batches:
            shard, salt = (batch.column(c).to_numpy() for c in ("shard", "salt"))
            of_rows = batch.column("level").is_null().to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0) | (np.diff(of_rows.view(np.int8)) != 0)) + 1
            for start, stop in zip([0, *turns], [*turns, batch.num_rows]):
                if start == stop:
                    continue
                if group != (shard[start], salt[start]):
                    group, levels, cascade = (shard[start], salt[start]), {}, Cascade()
                part = batch.slice(start, stop - start)
                if not of_rows[start]:
                    _filled(levels, part)
                    cascade = Cascade([levels[k] for k in sorted(levels)])
                else:
                    yield from pa.table(run(part, cascade), schema=out).to_batches()

    # a shard's levels come before its rows
    ordered = both.sortWithinPartitions("shard", "salt", F.col("level").isNull(), "level", "chunk")
    return ordered.mapInArrow(each, schema)


def build(listed: DataFrame, universe: DataFrame, key: str = "key", limit_bytes: int = LIMIT_BYTES) -> Cascades:
    """The cascades for the keys of ``listed``, exact for all keys of ``universe``."""
    inside = listed.select(F.col(key).alias("key")).filter("key is not null").distinct()
    outside = universe.select(F.col(key).alias("key")).filter("key is not null").distinct().join(inside, "key", "left_anti")
    inside, outside = materialized(inside), materialized(outside)
    shards = max(1, math.ceil(expected_bytes(inside.count(), outside.count()) / limit_bytes))
    encoded, other = (materialized(keys.select(*_hashed(F.col("key"), shards))) for keys in (inside, outside))
    discard(inside, outside)
    spark, levels, number = listed.sparkSession, [], 0
    while True:
        counts = materialized(encoded.groupBy("shard").agg(F.count("*").alias("keys")))
        if counts.isEmpty():
            break
        levels.append(materialized(_level(encoded, counts, number)))

        def passing(batch: pa.RecordBatch, cascade: Cascade) -> dict:
            first, second = (batch.column(c).to_numpy() for c in ("first", "second"))
            held = cascade.levels[0].holds(first, second) if cascade.levels else np.zeros(len(first), bool)
            return {"first": first[held], "second": second[held], "shard": batch.column("shard").to_numpy()[held]}

        level = Cascades(shards, levels[-1], limit_bytes)
        left = materialized(_judged(other, "first bigint, second bigint, shard bigint", level, passing))
        encoded, other, number = left, encoded, number + 1
    if not levels:
        levels = [spark.createDataFrame([], "shard bigint, level int, bits bigint, chunk bigint, at array<int>, words array<bigint>")]
    return Cascades(shards, reduce(DataFrame.unionByName, levels), limit_bytes)


def contains(rows: DataFrame, key: Column, cascades: Cascades, name: str = "listed") -> DataFrame:
    """``rows`` with a column that tells whether ``key`` is listed."""
    names = [f"`{c}`" for c in rows.columns if c != name]
    packed = rows.select(F.struct(*names).alias("row"), *_hashed(key, cascades.shards))

    def run(batch: pa.RecordBatch, cascade: Cascade) -> dict:
        first, second = (batch.column(c).to_numpy() for c in ("first", "second"))
        return {"row": batch.column("row"), "answer": cascade.listed(first, second)}

    schema = f"row {packed.schema['row'].dataType.simpleString()}, answer boolean"
    return _judged(packed, schema, cascades, run).select("row.*", F.col("answer").alias(name))
