"""Removal of repeated passages by difference-cover anchors.

A window of ``width`` words repeats where its word sequence also starts in a document with a smaller id. Hashing every
window of the corpus would move a row per word. Instead each document hashes short sequences, the anchors, only at
positions whose remainder by ``period`` lies in a difference cover: for any two positions some common shift below the
period puts both on the cover, so two equal windows always share an anchor at the same place within them. With a period of
31 the cover has 6 remainders, hence a row for every fifth word. Only windows around anchors that several documents have are
hashed in full and compared.

Every stage is pre-aggregated in its slice of documents: of equal anchors or windows in a slice only the smallest document's
travels under the common key, the others are already decided and are dealt out by a salt, so the rows of the most frequent
passage grow with the number of slices, not of documents.

Defined results: null or empty text has no words. A row without ``doc_id`` is neither changed nor compared. Rows that repeat
a ``doc_id`` do not count as smaller than each other. Texts shorter than a window are unchanged. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papersheaf.llm import words
from papersheaf.llm.tables import measured_bytes
from papersheaf.operators.blocks import arrow_schema
from papersheaf.session import materialized

# Perfect difference sets, whose differences give every remainder once.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


class Cover:
    """Anchor positions for windows of ``width`` words; anchor number ``r`` of a document stands at ``place(r)``."""

    def __init__(self, width: int):
        self.width = width
        self.period = max(p for p in COVERS if p == 1 or 3 * p <= 2 * width)
        self.length = width - self.period + 1
        self.shifts = np.array(COVERS[self.period])
        self.rank = np.full(self.period, -1)
        self.rank[self.shifts] = np.arange(len(self.shifts))

    def place(self, ranks: np.ndarray) -> np.ndarray:
        return ranks // len(self.shifts) * self.period + self.shifts[ranks % len(self.shifts)]

    def ranks(self, n_words: int) -> np.ndarray:
        """All anchors of a document of ``n_words``."""
        ranks = np.arange((n_words // self.period + 1) * len(self.shifts))
        return ranks[self.place(ranks) + self.length <= n_words]


def tokenized(texts: pa.Array) -> tuple[words.Words, np.ndarray]:
    data, offsets = words.utf8(texts)
    found = words.split(data, offsets, ~words.SPACE)
    return found, words.hashes(found)


def _compacted(
    keys: list[np.ndarray], ids: np.ndarray, tags: np.ndarray, places: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows to pass on, whether their key has a smaller id here, and whether it has any other id here.

    One row is left for each key, id and tag: equal sequences inside a text share its fate.
    """
    order = np.lexsort((places, tags, ids, *keys))
    keys, ids, tags = [k[order] for k in keys], ids[order], tags[order]
    new_key = np.ones(len(order), bool)
    new_key[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    new_id = new_key.copy()
    new_id[1:] |= ids[1:] != ids[:-1]
    new_row = new_id.copy()
    new_row[1:] |= tags[1:] != tags[:-1]
    group = np.cumsum(new_key) - 1
    later = (ids != ids[new_key][group])[new_row]
    several = (np.bincount(group, new_id, len(group)) > 1)[group][new_row]
    return order[new_row], later, several


def _unpacked_place() -> list[Column]:
    return [F.shiftright("place", 32).alias("tag"), F.col("place").bitwiseAND(0x7FFFFFFF).cast("int").alias("place")]


def shared_anchors(documents: DataFrame, cover: Cover) -> DataFrame:
    """``(doc_id, tag, place)``: numbers of anchors whose sequence other documents have as well."""

    def kernel(batch: pa.RecordBatch) -> dict:
        found, hashed = tokenized(batch.column("text"))
        counts = found.counts()
        position = np.arange(len(hashed)) - np.repeat(found.bounds[:-1], counts)
        n = np.repeat(counts, counts)
        at = np.flatnonzero((cover.rank[position % cover.period] >= 0) & (position + cover.length <= n) & (n >= cover.width))
        keys = words.windows(hashed, cover.length)[at]
        ids, tags = (np.repeat(batch.column(c).to_numpy(), counts)[at] for c in ("doc_id", "tag"))
        rank = position[at] // cover.period * len(cover.shifts) + cover.rank[position[at] % cover.period]
        order, later, several = _compacted([keys], ids, tags, rank)
        return {
            "key": keys[order].view(np.int64),
            "salt": np.where(later, 1 + ids[order] % 1024, 0).astype(np.int32),
            "doc_id": ids[order],
            "place": (tags[order] << 32) | rank[order],
            "decided": several,
        }

    schema = "key bigint, salt int, doc_id bigint, place bigint, decided boolean"
    anchors = words.map_slices(documents.filter("doc_id is not null").select("doc_id", "text", "tag"), kernel, schema)
    same = Window.partitionBy("key", "salt")
    several = F.min("doc_id").over(same) != F.max("doc_id").over(same)
    return anchors.withColumn("several", several).filter("decided or several").select("doc_id", *_unpacked_place())


def runs(places: DataFrame, keys: tuple[str, ...] = ("doc_id", "tag")) -> DataFrame:
    """The places of each document as runs: first and last of each, 32-bit numbers in ``runs``."""
    gathered = places.groupBy(*keys).agg(F.collect_list("place").alias("places"))  # no more than the document's words
    schema = ", ".join(f"{key} bigint" for key in keys) + ", runs binary"
    out = arrow_schema(places, schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("places")
            values, offsets = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
            packed = []
            for start, stop in zip(offsets[:-1], offsets[1:]):
                sorted_places = np.unique(values[start:stop])
                breaks = np.flatnonzero(np.diff(sorted_places) != 1)
                first = sorted_places[np.concatenate([[0], breaks + 1])]
                last = sorted_places[np.concatenate([breaks, [len(sorted_places) - 1]])]
                packed.append(np.stack([first, last], 1).astype("<i4").tobytes())
            yield from pa.table([*(batch.column(k) for k in keys), pa.array(packed, pa.binary())], schema=out).to_batches()

    return gathered.mapInArrow(pack, schema)


def unpacked(data: bytes) -> np.ndarray:
    pairs = np.frombuffer(data, "<i4").reshape(-1, 2).astype(np.int64)
    lengths = pairs[:, 1] - pairs[:, 0] + 1
    first = np.repeat(pairs[:, 0] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return first + np.arange(lengths.sum())


def repeated_windows(documents: DataFrame, anchors: DataFrame, cover: Cover) -> DataFrame:
    """``(doc_id, tag, place)``: starts of windows that also start in a document with a smaller id.

    ``anchors`` are the ``runs`` of shared anchors. ``tag`` is a checksum of the text, for rows that repeat an id.
    Windows are compared by 96 bits of hash.
    """

    def kernel(batch: pa.RecordBatch) -> dict:
        found, hashed = tokenized(batch.column("text"))
        at, ids, places, tags = [], [], [], []
        short, full = words.windows(hashed, cover.length), words.windows(hashed, cover.width)
        for row, packed in enumerate(batch.column("runs").to_pylist()):
            base, n = int(found.bounds[row]), int(found.bounds[row + 1] - found.bounds[row])
            if n < cover.width:
                continue
            every = cover.place(cover.ranks(n))
            flagged = unpacked(packed)
            flagged = cover.place(flagged[flagged < len(every)])
            near = every[np.isin(short[base + every], short[base + flagged])]
            change = np.zeros(n + 1, np.int64)
            np.add.at(change, np.maximum(near - cover.period + 1, 0), 1)
            np.add.at(change, near + 1, -1)
            starts = np.flatnonzero(np.cumsum(change)[: n - cover.width + 1] > 0)
            at.append(base + starts)
            places.append(starts)
            ids.append(np.full(len(starts), batch.column("doc_id")[row].as_py(), np.int64))
            tags.append(np.full(len(starts), batch.column("tag")[row].as_py(), np.int64))
        if not at:
            return {name: [] for name in ("key", "check", "salt", "doc_id", "place", "decided")}
        at, ids, places, tags = (np.concatenate(x) for x in (at, ids, places, tags))
        key = full[at]
        check = (words.windows(words.mix(hashed ^ words.PRIME), cover.width)[at] >> np.uint64(32)).astype(np.uint32)
        order, later, _ = _compacted([check, key], ids, tags, places)
        return {
            "key": key[order].view(np.int64),
            "check": check[order].view(np.int32),
            "salt": np.where(later, 1 + ids[order] % 1024, 0).astype(np.int32),
            "doc_id": ids[order],
            "place": (tags[order] << 32) | places[order],
            "decided": later,
        }

    schema = "key bigint, check int, salt int, doc_id bigint, place bigint, decided boolean"
    flagged = documents.select("doc_id", "text", "tag").join(measured_bytes(anchors, "runs"), ["doc_id", "tag"])
    found = words.map_slices(flagged, kernel, schema)
    smallest = F.min("doc_id").over(Window.partitionBy("key", "check", "salt"))
    found = found.withColumn("smallest", smallest).filter("decided or doc_id > smallest")
    return found.select("doc_id", *_unpacked_place())


def deduplicate(documents: DataFrame, width: int = 50) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: ``kept`` are the remaining words, joined by one space."""
    cover = Cover(width)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("tag", F.crc32(F.col("text").cast("binary")).bitwiseAND(0x7FFFFFFF))
    anchors = materialized(runs(shared_anchors(texts, cover)))
    removed = materialized(runs(repeated_windows(texts, anchors, cover)))

    def kernel(batch: pa.RecordBatch) -> dict:
        held = [bytes(t.as_buffer()).split() for t in batch.column("text")]  # white space of bytes is ASCII's
        packed = batch.column("runs").to_pylist()
        counts, gone = np.array([len(x) for x in held], np.int64), np.zeros(len(held), np.int64)
        hit = [k for k, data in enumerate(packed) if data is not None]
        if hit:
            found, hashed = tokenized(batch.column("text").take(pa.array(hit)))
            full = words.windows(hashed, width)
            for number, row in enumerate(hit):
                base, n = int(found.bounds[number]), int(counts[row])
                windows = full[base : base + n - width + 1]
                starts = np.flatnonzero(np.isin(windows, windows[unpacked(packed[row])]))
                change = np.zeros(n + 1, np.int64)
                change[starts] += 1
                change[starts + width] -= 1
                covered = np.cumsum(change)[:n] > 0
                gone[row] = covered.sum()
                held[row] = [held[row][k] for k in np.flatnonzero(~covered)]
        kept = [b" ".join(x).decode() for x in held]
        return {"doc_id": batch.column("doc_id"), "n_words": counts, "n_removed": gone, "kept": kept}

    joined = texts.join(measured_bytes(removed, "runs"), ["doc_id", "tag"], "left")
    return words.map_slices(joined, kernel, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
