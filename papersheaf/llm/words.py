"""Words of whole texts as NumPy arrays inside Arrow batches.

All patterns in use split on ASCII characters only, so words are found on the UTF-8 bytes: one lookup per byte
for a whole slice of documents, without a Python object per word. Hashes have 64 bits and do not depend on the
machine, the batch or the slice.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from papersheaf.operators.blocks import arrow_schema

SLICE_BYTES = 1 << 20
LONG_WORD = 64
PRIME = np.uint64(0x9E3779B97F4A7C15)
OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
STEP = np.uint64(0xD6E8FEB86659FD93)  # odd, so it has an inverse modulo 2**64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def alphanumeric() -> np.ndarray:
    """Bytes of words made of ASCII letters, digits and everything beyond ASCII."""
    table = np.zeros(256, bool)
    for first, last in (("0", "9"), ("A", "Z"), ("a", "z")):
        table[ord(first) : ord(last) + 1] = True
    table[0x80:] = True
    return table


@dataclass
class Words:
    """The words of a slice of documents: word ``k`` of document ``d`` is number ``bounds[d] + k``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def documents(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offset of each row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of whole rows of about ``size`` bytes of text, at least one row each."""
    for batch in batches:
        _, offsets = utf8(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def split(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> Words:
    """Maximal runs of bytes of one kind that do not cross a document's end; kind 0 separates."""
    kind = np.zeros(len(data) + 2, np.uint8)
    kind[1:-1] = kinds[data]
    change = kind[1:] != kind[:-1]
    change[offsets] = True
    starts = np.flatnonzero(change[:-1] & (kind[1:-1] > 0))
    ends = np.flatnonzero(change[1:] & (kind[1:-1] > 0)) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * OTHER
    x ^= x >> np.uint64(29)
    x *= PRIME
    x ^= x >> np.uint64(32)
    return x


def hashes(words: Words, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes, with A-Z lower-cased if asked for."""
    data = LOWER[words.data] if lower else words.data
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, np.dtype("<u8"), padded.data, strides=(1,))
    lengths = words.ends - words.starts
    keep = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    out = mix(lengths.astype(np.uint64) + PRIME)
    active = np.flatnonzero(lengths <= LONG_WORD)
    done = 0
    while len(active):
        left = np.minimum(lengths[active] - done, 8)
        out[active] = mix(out[active] * STEP + (eight[words.starts[active] + done] & keep[left]))
        done += 8
        active = active[lengths[active] > done]
    for k in np.flatnonzero(lengths > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(data[words.starts[k] : words.ends[k]].tobytes())
    return out


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def series(base: int) -> np.ndarray:
        table = np.full(size, base, np.uint64)
        table[0] = 1
        return np.cumprod(table, dtype=np.uint64)

    return series(int(STEP)), series(pow(int(STEP), -1, 1 << 64))


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive values, by differences of one running sum.

    Entry ``k`` belongs to ``values[k:k + width]``; windows that run over a document's end are the caller's to leave out.
    """
    if len(values) < width:
        return np.zeros(0, np.uint64)
    forward, backward = _powers(1 << int(len(values) + 1).bit_length())
    running = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * forward[: len(values)], out=running[1:])
    return mix((running[width:] - running[:-width]) * backward[: len(values) - width + 1])


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on between tasks and would keep the most that any task needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_slices(rows: DataFrame, kernel: Callable[[pa.RecordBatch], dict], schema: str, text: str = "text") -> DataFrame:
    """``kernel`` on every slice of rows; it returns columns by name."""
    out = arrow_schema(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            if batch.num_rows:
                yield from pa.table(kernel(batch), schema=out).to_batches()
        give_back()

    return rows.mapInArrow(run, schema)
