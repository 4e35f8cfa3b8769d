"""Byte-level BPE by tree concatenation of separately encoded pieces.

Texts beyond ``piece_chars`` are cut into pieces that are rows of their own, so one very long text is encoded by many tasks.
Neighbouring pieces are then joined in a tree. Most cuts lie where the pre-tokenizer splits whatever stands around them,
and the halves' ids can follow each other as they are. In a stretch that offers no such place, the cut is in the middle
of a run of one kind of characters: a window around the join is encoded again and grows until it begins with a token of the
left half and ends with a token of the right half, at the same places. Every pair of neighbouring tokens then stands in some
encoding of their surroundings, which makes the joined sequence the encoding of the whole.

Vocabulary and merges come from a public tokenizer file that the caller names; nothing is trained here. Decoding joins the
bytes of the tokens.

Defined results: null counts as empty and has no ids. Strings of special tokens in a text are those tokens. Rows are encoded
one by one, whatever their ``doc_id``; repeated or missing ids do no harm. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import sys
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersheaf.llm import words
from papersheaf.operators.blocks import arrow_schema

PIECE_CHARS = 32_768
WINDOW = 64  # characters on each side of a join at first
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
RUN = 4  # characters of the same kind that make a place the middle of a run
LETTER, NUMBER, SPACE = (regex.compile(p) for p in (r"\p{L}", r"\p{N}", r"\s"))


# How byte-level tokenizers of this family split a text into pre-tokens.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PLAIN = "\\t\\n\\r\u0020-\u007e\u00a1-\u024f"
OTHER = regex.compile(f"[^{PLAIN}]")
KNOWN, KNOWN_BYTES = 1 << 17, 1 << 22  # remembered pre-tokens of a task, and what they and their ids may take
SLICE_BYTES = 1 << 18  # of text at a time, since its pre-tokens take many times as much
AT_ONCE = 512  # pre-tokens that the tokenizer gets at once, since its own results take far more room than ids
LONG_WORD = 64  # characters; longer ones are not remembered


def pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if LITTLE else np.asarray(ids, "<u4").tobytes()


def unpack(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


class Codec:
    """One tokenizer inside a task, from the text of its file."""

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = json.loads(source)
        alphabet = byte_alphabet()
        self.bytes = [b""] * (1 + max([*model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"])]))
        for token, number in model["model"]["vocab"].items():
            self.bytes[number] = bytes(alphabet[char] for char in token)
        for token in model["added_tokens"]:
            self.bytes[token["id"]] = token["content"].encode()
        self.special = [t["content"] for t in model["added_tokens"]]
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0
        self.margin = max([len(s) for s in self.special], default=0)

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers.

        Pre-tokens are encoded on their own by definition, so each is looked up once and remembered. Texts with special tokens or
        with characters outside ``PLAIN``, where versions of Unicode could differ, are left to the tokenizer as a whole.
        """
        parts = [None if OTHER.search(t) or any(s in t for s in self.special) else PRE_TOKEN.findall(t) for t in texts]
        new = list(set().union(*(p for p in parts if p)).difference(self.known))
        self.known.update(zip(new, map(pack, self.encoded(new, AT_ONCE))))
        out = [b"" if p is None else b"".join(map(self.known.__getitem__, p)) for p in parts]
        for k, found in zip(rest := [k for k, p in enumerate(parts) if p is None], self.encoded([texts[k] for k in rest])):
            out[k] = pack(found)
        self.known_bytes += sum(len(word) + len(self.known[word]) for word in new)
        if len(self.known) > KNOWN or self.known_bytes > KNOWN_BYTES:
            self.known.clear()
            self.known_bytes = 0
        for word in new:
            if len(word) > LONG_WORD:
                self.known.pop(word, None)
        return out

    def encoded(self, texts: list[str], at_once: int = 1) -> Iterator[list[int]]:
        """The ids of each text, made for ``at_once`` texts at a time."""
        for start in range(0, len(texts), at_once):
            for found in self.tokenizer.encode_batch_fast(texts[start : start + at_once], add_special_tokens=False):
                yield found.ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        return list(self.encoded(texts))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[k] for k in ids]).decode("utf-8", "replace").encode()

    def ends(self, ids: list[int]) -> np.ndarray:
        """The byte after each token."""
        return np.cumsum([len(self.bytes[k]) for k in ids], dtype=np.int64)

    def near_special(self, text: str, at: int) -> bool:
        around = text[max(0, at - self.margin) : at + self.margin]
        return any(s in around for s in self.special)


@cache
def codec(source: str) -> Codec:
    made = Codec(source)
    words.give_back()  # the parsed file
    return made


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


def kind(char: str) -> str:
    if LETTER.match(char):
        return "letter"
    if NUMBER.match(char):
        return "number"
    return "space" if SPACE.match(char) else "other"


def certain(text: str, at: int) -> bool:
    """Whether the pre-tokenizer splits at ``at`` whatever else the text holds: the kind changes, and neither a space goes
    with what follows nor an apostrophe with letters."""
    if not 0 < at < len(text):
        return True
    before, after = kind(text[at - 1]), kind(text[at])
    return before != after and before != "space" and not (text[at - 1] == "'" and after == "letter")


def inside(text: str, at: int) -> bool:
    """Whether ``at`` is in the middle of a run of one kind."""
    if at < RUN or at + RUN > len(text):
        return False
    return len({kind(char) for char in text[at - RUN : at + RUN]}) == 1


def cut(text: str, at: int, code: Codec) -> int:
    """The place for a cut at or after ``at``: a certain one if any is near, else the middle of a run."""
    fallback = None
    for place in range(at, min(len(text), at + 4 * WINDOW)):
        if code.near_special(text, place):
            continue
        if certain(text, place):
            return place
        if fallback is None and inside(text, place):
            fallback = place
    if fallback is not None:
        return fallback
    for place in range(at + 4 * WINDOW, len(text)):
        if not code.near_special(text, place) and (certain(text, place) or inside(text, place)):
            return place
    return len(text)


def pieces(text: str, size: int, code: Codec) -> list[str]:
    out, start = [], 0
    while len(text) - start > size:
        stop = cut(text, start + size, code)
        out.append(text[start:stop])
        start = stop
    return [*out, text[start:]] if start < len(text) or not out else out


Half = tuple[str, list[int]]


def join(left: Half, right: Half, code: Codec) -> Half:
    """The encoding of two neighbouring texts from the encodings of each."""
    text, at = left[0] + right[0], len(left[0])
    if not left[1] or not right[1] or certain(text, at):
        return text, left[1] + right[1]
    left_ends, right_ends = code.ends(left[1]), code.ends(right[1])
    reach = WINDOW
    while True:
        start, stop = _place(text, at - reach, -1, code), _place(text, at + reach, 1, code)
        window = text[start:stop]
        ids = code.encode([window])[0]
        first, last = len(text[:start].encode()), len(text[at:stop].encode())
        ends = code.ends(ids)
        head = _common(left[1], left_ends, first, ids, ends, start == 0, len(left[0].encode()) - first, True)
        shift = len(text[start:at].encode())
        tail = _common(right[1], right_ends, -shift, ids, ends, stop == len(text), shift, False)
        if head is not None and tail is not None and head[1] <= tail[1]:
            return text, left[1][: head[0]] + ids[head[1] : tail[1]] + right[1][tail[0] :]
        if start == 0 and stop == len(text):
            return text, ids
        reach *= 2


def _place(text: str, at: int, step: int, code: Codec) -> int:
    """The nearest end of a window from ``at`` on outwards: certain or in the middle of a run, away from special tokens."""
    while 0 < at < len(text):
        if not code.near_special(text, at) and (certain(text, at) or inside(text, at)):
            return at
        at += step
    return 0 if at <= 0 else len(text)


def _common(
    half: list[int], half_ends: np.ndarray, shift: int, ids: list[int], ends: np.ndarray, whole: bool, limit: int, head: bool
) -> tuple[int, int] | None:
    """Where a half and the window can be joined: numbers of tokens of the half and of the window before that place.

    A token must stand at the same bytes in both, before the join for the left half and after it for the right half. ``shift``
    turns a byte of the window into one of the half. At the text's own end nothing of the half is needed (``whole``).
    """
    if whole:
        return (0, 0) if head else (len(half), len(ids))
    numbers = range(len(ids)) if head else range(len(ids) - 1, -1, -1)
    for k in numbers:
        begin, end = int(ends[k]) - len(_length(ids, ends, k)), int(ends[k])
        if (head and end > limit) or (not head and begin < limit):
            break
        at = bisect_left(half_ends, end + shift)
        if at < len(half) and half_ends[at] == end + shift and half[at] == ids[k]:
            return (at + 1, k + 1) if head else (at, k)
    return None


def _length(ids: list[int], ends: np.ndarray, k: int) -> range:
    return range(int(ends[k]) - (int(ends[k - 1]) if k else 0))


def concatenated(halves: list[Half], code: Codec) -> list[int]:
    """All pieces of a text, joined level by level."""
    while len(halves) > 1:
        paired = [join(halves[k], halves[k + 1], code) for k in range(0, len(halves) - 1, 2)]
        halves = paired + halves[len(paired) * 2 :]
    return halves[0][1] if halves else []


def encode(documents: DataFrame, source: str, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``(doc_id, ids, decoded)`` for each row: ids as little-endian unsigned 32-bit numbers, and the text they decode to.

    ``source`` is the text of the tokenizer's file; it goes to the tasks once.
    """
    shared = documents.sparkSession.sparkContext.broadcast(source)  # a vocabulary file, of fixed size
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    long = F.char_length("text") > piece_chars
    out = arrow_schema(rows, "doc_id bigint, ids binary, decoded string")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(shared.value)
        for part in words.slices(batches, size=SLICE_BYTES):
            found = code.packed(part.column("text").to_pylist())
            columns = [part.column("doc_id"), found, [code.decode(unpack(x)).decode() for x in found]]
            yield from pa.table(columns, schema=out).to_batches()
        words.give_back()

    cut_out = arrow_schema(rows, "row bigint, doc_id bigint, piece int, text string")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                row, doc_id, text = (batch.column(c)[k].as_py() for c in ("row", "doc_id", "text"))
                parts = pieces(text, piece_chars, code)
                n = len(parts)
                yield from pa.table([[row] * n, pa.array([doc_id] * n, pa.int64()), range(n), parts], schema=cut_out).to_batches()

    piece_out = arrow_schema(rows, "row bigint, doc_id bigint, piece int, text string, ids binary")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                ids = code.packed(one.column("text").to_pylist())[0]
                yield from pa.table([*one.columns, pa.array([ids], pa.binary())], schema=piece_out).to_batches()

    def joined(group: pa.Table) -> pa.Table:
        code = codec(shared.value)
        group = group.sort_by("piece")
        halves = [
            (text, unpack(ids))
            for text, ids in zip(group.column("text").to_pylist(), group.column("ids").to_pylist())
        ]
        ids = concatenated(halves, code)
        return pa.table([group.column("doc_id").slice(0, 1), [pack(ids)], [code.decode(ids).decode()]], schema=out)

    short = rows.filter(~long).mapInArrow(whole, "doc_id bigint, ids binary, decoded string")
    # a text and its id name a row, so that equal ids do not mix; equal rows are told apart by their number
    named = rows.filter(long).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text")
    parts = named.mapInArrow(cut_up, "row bigint, doc_id bigint, piece int, text string")
    spread = parts.repartition("row", "piece")
    encoded = spread.mapInArrow(each, "row bigint, doc_id bigint, piece int, text string, ids binary")
    rest = encoded.groupBy("row").applyInArrow(joined, "doc_id bigint, ids binary, decoded string")
    return short.unionByName(rest)
