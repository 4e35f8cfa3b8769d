"""Token counts by byte-pair merging over a heap and a linked list, without making token ids.

The symbols of a word are the nodes of a linked list, their neighbouring pairs that are pieces of the vocabulary wait in a heap.
The pair of the lowest rank, and of equal ones the leftmost, is taken out again and again and merged; pairs that a merge has
made obsolete are known by their length. What is counted is the number of symbols at the start less the merges; a character
outside the vocabulary starts as as many symbols as it has bytes.

No merge reaches over two neighbouring characters that no piece holds next to each other. Texts are cut there, exactly: first before
runs of spaces, then inside long stretches. Counts of short words are remembered by each task, in bounded memory.

Vocabulary, ranks and normalisation come from a public model file that the caller names; nothing is trained here. Models that are not
byte-pair models with byte fallback, or that hold user-defined or unused pieces, are refused with a ``ValueError``.

Defined results: null counts as empty and has 0 bytes and 0 tokens; strings of control symbols in a text are ordinary text. Every row is
counted on its own: repeated or missing ids do no harm, equal rows give equal rows, an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersheaf.operators.blocks import arrow_schema

SLICE_CHARS = 1 << 18  # of a text whose words are held at once
KNOWN_CHARS = 1 << 22  # of remembered words in a task
LONG_WORD = 48  # characters; longer words are not remembered
SPACE = "▁"  # fixed value: stands for a space in models of this kind
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
BPE, NORMAL, BYTE, REFUSED = 2, 1, 6, (4, 5)  # fixed values of the file format: a model's kind, kinds of pieces


class Counter:
    """One model inside a task, from the bytes of its file."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        kinds = {piece.type for piece in spec.pieces}
        if spec.trainer_spec.model_type != BPE or not spec.trainer_spec.byte_fallback or kinds & set(REFUSED):
            raise ValueError("counts need a byte-pair model with byte fallback and without user-defined or unused pieces")
        self.normalize = SentencePieceProcessor(model_proto=model).normalize
        scores = {piece.piece: piece.score for piece in spec.pieces if piece.type == NORMAL}
        ranks = {score: k for k, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {piece: ranks[score] for piece, score in scores.items()}
        self.longest = max(map(len, self.rank), default=0)
        self.neighbours = {piece[k : k + 2] for piece in self.rank for k in range(len(piece) - 1)}
        self.cut_at_spaces = not any(pair[1] == SPACE != pair[0] for pair in self.neighbours)
        self.known: dict[str, int] = {}
        self.known_chars = 0

    def count(self, text: str) -> int:
        plain = self.normalize(text)
        total, start = 0, 0
        while start < len(plain):
            stop = self.next_cut(plain, start + SLICE_CHARS)
            part = plain[start:stop]
            words = WORD.findall(part) if self.cut_at_spaces else [part]
            total += sum(map(self.known.__getitem__, words)) if self.learn(words) else sum(map(self.word, words))
            start = stop
        return total

    def next_cut(self, text: str, at: int) -> int:
        """The first place from ``at`` on that no merge reaches over."""
        while at < len(text) and text[at - 1 : at + 1] in self.neighbours:
            at += 1
        return min(at, len(text))

    def learn(self, words: list[str]) -> bool:
        """Remembers the counts of ``words``; false if some are too long for that."""
        if self.known_chars > KNOWN_CHARS:
            self.known.clear()
            self.known_chars = 0
        short = True
        for word in set(words).difference(self.known):
            if len(word) <= LONG_WORD:
                self.known[word] = self.word(word)
                self.known_chars += len(word)
            else:
                short = False
        return short

    def word(self, word: str) -> int:
        """The tokens of a stretch of text: those of its parts between cuts, which are remembered as words are."""
        neighbours, known = self.neighbours, self.known
        total, start = 0, 0
        for at in range(1, len(word) + 1):
            if word[at - 1 : at + 1] not in neighbours:  # at the end, one character alone is no pair
                part = word[start:at]
                start = at
                found = known.get(part)
                if found is None:
                    found = self.merged(part)
                    if len(part) <= LONG_WORD:
                        known[part] = found
                        self.known_chars += len(part)
                total += found
        return total

    def merged(self, part: str) -> int:
        """Symbols at the start less merges."""
        n, rank, longest = len(part), self.rank, self.longest
        weight = [1 if char in rank else len(char.encode()) for char in part]
        total = sum(weight)
        if n == 1:
            return total
        sizes, before, after = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank[pair], k, 2) for k in range(n - 1) if (pair := part[k : k + 2]) in rank]
        heapify(heap)
        while heap:
            _, left, size = heappop(heap)
            right = after[left]
            if right == n or sizes[left] + sizes[right] != size or not sizes[left]:
                continue  # one of the two has been merged since
            total -= weight[left] + weight[right] - 1
            weight[left] = 1
            sizes[left], sizes[right] = size, 0
            following, previous = after[right], before[left]
            after[left] = following
            if following < n:
                before[following] = left
                wide = size + sizes[following]
                if wide <= longest and (found := rank.get(part[left : left + wide])) is not None:
                    heappush(heap, (found, left, wide))
            if previous >= 0:
                wide = size + sizes[previous]
                if wide <= longest and (found := rank.get(part[previous : previous + wide])) is not None:
                    heappush(heap, (found, previous, wide))
        return total


@cache
def counter(model: bytes) -> Counter:
    return Counter(model)


def token_counts(documents: DataFrame, model: bytes, limit: int = 4096) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each row; ``model`` is the content of the model file.

    ``over_limit`` tells whether a text has more than ``limit`` tokens. Texts are read once and nothing is shuffled.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a vocabulary file, of fixed size
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"
    out = arrow_schema(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = counter(shared.value)
        for batch in batches:
            found = [code.count(text.as_py()) for text in batch.column("text")]
            yield from pa.table([batch.column("doc_id"), batch.column("n_bytes"), found], schema=out).to_batches()

    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
