"""Counts against the ids that the library gives."""

import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from papersheaf.llm import counts
from papersheaf.llm.queries import op11_token_counts, piece_model, table
from tests.llm.helpers import clashing, documents

LIBRARY = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
PARTS = ["a", "b", " ", "  ", "\n", "é", "é", "日", "🙂", "▁", "the", "ing", " the", "0", "1", ".", ",", "ß", "ﬁ", "<s>", "</s>",
         "<unk>", "<0x0A>", "\x00", "　", "aaaa", " ", "\t\r", "﻿", "‍"]


def text(draw, longest=120):
    return "".join(draw.choice(PARTS) for _ in range(draw.randint(0, longest)))


@pytest.mark.parametrize("slice_chars", [1, 7, 1 << 18])
def test_counts_equal_the_library(slice_chars, monkeypatch):
    monkeypatch.setattr(counts, "SLICE_CHARS", slice_chars)
    monkeypatch.setattr(counts, "KNOWN_CHARS", 300)
    draw, code = random.Random(slice_chars), counts.Counter(piece_model())
    for _ in range(800):
        one = text(draw)
        assert code.count(one) == len(LIBRARY.encode(one)), one


def test_long_stretches():
    code = counts.Counter(piece_model())
    for one in ("a" * 30_001, "ab" * 9_999, " " * 5_000 + "x", "日本" * 3_000, "éè" * 4_000, "0123456789" * 800, "-=" * 5_000):
        assert code.count(one) == len(LIBRARY.encode(one))


def test_other_models_are_refused():
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(piece_model())
    spec.pieces[1000].type = 4
    with pytest.raises(ValueError):
        counts.Counter(spec.SerializeToString())


def test_rows(spark):
    draw = random.Random(5)
    rows = [(k, text(draw)) for k in range(60)] + [(70, None), (71, ""), (None, "x y"), (3, "again"), (3, "again"), (72, "word " * 5_000)]
    got = counts.token_counts(clashing(documents(spark, rows)), piece_model(), limit=100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    n = {t: len(LIBRARY.encode(t or "")) for _, t in rows}
    want = [(i, len((t or "").encode()), n[t], n[t] > 100) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert counts.token_counts(documents(spark, rows).limit(0), piece_model()).count() == 0


def test_query_equals_the_library(spark):
    sf_dir = "/root/testdata/sf0.001"
    want = {r.doc_id: len(LIBRARY.encode(r.text or "")) for r in table(spark, sf_dir, "documents").collect()}
    got = op11_token_counts(spark, sf_dir).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want)
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
