"""Joined encodings against one call of the tokenizers library."""

import random

import pytest
from pyspark.sql import functions as F

from papersheaf.llm import bpe
from papersheaf.llm.queries import tokenizer_source
from tests.llm.helpers import clashing, documents

ALPHABETS = [
    "abcdefghijklmnopqrstuvwxyz", "ab", "aA1", "a'sltvre", " ", "  \n\t", "日本語中文", "é ñ'", "!?.,-", "0123456789",
    "🙂👍🏽", "   a", "the and of ing tion ",
]


def text(draw, length):
    out = []
    while sum(map(len, out)) < length:
        if draw.random() < 0.05:
            out.append("<|endoftext|>")
        alphabet = draw.choice(ALPHABETS)
        out.append("".join(draw.choice(alphabet) for _ in range(draw.choice([1, 3, 10, 100, 400]))))
    return "".join(out)


@pytest.mark.parametrize("seed", range(4))
def test_joined_pieces_equal_the_whole(seed):
    draw, code = random.Random(seed), bpe.Codec(tokenizer_source())
    for _ in range(60):
        whole = text(draw, draw.choice([50, 500, 3000]))
        parts = bpe.pieces(whole, draw.choice([5, 17, 64, 300]), code)
        assert "".join(parts) == whole
        ids = bpe.concatenated([(part, code.encode([part])[0]) for part in parts], code)
        assert ids == code.encode([whole])[0]
        assert code.decode(ids) == whole.encode() == code.tokenizer.decode(ids, skip_special_tokens=False).encode()


@pytest.mark.parametrize("seed", range(3))
def test_remembered_pre_tokens_equal_the_library(seed, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 200)
    draw, code = random.Random(100 + seed), bpe.Codec(tokenizer_source())
    odd = ["\x00\x1c\x1f\x85\xa0\u2003", "Ünïcödé ŝtŕ", "ß²³¼½ªº", "©®±×÷", "it's we'll I'M 'tis", "\t\r\n  \n"]
    for _ in range(40):
        texts = [text(draw, draw.choice([5, 80, 900])) + draw.choice(odd) * draw.randint(0, 3) for _ in range(8)] + ["", " "]
        assert code.packed(texts) == [bpe.pack(ids) for ids in code.encode(texts)]


def test_rows(spark):
    draw, code = random.Random(9), bpe.Codec(tokenizer_source())
    rows = [(k, text(draw, draw.choice([10, 2000]))) for k in range(40)] + [(50, None), (51, ""), (None, "x" * 900)]
    rows += [(7, "z" * 700 + " y"), (7, "z" * 700 + " y"), (7, "ab" * 600)]
    got = bpe.encode(clashing(documents(spark, rows)), tokenizer_source(), piece_chars=128)
    got = sorted(((r.doc_id, bytes(r.ids).hex(), r.decoded) for r in got.collect()), key=str)
    want = [(i, b"".join(x.to_bytes(4, "little") for x in code.encode([t or ""])[0]).hex(), t or "") for i, t in rows]
    assert got == sorted(want, key=str)
    assert bpe.encode(documents(spark, []), tokenizer_source()).filter(F.lit(True)).count() == 0


class Watched:
    """A tokenizer that notes what it gets at once."""

    def __init__(self, tokenizer):
        self.tokenizer, self.batches = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.batches.append(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_the_tokenizer_gets_few_texts_at_once():
    code = bpe.Codec(tokenizer_source())
    texts = [" ".join(f"word{k}x{j}" for j in range(300)) for k in range(20)] + ["日本語 " * 500, "中文 <|endoftext|>" * 300, ""]
    want = [bpe.pack(found.ids) for found in code.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    code.tokenizer = Watched(code.tokenizer)
    assert code.packed(texts) == want
    assert all(len(batch) == 1 or len(batch) <= bpe.AT_ONCE and max(map(len, batch)) < 20 for batch in code.tokenizer.batches)
