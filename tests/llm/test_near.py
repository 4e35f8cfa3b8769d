"""MinHash groups against all pairs of full sets."""

import random

import pytest

from papersheaf.llm import minhash
from tests.llm.helpers import clashing, documents, lower, space_words, texts


def plain(rows, width, percent):
    sets, label = {}, {}
    for i, text in rows:
        words = space_words(lower(text))
        n = len(words) - width + 1
        sets[i] = {tuple(words[k : k + width]) for k in range(n)} if n > 0 else ({tuple(words)} if words else set())
        label[i] = i
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            union = len(sets[a] | sets[b])
            if a < b and union and 100 * common >= percent * union and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in ids}


def found(table, width=4):
    rows = minhash.near_duplicates(table, width, 80).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_all_pairs(spark, seed):
    rows = texts(seed, 160)
    assert found(clashing(documents(spark, rows))) == plain(rows, 4, 80)


def test_a_large_group_around_the_threshold(spark, monkeypatch):
    """Copies of one text with several changes each, so that many pairs of a bucket are just below the threshold."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    draw = random.Random(3)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for place in draw.sample(range(120), draw.randint(0, 4)):
            words[place] = f"c{i}x{place}"
        rows.append((i, " ".join(words)))
    assert found(documents(spark, rows)) == plain(rows, 4, 80)


def test_odd_rows(spark):
    rows = [(None, "a b c d e"), (None, None), (5, "a b c d e"), (5, "a b c d e"), (7, "A  B C D E"), (8, "a b"), (9, "A b")]
    got = sorted(
        (tuple(r) for r in minhash.near_duplicates(documents(spark, rows), 4).collect()), key=lambda r: (r[0] is None, r[:2])
    )
    assert got == [
        (5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (8, 1, 8, True), (9, 1, 8, False),
        (None, 0, None, True), (None, 2, None, True),
    ]


def test_no_rows(spark):
    assert found(documents(spark, [])) == {}
    assert found(documents(spark, [(1, None)])) == {1: (0, 1)}
