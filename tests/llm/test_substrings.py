"""Removal of repeated windows against a dictionary of all windows."""

import pytest

from papersheaf.llm import substrings
from tests.llm.helpers import clashing, documents, space_words, texts


def plain(rows, width):
    first, out = {}, []
    for i, text in rows:
        words = space_words(text)
        for k in range(len(words) - width + 1):
            if i is not None:
                key = tuple(words[k : k + width])
                first[key] = min(first.get(key, i), i)
    for i, text in rows:
        words = space_words(text)
        gone = set()
        for k in range(len(words) - width + 1):
            if i is not None and first[tuple(words[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("period", sorted(substrings.COVERS))
def test_covers_give_every_difference(period):
    cover = substrings.COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("width, seed, vocabulary", [(1, 1, 12), (5, 2, 4), (5, 3, 40), (12, 4, 2), (50, 5, 2)])
def test_kept_words_equal_all_windows(spark, width, seed, vocabulary):
    rows = texts(seed, 120, vocabulary, 120)
    got = substrings.deduplicate(clashing(documents(spark, rows)), width).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, width)


def test_odd_rows(spark):
    long = " ".join(f"a{k % 9}" for k in range(30))
    rows = [(None, long), (4, long), (4, long), (4, "x " + long + " y z"), (9, "q " + long), (10, None), (11, "")]
    got = substrings.deduplicate(documents(spark, rows), 6).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, 6)


def test_no_rows(spark):
    assert substrings.deduplicate(documents(spark, []), 5).count() == 0


def test_larger_ids_of_several_texts(spark):
    long = " ".join(f"a{k % 9}" for k in range(30))
    rows = [(1, long), (9, "q " + long), (9, "a b c " + long), (9, "no part of it"), (12, long + " z"), (12, "y " + long)]
    for parts in (1, 6):
        got = substrings.deduplicate(documents(spark, rows).repartition(parts), 6).collect()
        assert sorted((tuple(r) for r in got), key=str) == plain(rows, 6)
