"""Phrase and proximity matches against a scan of all windows."""

import random
import re

import pytest

from papersheaf.llm import decontaminate
from papersheaf.session import materialized
from tests.llm.helpers import clashing, documents, lower

ITEMS = "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def plain(rows, items, width):
    out = []
    for i, text in rows:
        body, hit, names = words(text), set(), set()
        for name, phrase in items:
            asked = words(phrase)
            size = min(len(asked), width)
            for k in range(len(asked) - size + 1):
                for at in range(len(body) - size + 1):
                    if size and name is not None and body[at : at + size] == asked[k : k + size]:
                        hit |= set(range(at, at + size))
                        names.add(str(name))
        out.append((i, len(body), len(hit), len(names), sorted(names), bool(hit) and 20 * len(hit) >= len(body)))
    return sorted(out, key=str)


def sample(seed, vocabulary):
    draw = random.Random(seed)
    known = [f"t{k}" if k % 5 else f"É{k}" for k in range(vocabulary)]
    items = [(k, " ".join(draw.choice(known) for _ in range(draw.choice([1, 2, 4, 5, 9])))) for k in range(25)]
    items += [(3, "other text of the same id"), (30, None), (31, " .. "), (None, "t1 t2 t3 t4 t6"), (32, items[0][1])]
    rows = [(0, None), (1, ""), (2, "..")]
    for k in range(3, 80):
        body = [draw.choice(known) for _ in range(draw.randint(0, 60))]
        if draw.random() < 0.5:
            body[3:3] = words(draw.choice(items)[1])
        rows.append((k, draw.choice([" ", ", ", "-"]).join(body).upper() if k % 3 else " ".join(body)))
    return rows, items


@pytest.mark.parametrize("seed, vocabulary", [(1, 6), (2, 60)])
def test_hits_equal_a_scan(spark, seed, vocabulary):
    rows, items = sample(seed, vocabulary)
    rows += [(70, rows[70][1]), (70, rows[71][1]), (None, rows[72][1]), (None, items[4][1])]
    got = decontaminate.contamination(clashing(documents(spark, rows)), spark.createDataFrame(items, ITEMS), width=4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, items, 4)


def test_no_rows(spark):
    none, some = spark.createDataFrame([], ITEMS), spark.createDataFrame([(1, "a b c")], ITEMS)
    assert decontaminate.contamination(documents(spark, []), some).count() == 0
    got = decontaminate.contamination(documents(spark, [(1, "a b c"), (2, None)]), none).collect()
    assert sorted(tuple(r) for r in got) == [(1, 3, 0, 0, [], False), (2, 0, 0, 0, [], False)]


def test_proximity(spark):
    rows = [(1, "x a b c y"), (2, "a x b c"), (3, "c b a"), (4, "a x x x b x x x c"), (5, "a b")]
    asked = materialized(decontaminate.item_terms(spark.createDataFrame([(9, "a b c")], ITEMS)))
    known = materialized(decontaminate.vocabulary(asked))
    index = materialized(decontaminate.postings(documents(spark, rows), known))
    near = lambda slop: {r.doc_id for r in decontaminate.proximity_matches(index, asked, slop, 3).collect()}
    assert (near(0), near(1), near(4), near(6)) == ({1}, {1, 2}, {1, 2, 3}, {1, 2, 3, 4})
