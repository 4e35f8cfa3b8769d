"""Repairs against a search row by row with whole strings, and against all edits of short conversations."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from papersheaf.llm import repair
from papersheaf.llm.queries import op12_repair, table
from tests.llm.helpers import clashing

SCHEMA = "conv_id long, turn long, role string, text string"


def after_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv in out:
        out[conv].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+", "", text)
        if not body:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """States are the roles' initials so far: '' at first, then the last one. Inserted turns are single steps here."""
    best = {"": (0, "", [])}

    def insert(best):
        for _ in range(2):
            for last, (cost, audit, kept) in list(best.items()):
                new = "a" if last == "u" else "u"
                entry = (cost + 2, audit + "I", kept + [{"u": "user:", "a": "assistant:"}[new]])
                if new not in best or entry[:2] < best[new][:2]:
                    best[new] = entry
        return best

    for (_, role, text), why in zip(rows, fault):
        following = {}

        def offer(last, entry):
            if last not in following or entry[:2] < following[last][:2]:
                following[last] = entry

        for last, (cost, audit, kept) in insert(best).items():
            offer(last, (cost + 3, audit + "D", kept))
            if why in ("blank", "duplicate"):
                continue
            more = why == "truncated"
            if (last, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                offer(role[0], (cost + more, audit + "K", kept + [f"{role}:{text}"]))
            new = "a" if last == "u" else "u"
            offer(new, (cost + 2 + more, audit + "R", kept + [f"{'user' if new == 'u' else 'assistant'}:{text}"]))
        best = following
    return min((entry for last, entry in insert(best).items() if last in ("", "a")), key=lambda e: e[:2])


def every_edit(rows, fault):
    """The same by trying all edits of up to two insertions at each place."""
    best = None
    for edits in product("DKR", repeat=len(rows)):
        for gaps in product(("", "I", "II"), repeat=len(rows) + 1):
            last, cost, audit, good = "", 0, "", True
            for k, edit in enumerate([*edits, None]):
                for _ in gaps[k]:
                    last, cost = "a" if last == "u" else "u", cost + 2
                audit += gaps[k]
                if edit is None:
                    continue
                audit += edit
                if edit == "D":
                    cost += 3
                    continue
                if fault[k] in ("blank", "duplicate"):
                    good = False
                    break
                cost += (fault[k] == "truncated") + 2 * (edit == "R")
                new = rows[k][1][:1] if edit == "K" else "a" if last == "u" else "u"
                if last + new not in ("s", "u", "su", "ua", "au"):
                    good = False
                    break
                last = new
            if good and last in ("", "a") and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def expected(rows):
    out = []
    for conv, left in after_damage(rows).items():
        fault = faults(left)
        turns = [t for t, _, _ in left if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        roles = [r[:1] for _, r, _ in left]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        cost, audit, kept = cheapest(left, fault)
        counts = [fault.count(k) for k in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n):
    draw = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(draw.choice([1, 2, 4, 9, 30])):
            role = draw.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
            text = draw.choice(["Yes.", "No!", "cut", "what?", "  ", "", None, f"t{turn}.", f"t{turn}", "end. \n", "é…"])
            rows.append((conv, draw.choice([turn] * 9 + [turn + 3, None]), role, text))
    return rows


def collected(found):
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("segment_rows", [2, 7, 2048])
def test_equals_search(spark, segment_rows):
    rows = conversations(segment_rows, 120)
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"long {t}.") for t in range(400)]
    rows += [(501, None, "user", "same.")] * 40 + [(501, 1, "user", "same.")] * 9 + [(502, 5, "user", " ")] * 30
    rows += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (None, None, None, None)]
    rows += [(k, 0, "user", "x.") for k in range(600, 700)]  # some lose their only row
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = repair.repair(clashing(frame), segment_rows=segment_rows)
    assert collected(found) == expected(rows)
    assert any(not audit for *_, audit, _ in expected(rows))


def test_search_equals_every_edit():
    draw = random.Random(4)
    for _ in range(60):
        rows = [(0, draw.choice(["user", "assistant", "system", "tool"]), draw.choice(["a.", "b", " ", "c."])) for _ in range(draw.randint(0, 4))]
        fault = faults(rows)
        assert cheapest(rows, fault)[:2] == every_edit(rows, fault)


def test_grammar_gives_the_same_matrices():
    draw = random.Random(8)
    plain = repair.Grammar([]).prepare()
    texts = ["".join(draw.choice("suaoSUAOD") for _ in range(draw.randint(1, 60))) + "ua" * draw.randint(0, 90) for _ in range(30)]
    pairs = ["ua", chr(repair.FIRST_RULE) * 2, "D" + chr(repair.FIRST_RULE + 1), chr(repair.FIRST_RULE + 1) * 2]
    rules = repair.Grammar(pairs).prepare()
    for one in texts:
        a, b = plain.matrix(one), rules.matrix(one)
        assert {k: (c, repair.flat(r)) for k, (c, r) in a.items()} == {k: (c, repair.flat(r)) for k, (c, r) in b.items()}


def test_pairs_are_counted_as_they_are_replaced(spark):
    assert repair.pair_counts("aaaaa") == {"aa": 2}
    assert repair.pair_counts("uaua") == {"ua": 2, "au": 1}
    table = spark.createDataFrame([("uauaua", 5), ("suaua", 3), ("DD", 1)], "seq string, n long")
    grammar = repair.learn(table)
    assert grammar.pairs[0] == "ua" and all(len(p) == 2 for p in grammar.pairs)
    assert len(grammar.compressed("uauaua" * 8)) <= 12


def test_ropes():
    draw = random.Random(2)
    ropes = [("".join(draw.choice("DIK") for _ in range(draw.randint(0, 90)))) for _ in range(40)]
    for _ in range(200):
        ropes.append(repair.concat(draw.choice(ropes), draw.choice(ropes[:60])))
    for _ in range(2000):
        a, b = draw.choice(ropes), draw.choice(ropes)
        assert repair.less(a, b) == (repair.flat(a) < repair.flat(b)) and repair.length(a) == len(repair.flat(a))


def test_odd_tables(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    long = [(1, 0, "user", "word " * 300_000 + "."), (1, 1, "assistant", "x" * 1_500_000 + "!"), (1, 2, "user", "?"), (1, 3, "assistant", "!")]
    assert collected(repair.repair(spark.createDataFrame(long, SCHEMA))) == expected(long)


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert collected(op12_repair(spark, sf_dir)) == expected(rows)
