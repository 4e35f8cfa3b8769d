"""Groups of equal texts against a dictionary."""

import hashlib
import re

import pytest

from papersheaf.llm import exact
from tests.llm.helpers import clashing, documents, texts


def plain(rows):
    groups = {}
    body = lambda text: re.sub(r"[\x20\x09-\x0D]", "", text or "")
    for i, text in rows:
        groups.setdefault(body(text), []).append((-len(text or ""), i is None, i if i is not None else 0))
    out = []
    for i, text in rows:
        group = groups[body(text)]
        _, missing, best = min(group)
        keep = None if missing else best
        out.append((i, keep, len(group), i == keep, hashlib.sha256(body(text).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digits", [64, 1, 0])
def test_groups_equal_a_dictionary_even_if_digests_collide(spark, digits):
    rows = texts(4, 200) + [(300, "ab c"), (301, "a bc"), (302, "abc"), (303, "a b c"), (304, "a\u00a0bc")]
    got = exact.groups(clashing(documents(spark, rows)), salts=3, digest_digits=digits).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, "x y"), (3, "xy"), (3, "xy"), (-(2**63), "z z"), (2**63 - 1, "zz "), (None, "only"), (8, None), (7, "")]
    got = exact.groups(documents(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def test_no_rows(spark):
    assert exact.groups(documents(spark, [])).count() == 0
