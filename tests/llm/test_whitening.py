"""Whitening against NumPy in doubles and against exact whole numbers."""

import math

import numpy as np
import pytest

from papersheaf.llm import whitening
from papersheaf.llm.queries import op13_whitening, table
from tests.llm.helpers import clashing

SCHEMA = "vec_id long, embedding array<float>, label int"


def whole(vector):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vector]


def check(got, rows, components=16):
    """``rows``: usable ``(vec_id, vector)``."""
    x = [whole(v) for _, v in rows]
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, sums = len(fit), fit.sum(0)
    z = np.array([[float((n * int(a) - int(s)) / n) for a, s in zip(row, sums)] for row in fit])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == len(rows) * k
    by_row = {}
    for r in got:
        by_row.setdefault((r.vec_id, r.deviation), []).append(r)
    trace = values.sum()
    signs = {}
    for (vec_id, vector), xs in zip(rows, x):
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(xs, sums))
        found = sorted({(r.component, r.whitened) for r in by_row[vec_id, deviation]})
        assert [c for c, _ in found] == list(range(1, k + 1))
        mine = np.array([(n * a - int(s)) / n for a, s in zip(xs, sums)]) @ (vectors[:, :k] / np.sqrt(values[:k]))
        for (c, w), m in zip(found, mine):
            if abs(m) > 0.05:
                assert signs.setdefault(c, np.sign(w * m)) == np.sign(w * m)
            assert abs(abs(w) - abs(m)) < 1e-7
    for r in got:
        assert r.n == n and r.identity_error < 1e-10
        assert abs(r.explained - values[r.component - 1] / trace) < 1e-9


def vectors(seed, n, d=24):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)) * np.linspace(3, 0.3, d) @ np.linalg.qr(rng.normal(size=(d, d)))[0]


def test_rows(spark):
    x = vectors(1, 300)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    rows += [(900 + k, rows[7][1]) for k in range(200)] + [(None, rows[3][1]), (5, rows[9][1])]
    nan, infinite = [float("nan")] * 24, [float("inf")] + [0.0] * 23
    odd = [(800, None), (801, [None] + rows[0][1][1:]), (802, nan), (803, infinite), (804, []), (805, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, None) for i, v in rows + odd], SCHEMA).repartition(4)
    got = whitening.whiten(clashing(frame)).collect()
    check(got, rows)


def test_tables_without_components(spark):
    for rows in ([], [(1, None, 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], [(1, [], 0)]):
        found = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert found.count() == 0 and found.columns[0] == "vec_id"
    few = [(k, [float(k), float(2 * k), 1.0], None) for k in range(5)]
    assert {r.component for r in whitening.whiten(spark.createDataFrame(few, SCHEMA)).collect()} == {1}


def test_large_entries(spark):
    rows = [(k, [float(10 ** (k % 5)) * (1 if k % 2 else -1), float(k)], None) for k in range(40)] + [(99, [3e38, 0.0], None)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 41 and all(r.deviation is None for r in got)  # beside such a spread the other direction counts as flat
    assert all(np.isfinite(r.whitened) for r in got)


CASES = {
    "apart": np.linspace(5, 1, 40),
    "equal": np.r_[np.full(12, 5.0), np.full(28, 1.0)],
    "close": np.r_[2 + 1e-9 * np.arange(10), np.linspace(0.2, 0.9, 10), 0.1 + 1e-13 * np.arange(20)],
    "near float32": 3 * (1 + 3e-8 * np.arange(40)),
    "flat": np.r_[np.linspace(1, 2, 10), np.zeros(30)],
}


@pytest.mark.parametrize("case", CASES)
def test_eigenvectors(case):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    v = (q * CASES[case]) @ q.T
    v = (v + v.T) / 2
    values, found = whitening.eigenvectors(v)
    wide, e = found.astype(np.longdouble), values.astype(np.longdouble)
    assert np.all(np.diff(values) <= 1e-15 * values[0])
    assert np.abs(v.astype(np.longdouble) @ wide - wide * e).max() < 2e-15 * values[0]
    assert np.abs(wide.T @ wide - np.eye(40)).max() < 1e-13


def test_parts_add_up_whatever_the_tasks(spark):
    x = vectors(2, 500, 8)
    rows = [(k, [float(c) for c in v], 0) for k, v in enumerate(x)]
    got = [whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(n)).collect() for n in (1, 13)]
    a, b = ({(r.vec_id, r.component): r for r in found} for found in got)
    assert a.keys() == b.keys()
    assert all(a[k].deviation == b[k].deviation and abs(abs(a[k].whitened) - abs(b[k].whitened)) < 1e-10 for k in a)


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    check(op13_whitening(spark, sf_dir).collect(), rows)
