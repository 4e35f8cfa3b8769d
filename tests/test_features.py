"""Cluster features: sums, radii and members, and Ward over them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from papersheaf.operators import agglomerative, features
from tests.test_clustering import blobs, labels_of, same_partition
from tests.test_vectors import frame


@pytest.mark.parametrize("radius, limit, block_rows", [(0.0, 4096, 2048), (0.4, 4096, 2048), (0.4, 4096, 20), (0.05, 12, 2048)])
def test_features_hold_all_rows(spark, radius, limit, block_rows):
    x = blobs(seed=21, n=200, copies=30)
    found, members = features.cluster_features(frame(spark, x).repartition(3), radius, limit, block_rows)
    found = {r.feature: r for r in found.collect()}
    of = {}
    for r in members.collect():
        of.setdefault(r.feature, []).append(r.doc_id)
    assert of.keys() == found.keys() and sorted(i for ids in of.values() for i in ids) == list(range(len(x)))
    for name, ids in of.items():
        r = found[name]
        assert name in ids and r.n == len(ids)
        assert np.array(r.total) == pytest.approx(x[ids].sum(0)) and r.squares == pytest.approx((x[ids] ** 2).sum())
        if limit > 200:
            spread = ((x[ids] - x[ids].mean(0)) ** 2).sum(1).mean()
            assert spread <= radius**2 + 1e-9
    if radius == 0 :
        assert len(found) == len(np.unique(x, axis=0))


def test_ward_over_features(spark):
    x = blobs(seed=22, n=150, copies=20, spread=0.05)
    rows = frame(spark, x).repartition(4)
    exact = labels_of(agglomerative.agglomerative(rows, 6), len(x))
    got = labels_of(features.agglomerative_over_features(rows, 6, radius=0.0), len(x))
    assert list(got) == list(exact)
    coarse = labels_of(features.agglomerative_over_features(rows, 4, radius=0.1), len(x))
    assert same_partition(coarse, labels_of(agglomerative.agglomerative(rows, 4), len(x)))


def test_no_rows(spark):
    found, members = features.cluster_features(frame(spark, np.eye(2)).filter(F.lit(False)), 0.5)
    assert found.count() == members.count() == 0
