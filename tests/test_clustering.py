import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from papersheaf import DocumentClusterer, cluster_documents
from papersheaf.operators import agglomerative, blocks, dbscan, kmeans, select_k
from papersheaf.operators.components import connected_components
from tests.test_vectors import frame


def blobs(seed=1, n=120, d=5, k=4, spread=0.15, copies=15):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(k, d))
    x = centers[rng.integers(0, k, n)] + rng.normal(scale=spread, size=(n, d))
    x[-copies:] = x[3]
    return x


def labels_of(rows, n):
    got = {r.doc_id: r.cluster_id for r in rows.collect()}
    assert len(got) == n
    return np.array([got[i] for i in range(n)])


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_components(spark):
    nodes = spark.range(40)
    edges = spark.createDataFrame([(i, i + 2) for i in range(0, 30)] + [(35, 31), (36, 35)], "u bigint, v bigint")
    got = dict(connected_components(nodes, edges).collect())
    assert got == {
        **{i: i % 2 for i in range(32)}, 31: 1, 35: 1, 36: 1,
        **{i: i for i in (32, 33, 34, 37, 38, 39)},
    }


def scan_in_id_order(x, eps, min_samples):
    """DBSCAN as a scan over the rows, for comparison."""
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0))
    near = d <= eps
    core = near.sum(1) >= min_samples
    label = np.full(len(x), -1)
    number = 0
    for start in range(len(x)):
        if not core[start] or label[start] >= 0:
            continue
        stack, label[start] = [start], number
        while stack:
            for j in np.flatnonzero(near[stack.pop()]):
                if label[j] < 0:
                    label[j] = number
                    if core[j]:
                        stack.append(j)
        number += 1
    return label, core


@pytest.mark.parametrize("eps, min_samples, block_rows, cells", [(0.35, 5, 4096, None), (0.3, 4, 17, None), (0.3, 4, 20, 6), (0.01, 3, 4096, None)])
def test_dbscan_matches_a_scan(spark, eps, min_samples, block_rows, cells):
    x = blobs()
    label, core = scan_in_id_order(x, eps, min_samples)
    rows = dbscan.dbscan(frame(spark, x), eps, min_samples, block_rows, cells).collect()
    got = {r.doc_id: (r.cluster_id, r.is_core) for r in rows}
    assert [got[i] for i in range(len(x))] == list(zip(label, core))


def naive_ward(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        best = None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                ca, cb = x[groups[a]].mean(0), x[groups[b]].mean(0)
                na, nb = len(groups[a]), len(groups[b])
                height = 2 * na * nb / (na + nb) * ((ca - cb) ** 2).sum()
                if best is None or height < best[0]:
                    best = (height, a, b)
        _, a, b = best
        groups[a] += groups.pop(b)
    label = np.empty(len(x), int)
    for number, group in enumerate(groups):
        label[group] = number
    return label


def naive_single(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    label = np.arange(len(x))
    for i, j in sorted(zip(*np.triu_indices(len(x), 1)), key=lambda p: d[p]):
        if len(set(label)) == k:
            break
        label[label == label[j]] = label[i]
    return label


@pytest.mark.parametrize("tail", [0, 256])
def test_ward_matches_one_merge_at_a_time(spark, tail):
    x = blobs(n=60, copies=6)
    rows = frame(spark, x)
    for k, cut in agglomerative.agglomerative_cuts(rows, [2, 5, 11], block_rows=25, tail_clusters=tail).items():
        got = labels_of(cut, len(x))
        assert same_partition(got, naive_ward(x, k))
        sizes = np.bincount(got)
        assert list(sizes) == sorted(sizes, reverse=True)


def naive_average(x, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - unit @ unit.T
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        pairs = [(d[np.ix_(groups[a], groups[b])].mean(), a, b) for a in range(len(groups)) for b in range(a + 1, len(groups))]
        _, a, b = min(pairs)
        groups[a] += groups.pop(b)
    label = np.empty(len(x), int)
    for number, group in enumerate(groups):
        label[group] = number
    return label


@pytest.mark.parametrize("block_rows", [45, 2048])
def test_average_linkage_by_cosine(spark, block_rows):
    x = blobs(seed=5, n=70, copies=6, spread=0.6)
    cuts = agglomerative.agglomerative_cuts(frame(spark, x), [2, 6, 15], "average", block_rows=block_rows)
    for k, cut in cuts.items():
        assert same_partition(labels_of(cut, len(x)), naive_average(x, k))


def test_ward_over_many_groups(spark):
    """All merges and their heights against one group, where most partners lie in other groups."""
    x = blobs(seed=11, n=110, copies=3, spread=2.0)
    distinct = blocks.distinct_points(frame(spark, x)).persist()
    size = blocks.measure(distinct)
    found = [agglomerative.reducible_merges(distinct, size, "ward", rows).collect() for rows in (80, 2048)]
    many, one = (np.array(sorted((r.height, r.dead, r.survivor) for r in merges)) for merges in found)
    assert len(many) == size.rows - 1 and many == pytest.approx(one)


def test_equal_heights_everywhere(spark):
    """A lattice and the corners of a simplex: any order of equal merges will do, but every merge must come."""
    lattice = np.array([[i, j] for i in range(7) for j in range(7)], float)
    for x, linkage in ((lattice, "ward"), (np.eye(40), "average")):
        got = labels_of(agglomerative.agglomerative(frame(spark, x + 1), 4, linkage, block_rows=30), len(x))
        assert len(set(got)) == 4


def test_single_linkage(spark):
    x = blobs(n=60, copies=6)
    got = labels_of(agglomerative.agglomerative(frame(spark, x), 4, "single", block_rows=25), len(x))
    assert same_partition(got, naive_single(x, 4))


def test_more_clusters_than_vectors(spark):
    x = np.repeat(np.eye(2), 4, axis=0)
    got = labels_of(agglomerative.agglomerative(frame(spark, x), 5), len(x))
    assert len(set(got)) == 5
    assert all(len(set(x[got == c][:, 0])) == 1 for c in set(got))


def test_unknown_linkage(spark):
    with pytest.raises(ValueError, match="linkage"):
        agglomerative.agglomerative(frame(spark, np.eye(2)), 2, "median")


def test_kmeans_finds_separate_groups(spark):
    x = blobs(spread=0.02)
    assigned, centers = kmeans.kmeans(frame(spark, x), 4)
    label = labels_of(assigned, len(x))
    means = np.array([r.center for r in centers.orderBy("cluster_id").collect()])
    d = ((x[:, None] - means[None]) ** 2).sum(-1)
    assert list(label) == list(d.argmin(1))  # every row sits with its nearest centre
    for c in range(4):
        assert means[c] == pytest.approx(x[label == c].mean(0))
    assert list(np.bincount(label)) == sorted(np.bincount(label), reverse=True)
    again, _ = kmeans.kmeans(frame(spark, x), 4)
    assert list(labels_of(again, len(x))) == list(label)


def test_a_far_group_among_many_rows_gets_a_centre(spark):
    """6000 rows of which 6 are far away: every row can be a start, and limits of bytes change nothing."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (5994, 4)), rng.normal(0, 0.01, (6, 4)) + 80])
    rows = frame(spark, x)
    labels = [
        {r.doc_id: r.cluster_id for r in kmeans.kmeans(rows, 2, restarts=2, limit_bytes=limit)[0].collect()}
        for limit in (10, kmeans.LIMIT_BYTES)
    ]
    assert labels[0] == labels[1]
    assert [i for i, label in sorted(labels[0].items()) if label == 1] == list(range(5994, 6000))


def test_kmeans_in_small_passes_and_as_a_table(spark):
    x = blobs(spread=0.05)
    rows = frame(spark, x)
    one = kmeans.fit_many(rows, [3], restarts=4)[3]
    many = kmeans.fit_many(rows, [3], restarts=4, limit_bytes=200)[3]
    assert many.inertia == pytest.approx(one.inertia)
    assigned, centers = kmeans.kmeans(rows, 3, limit_bytes=10)
    assert assigned.count() == len(x) and centers.count() == 3
    again = kmeans.kmeans_step(rows, centers).orderBy("cluster_id").collect()
    fixed = centers.orderBy("cluster_id").collect()
    for before, after in zip(fixed, again):
        assert after.center == pytest.approx(before.center, abs=1e-2)


def test_assignment_beyond_the_limit(spark):
    x = blobs()
    rows = frame(spark, x)
    centers = rows.limit(9).select(F.col("doc_id").cast("int").alias("cluster_id"), F.col("embedding").alias("center"))
    near = kmeans.kmeans_assign(rows, centers).collect()
    far = kmeans.kmeans_assign(rows, centers, limit_bytes=100).collect()
    assert {(r.doc_id, r.cluster_id, round(r.distance, 9)) for r in near} == {
        (r.doc_id, r.cluster_id, round(r.distance, 9)) for r in far
    }


def test_sweep_and_choice(spark):
    x = blobs(spread=0.02, k=3)
    rows = frame(spark, x)
    scores = select_k.k_sweep(rows, restarts=4)
    table = {r.k: r for r in scores.collect()}
    assert sorted(table) == list(range(2, 8))  # sqrt(120 / 2) = 7.7
    assert max(table, key=lambda k: table[k].silhouette) == 3
    assert all(table[k].inertia >= table[k + 1].inertia for k in range(2, 7))
    assert select_k.best_k(scores).first().composite_k == 3
    done = DocumentClusterer("kmeans").fit(rows)
    assert done.n_clusters == 3 and done.points.select("cluster_id").distinct().count() == 3


def test_sweep_range():
    assert select_k.sweep_range(1) == []
    assert select_k.sweep_range(2) == []
    assert select_k.sweep_range(3) == [2]
    assert select_k.sweep_range(1000) == list(range(2, 11))


def scores(spark, rows):
    return spark.createDataFrame(rows, select_k.SCORES)


def test_normalize_infinite_and_equal(spark):
    rows = scores(spark, [(2, 1.0, 0.5, math.inf, 1.0), (3, 1.0, 0.1, 2.0, 1.0), (4, 1.0, 0.3, 1.0, 1.0)])
    got = select_k.normalize_scores(rows, "davies_bouldin", False, "d").orderBy("k").collect()
    assert [r.d for r in got] == [0.0, 0.0, 1.0]
    assert {r.c for r in select_k.normalize_scores(rows, "calinski_harabasz", True, "c").collect()} == {0.5}


def test_elbow(spark):
    rows = scores(spark, [(k, v, 0.0, 0.0, 0.0) for k, v in [(2, 100.0), (3, 30.0), (4, 25.0), (5, 20.0)]])
    assert select_k.elbow_point(rows).first()[0] == 3
    assert select_k.elbow_point(rows.filter("k < 4")).first()[0] == 2
    flat = scores(spark, [(k, 7.0, 0.0, 0.0, 0.0) for k in (2, 3, 4)])
    assert select_k.elbow_point(flat).first()[0] == 2


def test_separation(spark):
    rows = scores(spark, [(k, 0.0, s, 1.0, 1.0) for k, s in [(2, 0.10), (3, 0.15), (4, 0.05), (5, 0.12), (6, 0.2)]])
    check = lambda k: select_k.validate_separation(rows, k).first()[0]
    assert check(6) == 6  # nothing from 4 down to 2 beats 0.2
    assert check(5) == 3
    assert check(4) == 2
    good = scores(spark, [(2, 0.0, 0.9, 1.0, 1.0), (5, 0.0, 0.3, 1.0, 1.0)])
    assert select_k.validate_separation(good, 5).first()[0] == 5


def test_evaluate_range(spark):
    x = blobs(n=40, copies=2, spread=0.05)
    rows = frame(spark, x)
    got = select_k.evaluate_k_range(rows, [2, 4, 60], restarts=3).collect()
    assert [r.k for r in got] == [2, 4] and got[0].inertia > got[1].inertia
    tree = select_k.evaluate_k_range(rows, [2, 4], "agglomerative").collect()
    assert [(r.n_clusters_found, r.inertia) for r in tree] == [(2, None), (4, None)]
    best = select_k.best_per_metric(select_k.evaluate_k_range(rows, [2, 4], "agglomerative")).first()
    assert best.best_silhouette_k == max(tree, key=lambda r: r.silhouette_score).k


def test_unknown_algorithm():
    with pytest.raises(ValueError, match="no algorithm named"):
        DocumentClusterer(algorithm="invalid_algorithm")
    chosen = DocumentClusterer(algorithm="kmeans", n_clusters=3)
    assert (chosen.algorithm, chosen.n_clusters) == ("kmeans", 3)


def test_small_inputs(spark):
    x = blobs(n=20, copies=1)
    rows = frame(spark, x)
    assert DocumentClusterer("kmeans").fit_predict(rows.limit(0)).count() == 0
    single = DocumentClusterer("kmeans").fit(rows.filter("doc_id = 4"))
    assert single.assignments.collect() == [(4, 0)]
    assert single.scores().first().silhouette_score is None
    two = cluster_documents(rows.filter("doc_id < 2"), n_clusters=5)
    assert two.n_clusters == 1 and two.points.select("cluster_id").distinct().count() == 1
    auto = DocumentClusterer("kmeans").fit(rows.filter("doc_id < 2"))
    assert auto.n_clusters == 1
    with pytest.raises(ValueError, match="n_clusters"):
        DocumentClusterer("agglomerative").fit(rows, auto_tune=False)
    noise = DocumentClusterer("dbscan", eps=1e-6).fit(rows)
    assert {r.cluster_id for r in noise.assignments.collect()} == {-1}


def nearest_by_differences(x, own, y, other):
    d = ((x[:, None] - y[None]) ** 2).sum(2)
    d[own[:, None] == other[None]] = np.inf
    at = np.argsort(d, axis=1, kind="stable")[:, : agglomerative.NEAREST]
    d = np.take_along_axis(d, at, 1)
    r, k = np.nonzero(np.isfinite(d))
    return r, at[r, k], np.sqrt(d[r, k])


@pytest.mark.parametrize(("scale", "offset"), [(1.0, 0.0), (1e-25, 0.0), (1e25, 0.0), (1.0, 1e7)])
def test_nearest_rows_leave_none_out(scale, offset):
    rng = np.random.default_rng(7)
    x, y = (rng.normal(size=(n, 6)) * scale + offset for n in (300, 2700))
    y[5], y[900:1000] = y[5] * 1e4, y[7]  # one far from all, many equal
    for labels in (10_000, 3, 1):
        own, other = rng.integers(0, labels, len(x)), rng.integers(0, labels, len(y))
        for got, want in zip(agglomerative._nearest_rows(x, own, y, other), nearest_by_differences(x, own, y, other)):
            assert np.array_equal(got, want)


def nearest_by_heights(rows, targets, linkage, ties):
    (mine, x, n), (ids, y, m) = rows, targets
    gaps = x[:, None] - y[None]
    growth = (0.5 / n)[:, None] + (0.5 / m)[None]
    h = np.sqrt((gaps * gaps).sum(2) / growth) if linkage == "ward" else 1.0 - (x[:, None] * y[None]).sum(2)
    h[(mine[:, None] == ids[None]) | ~np.isfinite(h)] = np.inf
    low, found = h.min(1), []
    for i in range(len(x)):
        equal = np.flatnonzero(h[i] == low[i])
        keys = agglomerative._mixed(np.minimum(mine[i], ids[equal]), np.maximum(mine[i], ids[equal])) if ties else np.zeros(len(equal), int)
        found.append(equal[np.lexsort((equal, keys))[0]] if np.isfinite(low[i]) else -1)
    return np.array(found), low


@pytest.mark.parametrize("linkage", ["ward", "average"])
@pytest.mark.parametrize(("scale", "offset"), [(1.0, 0.0), (1e-25, 0.0), (1.0, 1e7), (0.0, 1.0), (None, 0.0)])
def test_nearest_clusters_leave_none_out(linkage, scale, offset, monkeypatch):
    """Products of single precision, crowded ones, equal heights, clusters of many sizes, some without a finite vector."""
    monkeypatch.setattr(agglomerative, "PRODUCTS", (64, 128))
    monkeypatch.setattr(agglomerative, "MEASURED", 1000)
    rng = np.random.default_rng(9)
    every = rng.normal(size=(900, 6)) * (scale or 1.0) + offset if scale is not None else rng.integers(0, 3, (900, 6)).astype(float)
    if linkage == "average":
        every = every / np.maximum(np.linalg.norm(every, axis=1, keepdims=True), 1e-300)
    every[500] = np.nan
    weights = rng.geometric(0.2, 900) ** rng.integers(1, 4, 900)
    for mine, ids in ((np.arange(0, 900, 3), np.arange(900)), (np.arange(100), np.arange(100, 900)), (np.array([7]), np.array([7]))):
        rows, targets = (mine, every[mine], weights[mine]), (ids, every[ids], weights[ids])
        for ties in (False, True):
            at, height, _ = agglomerative._nearest_clusters(rows, targets, linkage, ties)
            with np.errstate(invalid="ignore"):
                want, low = nearest_by_heights(rows, targets, linkage, ties)
            assert np.array_equal(height, low) and np.array_equal(at, want)


@pytest.mark.parametrize("linkage", ["ward", "average"])
def test_one_task_searches_among_the_last_clusters(spark, linkage, monkeypatch):
    """More clusters than a matrix may have are merged without a round of the whole job for each few of them."""
    x = blobs(seed=21, n=90, spread=1.0, copies=1)
    distinct = blocks.distinct_points(frame(spark, x)).persist()
    size = blocks.measure(distinct)
    want = {(r.dead, r.survivor, round(r.height, 9)) for r in agglomerative.reducible_merges(distinct, size, linkage).collect()}
    monkeypatch.setattr(agglomerative, "LAST_ROWS", 12)
    monkeypatch.setattr(agglomerative, "_nearest_of", None)
    got = agglomerative.reducible_merges(distinct, size, linkage).collect()
    assert {(r.dead, r.survivor, round(r.height, 9)) for r in got} == want and len(got) == len(want) == size.rows - 1
    order = {r.dead: r["round"] for r in got}
    assert all(order[r.dead] < order[r.survivor] for r in got if r.survivor in order)


def test_searched_merges_are_the_nearest_left():
    """Whole numbers with many equal heights, and vectors that are not finite, which never merge."""
    rng = np.random.default_rng(2)
    x = np.unique(rng.integers(0, 6, (150, 3)), axis=0).astype(float)
    x[5], x[9] = np.nan, np.inf
    ids, means, sizes, merges = agglomerative._searched(np.arange(len(x)), x.copy(), np.ones(len(x)), "ward", 1, 7)
    assert sorted(ids) == [0, 5, 9] and sizes[list(ids).index(0)] == len(x) - 2 and len(merges) == len(x) - 3
    members = {i: [i] for i in range(len(x))}
    for number in sorted({m[3] for m in merges}):
        alive = {i: (x[m].mean(0), len(m)) for i, m in members.items() if i not in (5, 9)}
        for dead, survivor, height, _ in (m for m in merges if m[3] == number):
            for one in (dead, survivor):
                others = [np.sqrt(((alive[one][0] - y) ** 2).sum() / (0.5 / alive[one][1] + 0.5 / m)) for j, (y, m) in alive.items() if j != one]
                assert math.isclose(min(others), height, rel_tol=1e-9)
        for dead, survivor, _, _ in (m for m in merges if m[3] == number):
            members[survivor] += members.pop(dead)


def test_heights_far_from_the_origin(spark):
    """Measured from products they were lost in rounding."""
    x = np.random.default_rng(4).normal(size=(200, 6)) + 1e8
    rows = blocks.distinct_points(frame(spark, x)).persist()
    found = agglomerative._nearest_of(rows, rows, (200, 200), 6, "ward", 50, False)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = {r.doc_id: (r.partner, r.height) for r in found.collect()}
    assert all(got[i][0] == d[i].argmin() and math.isclose(got[i][1], d[i].min(), rel_tol=1e-12) for i in range(200))


def test_single_linkage_far_from_the_origin(spark):
    x = blobs(seed=3, n=90, d=4, copies=1)
    got = labels_of(agglomerative.agglomerative(frame(spark, x + 1e8), 12, "single", block_rows=25), len(x))
    assert same_partition(got, naive_single(x + 1e8, 12))


def test_single_linkage_over_many_rows(spark):
    """Groups of more rows than a row knows neighbours, so that rows must search again."""
    x = blobs(seed=31, n=90, k=3, spread=0.05, copies=2)
    got = labels_of(agglomerative.agglomerative(frame(spark, x), 3, "single"), len(x))
    assert same_partition(got, naive_single(x, 3))


def test_merge_rounds_search_without_the_driver(spark, monkeypatch):
    """No round collects the clusters, and few search again."""
    asked, search = [], agglomerative._nearest_of

    def counted(rows, clusters, counts, *rest):
        asked.append(counts)
        return search(rows, clusters, counts, *rest)

    monkeypatch.setattr(agglomerative, "_nearest_of", counted)
    monkeypatch.setattr(blocks, "against", None)
    x = blobs(seed=12, n=90, copies=2, spread=2.0)
    distinct = blocks.distinct_points(frame(spark, x)).persist()
    merges = agglomerative.reducible_merges(distinct, blocks.measure(distinct), "average", 50)
    assert merges.count() == distinct.count() - 1
    assert asked[0][0] == asked[0][1] and all(0 < few < every for few, every in asked[1:])


def one_pass_plainly(x, sets):
    found = []
    for c in sets:
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        label = d.argmin(1)
        found.append((np.bincount(label, minlength=len(c)), np.stack([x[label == j].sum(0) for j in range(len(c))]), d.min(1).sum()))
    return found


def test_a_pass_over_many_partitions_returns_one_sum_for_each_set(spark, monkeypatch):
    x = np.random.default_rng(5).integers(-3, 4, (400, 6)).astype(float)
    sets = [x[:3], np.concatenate([x[:2], x[:2]]), x[10:13], x[:90]]  # of several sizes; equal centres, of which the first takes the rows
    packed = blocks.pack(frame(spark, x).repartition(40)).persist()
    sent = []
    collected = type(packed).toArrow
    monkeypatch.setattr(type(packed), "toArrow", lambda df: sent.append(collected(df)) or sent[-1])
    for limit in (0, 1 << 40):
        monkeypatch.setattr(kmeans, "PARTIAL_BYTES", limit)
        for got, (sizes, totals, cost) in zip(kmeans._one_pass(packed, 40, sets), one_pass_plainly(x, sets)):
            assert np.array_equal(got.sizes, sizes) and np.allclose(got.totals, totals) and np.isclose(got.cost, cost)
    assert sent[0].num_rows == len(sets) < sent[1].num_rows


def test_few_bytes_reach_the_driver_however_many_tasks_a_pass_has(spark, monkeypatch):
    """Every pass sends its bounded partial sums or one sum for each set; both ways end in the same bits."""
    rows = frame(spark, np.random.default_rng(8).normal(size=(600, 32))).repartition(60).persist()
    monkeypatch.setattr(blocks, "TASK_PRODUCTS", 1)
    cores = spark.sparkContext.defaultParallelism
    passes, collected, one = [], type(rows).toArrow, kmeans._one_pass

    def counted(packed, partitions, sets):
        sent = []
        monkeypatch.setattr(type(rows), "toArrow", lambda df: sent.append(collected(df)) or sent[-1])
        found = one(packed, partitions, sets)
        monkeypatch.setattr(type(rows), "toArrow", collected)
        passes.append((sent[0].nbytes, partitions, sum(c.size + len(c) + 1 for c in sets) * 8, len(sets)))
        return found

    monkeypatch.setattr(kmeans, "_one_pass", counted)
    fits = [kmeans.fit_many(rows, [8], max_iter=6)[8]]
    assert passes[0][1] == kmeans.TASKS_PER_CORE * cores > 8
    for sent, partitions, one_each, sets in passes:
        assert sent <= max(kmeans.PARTIAL_BYTES + partitions * sets * 256, one_each + sets * 256)
    assert sum(p[0] for p in passes) < len(passes) * 160 * 1024  # of some 340 kB made in the first of them
    for limit in (0, 1 << 40):
        monkeypatch.setattr(kmeans, "PARTIAL_BYTES", limit)
        fits.append(kmeans.fit_many(rows, [8], max_iter=6)[8])
    assert all(np.array_equal(f.centers, fits[0].centers) and f.inertia == fits[0].inertia for f in fits)


def test_a_pass_has_a_few_tasks_for_each_core(spark, monkeypatch):
    monkeypatch.setattr(blocks, "TASK_PRODUCTS", 1)
    seen = []
    lloyd = kmeans.lloyd
    monkeypatch.setattr(kmeans, "lloyd", lambda packed, *rest: seen.append(packed.rdd.getNumPartitions()) or lloyd(packed, *rest))
    kmeans.fit_many(frame(spark, blobs()).repartition(60), [3], restarts=2)
    assert seen == [kmeans.TASKS_PER_CORE * spark.sparkContext.defaultParallelism]


def test_packs_and_slices_are_bounded_in_bytes(spark):
    rows = spark.range(0, 9000, 1, 1).select(F.array_repeat(F.col("id").cast("float"), 384).alias("embedding"))
    packed = blocks.pack(rows)
    sizes = packed.select(F.octet_length("data").alias("n"), "dimension").collect()
    assert sum(r.n for r in sizes) == 9000 * 384 * 4 and max(r.n for r in sizes) <= blocks.PACK_BYTES
    held = np.concatenate(list(blocks.unpack(packed.toArrow().to_batches(), 5)))
    assert np.array_equal(held, np.repeat(np.arange(9000.0), 384).reshape(-1, 384))
    table = packed.sparkSession.range(10_000).toArrow()
    pieces = list(blocks.cut(table, 5, 384))
    assert sum(len(p) for p in pieces) == 10_000 and max(len(p) for p in pieces) * 384 * 8 * blocks.COPIES <= blocks.TARGET_BYTES
