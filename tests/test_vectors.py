import numpy as np
import pytest
from pyspark.sql import functions as F

from papersheaf.functions import ranking
from papersheaf.operators import blocks, embedding, metrics, projection, similarity
from papersheaf.plans import pipeline


def sample(seed=0, n=90, d=6, copies=12, clusters=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[-copies:] = x[0]  # a group of copies
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, rng.integers(0, clusters, n)


def frame(spark, x, labels=None):
    labels = np.zeros(len(x), int) if labels is None else labels
    rows = [(i, [float(v) for v in x[i]], int(labels[i])) for i in range(len(x))]
    return spark.createDataFrame(rows, "doc_id bigint, embedding array<double>, cluster_id int").repartition(5)


def expanded(pairs, x):
    """All pairs told by the pair rows: those of a vector's smallest id hold for its copies."""
    rep = {}
    for i, row in enumerate(x):
        rep[i] = next(j for j in range(i + 1) if np.array_equal(x[j], row))
    told = {(min(a, b), max(a, b)): s for a, b, s in pairs}
    result = set()
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            a, b = rep[i], rep[j]
            key = (a, i) if a == b and i != a else (a, j) if a == b else (min(a, b), max(a, b))
            if key in told:
                result.add((i, j))
    return result


@pytest.mark.parametrize("block_rows, cells", [(4096, None), (11, None), (16, 5)])
def test_pairs_match_brute_force(spark, block_rows, cells):
    x, _ = sample()
    sims = x @ x.T
    wanted = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if sims[i, j] > 0.5}
    compact = similarity.similarity_network(frame(spark, x), 0.5, block_rows, cells, compact=True).collect()
    assert expanded(compact, x) == wanted
    # copies are linked once each, not pair by pair
    assert len(compact) < len(wanted)
    found = similarity.similarity_network(frame(spark, x), 0.5, block_rows, cells).collect()
    assert {(a, b) for a, b, _ in found} == wanted and len(found) == len(wanted)
    for a, b, s in [*found, *compact]:
        assert s == pytest.approx(sims[a, b])


def test_copies_keep_all_their_pairs(spark):
    x = [[1.0, 0.0], [1.0, 0.0], [0.8, 0.6], [0.8, 0.6]]
    found = similarity.similarity_network(frame(spark, np.array(x)), 0.3).collect()
    assert sorted((a, b, round(s, 9)) for a, b, s in found) == [
        (0, 1, 1.0), (0, 2, 0.8), (0, 3, 0.8), (1, 2, 0.8), (1, 3, 0.8), (2, 3, 1.0),
    ]


def test_similarity_diagonal_and_correlation(spark):
    x, _ = sample(copies=1)
    rows = similarity.pairwise_similarity(frame(spark, x), 0.4).filter("id_a = id_b")
    assert rows.count() == len(x) and rows.filter("similarity <> 1").isEmpty()
    corr = np.corrcoef(x)
    for a, b, r in similarity.pairwise_correlation(frame(spark, x), 0.4).filter("id_a < id_b").collect():
        assert r == pytest.approx(corr[a, b])


@pytest.mark.parametrize("limit", [blocks.TARGET_BYTES, 300])
def test_top_k_within_and_beyond_the_broadcast_limit(spark, limit):
    x, _ = sample()
    rows = frame(spark, x)
    asked = rows.select(F.col("doc_id").alias("query_id"), "embedding")
    got = similarity.find_most_similar(asked, rows, 3, limit_bytes=limit).collect()
    assert len(got) == 3 * len(x)
    sims = x @ x.T
    for row in got:
        order = sorted(range(len(x)), key=lambda j: (-round(sims[row.query_id, j], 9), j))
        best = round(sims[row.query_id, order[row["rank"] - 1]], 9)
        assert row.similarity == pytest.approx(best, abs=1e-8)


def silhouette(x, labels, kind):
    if kind == "cosine":
        d = 1 - x @ x.T
    else:
        d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0))
    np.fill_diagonal(d, 0)
    result = []
    for i in range(len(x)):
        own = (labels == labels[i]).sum()
        others = [d[i, labels == c].mean() for c in set(labels) if c != labels[i]]
        if own == 1 or not others:
            result.append(0.0)
            continue
        a, b = d[i, labels == labels[i]].sum() / (own - 1), min(others)
        result.append((b - a) / max(a, b))
    return np.array(result)


@pytest.mark.parametrize("block_rows", [4096, 13])
def test_euclidean_silhouette(spark, block_rows):
    x, labels = sample()
    labels[5] = 9  # a cluster of one
    rows = frame(spark, x, labels)
    wanted = silhouette(x, labels, "euclidean")
    got = {r.doc_id: r.silhouette for r in metrics.silhouette_samples(rows, block_rows).collect()}
    assert len(got) == len(x)
    assert [got[i] for i in range(len(x))] == pytest.approx(wanted)
    assert metrics.silhouette_euclidean(rows, block_rows).first()[0] == pytest.approx(wanted.mean())


@pytest.mark.parametrize("block_rows", [9, 2048])
def test_silhouettes_of_many_clusterings(spark, block_rows):
    rng = np.random.default_rng(31)
    x = rng.normal(size=(90, 4))
    x[70:] = x[5]
    labels = np.stack([rng.integers(0, k, 90) for k in (1, 2, 5, 40)], axis=1)
    rows = frame(spark, x).join(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(labels)], "doc_id long, labels array<int>"), "doc_id")
    got = {r.position: r.silhouette_euclidean for r in metrics.silhouettes_by_clustering(rows, block_rows).collect()}
    assert got[0] == 0
    for k in (1, 2, 3):
        assert got[k] == pytest.approx(silhouette(x, labels[:, k], "euclidean").mean())


def test_sampled_silhouette(spark):
    rng = np.random.default_rng(32)
    labels = np.repeat([0, 1, 2, 3], [200, 60, 3, 1])
    x = rng.normal(size=(len(labels), 3)) + labels[:, None] * 1.5
    rows = frame(spark, x, labels)
    exact = silhouette(x, labels, "euclidean").mean()
    for sample, seed, limit in ((60, 0, 1 << 26), (60, 3, 500), (120, 1, 1 << 26)):
        got = metrics.sampled_silhouette(rows, sample, seed, limit_bytes=limit).first()
        assert 0 < got.standard_error < 0.1 and abs(got.silhouette_euclidean - exact) <= 3 * got.standard_error
        assert got.n_sampled <= sample + 4
    every = metrics.silhouette_euclidean(rows, sample=10_000).first()
    assert every.silhouette_euclidean == pytest.approx(exact) and every.standard_error == 0 and every.n_sampled == len(x)
    assert metrics.sampled_silhouette(rows.limit(0), 10).first().silhouette_euclidean == 0


@pytest.mark.parametrize("limit", [blocks.TARGET_BYTES, 100])
def test_cosine_silhouette(spark, limit):
    x, labels = sample()
    labels[5] = 9
    got = {r.doc_id: r.silhouette for r in metrics.cosine_samples(frame(spark, x, labels), limit_bytes=limit).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(silhouette(x, labels, "cosine"))


@pytest.mark.parametrize("block_rows", [4096, 7])
def test_pooled_distance_and_compactness(spark, block_rows):
    x, labels = sample()
    rows = frame(spark, x, labels)
    pool, compact = [], {}
    for c in sorted(set(labels)):
        own = x[labels == c]
        i, j = np.triu_indices(len(own), 1)
        pool += list(1 - (own @ own.T)[i, j])
        compact[c] = np.sqrt(((own[i] - own[j]) ** 2).sum(1)).mean()
    mean, std = metrics.intra_cluster_distance_pool(rows, block_rows).first()
    assert (mean, std) == (pytest.approx(np.mean(pool)), pytest.approx(np.std(pool)))
    assert dict(metrics.cluster_compactness(rows, block_rows).collect()) == pytest.approx(compact)


def test_lone_clusters(spark):
    x, _ = sample(n=3, copies=1)
    rows = frame(spark, x, np.array([0, 1, 2]))
    assert metrics.intra_cluster_distance_pool(rows).first() == (0.0, 0.0)
    assert [r[1] for r in metrics.cluster_compactness(rows).collect()] == [0, 0, 0]
    assert [r[1] for r in metrics.intra_cluster_similarity(rows).collect()] == [1, 1, 1]
    assert metrics.silhouette_euclidean(rows).first()[0] == 0
    one = frame(spark, x)
    assert metrics.calinski_harabasz(one).first()[0] == 0
    assert metrics.davies_bouldin(one).first()[0] == 0
    assert metrics.silhouette_euclidean(one).first()[0] == 0


def test_noise_is_a_cluster_unless_left_out(spark):
    x, labels = sample()
    labels[:4] = -1
    rows = frame(spark, x, labels)
    assert metrics.cluster_sizes(rows).count() == 5
    assert metrics.cluster_sizes(metrics.without_noise(rows)).count() == 4


def test_measures_by_group_equal_single_runs(spark):
    x, labels = sample()
    first, second = frame(spark, x, labels), frame(spark, x, (labels + np.arange(len(x)) % 2) % 3)
    both = first.withColumn("k", F.lit(1)).unionByName(second.withColumn("k", F.lit(2)))
    for measure in (metrics.calinski_harabasz, metrics.davies_bouldin, metrics.silhouette_cosine, metrics.inertia):
        grouped = {r["k"]: r[1] for r in (measure(both, by="k")).collect()}
        assert grouped == pytest.approx({1: measure(first).first()[0], 2: measure(second).first()[0]})


def test_histogram_and_statistics(spark):
    x, _ = sample()
    got = dict(embedding.embedding_histogram(frame(spark, x), 10).collect())
    wanted, _ = np.histogram(x, bins=10)
    assert [got.get(i, 0) for i in range(10)] == list(wanted)
    row = embedding.embedding_statistics(frame(spark, x)).first()
    assert (row.n_documents, row.dimension) == x.shape
    assert (row.mean_value, row.std_value) == (pytest.approx(x.mean()), pytest.approx(x.std()))


def test_normalize_keeps_zero_vectors(spark):
    rows = frame(spark, np.array([[3.0, 4.0], [0.0, 0.0]]))
    got = {r.doc_id: r.embedding for r in embedding.l2_normalize(rows).collect()}
    assert got == {0: pytest.approx([0.6, 0.8]), 1: [0, 0]}


def test_tf_idf_vectors(spark):
    rows = spark.createDataFrame(
        [(1, "red fox red"), (2, "blue fox"), (3, "blue sky, blue sea")], "doc_id bigint, full_text string"
    )
    got = {r.doc_id: np.array(r.embedding) for r in embedding.embed_documents(rows, dimensions=1 << 16).collect()}
    idf = {w: np.log(4 / (n + 1)) for w, n in {"red": 1, "fox": 2, "blue": 2, "sky": 1, "sea": 1}.items()}
    norm = np.hypot(2 * idf["red"], idf["fox"])
    assert sorted(got[1][got[1] > 0]) == pytest.approx(sorted([2 * idf["red"] / norm, idf["fox"] / norm]))
    assert got[1] @ got[2] > 0 and got[1] @ got[3] == 0


def test_projection(spark):
    x, labels = sample()
    centred = x - x.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    vt *= np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(1)])[:, None]
    got = {r.doc_id: (r.x, r.y) for r in projection.pca_project(frame(spark, x)).collect()}
    assert np.array([got[i] for i in range(len(x))]) == pytest.approx(centred @ vt[:2].T, abs=1e-9)
    shares = projection.Projection.fit(frame(spark, x), 3).explained_variance(frame(spark, x)).collect()
    assert [r[1] for r in shares] == pytest.approx((s**2 / (s**2).sum())[:3])


def test_projection_of_few_documents(spark):
    x, _ = sample(n=3, copies=1)
    assert projection.pca_project(frame(spark, x[:1])).collect() == [(0, 0.0, 0.0)]
    assert sorted(projection.pca_project(frame(spark, x[:2])).collect()) == [(0, 0.0, 0.0), (1, 1.0, 0.0)]
    flat = projection.pca_project(frame(spark, np.array([[1.0], [2.0], [4.0]]))).collect()
    assert {r.y for r in flat} == {0.0}


def test_rank_within_a_key_holding_most_rows(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise("b").alias("k"))
    got = ranking.rank_within(rows.repartition(7), ["k"], "doc_id", "r", slices=16).collect()
    for key in ("hot", "b"):
        assert [r.r for r in sorted((r for r in got if r.k == key), key=lambda r: r.doc_id)] == list(
            range(1, sum(r.k == key for r in got) + 1)
        )
    texts = rows.select(F.concat(F.lit("n"), "doc_id").alias("doc_id"), "k")
    ranks = [r.r for r in ranking.rank_within(texts, ["k"], "doc_id", "r").filter("k = 'hot'").collect()]
    assert sorted(ranks) == list(range(1, 2001))


def test_cluster_summary_and_scores(spark):
    x, labels = sample()
    rows = frame(spark, x, labels)
    done = pipeline.Clustering("kmeans", rows, None, 4)
    names = rows.select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_name"))
    got = done.summary(names).collect()
    assert [(r.cluster_id, r.document_name) for r in got] == sorted((r.cluster_id, r.document_name) for r in got)
    assert done.scores().first().silhouette_score == pytest.approx(silhouette(x, labels, "euclidean").mean())


def test_blocks_do_not_grow_in_number():
    """What a pair job shuffles is the rows times their blocks, which must not grow with the rows."""
    for rows in (100_000, 200_000, 400_000):
        assert blocks.block_count(rows, blocks.wide_rows(rows, 64, blocks.BLOCK_ROWS)) <= blocks.MAX_BLOCKS
    assert blocks.wide_rows(10_000_000, 64, blocks.BLOCK_ROWS) * 64 * 8 <= blocks.BLOCK_BYTES
    assert blocks.wide_rows(120, 5, 17) == 17


def test_many_copies_in_parts(spark, monkeypatch):
    """Pairs of many copies come once each, in bounded parts, and distances are made once."""
    monkeypatch.setattr(similarity, "MEMBERS", 3)
    monkeypatch.setattr(similarity, "PAIRS_AT_ONCE", 4)
    x = np.array([[1.0, 0.0]] * 10 + [[0.8, 0.6]] * 7 + [[0.0, 1.0]] * 2)
    found = similarity.pairwise_similarity(frame(spark, x), 0.7, include_diagonal=False)
    sims = x @ x.T
    wanted = sorted((i, j) for i in range(19) for j in range(i + 1, 19) if sims[i, j] >= 0.7)
    assert sorted((a, b) for a, b, _ in found.collect()) == wanted


def test_silhouettes_hold_one_block_a_task(spark):
    """A task reads the passing blocks once, for one block of rows."""
    x, label = sample()
    rows = frame(spark, x, label).select("doc_id", "embedding", F.array("cluster_id").alias("labels"), F.lit(1).cast("bigint").alias("weight"))
    found = metrics.euclidean_silhouettes(rows.withColumn("embedding", F.col("embedding").cast("array<double>")), block_rows=8)
    held = [n for n in found.groupBy(F.spark_partition_id().alias("p"), F.pmod(F.xxhash64("doc_id"), F.lit(-(-len(x) // 8))).alias("b")).count().groupBy("p").count().select("count").collect()]
    assert max(n[0] for n in held) == 1


@pytest.mark.parametrize("limit", [1 << 26, 900])
def test_silhouettes_shuffle_no_copies_of_the_vectors(spark, monkeypatch, limit):
    """Passing blocks are read again from the store, by one task or, of a large store, in parts whose sums are added up."""
    x, label = sample()
    x = np.vstack([x, x + 0.25])
    label = np.r_[label, label + 1]
    rows = frame(spark, x, label).select(
        "doc_id", F.col("embedding").cast("array<double>").alias("embedding"), F.array("cluster_id", F.col("doc_id").cast("int") % 3).alias("labels"), F.lit(1).cast("bigint").alias("weight")
    )
    monkeypatch.setattr(blocks, "TARGET_BYTES", limit)
    found = metrics.euclidean_silhouettes(rows, block_rows=8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and ("FlatMapGroupsInArrow" in plan) == (limit < 1000)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = {row.doc_id: row for row in found.collect()}
    assert len(got) == len(x)
    for k, member in enumerate((label, np.arange(len(x)) % 3)):
        for i in range(len(x)):
            means = {c: d[i, member == c].sum() / max(1, (member == c).sum() - (c == member[i])) for c in set(member.tolist())}
            a, b = means.pop(member[i]), min(means.values())
            want = (b - a) / max(a, b) if (member == member[i]).sum() > 1 else 0.0
            assert got[i].labels[k] == member[i] and abs(got[i].silhouettes[k] - want) < 1e-9


@pytest.mark.parametrize("cells", [1, 5])
def test_pairs_shuffle_no_copies_of_the_blocks(spark, monkeypatch, cells):
    """Blocks, and the packs of large ones, meet by reading the written store again."""
    monkeypatch.setattr(blocks, "PACK_BYTES", 200)
    x, _ = sample()
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = similarity.pairwise_similarity(frame(spark, np.vstack([x, x[:7]])), 0.6, include_diagonal=False, block_rows=9, cells=cells)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    sims = np.vstack([x, x[:7]]) @ np.vstack([x, x[:7]]).T
    wanted = sorted((i, j) for i in range(len(sims)) for j in range(i + 1, len(sims)) if sims[i, j] >= 0.6)
    assert sorted((a, b) for a, b, _ in found.collect()) == wanted
