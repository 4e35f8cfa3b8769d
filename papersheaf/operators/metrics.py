"""Cluster quality. Points carry ``doc_id, embedding, cluster_id``; noise (-1) is a cluster like any other.

Whatever can be written with per-cluster counts, vector sums and second moments is computed from them
in one pre-aggregated pass. Only the Euclidean silhouette and the compactness need distances between
rows; those come block by block, and only sums or finished values leave a task. ``by`` names an extra grouping column,
such as the k of a sweep, so that many clusterings of the same documents are measured in one pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersheaf.functions import names, vectors
from papersheaf.functions.binding import bind
from papersheaf.functions.ranking import top_per_key
from papersheaf.operators import blocks
from papersheaf.operators.embedding import histogram
from papersheaf.session import materialized


def without_noise(points: DataFrame) -> DataFrame:
    return points.filter(F.col("cluster_id") != -1)


def _keys(by: str | None) -> list[str]:
    return [by] if by else []


def _vector_sum(column: str | Column) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(column)))


def cluster_moments(points: DataFrame, by: str | None = None) -> DataFrame:
    """Per cluster: rows ``n``, vector sum ``s`` and sum of squared lengths ``q``."""
    vector = array_to_vector(vectors.doubles(F.col("embedding")))
    summary = Summarizer.metrics("count", "sum", "normL2").summary(vector).alias("_m")
    return (
        points.groupBy(*_keys(by), "cluster_id")
        .agg(summary)
        .select(
            *_keys(by),
            "cluster_id",
            F.col("_m.count").alias("n"),
            vector_to_array("_m.sum").alias("s"),
            vectors.squared_norm(vector_to_array("_m.normL2")).alias("q"),
        )
    )


def unit_points(points: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and the vectors at unit length, zero vectors as they are."""
    vector = points.select(*columns, array_to_vector(vectors.doubles(F.col("embedding"))).alias("_v"))
    unit = Normalizer(p=2.0, inputCol="_v", outputCol="_u").transform(vector)
    return unit.select(*columns, vector_to_array("_u").alias("embedding"))


def cluster_centers(points: DataFrame, by: str | None = None) -> DataFrame:
    """Mean vector of each cluster as ``center``."""
    return cluster_moments(points, by).select(*_keys(by), "cluster_id", "n", _mean().alias("center"))


def _mean() -> Column:
    return bind(F.col("n").cast("double"), lambda n: F.transform("s", lambda x: x / n))


def cluster_sizes(assignments: DataFrame, by: str | None = None) -> DataFrame:
    """Count and percentage of each cluster."""
    sizes = assignments.groupBy(*_keys(by), "cluster_id").agg(F.count("*").alias("size"))
    if by:
        totals = sizes.groupBy(by).agg(F.sum("size").alias("_total"))
        return sizes.join(totals, by).withColumn("percentage", F.col("size") / F.col("_total") * 100).drop("_total")
    total = sizes.agg(F.sum("size")).scalar()
    return sizes.withColumn("percentage", F.col("size") / total * 100)


def calinski_harabasz(points: DataFrame, by: str | None = None) -> DataFrame:
    """One row (per ``by``): ``calinski_harabasz``; 0 for a single cluster, 1 without inner spread."""
    moments = cluster_moments(points, by).withColumn("b", vectors.squared_norm(F.col("s")) / F.col("n"))
    sums = moments.groupBy(*_keys(by)).agg(
        F.count("*").alias("_clusters"),
        F.sum("n").alias("n"),
        F.sum("q").alias("q"),
        F.sum("b").alias("b"),
        _vector_sum("s").alias("s"),
    )
    within = F.col("q") - F.col("b")
    between = F.col("b") - vectors.squared_norm(F.col("s")) / F.col("n")
    ratio = (between * (F.col("n") - F.col("_clusters"))) / (within * (F.col("_clusters") - 1))
    score = F.when(F.col("_clusters") <= 1, 0.0).when(within <= 1e-12 * F.col("q"), 1.0).otherwise(ratio)
    return sums.select(*_keys(by), score.alias("calinski_harabasz"))


def inertia(points: DataFrame, centers: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Sum of squared distances to the own centre, the cluster mean when no ``centers`` are given."""
    moments = cluster_moments(points, by)
    if centers is None:
        spent = F.col("q") - vectors.squared_norm(F.col("s")) / F.col("n")
    else:
        moments = moments.join(centers.select(*_keys(by), "cluster_id", "center"), [*_keys(by), "cluster_id"])
        spent = (
            F.col("q")
            - 2 * vectors.dot(F.col("s"), F.col("center"))
            + F.col("n") * vectors.squared_norm(F.col("center"))
        )
    return moments.groupBy(*_keys(by)).agg(F.sum(spent).alias("inertia"))


def distances_to_center(points: DataFrame, centers: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Every document with the Euclidean distance to its own centre."""
    centers = cluster_centers(points, by) if centers is None else centers
    keys = [*_keys(by), "cluster_id"]

    def named(table: pa.Table) -> pd.MultiIndex:
        return pd.MultiIndex.from_arrays([table.column(key).to_numpy() for key in keys])

    def kernel(rows: pa.Table, known: pa.Table) -> dict:
        own = named(known).get_indexer(named(rows))
        rows, own = rows.filter(pa.array(own >= 0)), own[own >= 0]
        gap = blocks.matrix(rows.column("embedding")) - blocks.matrix(known.column("embedding"))[own]
        distance = np.sqrt((gap * gap).sum(1))
        return {**{c: rows.column(c) for c in ["doc_id", *keys]}, "distance": distance}

    fields = [f"{c} {points.schema[c].dataType.simpleString()}" for c in ["doc_id", *keys]]
    return blocks.against(
        points.select("doc_id", *keys, "embedding"),
        centers.select(*keys, F.col("center").alias("embedding")),
        blocks.each(kernel),
        ", ".join([*fields, "distance double"]),
        reduce=lambda parts: parts,  # a row finds its centre in one chunk only
    )


def avg_distance_to_center(points: DataFrame, centers: DataFrame | None = None, by: str | None = None) -> DataFrame:
    return (
        distances_to_center(points, centers, by)
        .groupBy(*_keys(by), "cluster_id")
        .agg(F.avg("distance").alias("avg_distance_to_center"))
    )


def distance_to_center_histogram(points: DataFrame, centers: DataFrame | None = None, bins: int = 20) -> DataFrame:
    return histogram(distances_to_center(points, centers), "distance", bins)


def intra_cluster_similarity(points: DataFrame) -> DataFrame:
    """Mean dot product over the pairs of a cluster, from its vector sum; 1 below two members."""
    return cluster_moments(points).select("cluster_id", _intra_similarity().alias("intra_cluster_similarity"))


def _intra_similarity() -> Column:
    pairs = F.col("n") * (F.col("n") - 1)
    return F.when(F.col("n") < 2, 1.0).otherwise(
        (vectors.squared_norm(F.col("s")) - F.col("q")) / F.when(pairs > 0, pairs)
    )


def davies_bouldin(points: DataFrame, by: str | None = None) -> DataFrame:
    """Mean over clusters of the worst ``(s_i + s_j) / |c_i - c_j|``; 0 for a single cluster."""
    keys = _keys(by)
    centers = cluster_centers(points, by)
    spread = avg_distance_to_center(points, centers, by)
    rows = (
        centers.join(spread, [*keys, "cluster_id"])
        .withColumnRenamed("avg_distance_to_center", "spread")
        .withColumnRenamed("center", "embedding")
        .withColumn("doc_id", F.col("cluster_id"))
        .withColumn("_by", F.col(by).cast("string") if by else F.lit("all"))
        .select("_by", "doc_id", "embedding", "spread")
    )

    def kernel(left: blocks.Block, right: blocks.Block, same: bool) -> dict:
        gaps = np.sqrt(blocks.squared_distances(left.x, right.x, same))
        gaps[gaps == 0] = np.inf
        ratio = (left.column("spread")[:, None] + right.column("spread")[None, :]) / gaps
        ids, worst = [left.ids], [ratio.max(1)]
        if not same:
            ids.append(right.ids)
            worst.append(ratio.max(0))
        group = left.column("_by")[0]
        ids, worst = np.concatenate(ids), np.concatenate(worst)
        return {"_by": np.repeat(group, len(ids)), "cluster_id": ids, "worst": worst}

    worst = blocks.cluster_pairs(rows, kernel, "_by string, cluster_id int, worst double", ("_by",), ("spread",))
    scores = worst.groupBy("_by", "cluster_id").agg(F.max("worst").alias("worst"))
    if not by:
        return scores.agg(F.avg("worst").alias("davies_bouldin"))
    kind = points.schema[by].dataType
    means = scores.groupBy("_by").agg(F.avg("worst").alias("davies_bouldin"))
    return means.select(F.col("_by").cast(kind).alias(by), "davies_bouldin")


def _coefficient(a: Column, b: Column) -> Column:
    """``(b - a) / max(a, b)``; 0 for a lone member, a single cluster or no distance at all."""
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))


def cosine_samples(points: DataFrame, by: str | None = None, limit_bytes: int = blocks.TARGET_BYTES) -> DataFrame:
    """Cosine silhouette of every document, in linear time.

    The mean cosine distance to a cluster follows from the sum of its unit vectors, so every document
    meets one vector per cluster and no other document.
    """
    keys = _keys(by)
    unit = unit_points(points, "doc_id", *keys, "cluster_id")
    targets = cluster_moments(unit, by).select(*keys, "cluster_id", "n", F.col("s").alias("embedding"))

    def kernel(rows: pa.Table, clusters: pa.Table) -> dict:
        x, sums = blocks.matrix(rows.column("embedding")), blocks.matrix(clusters.column("embedding"))
        own_id = rows.column("cluster_id").to_numpy()
        ids, n = clusters.column("cluster_id").to_numpy(), clusters.column("n").to_numpy().astype(float)
        distance = 1.0 - (x @ sums.T) / n
        mine = own_id[:, None] == ids[None, :]
        if by:
            same_group = rows.column(by).to_numpy()[:, None] == clusters.column(by).to_numpy()[None, :]
            mine &= same_group
            distance = np.where(same_group, distance, np.inf)
        lengths = (x * x).sum(1)
        others = np.where(n > 1, n - 1, 1.0)
        inner = 1.0 - ((1.0 - distance) * n - lengths[:, None]) / others
        inner = np.where(mine & (n > 1), inner, np.nan)
        with np.errstate(all="ignore"):
            a = np.where(np.isnan(inner).all(1), np.nan, np.nansum(inner, 1))
            b = np.where(mine, np.inf, distance).min(1)
        result = {"doc_id": rows.column("doc_id"), "cluster_id": own_id}
        if by:
            result[by] = rows.column(by)
        result["a"] = pa.array(a, from_pandas=True)
        result["b"] = pa.array(np.where(np.isinf(b), np.nan, b), from_pandas=True)
        return {name: result[name] for name in ["doc_id", *keys, "cluster_id", "a", "b"]}

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in unit.schema.fields if f.name != "embedding"]
    schema = ", ".join([*fields, "a double", "b double"])
    parts = blocks.against(
        unit,
        targets,
        blocks.each(kernel),
        schema,
        reduce=lambda p: p.groupBy("doc_id", *keys, "cluster_id").agg(F.max("a").alias("a"), F.min("b").alias("b")),
        limit_bytes=limit_bytes,
    )
    return parts.select("doc_id", *keys, "cluster_id", _coefficient(F.col("a"), F.col("b")).alias("silhouette"))


def silhouette_cosine(points: DataFrame, by: str | None = None) -> DataFrame:
    return cosine_samples(points, by).groupBy(*_keys(by)).agg(F.avg("silhouette").alias("silhouette_cosine"))


def _block_store(rows: DataFrame, blocks_total: int) -> DataFrame:
    """``(doc_id, embedding, labels, weight)`` as one written row per block, with all its vectors, labels and weights packed."""
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("doc_id", "labels"))
    schema = f"block int, ids array<{id_type}>, data binary, single boolean, labels {label_type}, weights array<bigint>"
    out = blocks.arrow_schema(rows, schema)

    def pack(table: pa.Table) -> pa.Table:
        listed = lambda values, kind: pa.array([values.to_pylist()], kind)
        x = blocks.matrix(table.column("embedding"))
        narrow = x.astype(np.float32)
        single = bool((narrow == x).all())  # half the bytes where nothing is lost
        labels = table.column("labels").combine_chunks().flatten()
        columns = [
            table.column("block").slice(0, 1), listed(table.column("doc_id"), out.field("ids").type),
            pa.array([narrow.tobytes() if single else x.tobytes()]), pa.array([single]),
            listed(labels, out.field("labels").type), listed(table.column("weight"), pa.list_(pa.int64())),
        ]
        return pa.table(columns, names=out.names).cast(out)

    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks_total)).cast("int")
    return materialized(rows.withColumn("block", block).groupBy("block").applyInArrow(pack, schema))


FIELDS = ("ids", "data", "single", "labels", "weights")


class _Toward:
    """Sums of the distances from the rows of one block to every cluster of every clustering, as other blocks come by."""

    def __init__(self, row: dict, first: int):
        self.own, self.first = row.get("own"), first
        self.ids, self.weights = row["ids"], row["weights"]
        self.x, self.labels = self.unpacked(row)
        self.places: list[dict] = [{} for _ in range(self.labels.shape[1])]
        self.sums = [np.zeros((len(self.ids), 0)) for _ in self.places]
        self.sizes = [np.zeros(0) for _ in self.places]

    @staticmethod
    def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
        n = len(row["ids"])
        x = np.frombuffer(row["data"], np.float32 if row["single"] else np.float64).reshape(n, -1)
        return x.astype(np.float64), np.asarray(row["labels"]).reshape(n, -1)

    def add(self, row: dict, same: bool) -> None:
        x, labels = self.unpacked(row)
        weights = np.asarray(row["weights"], float)
        distances = np.sqrt(blocks.squared_distances(self.x, x, same))
        for k, place in enumerate(self.places):
            found, member = np.unique(labels[:, k], return_inverse=True)
            share = np.zeros((len(x), len(found)))
            share[np.arange(len(x)), member] = weights
            self._put(k, place, found.tolist(), distances @ share, share.sum(0))

    def _put(self, k: int, place: dict, found: list, sums: np.ndarray, sizes: np.ndarray) -> None:
        at = [place.setdefault(label, len(place)) for label in found]
        more = len(place) - self.sums[k].shape[1]
        if more:
            self.sums[k] = np.pad(self.sums[k], ((0, 0), (0, more)))
            self.sizes[k] = np.pad(self.sizes[k], (0, more))
        self.sums[k][:, at] += sums
        self.sizes[k][at] += sizes

    def partial(self) -> dict:
        """What ``take`` adds to the sums of another part of the store."""
        return {
            "own": self.own, "first": self.first, "ids": self.ids, "labels": self.labels.ravel().tolist(), "weights": self.weights,
            "places": [list(place) for place in self.places], "sums": [s.ravel() for s in self.sums], "sizes": self.sizes,
        }

    def take(self, row: dict) -> None:
        for k, place in enumerate(self.places):
            found, sizes = row["places"][k], np.asarray(row["sizes"][k], float)
            self._put(k, place, found, np.asarray(row["sums"][k], float).reshape(len(self.ids), len(found)), sizes)

    def silhouettes(self) -> np.ndarray:
        """``(b - a) / max(a, b)`` by row and clustering; 0 for a lone member, a single cluster or no distance at all."""
        out = np.zeros(self.labels.shape)
        rows = np.arange(len(self.ids))
        for k, place in enumerate(self.places):
            own = np.array([place[label] for label in self.labels[:, k].tolist()])
            n = self.sizes[k]
            inner = self.sums[k][rows, own] / np.maximum(n[own] - 1, 1)
            outer = self.sums[k] / n
            outer[rows, own] = np.inf
            b = outer.min(1)
            good = (n[own] > 1) & np.isfinite(b) & (np.maximum(inner, b) > 0)
            out[good, k] = ((b - inner) / np.maximum(inner, b))[good]
        return out


def euclidean_silhouettes(rows: DataFrame, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """``(doc_id, labels, weight, silhouettes)`` of ``(doc_id, embedding, labels, weight)``: one value for each label of the array.

    Vectors are packed into a written store of blocks. Every block of rows is held by one task, and all blocks pass by it one
    after the other, so distances are made once for all clusterings. Tasks read the passing blocks from the store again, so they
    are never shuffled; of a store beyond ``blocks.TARGET_BYTES`` each task takes a part, and sums of the parts are added up.
    Blocks get smaller where there are so many clusters that their sums would fill a task.
    """
    first = rows.agg(F.count("*").alias("n"), F.max(F.size("labels")).alias("k")).first()
    clusterings = first.k or 0
    if clusterings:
        labels = rows.agg(*(F.approx_count_distinct(F.col("labels")[k]) for k in range(clusterings))).first()
        block_rows = max(1, min(block_rows, blocks.TARGET_BYTES // (8 * max(sum(labels), 1))))
    total = blocks.block_count(first.n, block_rows)
    store = _block_store(rows, total)
    stored = store.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    parts = int(max(1, min(total, -(-stored // blocks.TARGET_BYTES))))
    own = store.select(F.col("block").alias("own"), *(F.col(c).alias(f"own_{c}") for c in store.columns if c != "block"))
    own = own.repartitionById(min(total, blocks.MAX_PARTITIONS), F.col("own"))  # one block of rows a task, not several by chance
    passing = blocks.every_pair(own, store.coalesce(parts))
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("doc_id", "labels"))
    schema = f"doc_id {id_type}, labels {label_type}, weight bigint, silhouettes array<double>"
    out = blocks.arrow_schema(rows, schema)
    partial_schema = (
        f"own int, first int, ids array<{id_type}>, labels {label_type}, weights array<bigint>, "
        f"places array<{label_type}>, sums array<array<double>>, sizes array<array<double>>"
    )
    partial_out = blocks.arrow_schema(rows, partial_schema)

    def finished(held: _Toward) -> pa.Table:
        return pa.table([held.ids, held.labels.tolist(), held.weights, list(held.silhouettes())], names=out.names).cast(out)

    def added(held: _Toward) -> pa.Table:
        return pa.Table.from_pylist([held.partial()], schema=partial_out)

    def run(batches):
        own, held = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                if row.column("own")[0].as_py() != own:
                    if held is not None:
                        yield from (finished if parts == 1 else added)(held).to_batches()
                    row = row.to_pylist()[0]
                    own = row["own"]
                    held = _Toward({"own": own} | {c: row[f"own_{c}"] for c in FIELDS}, row["block"])
                else:
                    row = row.select(["block", *FIELDS]).to_pylist()[0]
                held.add(row, row["block"] == own)
        if held is not None:
            yield from (finished if parts == 1 else added)(held).to_batches()

    def together(table: pa.Table) -> pa.Table:
        first, *others = sorted(table.to_pylist(), key=lambda row: row["first"])
        held = _Toward(first | {"data": b"", "single": True}, first["first"])
        for part in (first, *others):
            held.take(part)
        return finished(held)

    if parts == 1:
        return passing.mapInArrow(run, schema)
    return passing.mapInArrow(run, partial_schema).groupBy("own").applyInArrow(together, schema)


def _euclidean_by_vector(points: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame, blocks.Size]:
    """Silhouette of every distinct (vector, cluster) with the number of documents sharing it."""
    distinct = materialized(blocks.distinct_points(points, ("cluster_id",)))
    size = blocks.measure(distinct)
    rows = distinct.select("doc_id", "embedding", F.array("cluster_id").alias("labels"), "weight")
    found = euclidean_silhouettes(rows, block_rows)
    cluster, value = F.col("labels")[0].alias("cluster_id"), F.col("silhouettes")[0].alias("silhouette")
    return found.select("doc_id", cluster, "weight", value), distinct, size


def silhouette_samples(points: DataFrame, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Euclidean silhouette of every document, ordered by value within its cluster."""
    scored, distinct, size = _euclidean_by_vector(points, block_rows)
    samples = scored.select("doc_id", "cluster_id", "silhouette")
    if size.has_copies:
        copies = blocks.copies_of(points, distinct, ("cluster_id",)).join(
            samples.withColumnRenamed("doc_id", "rep"), "rep"
        )
        samples = samples.unionByName(copies.drop("rep"))
    return samples.orderBy("cluster_id", "silhouette", "doc_id")


def silhouette_euclidean(
    points: DataFrame, block_rows: int = blocks.BLOCK_ROWS, sample: int | None = None, seed: int = 0
) -> DataFrame:
    """Mean Euclidean silhouette, 0 for a single cluster; with ``sample``, the estimate of ``sampled_silhouette``."""
    if sample is not None:
        return sampled_silhouette(points, sample, seed)
    scored, _, _ = _euclidean_by_vector(points, block_rows)
    mean = F.try_divide(F.sum(F.col("silhouette") * F.col("weight")), F.sum("weight"))
    return scored.agg(F.coalesce(mean, F.lit(0.0)).alias("silhouette_euclidean"))


def silhouettes_by_clustering(rows: DataFrame, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """``(position, silhouette_euclidean)``: the mean of each clustering of ``(doc_id, embedding, labels)``, all from one pass over pairs."""
    distinct = rows.groupBy(vectors.doubles(F.col("embedding")).alias("embedding"), "labels").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("weight")
    )
    found = euclidean_silhouettes(materialized(distinct), block_rows)
    each = found.select("weight", F.posexplode("silhouettes").alias("position", "value"))
    mean = F.sum(F.col("value") * F.col("weight")) / F.sum("weight")
    return each.groupBy("position").agg(mean.alias("silhouette_euclidean"))


def stratified_sample(points: DataFrame, sample: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """About ``sample`` rows, at least two of each cluster, and the clusters with their rows ``n`` and sampled rows ``taken``.

    Rows are taken in the order of a digest of the seed and their id, in proportion to the clusters' sizes. Only the first rows of each
    cluster in each task are shuffled.
    """
    sizes = points.groupBy("cluster_id").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).scalar()
    share = F.floor(F.lit(sample) * F.col("n") / F.col("_total"))
    sizes = materialized(sizes.withColumn("_total", total).select("cluster_id", "n", F.least("n", F.greatest(F.lit(2), share)).alias("taken")))
    order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), F.col("doc_id")]
    first = top_per_key(points.select("doc_id", "embedding", "cluster_id"), ["cluster_id"], order, max(sample, 2))
    chosen = first.join(sizes.select("cluster_id", "taken"), "cluster_id").filter("rank <= taken").drop("rank", "taken")
    return materialized(chosen), sizes


def sampled_silhouette(points: DataFrame, sample: int, seed: int = 0, limit_bytes: int = blocks.TARGET_BYTES) -> DataFrame:
    """``(n_sampled, silhouette_euclidean, standard_error)``: the mean over a stratified sample, each row of it against all rows.

    Clusters weigh by their size. The error is that of a stratified mean without replacement; it is 0 where all rows are taken.
    Work grows with the rows times the sample, not with their square.
    """
    chosen, sizes = stratified_sample(points, sample, seed)

    def kernel(slices, targets: pa.Table):
        y, sums = blocks.matrix(targets.column("embedding")), {}
        for part in slices:
            found, member = np.unique(part.column("cluster_id").to_numpy(), return_inverse=True)
            share = np.zeros((part.num_rows, len(found)))
            share[np.arange(part.num_rows), member] = 1.0
            added = np.sqrt(blocks.squared_distances(y, blocks.matrix(part.column("embedding")))) @ share
            for k, label in enumerate(found.tolist()):
                sums[label] = sums.get(label, 0.0) + added[:, k]
        for label, total in sums.items():
            yield {"doc_id": targets.column("doc_id"), "cluster_id": targets.column("cluster_id"), "other": [label] * len(y), "total": total}

    id_type, cluster_type = (points.schema[c].dataType.simpleString() for c in ("doc_id", "cluster_id"))
    schema = f"doc_id {id_type}, cluster_id {cluster_type}, other {cluster_type}, total double"
    parts = blocks.against(
        points.select("doc_id", "embedding", "cluster_id"), chosen, kernel, schema, reduce=lambda p: p, limit_bytes=limit_bytes
    )
    sums = parts.groupBy("doc_id", "cluster_id", "other").agg(F.sum("total").alias("total"))
    own = F.col("cluster_id") == F.col("other")
    means = sums.join(sizes.select(F.col("cluster_id").alias("other"), "n"), "other").groupBy("doc_id", "cluster_id").agg(
        F.max(F.when(own & (F.col("n") > 1), F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
    )
    scored = means.select("cluster_id", _coefficient(F.col("a"), F.col("b")).alias("s"))
    strata = scored.groupBy("cluster_id").agg(F.avg("s").alias("mean"), F.var_samp("s").alias("spread")).join(sizes, "cluster_id")
    rest = (1 - F.col("taken") / F.col("n")) * F.coalesce("spread", F.lit(0.0)) / F.col("taken")
    total = F.sum("n")
    return strata.agg(
        F.sum("taken").alias("n_sampled"),
        F.coalesce(F.try_divide(F.sum(F.col("mean") * F.col("n")), total), F.lit(0.0)).alias("silhouette_euclidean"),
        F.coalesce(F.try_divide(F.sqrt(F.sum(F.col("n") * F.col("n") * rest)), total), F.lit(0.0)).alias("standard_error"),
    )


def cluster_compactness(points: DataFrame, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Mean Euclidean distance over the pairs of each cluster, 0 below two members."""
    distinct = blocks.distinct_points(points, ("cluster_id",))

    def kernel(left: blocks.Block, right: blocks.Block, same: bool) -> dict:
        d = np.sqrt(blocks.squared_distances(left.x, right.x, same))
        total = float(left.column("weight") @ d @ right.column("weight")) / (2 if same else 1)
        return {"cluster_id": left.column("cluster_id")[:1], "total": np.array([total])}

    cluster_type = points.schema["cluster_id"].dataType.simpleString()
    sums = blocks.cluster_pairs(
        distinct,
        kernel,
        f"cluster_id {cluster_type}, total double",
        ("cluster_id",),
        ("weight",),
        block_rows,
    )
    totals = sums.groupBy("cluster_id").agg(F.sum("total").alias("total"))
    sizes = points.groupBy("cluster_id").agg(F.count("*").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return sizes.join(totals, "cluster_id").select(
        "cluster_id",
        F.coalesce(F.try_divide(F.col("total"), pairs), F.lit(0.0)).alias("avg_pairwise_distance"),
    )


def intra_cluster_distance_pool(points: DataFrame, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Mean and population deviation of the cosine distance over all same-cluster pairs, in linear time.

    The sum of pairwise similarities follows from the vector sum of a cluster and the sum of their
    squares from its second-moment matrix. A cluster that fits one block gives that square directly,
    a larger one gives one triangular matrix per block, which Spark adds up.
    """
    unit = unit_points(points, "cluster_id", "doc_id")
    slots = unit.groupBy("cluster_id").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks"))
    placed = unit.join(slots, "cluster_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))

    def second_moment(table: pa.Table) -> pa.Table:
        x = blocks.matrix(table.column("embedding"))
        if table.column("blocks")[0].as_py() == 1:
            small = x @ x.T if len(x) < x.shape[1] else x.T @ x
            position, value = np.array([-1]), np.array([np.sqrt((small * small).sum())])
        else:
            g = (x.T @ x) * np.sqrt(2.0)
            g[np.diag_indices_from(g)] /= np.sqrt(2.0)
            value = g[np.triu_indices_from(g)]
            position = np.arange(len(value))
        cluster = np.repeat(table.column("cluster_id")[:1].to_numpy(), len(value))
        return pa.table({"cluster_id": cluster, "position": position, "value": value}).cast(out)

    schema = f"cluster_id {points.schema['cluster_id'].dataType.simpleString()}, position bigint, value double"
    out = blocks.arrow_schema(points, schema)
    entries = placed.groupBy("cluster_id", "block").applyInArrow(second_moment, schema)
    summed = entries.groupBy("cluster_id", "position").agg(F.sum("value").alias("value"))
    squares = summed.agg(F.sum(F.col("value") * F.col("value")).alias("g"))
    lengths = unit.select(vectors.squared_norm(F.col("embedding")).alias("l"))
    fourth = lengths.agg(F.sum(F.col("l") * F.col("l")).alias("f"))
    sums = cluster_moments(unit).agg(
        F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"),
        F.sum((vectors.squared_norm(F.col("s")) - F.col("q")) / 2).alias("similarity"),
    )
    mean = F.try_divide(F.col("similarity"), F.col("pairs"))
    second = F.try_divide((squares.scalar() - fourth.scalar()) / 2, F.col("pairs"))
    return sums.select("pairs", mean.alias("mean"), second.alias("second")).select(
        F.coalesce(1 - F.col("mean"), F.lit(0.0)).alias("avg_intra_cluster_distance"),
        F.coalesce(F.sqrt(F.greatest(F.col("second") - F.col("mean") * F.col("mean"), F.lit(0.0))), F.lit(0.0)).alias(
            "std_intra_cluster_distance"
        ),
    )


def cluster_summary(
    assignments: DataFrame, points: DataFrame | None = None, centers: DataFrame | None = None
) -> DataFrame:
    """One row per document with the statistics of its cluster, ordered by cluster and name.

    ``assignments`` has ``document_name, cluster_id``; with ``points`` the two vector statistics are added.
    """
    stats = cluster_sizes(assignments)
    if points is not None:
        stats = stats.join(avg_distance_to_center(points, centers), "cluster_id", "left").join(
            intra_cluster_similarity(points), "cluster_id", "left"
        )
    extra = [c for c in stats.columns if c != "cluster_id"]
    rows = assignments.join(stats, "cluster_id", "left")
    keep = [c for c in assignments.columns if c not in ("document_name", "cluster_id")]
    return rows.select("document_name", "cluster_id", *extra, *keep).orderBy("cluster_id", "document_name")


def cluster_info(points: DataFrame, algorithm: str) -> DataFrame:
    """Algorithm, clusters, documents and both scores, with one row per cluster label and its size."""
    sizes = points.groupBy("cluster_id").agg(F.count("*").alias("size"))
    totals = sizes.agg(F.struct(F.count("*").alias("k"), F.sum("size").alias("n"))).scalar()
    return sizes.withColumn("_totals", totals).select(
        F.lit(algorithm).alias("algorithm"),
        F.col("_totals.k").alias("n_clusters"),
        F.col("_totals.n").alias("n_documents"),
        silhouette_euclidean(points).scalar().alias("silhouette_score"),
        calinski_harabasz(points).scalar().alias("calinski_harabasz_score"),
        "cluster_id",
        "size",
    )


def clustering_evaluation(points: DataFrame) -> DataFrame:
    """One row: clusters, documents, both silhouettes, Calinski-Harabasz and the pooled inner distances."""
    sizes = cluster_sizes(points)
    pool = intra_cluster_distance_pool(points).withColumn("pool", F.struct("*")).select("pool").scalar()
    return (
        sizes.agg(F.count("*").alias("n_clusters"), F.sum("size").alias("n_documents"))
        .withColumn("silhouette_score", silhouette_euclidean(points).scalar())
        .withColumn("silhouette_cosine", silhouette_cosine(points).scalar())
        .withColumn("calinski_harabasz_score", calinski_harabasz(points).scalar())
        .withColumn("_pool", pool)
        .select("*", "_pool.*")
        .drop("_pool")
    )


def with_quality_band(scores: DataFrame, column: str = "silhouette_score") -> DataFrame:
    return scores.withColumn("quality", names.quality_band(F.col(column)))
