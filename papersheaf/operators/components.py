"""Connected components by repeated contraction of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersheaf.session import discard, materialized


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, label)`` for all ``nodes(id)``; the label is the smallest id of the component.

    In each round a node follows its smallest neighbour, if smaller than itself; the edges are rewritten
    to those targets and loops dropped, so they shrink quickly. Each round is written to the shared folder.
    """
    labels = nodes.select("id", F.col("id").alias("label"))
    remaining = materialized(edges.select("u", "v").filter("u <> v").distinct())
    first = True
    while not remaining.isEmpty():
        before = [remaining] if first else [remaining, labels]
        both = remaining.unionByName(remaining.select(F.col("v").alias("u"), F.col("u").alias("v")))
        follow = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to"))
        onward = follow.select(F.col("u").alias("to"), F.col("to").alias("root"))
        parents = materialized(follow.join(onward, "to").select(F.col("u").alias("node"), "root"))
        labels = materialized(
            labels.join(parents, labels["label"] == parents["node"], "left").select(
                "id", F.coalesce("root", "label").alias("label")
            )
        )
        left = parents.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        right = parents.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        remaining = materialized(
            remaining.join(left, "u")
            .join(right, "v")
            .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        discard(*before, parents)
        first = False
    return labels
