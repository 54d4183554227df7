"""Connected components of a graph given as edges, by hooking and shortcutting; nothing goes to the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) for every node of ``edges`` (columns a, b: long).

    A round sends the smallest label of each edge to its other end and to that end's label, then replaces labels by
    the labels of these. Labels only shrink; the loop ends when none changes, so the result is exact (each round at least
    halves the way to a root that is left, and ``rounds`` of them without an end are an error, not a cut result). Hot nodes
    are aggregated before each shuffle. No edges: no rows.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = cut(edges)
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    for _ in range(rounds):
        of_a, of_b = labels.select("node", "root").toDF("a", "ra"), labels.select("node", "root").toDF("b", "rb")
        seen = edges.join(of_a, "a").join(of_b, "b").where("ra <> rb")
        low, high = F.least("ra", "rb"), F.greatest("ra", "rb")
        hooks = seen.select(F.explode(F.array(high, F.when(F.col("ra") > F.col("rb"), F.col("a")).otherwise(F.col("b")))).alias("node"), low.alias("root"), F.lit(None).cast("long").alias("old"))
        better = hooks.union(labels.select("node", "root", F.col("root").alias("old"))).groupBy("node").agg(F.min("root").alias("root"), F.max("old").alias("old"))
        up = better.select("node", "root").toDF("root", "over")
        labels = cut(better.join(up, "root", "left").select("node", F.coalesce(F.least("over", "root"), "root").alias("root"), "old"))
        if labels.where("root <> old").isEmpty():
            return labels.select("node", "root")
    raise RuntimeError(f"labels still change after {rounds} rounds")
