"""Connected components of a link table by alternating stars; hubs stay splittable, nothing goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeframe.llm.common import cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("high").alias("node"), F.col("low").alias("near")).unionByName(edges.select(F.col("low").alias("node"), F.col("high").alias("near")))
    least = cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("root")))
    return both.where("near > node").join(least, "node").where("near <> root").select(F.col("near").alias("high"), F.col("root").alias("low")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = cut(edges.groupBy("high").agg(F.min("low").alias("root")))
    hung = edges.join(least, "high").where("low <> root").select(F.col("low").alias("high"), F.col("root").alias("low"))
    return hung.unionByName(least.select("high", F.col("root").alias("low"))).distinct()


def connected_components(links: DataFrame, left: str, right: str, rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node with a link to another; component is its smallest reachable node.

    Links may repeat, point either way or loop; null ends are ignored. Each round contracts the graph to
    stars (logarithmically many rounds); every intermediate is checkpointed, so joins on hub nodes are
    plain two-sided shuffles that adaptive execution can split.
    """
    edges = links.select(F.greatest(left, right).alias("high"), F.least(left, right).alias("low")).where(F.col(left).isNotNull() & F.col(right).isNotNull()).where("high > low").distinct()
    edges = cut(edges)
    seen = _mark(edges)
    for _ in range(rounds):
        if not seen[0]:
            break
        edges = cut(_small_star(cut(_large_star(edges))))
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = edges.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return nodes.unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
