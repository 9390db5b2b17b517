"""Connected components by alternating stars, as joins and grouped minima over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import staged


def _minima(links: DataFrame, label: str) -> DataFrame:
    """The smallest neighbour of each node, the node itself included. Combined before it is shuffled and
    written, so that the join to it sees two plain sides and a node with very many links can be split."""
    return staged(links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), label)


def _settled(links: DataFrame) -> bool:
    """Whether links (u > v) are stars around the smallest node of each component: no u has two v, and no v is a u."""
    if not links.groupBy("u").count().where("count > 1").isEmpty():
        return False
    return links.select("v").distinct().join(links.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node and component (smallest node reachable) of every node in edges (a, b: bigint, not null).

    Each round links every larger neighbour of a node to the smallest one, then every smaller one;
    the edges end as stars around the smallest nodes, and rounds end as soon as they are. Edges of a node to itself are ignored."""
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    links = staged(links, "edges")
    for _ in range(max_rounds):
        if _settled(links):
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_minima(both, "large"), "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.distinct(), "large-star")
        small = large.join(_minima(large, "small"), "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        links = staged(small.select("e.u", "e.v").where("u > v").distinct(), "small-star")
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    leaves = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
