"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour v of u is linked to the least node of u's closed neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a")
    return (
        moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(least.select("a", F.col("m").alias("b")))
        .filter("a <> b")
        .distinct()
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``; the component is its least node.

    Neighbourhoods are only ever aggregated (min) and joined, never collected, so a hub costs no more than its edges.
    Rounds stop when the edge set no longer changes; lineage is cut by a reliable checkpoint in each. Null ends, loops
    and repeated edges are ignored (a loop's node forms its own component); no edges give no rows. It raises if the
    rounds don't suffice, rather than return a half-merged result; they are O(log^2 n) of the number of nodes.
    """
    edges = edges.select("a", "b").filter("a is not null and b is not null")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    current = cut_lineage(edges.filter("a <> b").distinct())
    mark = None
    for _ in range(max_rounds):
        current = cut_lineage(_small_star(_large_star(current)))
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return nodes.join(current.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
