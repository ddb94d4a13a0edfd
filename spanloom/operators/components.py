"""Connected components of an edge table, by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import cut
from spanloom.skew import HOT_NARROW_ROWS, lookup

MAX_ROUNDS = 100


def connected_components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component) for each node of the edges (src, dst); a component is named by its smallest node."""
    star = cut(_down(edges.select("src", "dst")))
    # Each step turns an edge into at most one other, so this bounds the rows of all rounds.
    most = 2 * star.count()
    for _ in range(max_rounds):
        if _is_star(star):
            return _labels(star)
        star = cut(_small_star(_large_star(star, most), most))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _down(edges: DataFrame) -> DataFrame:
    """Distinct edges that point from the larger to the smaller node."""
    return (
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct()
    )


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    around = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("root"), F.count(F.lit(1)).alias("_rows"))
    linked = lookup(both.where(F.col("dst") > F.col("src")), around, "src", "_rows", total, HOT_NARROW_ROWS)
    return _down(linked.select(F.col("dst").alias("src"), F.col("root").alias("dst")))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them."""
    below = edges.groupBy("src").agg(F.min("dst").alias("root"), F.count(F.lit(1)).alias("_rows"))
    linked = lookup(edges, below, "src", "_rows", total, HOT_NARROW_ROWS)
    return _down(
        linked.select(F.col("dst").alias("src"), F.col("root").alias("dst")).unionByName(
            below.select("src", F.col("root").alias("dst"))
        )
    )


def _is_star(edges: DataFrame) -> bool:
    """Whether every node has one root and no root has a root of its own."""
    torn = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("src")
    roots = edges.select(F.col("dst").alias("src")).distinct()
    return torn.unionByName(edges.join(roots, "src", "left_semi").select("src")).isEmpty()


def _labels(star: DataFrame) -> DataFrame:
    roots = star.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return star.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
