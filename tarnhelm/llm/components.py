"""Connected components by alternating stars, without collecting any link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnhelm.llm.lineage import cut, drop


def _largest_stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step on (u, v) with u > v.

    Large star: a node's larger neighbours go to its least neighbour or itself.  Small star:
    a node and its smaller neighbours go to the least of them.
    """
    sides = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
    both = sides.join(least, sides["u"] == least["w"])
    if larger:
        out = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; the root is its component's least node.

    ``edges`` are (a, b) of any orderable type.  The number of rounds grows with the logarithm of
    the longest chain.  A round's checksum tells when nothing moved.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    seen = None
    for _ in range(most_rounds):
        before, edges = edges, cut(_largest_stars(_largest_stars(edges, True), False))
        drop(before)
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (row["n"], row["s"]) == seen:
            break
        seen = (row["n"], row["s"])
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
