"""Connected components over an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import stored


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the smallest node reachable.

    Each round replaces the edges by stars around local minima, so the number of
    rounds grows with the logarithm of the longest path, and the number of edges
    never grows. Every round is written to the shared folder, which cuts the lineage.
    Self-loops and nulls are ignored; repeated edges are harmless.
    """
    current = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    current, mark = _settled(current)
    for _ in range(max_rounds):
        current, new_mark = _settled(_small_star(_large_star(current)))
        if new_mark == mark:
            break
        mark = new_mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _settled(frame: DataFrame) -> tuple[DataFrame, tuple]:
    kept = stored(frame, "components")
    row = kept.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
    return kept, tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node in the neighbourhood."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))
    tied = larger.join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
    return tied.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
