"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import forget, written


def _towards_min(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written minima, and (u, v, m): m is the least of u and all its neighbours. The minima are a table of their own, so that a node
    with very many neighbours is a plain skewed join, which adaptive execution splits."""
    least = written(edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")), "least")
    return least, edges.join(least, "u")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """Give each node that has an edge the least node id that it can reach: ``node``, ``component``.

    Edges count both ways; loops, repeated edges and null ends are allowed and add nothing. An empty input gives an
    empty table. Each round shuffles the edges and writes them to the shared folder; the number of rounds
    grows with the logarithm of the longest path. Nothing but a checksum comes to the driver.
    """
    edges = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = mark
        all_least, both = _towards_min(edges.union(edges.select("v", "u")))
        large = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large")
        large_least, near = _towards_min(large)
        small = near.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        last, edges = edges, written(small.union(near.select("u", F.col("m").alias("v"))).distinct(), "small")
        forget(last, all_least, large, large_least)
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
