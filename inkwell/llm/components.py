"""Connected components of an edge table by alternating large and small stars.

Each round joins the edges with each node's least neighbour, so a node with many neighbours is a hot key of a join that
Spark can split, never a collected group. Every round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MAX_ROUNDS = 60


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (larger ones, or smaller ones and itself) tied to its least neighbour."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        moved = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).join(least, "u")
        out = moved.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return out.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label for each node of edges (a, b: long): label is the smallest node that it is connected with."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
    seen = edges.agg(mark.alias("m")).first()["m"]
    for _ in range(MAX_ROUNDS):
        if not seen["n"]:
            break
        edges = written(_starred(_starred(edges, True), False))
        now = edges.agg(mark.alias("m")).first()["m"]
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components still change after {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
