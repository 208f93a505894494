"""Connected components by alternating star contraction (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import drop, stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Every node's smallest neighbour m; larger (small: not larger) neighbours are linked to m instead."""
    if small:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = near.join(least, "u")
    if small:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for undirected edges a, b of one comparable type; loops are ignored.

    Each round makes two hash aggregations and joins over the remaining edges; rounds grow with the logarithm
    of the longest chain. Isolated nodes don't appear. Ties can't arise: nodes are distinct values.
    """
    now = stored(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        following = stored(_star(_star(now, False), True), "edges")
        drop(now)
        now, before, mark = following, mark, _mark(following)
        if mark == before:
            break
    hubs = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(hubs.select("node", F.col("node").alias("component")))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]
