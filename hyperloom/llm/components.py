"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import cut, free_shuffles


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b) -> node, label: the least node that can be reached; every node of an edge, once.

    Both stars keep the components and only replace a node's neighbours by the
    least one, so edges never grow beyond those there were. A hub's neighbours
    are not gathered: its least neighbour is an aggregate with partial sums,
    joined back to the edges. The shuffle files of a round go with it.
    """
    e = cut(edges.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), free=True)

    def sums(x: DataFrame) -> Row:
        both = x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("h"))
        row = both.collect()[0]
        free_shuffles(both)
        return row

    seen = sums(e)
    for _ in range(max_rounds):
        if not seen["n"]:
            break
        # large star: each node's greater neighbours move to its least neighbour (itself included)
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"))
        large = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        # small star: each node's smaller neighbours, and itself, move to the least of them
        m = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(m, "hi").select("m", "lo", "hi")
        small = moved.select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi")).filter("lo <> hi").distinct()
        e = cut(small, free=True)
        now = sums(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(e.select(F.col("lo").alias("node"), F.col("lo").alias("label"))).distinct()
