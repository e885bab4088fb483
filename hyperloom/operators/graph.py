"""Line graph and closed cycles; reading and changing a graph; descriptions of it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import checkpoint, incidence


def line_graph(edges: DataFrame) -> DataFrame:
    """a, b with a < b: the pairs of edges that share a node, once."""
    inc = incidence(edges).distinct()
    x, y = inc.select(F.col("edge_id").alias("a"), "node_id"), inc.select(F.col("edge_id").alias("b"), "node_id")
    return x.join(y, "node_id").filter("a < b").select("a", "b").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """edge_id, degree in the line graph; isolated edges have 0."""
    pairs = line_graph(edges)
    both = pairs.select(F.col("a").alias("edge_id")).union(pairs.select(F.col("b").alias("edge_id")))
    n = both.groupBy("edge_id").agg(F.count("*").alias("degree"))
    return edges.select("edge_id").join(n, "edge_id", "left").select("edge_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def cycles(pairs: DataFrame, length: int) -> DataFrame:
    """members (sorted ids): the sets of ``length`` edges that some simple cycle of the line graph visits, once.

    Paths start at their least id and grow by one join for each step; a cycle
    and its reverse are one (the second id is less than the last).
    """
    if length < 3:
        raise ValueError("a cycle has three edges at least")
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    paths = both.filter("u < v").select(F.array("u", "v").alias("path"))
    for _ in range(length - 2):
        step = paths.withColumn("u", F.element_at("path", -1)).join(both, "u")
        step = step.filter((F.col("v") > F.col("path")[0]) & ~F.array_contains("path", F.col("v")))
        paths = step.select(F.concat("path", F.array("v")).alias("path"))
    paths = paths.filter(F.col("path")[1] < F.element_at("path", -1))
    ends = paths.withColumn("a", F.col("path")[0]).withColumn("b", F.element_at("path", -1))
    return ends.join(pairs, ["a", "b"], "left_semi").select(F.array_sort("path").alias("members")).distinct()


def find_cycles(edges: DataFrame, min_length: int = 3, max_length: int = 4) -> DataFrame:
    """length, members: the edge sets of simple closed cycles of the line graph, from min_length to max_length edges.

    A cycle of two edges is a pair that shares a node; cycles of one set count
    once. Work grows with the number of paths, so the greatest length is the
    caller's bound.
    """
    pairs = checkpoint(line_graph(edges))
    out = None
    for n in range(max(2, min_length), max_length + 1):
        found = pairs.select(F.array("a", "b").alias("members")) if n == 2 else cycles(pairs, n)
        found = found.select(F.lit(n).alias("length"), "members")
        out = found if out is None else out.union(found)
    return out if out is not None else pairs.select(F.lit(0).alias("length"), F.array("a").alias("members")).limit(0)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes(node_id, attributes) with those of ``new`` in place of, or beside, its own."""
    return nodes.join(new, "node_id", "left_anti").unionByName(new)


def append_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with ``new`` behind them; ids may repeat."""
    last = edges.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("n")).first()["n"]
    return edges.unionByName(new.withColumn("pos", F.col("pos") + last))


def remove_first(edges: DataFrame, edge_id: str) -> DataFrame:
    """Edges without the first of that id."""
    mine = edges.filter(F.col("edge_id") == edge_id).agg(F.min("pos").alias("p")).first()["p"]
    return edges if mine is None else edges.filter(~((F.col("edge_id") == edge_id) & (F.col("pos") == mine)))


def edges_by_node(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.filter(F.array_contains("nodes", node_id))


def delete_node(nodes: DataFrame, edges: DataFrame, node_id: str) -> tuple[DataFrame, DataFrame]:
    """The graph without a node and the edges that it is a member of."""
    return nodes.filter(F.col("node_id") != node_id), edges.filter(~F.array_contains("nodes", node_id))


def count_types(nodes: DataFrame) -> DataFrame:
    """node_type, n: by the attribute ``type``, 'unknown' without one."""
    kind = F.coalesce(F.col("attributes")["type"], F.lit('"unknown"'))
    return nodes.groupBy(kind.alias("node_type")).agg(F.count("*").alias("n"))


def count_predicates(edges: DataFrame) -> DataFrame:
    return edges.groupBy("predicate").agg(F.count("*").alias("n"))


def describe(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, name, n: totals, node types and predicates in one table."""
    total = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit(name).alias("name"), "n")
    types = count_types(nodes).select(F.lit("node_type").alias("kind"), F.col("node_type").alias("name"), "n")
    preds = count_predicates(edges).select(F.lit("predicate").alias("kind"), F.col("predicate").alias("name"), "n")
    return total(nodes, "nodes").union(total(edges, "edges")).union(types).union(preds)


def preview(edges: DataFrame, n: int = 10) -> DataFrame:
    """edge_id and I_value as text of the first n edges."""
    return edges.orderBy("pos").limit(n).select("edge_id", F.format_string("%.4f", "I_value").alias("information"))


def identity_hash(nodes: DataFrame) -> DataFrame:
    """n, hash: 8 hex digits of the MD5 of all ids in order.

    A digest of a total order is sequential: sorted ranges stream through one
    task, which holds nothing but the state of the hash.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, h = 0, hashlib.md5(usedforsecurity=False)
        for b in batches:
            n += b.num_rows
            for x in b.column(0).drop_null().cast(pa.binary()):
                h.update(x.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([h.hexdigest()[:8]])], names=["n", "hash"])

    return nodes.select("node_id").orderBy("node_id").coalesce(1).mapInArrow(run, "n long, hash string")


def estimated_size(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """edges, bytes (and nodes): the graph as JSON text; an edge or node without id counts by the flat estimate of 80 or 50 bytes."""
    size = lambda cols, flat: F.sum(F.when(F.col(cols[0]).isNull(), F.lit(flat)).otherwise(F.octet_length(F.to_json(F.struct(*cols)))).cast("long"))
    e = edges.agg(F.count("*").alias("edges"), F.coalesce(size(["edge_id", "nodes", "predicate", "I_value"], 80), F.lit(0)).alias("bytes"))
    if nodes is None:
        return e
    n = nodes.agg(F.count("*").alias("nodes"), F.coalesce(size(["node_id", "attributes"], 50), F.lit(0)).alias("__more"))
    return e.join(n).select("nodes", "edges", (F.col("bytes") + F.col("__more")).alias("bytes"))  # one row each
