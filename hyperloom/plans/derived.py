"""Hypergraphs derived from the relational tables, deterministically."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import sorted_set, with_defaults
from ..operators import features


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(*parts) -> F.Column:
    return F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge of three nodes for each lineitem; rows with equal keys are numbered."""
    li = table(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    w = Window.partitionBy(*keys).orderBy("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    c = F.col
    return li.withColumn("dup", F.row_number().over(w)).select(
        _id("li", *[c(k) for k in keys], c("dup")).alias("edge_id"),
        F.array(_id("o", c("l_orderkey")), _id("p", c("l_partkey")), _id("s", c("l_suppkey"))).alias("nodes"),
        F.lit("supplies").alias("predicate"),
        (c("l_quantity") / F.lit(50.0)).alias("I_value"),
        (F.lit(1.0) + c("l_tax")).alias("base_weight"),
        F.when(c("l_returnflag") == "R", -1.0).otherwise(1.0).alias("dir_factor"),
    )


def knowledge_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary edges of six kinds between the rows of the tables."""
    def part(name: str, short: str, key: str, a: F.Column, b: F.Column, predicate: str) -> DataFrame:
        k = F.col(key)
        attrs = F.when(k % 3 == 0, F.array(F.lit("name"), F.lit("type"))).when(k % 3 == 1, F.array(F.lit("name"))).otherwise(F.array(F.lit("name"), F.lit("segment"), F.lit("type")))
        return table(spark, sf_dir, name).select(_id("kg", F.lit(short), k).alias("edge_id"), sorted_set(F.array(a, b)).alias("nodes"), F.lit(predicate).alias("predicate"), ((k % 100) / F.lit(100.0)).alias("I_value"), F.lit(1.0).alias("base_weight"), F.lit(1.0).alias("dir_factor"), attrs.alias("attr_types"))

    c = F.col
    rows = [
        part("customer", "cn", "c_custkey", _id("c", c("c_custkey")), _id("n", c("c_nationkey")), "located_in"),
        part("supplier", "sn", "s_suppkey", _id("s", c("s_suppkey")), _id("n", c("s_nationkey")), "located_in"),
        part("nation", "nr", "n_nationkey", _id("n", c("n_nationkey")), _id("r", c("n_regionkey")), "part_of"),
        part("orders", "oc", "o_orderkey", _id("o", c("o_orderkey")), _id("c", c("o_custkey")), "placed_by"),
        part("part", "pt", "p_partkey", _id("p", c("p_partkey")), _id("t", c("p_type")), "is_a"),
        part("part", "pb", "p_partkey", _id("p", c("p_partkey")), _id("b", c("p_brand")), "instance_of"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def knowledge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, suppliers and nations as typed nodes; attribute values are JSON text."""
    def part(name: str, short: str, key: str, kind: str, **attrs: str) -> DataFrame:
        entries = [x for k, col in {"name": attrs["label"], **({"segment": attrs["segment"]} if "segment" in attrs else {})}.items() for x in (F.lit(k), F.concat(F.lit('"'), F.col(col), F.lit('"')))]
        return table(spark, sf_dir, name).select(_id(F.lit(short), F.col(key)).alias("node_id"), F.create_map(F.lit("type"), F.lit(f'"{kind}"'), *entries).alias("attributes"))

    return part("customer", "c", "c_custkey", "customer", label="c_name", segment="c_mktsegment").unionByName(part("supplier", "s", "s_suppkey", "supplier", label="s_name")).unionByName(part("nation", "n", "n_nationkey", "nation", label="n_name"))


def event_chain(spark: SparkSession, sf_dir: str, by_value: bool = False) -> DataFrame:
    """Edges over three events in a row of one user; ordered by (user_id, i)."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    e = features.temporal_edges(ev, "user_id", ["ts", "event_id"], _id("e", F.col("event_id")), F.col("value") if by_value else None)
    return e.select("edge_id", "nodes", "predicate", "I_value", F.lit(1.0).alias("base_weight"), F.lit(1.0).alias("dir_factor"), F.array().cast("array<string>").alias("attr_types"), "user_id", "i")


def event_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The event chain, and a later version: edges by i modulo 20 dropped, re-weighted, or new."""
    old = event_chain(spark, sf_dir)
    new = old.filter("i % 20 <> 0").withColumn("I_value", F.when(F.col("i") % 20 == 1, F.col("I_value") / 2).otherwise(F.col("I_value")))
    extra = old.filter("i % 20 = 0").withColumn("edge_id", F.concat(F.lit("new:"), "edge_id"))
    return with_defaults(old.drop("user_id", "i")), with_defaults(new.unionByName(extra).drop("user_id", "i"))


def node_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Typed nodes, and a later version: by the number in the id modulo 10, dropped or renamed."""
    old = knowledge_nodes(spark, sf_dir)
    n = F.element_at(F.split("node_id", ":"), 2).cast("long")
    new = old.filter(n % 10 != 0).withColumn("attributes", F.when(n % 10 == 1, F.map_concat(F.map_filter("attributes", lambda k, _: k != "name"), F.create_map(F.lit("name"), F.lit('"renamed"')))).otherwise(F.col("attributes")))
    return old, new.unionByName(old.filter(n % 10 == 0).withColumn("node_id", F.concat(F.lit("new:"), "node_id")))
