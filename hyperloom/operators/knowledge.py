"""The knowledge base: patterns, matching, absorbing and rebuilding edges.

Patterns are a small table (``MAX_PATTERNS`` at most, checked when they are made,
added or read). Joins with them carry no hint: Spark broadcasts the table where
its size allows, and else joins by key.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import EPSILON, sorted_set

MAX_PATTERNS = 100_000
PATTERN = "pat_pos long, edge_id string, nodes array<string>, predicate string, I_value double, base_weight double, dir_factor double, attr_types array<string>"

# The built-in patterns (id, predicate, arity, attribute types)
BUILTIN = [
    ("pat_knows_2", "knows", 2, ["name", "type"]),
    ("pat_friend_of_2", "friend_of", 2, ["name", "type"]),
    ("pat_family_of_2", "family_of", 2, ["name", "role", "type"]),
    ("pat_colleague_of_2", "colleague_of", 2, ["name", "type"]),
    ("pat_works_at_2", "works_at", 2, ["name", "type"]),
    ("pat_member_of_2", "member_of", 2, ["name", "type"]),
    ("pat_founder_of_2", "founder_of", 2, ["name", "type"]),
    ("pat_located_in_2", "located_in", 2, ["name", "type"]),
    ("pat_near_2", "near", 2, ["distance", "name", "type"]),
    ("pat_partof_3", "part_of", 3, ["name", "type"]),
    ("pat_participated_in_2", "participated_in", 2, ["date", "name", "type"]),
    ("pat_occurred_at_2", "occurred_at", 2, ["date", "name", "type"]),
    ("pat_has_attribute_2", "has_attribute", 2, ["name", "type"]),
    ("pat_is_a_2", "is_a", 2, ["name", "type"]),
    ("pat_instance_of_2", "instance_of", 2, ["name", "type"]),
    ("pat_causes_2", "causes", 2, ["name", "type"]),
    ("pat_related_2", "related_to", 2, ["name"]),
    ("pat_interacts_3", "interacts_with", 3, ["name", "type"]),
]


def patterns(spark: SparkSession, rows: list[tuple[str, str, int, list[str]]]) -> DataFrame:
    """(id, predicate, arity, attribute types) in order of priority -> the pattern table."""
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"{len(rows)} patterns; at most {MAX_PATTERNS}")
    data = [(i, p, [f"n_{chr(97 + k)}" for k in range(n)], pred, 1.0, 1.0, 1.0, sorted(set(a))) for i, (p, pred, n, a) in enumerate(rows)]
    return spark.createDataFrame(data, PATTERN)


def builtin(spark: SparkSession) -> DataFrame:
    return patterns(spark, BUILTIN)


def empty(spark: SparkSession) -> DataFrame:
    return patterns(spark, [])


def add(kb: DataFrame, new: DataFrame) -> DataFrame:
    """kb with the rows of ``new`` after its own; MAX_PATTERNS at most."""
    last = kb.agg(F.coalesce(F.max("pat_pos") + 1, F.lit(0)).alias("n")).first()["n"]
    return checked(kb.unionByName(new.withColumn("pat_pos", F.col("pat_pos") + last)))


def checked(kb: DataFrame) -> DataFrame:
    """kb, if it has no more than MAX_PATTERNS rows."""
    if kb.limit(MAX_PATTERNS + 1).count() > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns")
    return kb


def index(edges: DataFrame) -> DataFrame:
    """k_predicate, k_arity, k_attrs, n, first: the canonical keys of edges, how many have each, and the least id."""
    return edges.select("edge_id", *key()).groupBy("k_predicate", "k_arity", "k_attrs").agg(F.count("*").alias("n"), F.min("edge_id").alias("first"))


def summary(kb: DataFrame, rounds: list[dict] | None = None) -> str:
    """The number of patterns, and what each round of learning did, as text."""
    lines = ["Knowledge base", f"  patterns: {kb.count()}", f"  rounds: {len(rounds or [])}"]
    return "\n".join([*lines, *(f"  round {k}: mined {r['patterns_mined']}, added {r['added']}, skipped {r['skipped_duplicates']}" for k, r in enumerate(rounds or [], 1))])


def key() -> list[Column]:
    """The canonical key: predicate, arity, attribute types."""
    return [F.col("predicate").alias("k_predicate"), F.size("nodes").alias("k_arity"), sorted_set("attr_types").alias("k_attrs")]


def first_by_key(kb: DataFrame) -> DataFrame:
    """Of patterns with one key, the first."""
    k = kb.select("*", *key())
    w = Window.partitionBy("k_predicate", "k_arity", "k_attrs").orderBy("pat_pos")
    return k.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def match(edges: DataFrame, kb: DataFrame, keep: tuple[str, ...] = (), how: str = "inner") -> DataFrame:
    """Edges with the pattern that they match (pattern_id, pattern_nodes)."""
    p = first_by_key(kb).select("k_predicate", "k_arity", "k_attrs", F.col("edge_id").alias("pattern_id"), F.col("nodes").alias("pattern_nodes"))
    return edges.select("*", *key()).join(p, ["k_predicate", "k_arity", "k_attrs"], how).drop("k_predicate", "k_arity", "k_attrs")


def unmatched(edges: DataFrame, kb: DataFrame | None) -> DataFrame:
    """Edges that no pattern absorbs."""
    if kb is None:
        return edges
    p = first_by_key(kb).select("k_predicate", "k_arity", "k_attrs")
    return edges.select("*", *key()).join(p, ["k_predicate", "k_arity", "k_attrs"], "left_anti").drop("k_predicate", "k_arity", "k_attrs")


def absorb(edges: DataFrame, kb: DataFrame, strict: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """edge_id, pattern_id, node_mapping (pattern node -> node), and the fields that rebuilding needs (and the columns ``keep``)."""
    if strict and not unmatched(edges, kb).isEmpty():
        raise ValueError("an edge matches no pattern")
    m = match(edges, kb)
    mapping = F.map_from_arrays(F.array_sort("pattern_nodes"), F.array_sort("nodes"))
    return m.select("edge_id", "pattern_id", mapping.alias("node_mapping"), "I_value", "base_weight", "dir_factor", "predicate", *keep)


def rebuild(records: DataFrame, kb: DataFrame) -> DataFrame:
    """records(idx, pattern_id, node_mapping, ..) -> edges; unknown patterns drop out, of equal pattern ids the last counts."""
    w = Window.partitionBy("edge_id").orderBy(F.desc("pat_pos"))
    last = kb.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(F.col("edge_id").alias("pattern_id"), "attr_types")
    r = records.join(last, "pattern_id")
    dist = F.lit(1.0) / (F.col("I_value") + F.lit(EPSILON)) * F.col("base_weight") * F.col("dir_factor")
    return r.select(F.concat(F.lit("reabsorbed_"), "pattern_id", F.lit("_"), F.col("idx").cast("string")).alias("edge_id"), sorted_set(F.map_values("node_mapping")).alias("nodes"), "predicate", "I_value", "base_weight", "dir_factor", dist.alias("d_sem"), "attr_types")


def signature(kb: DataFrame) -> str:
    """SHA-256 of the patterns as sorted JSON, by canonical key (a bounded table, read by the driver)."""
    rows = [r.asDict() for r in kb.orderBy("pat_pos").limit(MAX_PATTERNS + 1).collect()]
    if len(rows) > MAX_PATTERNS:
        raise ValueError("too many patterns")
    rows.sort(key=lambda r: (r["predicate"], len(r["nodes"]), sorted(r["attr_types"])))
    fields = ("edge_id", "nodes", "predicate", "I_value", "base_weight", "dir_factor")
    text = [{**{f: r[f] for f in fields}, "nodes": sorted(r["nodes"]), "attr_types": sorted(r["attr_types"]), "d_sem": 0.0} for r in rows]
    return hashlib.sha256(json.dumps(text, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def verify(kb: DataFrame, expected: str) -> bool:
    return signature(kb) == expected


def attr_types_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edge_id, attr_types: the union of the attribute keys of an edge's nodes; unknown nodes add none."""
    inc = edges.select("edge_id", F.explode_outer("nodes").alias("node_id")).distinct()
    keys = inc.join(nodes.select("node_id", F.map_keys("attributes").alias("keys")), "node_id", "left").select("edge_id", F.explode_outer("keys").alias("k"))
    return keys.groupBy("edge_id").agg(F.array_sort(F.collect_set("k")).alias("attr_types"))
