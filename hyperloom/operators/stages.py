"""The stages before selection: pruning, absorbing, weighting; and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import EPSILON, THETA
from . import knowledge


def alive(theta: float = THETA) -> Column:
    """True if the edge's information reaches theta; NaN and null do not."""
    # two conjuncts, so that the range reaches the scan's statistics
    return (F.col("I_value") >= theta) & F.coalesce(~F.isnan("I_value"), F.lit(False))


def prune(edges: DataFrame, theta: float = THETA) -> DataFrame:
    return edges.filter(alive(theta))


def pruned_summary(edges: DataFrame, theta: float = THETA) -> DataFrame:
    return edges.filter(~F.coalesce(alive(theta), F.lit(False))).select("edge_id", "I_value", "predicate", "nodes")


def d_sem() -> Column:
    """Semantic distance of an edge; the order of operations is part of the result."""
    return F.lit(1.0) / (F.col("I_value") + F.lit(EPSILON)) * F.col("base_weight") * F.col("dir_factor")


def weigh(edges: DataFrame) -> DataFrame:
    return edges.withColumn("d_sem", d_sem())


def distance_range(weighted: DataFrame) -> DataFrame:
    """min_d_sem and max_d_sem, 0 if there are no edges."""
    return weighted.agg(F.coalesce(F.min("d_sem"), F.lit(0.0)).alias("min_d_sem"), F.coalesce(F.max("d_sem"), F.lit(0.0)).alias("max_d_sem"))


def stage_counts(edges: DataFrame, patterns: DataFrame, theta: float = THETA) -> DataFrame:
    """stage_name, input_count, output_count of the first three stages, in one pass over the edges."""
    matched = knowledge.match(edges.withColumn("__alive", F.coalesce(alive(theta), F.lit(False))), patterns, keep=("__alive",), how="left")
    one = matched.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.col("__alive").cast("long")), F.lit(0)).alias("kept"),
        F.coalesce(F.sum((F.col("__alive") & F.col("pattern_id").isNull()).cast("long")), F.lit(0)).alias("merged"),
    )
    stage = lambda name, a, b: F.struct(F.lit(name).alias("stage_name"), F.col(a).alias("input_count"), F.col(b).alias("output_count"))
    rows = F.array(stage("dead_zero_prune", "n", "kept"), stage("isomorphism_merge", "kept", "merged"), stage("weighting", "merged", "merged"))
    return one.select(F.explode(rows).alias("s")).select("s.*")


def compression_ratios(row: DataFrame) -> DataFrame:
    """original_edges, compressed_edges, reused_edges, original_bytes, compressed_bytes -> scr_anchor, scr_info, bit_ratio (0 for an empty denominator)."""
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(F.col(a).cast("double") / b)
    c = F.col("compressed_edges")
    return row.withColumn("scr_anchor", ratio("original_edges", c)).withColumn("scr_info", ratio("original_edges", c + F.col("reused_edges"))).withColumn("bit_ratio", ratio("original_bytes", F.col("compressed_bytes")))
