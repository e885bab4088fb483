"""Mining patterns from edges, and learning them into a knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import knowledge

MIN_SUPPORT, MIN_CONFIDENCE, MOST_PATTERNS = 2, 0.3, 50


def frequent_predicates(edges: DataFrame, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, order: str = "pos", by: tuple[str, ...] = ()) -> DataFrame:
    """predicate, node_count, support, total, confidence, attr_types, sample_edges, first_pos.

    node_count is the most frequent arity (ties: the one met first); support
    counts its edges, total all edges of the predicate; attr_types are common
    to all edges of that arity; the samples are the first three edges of any.
    ``by``: mine each group by itself.
    """
    g = [*by, "predicate"]
    e = edges.select(*g, "edge_id", "attr_types", F.size("nodes").alias("node_count"), F.col(order).alias("__p"))
    sizes = e.groupBy(*g, "node_count").agg(F.count("*").alias("support"), F.min("__p").alias("first"))
    w = Window.partitionBy(*g).orderBy(F.desc("support"), F.asc("first"))
    mode = sizes.withColumn("__n", F.row_number().over(w)).withColumn("total", F.sum("support").over(Window.partitionBy(*g))).withColumn("first_pos", F.min("first").over(Window.partitionBy(*g)))
    mode = mode.filter("__n = 1").drop("__n", "first").withColumn("confidence", F.round(F.col("support") / F.col("total"), 4))
    mode = mode.filter((F.col("total") >= min_support) & (F.col("support") / F.col("total") >= min_confidence))
    # an attribute is common if as many edges have it as there are edges of the arity
    have = e.select(*g, "node_count", F.explode(F.array_distinct("attr_types")).alias("a")).groupBy(*g, "node_count", "a").agg(F.count("*").alias("n"))
    common = mode.join(have, [*g, "node_count"]).filter("n = support").groupBy(*g).agg(F.array_sort(F.collect_set("a")).alias("attr_types"))
    # the first three: a running minimum, so no list of all edges is built
    first = e.withColumn("__r", F.row_number().over(Window.partitionBy(*g).orderBy("__p"))).filter("__r <= 3")
    samples = first.groupBy(*g).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "edge_id"))), lambda s: s["edge_id"]).alias("sample_edges"))
    out = mode.join(common, g, "left").join(samples, g)
    return out.select(*g, "node_count", "support", "total", "confidence", F.coalesce("attr_types", F.array().cast("array<string>")).alias("attr_types"), "sample_edges", "first_pos")


def correlations(edges: DataFrame, min_cooccur: int = 2) -> DataFrame:
    """attr_a < attr_b, cooccur_count (predicates with both), support_ratio (of the more widespread one's)."""
    ap = edges.select("predicate", F.explode("attr_types").alias("a")).distinct()
    n = ap.groupBy("a").agg(F.count("*").alias("n"))
    both = ap.select("predicate", F.col("a").alias("attr_a")).join(ap.select("predicate", F.col("a").alias("attr_b")), "predicate").filter("attr_a < attr_b")
    c = both.groupBy("attr_a", "attr_b").agg(F.count("*").alias("cooccur_count")).filter(F.col("cooccur_count") >= min_cooccur)
    if min_cooccur <= 0:  # pairs that no predicate has together count too: attribute names are a small set
        x, y = n.select(F.col("a").alias("attr_a")), n.select(F.col("a").alias("attr_b"))
        c = x.join(y, F.col("attr_a") < F.col("attr_b")).join(c, ["attr_a", "attr_b"], "left").withColumn("cooccur_count", F.coalesce("cooccur_count", F.lit(0)))
    c = c.join(n.select(F.col("a").alias("attr_a"), F.col("n").alias("na")), "attr_a").join(n.select(F.col("a").alias("attr_b"), F.col("n").alias("nb")), "attr_b")
    return c.select("attr_a", "attr_b", "cooccur_count", F.round(F.col("cooccur_count") / F.greatest("na", "nb"), 4).alias("support_ratio"))


def to_patterns(edges: DataFrame, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, most: int = MOST_PATTERNS, order: str = "pos", by: tuple[str, ...] = ()) -> DataFrame:
    """edge_id, nodes, predicate, attr_types, confidence, i: the ``most`` best predicates as patterns.

    Numbers count predicates of one node too, which are left out.
    """
    f = frequent_predicates(edges, min_support, min_confidence, order, by)
    w = Window.partitionBy(*by).orderBy(F.desc("support"), F.desc("confidence"), F.asc("first_pos"))
    p = f.withColumn("i", F.row_number().over(w) - 1).filter((F.col("i") < most) & (F.col("node_count") >= 2))
    name = F.concat_ws("_", F.lit("auto_pat"), "predicate", F.col("node_count").cast("string"), F.col("i").cast("string"))
    nodes = F.transform(F.sequence(F.lit(0), F.col("node_count") - 1), lambda j: F.concat(F.lit("n_"), j.cast("string")))
    return p.select(*by, name.alias("edge_id"), nodes.alias("nodes"), "predicate", "attr_types", "confidence", "i")


def new_patterns(found: DataFrame, kb: DataFrame) -> DataFrame:
    """Patterns whose key the knowledge base does not have; of equal keys the first."""
    w = Window.partitionBy("predicate", F.size("nodes"), "attr_types").orderBy("i")
    one = found.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return knowledge.unmatched(one, kb)


def learn(kb: DataFrame, edges: DataFrame, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, order: str = "pos") -> DataFrame:
    """kb with the new patterns of a graph."""
    new = new_patterns(to_patterns(edges, min_support, min_confidence, order=order), kb)
    as_rows = new.select(F.col("i").cast("long").alias("pat_pos"), "edge_id", "nodes", "predicate", F.lit(1.0).alias("I_value"), F.lit(1.0).alias("base_weight"), F.lit(1.0).alias("dir_factor"), "attr_types")
    return knowledge.add(kb, as_rows)


def learn_report(kb: DataFrame, edges: DataFrame, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, order: str = "pos") -> tuple[DataFrame, dict]:
    """kb with the new patterns of a graph, and what was mined, added and skipped, with the signatures before and after."""
    found = to_patterns(edges, min_support, min_confidence, order=order)
    after = learn(kb, edges, min_support, min_confidence, order)
    mined, n, m = found.count(), kb.count(), after.count()
    sig = lambda x: knowledge.signature(x)[:16]
    return after, {"source_edges": edges.count(), "patterns_mined": mined, "patterns_before": n, "patterns_after": m, "added": m - n, "skipped_duplicates": mined - (m - n), "kb_sig_before": sig(kb), "kb_sig_after": sig(after)}


def ordered_correlations(edges: DataFrame, min_cooccur: int = 2) -> DataFrame:
    """The correlations, most frequent first."""
    return correlations(edges, min_cooccur).orderBy(F.desc("cooccur_count"), "attr_a", "attr_b")


def learn_graphs(kb: DataFrame, edges: DataFrame, graph: str, order: str = "pos") -> DataFrame:
    """kb with the new patterns of many graphs in one pass: of equal keys the first by (graph, number)."""
    found = to_patterns(edges, order=order, by=(graph,))
    w = Window.partitionBy("predicate", F.size("nodes"), "attr_types").orderBy(graph, "i")
    one = knowledge.unmatched(found.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n"), kb)
    # patterns are few: MOST_PATTERNS for each graph
    rank = Window.orderBy(graph, "i")
    rows = one.withColumn("pat_pos", (F.row_number().over(rank) - 1).cast("long"))
    return knowledge.add(kb, rows.select("pat_pos", "edge_id", "nodes", "predicate", F.lit(1.0).alias("I_value"), F.lit(1.0).alias("base_weight"), F.lit(1.0).alias("dir_factor"), "attr_types"))


def coverage(edges: DataFrame, kb: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """edges, matched, coverage for each group."""
    m = knowledge.match(edges, kb, how="left").withColumn("hit", F.col("pattern_id").isNotNull().cast("long"))
    return m.groupBy(*by).agg(F.count("*").alias("edges"), F.sum("hit").alias("matched"), F.round(F.avg(F.col("hit").cast("double")), 4).alias("coverage"))


def learning_curve(rounds: DataFrame) -> DataFrame:
    """rounds(round, patterns, coverage) -> with patterns_before, novelty and coverage_gain."""
    w = Window.orderBy("round")  # one row a round
    before = F.lag("patterns", 1, 0).over(w)
    new = F.col("patterns") - before
    return rounds.withColumn("patterns_before", before).withColumn("novelty", F.round(new / F.greatest(F.lit(1), F.col("patterns")), 4)).withColumn("coverage_gain", F.round(F.col("coverage") - F.lag("coverage", 1, 0.0).over(w), 4))
