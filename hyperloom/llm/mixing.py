"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Slot k of the schedule draws the golden-ratio point frac((k + 1) * phi); the
cumulative target shares map it to a source, and its rank among the slots of
that source picks the next of the source's equal-token blocks. A source's
blocks are the runs of ``block`` tokens of its documents laid end to end in
hash order, so block b is drawn in epoch 0 before any block is drawn in epoch 1.

Ranks and offsets are two-level prefix sums (within chunks, and over chunk
totals), so that a source with a third of all rows is spread over many tasks.
Only sums over chunks of one source meet in one task: 1,024 chunks of documents,
and one row per 65,536 slots.

Defined results: null and blank texts have size 0 and are never taken; a null
source is a source like any other, the last in order; repeated rows are rows of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Tokens of a block.
BLOCK = 64
#: No document and no source is taken more often than this.
MOST = 3
WEIGHTS = (5, 2, 1)
DOC_CHUNKS = 1024
SLOT_CHUNK = 65536
GRID = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Source, source_size, target: shares of all sizes by weight, at most ``most`` times a source's size.

    The excess over a cap is reshared by weight. A source is capped exactly if,
    in ascending order of cap per weight, the level that the sources from it on
    would share is above its cap per weight; so one ordered pass replaces the
    rounds. ``sizes`` has one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    n = len(weights)
    s = sizes.withColumn("i", F.row_number().over(order) - 1)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("i") % n + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("per", F.col("cap") / F.col("w"))
    up = Window.orderBy("per", "i")
    s = (
        s.withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_from", F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("w_from"))
    )
    # the first source whose level is not above its cap per weight sets the level of all from there on
    s = s.withColumn("final", F.min(F.when(F.col("level") <= F.col("per"), F.struct("per", "i", "level"))).over(Window.partitionBy()))
    t = F.when(F.col("final").isNotNull() & (F.struct("per", "i") >= F.struct("final.per", "final.i")), F.col("w") * F.col("final.level")).otherwise(F.col("cap"))
    return s.select("source", "i", "source_size", F.least(t, F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, size, source_size, target, taken."""
    d = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    # the hash order of documents is their shuffle; ties and repeated rows are numbered within a chunk
    h = F.xxhash64("doc_id", "source", F.lit(17))
    d = d.withColumn("h", h).withColumn("chunk", F.shiftrightunsigned("h", 54).cast("int"))
    d = cut(d)
    src = cut(targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    blocks = F.ceil(F.col("source_size") / block)

    # where each document starts among its source's tokens
    chunks = d.groupBy("source", "chunk").agg(F.sum("size").alias("chunk_size"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("chunk_at", F.coalesce(F.sum("chunk_size").over(before), F.lit(0)))
    chunks = chunks.join(src, chunks.source.eqNullSafe(src.source)).select(chunks.source.alias("cs"), F.col("chunk").alias("cc"), "chunk_at", "i", "source_size", "target")
    within = Window.partitionBy("source", "chunk").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0))).withColumn("row", F.monotonically_increasing_id())
    d = d.join(chunks, d.source.eqNullSafe(F.col("cs")) & (F.col("chunk") == F.col("cc"))).withColumn("at", F.col("at") + F.col("chunk_at"))
    d = cut(d.select("row", "doc_id", "size", "i", "source_size", "target", "at"))

    # the schedule
    spark = docs.sparkSession
    shares = src.filter("target > 0").select("i", "target", blocks.alias("blocks"), F.sum("target").over(Window.orderBy("i")).alias("hi"), F.sum("target").over(Window.partitionBy()).alias("all"))
    shares = shares.withColumn("lo", (F.col("hi") - F.col("target")) / F.col("all")).withColumn("hi", F.col("hi") / F.col("all"))
    cells = shares.select("i", "blocks", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * GRID).cast("int"), F.least(F.floor(F.col("hi") * GRID), F.lit(GRID - 1)).cast("int"))).alias("cell"))
    total = src.agg(F.sum("target")).first()[0] or 0.0
    n_slots = int(-(-total // block))
    point = F.pmod((F.col("id") + 1).cast("decimal(20,0)") * F.lit(6180339887498949).cast("decimal(17,0)"), F.lit(10**16).cast("decimal(18,0)")).cast("double") / 1e16
    slots = spark.range(n_slots).withColumn("u", point).withColumn("cell", F.least(F.floor(F.col("u") * GRID), F.lit(GRID - 1)).cast("int"))
    slots = cut(slots.join(cells, "cell").filter("u >= lo and (u < hi or hi >= 1)").select("id", "i", "blocks", F.floor(F.col("id") / SLOT_CHUNK).alias("c")))
    per = slots.groupBy("i", "c").agg(F.count("*").alias("n")).withColumn("rank_at", F.coalesce(F.sum("n").over(Window.partitionBy("i").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    slots = slots.withColumn("r", F.row_number().over(Window.partitionBy("i", "c").orderBy("id")) - 1).join(per.select("i", "c", "rank_at"), ["i", "c"])
    rank = F.col("r") + F.col("rank_at")
    drawn = slots.filter(rank < F.col("blocks") * most).groupBy("i", (rank % F.col("blocks")).alias("b")).agg(F.count("*").alias("times"))

    # each document's share of the drawn blocks
    parts = d.filter("size > 0").select("row", "i", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("b"))
    overlap = F.least(F.col("at") + F.col("size"), (F.col("b") + 1) * block) - F.greatest(F.col("at"), F.col("b") * block)
    taken = parts.join(drawn, ["i", "b"]).groupBy("row").agg(F.sum(overlap * F.col("times")).alias("taken"))
    out = d.join(taken, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def repeat(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """Each row of docs as often as the mix takes it, taken / size to the nearest whole number.

    Blank texts are never taken; rows of one doc_id are taken equally often.
    """
    by = mix(docs, weights, block, most).groupBy("doc_id").agg(F.sum("taken").alias("t"), F.sum("size").alias("s"))
    times = F.floor(F.col("t") / F.greatest("s", F.lit(1)) + 0.5).cast("int")
    by = by.select(F.col("doc_id").alias("__id"), times.alias("__times")).filter("__times > 0")
    out = docs.join(by, docs.doc_id.eqNullSafe(F.col("__id")))
    return out.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)
