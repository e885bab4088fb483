"""Global ranks without a single-partition sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import checkpoint

#: Steps of I_value that are counted apart to find how far down the top of a group reaches.
BAR_STEPS = 4096
#: Bars of so many groups at most are broadcast.
GROUPS = 65_536


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with ``name``: the row's place (from 0) in the total order ``order``.

    Rows are range-partitioned by the order; each partition numbers its rows,
    and the driver adds up one count for each partition. The checkpoint pins the
    ranges, which sampling may draw differently when recomputed.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = checkpoint(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    sizes = {r["__part"]: r["n"] for r in parts.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    before, at = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append((p, at))
        at += sizes.get(p, 0)
    offsets = df.sparkSession.createDataFrame(before, "__part int, __before long")
    w = Window.partitionBy("__part").orderBy(*order)
    ranked = parts.withColumn("__row", F.row_number().over(w) - 1).join(F.broadcast(offsets), "__part")
    return ranked.withColumn(name, F.col("__row") + F.col("__before")).drop("__part", "__row", "__before")


def group_rank(df: DataFrame, group: str, order: list[Column], name: str = "rank") -> DataFrame:
    """df with ``name``: the row's place (from 0) within its group, however large a group is."""
    ranked = global_rank(df, [F.asc(group), *order], "__at")
    first = ranked.groupBy(F.col(group).alias("__g")).agg(F.min("__at").alias("__first"))
    return ranked.join(first, F.col(group).eqNullSafe(F.col("__g"))).withColumn(name, F.col("__at") - F.col("__first")).drop("__at", "__first", "__g")


def _bar(counts: DataFrame, ratio: float) -> tuple[int, int]:
    """(the step down to which the top reaches, its number of rows) from counts(__step, n)."""
    counts = checkpoint(counts)
    k = max(1, int((counts.agg(F.sum("n")).first()[0] or 0) * ratio))
    few = counts.limit(int(16 * BAR_STEPS) + 1).collect()
    if len(few) <= 16 * BAR_STEPS:
        at = 0
        for r in sorted(few, key=lambda r: -r["__step"]):
            at += r["n"]
            if at >= k:
                return r["__step"], k
        return 0, k
    low, high = counts.agg(F.min("__step"), F.max("__step")).first()
    while low < high:  # the greatest step that has k rows from it on: halving, so that no number of steps matters
        middle = (low + high + 1) // 2
        above = counts.filter(F.col("__step") >= middle).agg(F.sum("n")).first()[0] or 0
        low, high = (middle, high) if above >= k else (low, middle - 1)
    return low, k


def _steps(df: DataFrame, by: str) -> DataFrame:
    """df with __step: nulls come last, NaN first, as in a descending sort."""
    step = F.when(F.col(by).isNull(), F.lit(-(1 << 62))).when(F.isnan(by), F.lit(1 << 62)).otherwise(F.floor(F.greatest(F.lit(-1e12), F.least(F.lit(1e12), F.col(by))) * BAR_STEPS))
    return df.withColumn("__step", step.cast("long"))


def _near(df: DataFrame, ratio: float, group: str, by: str) -> DataFrame:
    """The rows of df down to their group's bar, with __group, __step, __k (the size of the top), __bar and __over (the rows above the bar)."""
    d = _steps(df, by).withColumn("__group", F.col(group))
    counts = checkpoint(d.groupBy("__group", "__step").agg(F.count("*").alias("n")))
    sizes = counts.groupBy(F.col("__group").alias("__g")).agg(F.greatest(F.lit(1), F.floor(F.sum("n") * F.lit(float(ratio)))).alias("__k"))
    down = Window.partitionBy("__group").orderBy(F.desc("__step")).rowsBetween(Window.unboundedPreceding, -1)
    bars = counts.withColumn("before", F.coalesce(F.sum("n").over(down), F.lit(0))).join(sizes, F.col("__group").eqNullSafe(F.col("__g")))
    bars = checkpoint(bars.filter(F.col("before") < F.col("__k")).groupBy(F.col("__g"), F.col("__k")).agg(F.min("__step").alias("__bar"), F.max("before").alias("__over")))
    if bars.count() <= GROUPS:  # else the rows would be dealt by group
        bars = F.broadcast(bars)
    return d.join(bars, F.col("__group").eqNullSafe(F.col("__g"))).filter(F.col("__step") >= F.col("__bar")).drop("__g")


def top_by(df: DataFrame, ratio: float, order: list[Column], group: str | None = None, by: str = "I_value") -> DataFrame:
    """The first max(1, floor(rows * ratio)) rows of each group by falling ``by``, then ``order``; with ``rank`` (from 0).

    Counts by steps of ``by`` show how far down each group's top reaches; only
    the rows down to there are ordered.
    """
    if group is None:  # one bar: the steps are walked here, BAR_STEPS of them for information between 0 and 1
        d = _steps(df, by)
        bar, k = _bar(d.groupBy("__step").agg(F.count("*").alias("n")), ratio)
        return global_rank(d.filter(F.col("__step") >= bar).drop("__step"), [F.desc(by), *order]).filter(F.col("rank") < k)
    ranked = group_rank(_near(df, ratio, group, by).drop("__step", "__bar", "__over"), "__group", [F.desc(by), *order])
    return ranked.filter(F.col("rank") < F.col("__k")).drop("__group", "__k")


def top_of(df: DataFrame, ratio: float, order: list[Column], group: str, by: str = "I_value") -> DataFrame:
    """The rows of ``top_by`` without their ranks: only those at their group's bar are ordered."""
    near = _near(df, ratio, group, by)
    at = group_rank(near.filter(F.col("__step") == F.col("__bar")), "__group", [F.desc(by), *order], "__rank")
    at = at.filter(F.col("__rank") < F.col("__k") - F.col("__over")).drop("__rank")
    return near.filter(F.col("__step") > F.col("__bar")).unionByName(at).drop("__group", "__step", "__k", "__bar", "__over")
