"""URL filters by hashed host-suffix and path-prefix expressions (DataFrame functions only).

Rules are kept as SHA-256 digests of ``host + path`` and found by their first
four bytes. Every url is expanded into the expressions that a rule could hold:
its host's suffixes at label borders, with prefixes of its path, for the
(number of labels, path length) pairs that occur among the rules. The short
hash finds candidates by an equi-join, the full digest confirms them, and the
longest rule (host first, then path; block before allow) decides.

The rules are small (``MAX_RULES`` at most, checked) and so are the pairs.
Distinct (host, path) are judged once; copies of a url join back to the verdict.

Defined results: a null url or one without ``://`` has an empty host and path
and gets the default verdict; an empty host or path fits no rule that has one;
repeated rows are judged alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RULES = 1_000_000
MAX_SHAPES = 10_000


def compile_rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(verdict, host, path) -> the table of digests, and the (labels, path length) pairs in use."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    if len(shapes) > MAX_SHAPES:
        raise ValueError("the rules have too many shapes")
    rows = [(v, h.lower(), p, h.count(".") + 1, len(p)) for v, h, p in rules]
    t = spark.createDataFrame(rows, "verdict string, rule_host string, rule_path string, labels int, path_len int")
    return t.withColumn("digest", F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256)).withColumn("short", F.substring("digest", 1, 8)), shapes


def host_and_path(url) -> tuple:
    """Host and path columns of a url column, by the text alone."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict."""
    spark = pages.sparkSession
    table, shapes = compile_rules(spark, rules)
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    # one row per distinct url and shape that the url can fill
    pairs = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("path_len")) for a, b in shapes])
    exprs = urls.select("host", "path").distinct().withColumn("s", F.explode(pairs)).select("host", "path", "s.*")
    exprs = exprs.withColumn("parts", F.split("host", r"\.")).filter((F.size("parts") >= F.col("labels")) & (F.length("path") >= F.col("path_len")))
    suffix = F.array_join(F.slice("parts", F.size("parts") - F.col("labels") + 1, F.col("labels")), ".")
    exprs = exprs.withColumn("full", F.sha2(F.concat_ws("\n", suffix, F.expr("left(path, path_len)")), 256)).withColumn("short", F.substring("full", 1, 8))
    small = table.select("short", "digest", "verdict", "rule_host", "rule_path")
    # at most MAX_RULES short rows: broadcast only while they are few
    hits = exprs.join(F.broadcast(small) if len(rules) <= 50_000 else small, "short").filter(F.col("full") == F.col("digest"))
    best = F.max_by(F.struct("rule_host", "rule_path", "verdict"), F.struct(F.length("rule_host"), F.length("rule_path"), (F.col("verdict") == "block").cast("int")))
    won = hits.groupBy("host", "path").agg(best.alias("r")).select(F.col("host").alias("h"), F.col("path").alias("p"), "r")
    out = urls.join(won, (urls.host == won.h) & (urls.path == won.p), "left")
    return out.select("page_id", "host", "path", F.concat("r.rule_host", "r.rule_path").alias("rule"), F.coalesce("r.verdict", F.lit(default)).alias("verdict"))
