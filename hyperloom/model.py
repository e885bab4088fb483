"""The data model: nodes and hyperedges as DataFrames.

An edge is (edge_id, nodes, I_value, base_weight, dir_factor, predicate,
attr_types); ``nodes`` and ``attr_types`` are sorted sets. Where list order
matters there is a ``pos`` column, or an order given by the caller.
A node is (node_id, attributes): attribute values are canonical JSON text.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Defaults and limits of the data model
THETA, KAPPA = 0.45, 0.15
EPSILON = 1e-9
PASSES = 10

EDGE = T.StructType(
    [
        T.StructField("edge_id", T.StringType()),
        T.StructField("nodes", T.ArrayType(T.StringType())),
        T.StructField("predicate", T.StringType()),
        T.StructField("I_value", T.DoubleType()),
        T.StructField("base_weight", T.DoubleType()),
        T.StructField("dir_factor", T.DoubleType()),
        T.StructField("d_sem", T.DoubleType()),
        T.StructField("attr_types", T.ArrayType(T.StringType())),
    ]
)
NODE = T.StructType([T.StructField("node_id", T.StringType()), T.StructField("attributes", T.MapType(T.StringType(), T.StringType()))])
GRAPH = T.StructType([T.StructField("nodes", T.ArrayType(NODE)), T.StructField("edges", T.ArrayType(EDGE))])
EDGE_COLUMNS = [f.name for f in EDGE]


def sorted_set(col: Column | str) -> Column:
    return F.array_sort(F.array_distinct(col))


def with_defaults(edges: DataFrame) -> DataFrame:
    """Fill the fields that an edge may leave out, and make its sets sorted sets."""
    have = set(edges.columns)
    none = F.lit(None)
    get = lambda c, kind, default: F.coalesce((F.col(c) if c in have else none).cast(kind), default).alias(c)
    empty = F.array().cast("array<string>")
    cols = [
        F.col("edge_id"),
        sorted_set(get("nodes", "array<string>", empty)).alias("nodes"),
        get("predicate", "string", F.lit("")),
        get("I_value", "double", F.lit(0.0)),
        get("base_weight", "double", F.lit(1.0)),
        get("dir_factor", "double", F.lit(1.0)),
        get("d_sem", "double", F.lit(0.0)),
        sorted_set(get("attr_types", "array<string>", empty)).alias("attr_types"),
    ]
    return edges.select(*cols, *[c for c in edges.columns if c not in EDGE_COLUMNS])


def incidence(edges: DataFrame, *keep: str) -> DataFrame:
    """edge_id, node_id (and the columns ``keep``): a row for each member of an edge."""
    return edges.select("edge_id", *keep, F.explode("nodes").alias("node_id"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder that the cluster shares (spark.checkpoint.dir)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> str:
    """Write df as Parquet, packed, into the cluster's shared folder; the path, which ``remove`` takes. The shuffle files that made it go at once."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all of the cluster shares: spark.checkpoint.dir. An own one is made only on one machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if named is None and not (sc.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loom-checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()
