"""Streaming forms of the stages that need no whole graph."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import THETA, shared_folder, sorted_set
from ..operators import knowledge, mining, stages


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a Parquet table's files: of a folder's, or of one file in its folder."""
    table = spark.read.parquet(path)
    folder, name = path.rstrip("/").rsplit("/", 1)
    one = [f for f in table.inputFiles() if f.rsplit("/", 1)[1] == name]
    s = spark.readStream.schema(table.schema).option("recursiveFileLookup", True)
    return s.option("pathGlobFilter", name).parquet(folder) if one else s.parquet(path)


def drain(rows: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that its sources hold now; what it wrote, as a table in the shared folder.

    ``append``: the rows of all micro-batches, each written under its number, so
    that one that runs again replaces itself. ``complete``: the last one's.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # an empty first part gives the table a schema even if nothing comes
    spark.createDataFrame([], rows.schema).write.parquet(f"{folder}/out/batch=-1")
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        last[:] = [number]

    q = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(rows.schema).parquet(*([f"{folder}/out/batch={last[0]}"] if mode == "complete" and last else [f"{folder}/out/batch={n}" for n in range(-1, (last[0] if last else -1) + 1)]))
    return out


def prune_and_weigh(edges: DataFrame, theta: float = THETA) -> DataFrame:
    """Stateless: the edges of a stream that stay, weighted."""
    return stages.weigh(stages.prune(edges, theta))


def absorb(edges: DataFrame, kb: DataFrame) -> DataFrame:
    """Stateless: a stream against the (static, small) pattern table."""
    return knowledge.match(edges, kb, how="left")


def first_seen(edges: DataFrame, ts: str, delay: str = "10 minutes") -> DataFrame:
    """Each edge_id once within the watermark."""
    return edges.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["edge_id"])


def windowed_edges(events: DataFrame, ts: str = "ts", key: str = "user_id", member: str = "event_id", length: str = "1 day", delay: str = "1 day", least: int = 2) -> DataFrame:
    """An edge over each key's members of a time window, when the watermark has passed it."""
    g = events.withWatermark(ts, delay).groupBy(F.window(ts, length).alias("w"), F.col(key))
    g = g.agg(F.collect_set(F.col(member).cast("string")).alias("m"), F.avg("value").alias("I_value"))
    edge_id = F.concat_ws(":", F.lit("win"), F.col(key).cast("string"), F.unix_timestamp("w.start").cast("string"))
    return g.select(edge_id.alias("edge_id"), sorted_set("m").alias("nodes"), "I_value", F.lit("co_occurs").alias("predicate")).filter(F.size("nodes") >= least)


def learn(edges: DataFrame, kb_path: str, kb: DataFrame, checkpoint: str) -> StreamingQuery:
    """Learn every micro-batch's patterns into a table: version n of the knowledge base is in kb_path/n."""
    spark = kb.sparkSession
    kb.write.mode("overwrite").parquet(f"{kb_path}/0")

    def step(batch: DataFrame, epoch: int) -> None:
        # a batch that runs again writes the same version again
        now = spark.read.parquet(f"{kb_path}/{epoch}")
        mining.learn(now, batch).write.mode("overwrite").parquet(f"{kb_path}/{epoch + 1}")

    return edges.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()
