"""Reading and writing graphs, triples and packets."""

from __future__ import annotations

import io
import json
import pickle
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EDGE_COLUMNS, sorted_set, with_defaults
from ..operators.graph import last_wins


def from_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(graph_id, value: the JSON text of a graph) -> nodes, edges with graph_id and pos.

    Attribute values stay JSON text, so 1 and "1" differ. Missing keys are empty
    lists, missing fields take their defaults, of equal node ids the last counts.
    """
    node_list = F.from_json(F.get_json_object("value", "$.nodes"), "array<struct<node_id: string, attributes: string>>")
    raw = docs.select("graph_id", F.posexplode(F.coalesce(node_list, F.array().cast("array<struct<node_id: string, attributes: string>>"))).alias("pos", "n"))
    nodes = raw.select("graph_id", "n.node_id", json_object(F.col("n.attributes")).alias("attributes"), "pos")
    nodes = last_wins(nodes.withColumn("__k", F.struct("graph_id", "node_id")), "__k", "pos").drop("__k", "pos")
    edge = "array<struct<edge_id: string, nodes: array<string>, predicate: string, I_value: string, base_weight: string, dir_factor: string, d_sem: string, attr_types: array<string>>>"
    edge_list = F.from_json(F.get_json_object("value", "$.edges"), edge)
    edges = docs.select("graph_id", F.posexplode(F.coalesce(edge_list, F.array().cast(edge))).alias("pos", "e")).select("graph_id", "pos", "e.*")
    return nodes, with_defaults(edges)


def json_object(text):
    """A JSON object's text as a map of JSON texts."""
    @F.pandas_udf("map<string, string>")
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda s: {k: json.dumps(v, ensure_ascii=False, sort_keys=True) for k, v in json.loads(s).items()} if s else {})

    return run(text)


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A graph file, or a folder of them read recursively: one graph for each file."""
    docs = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return from_documents(docs.select(F.col("_metadata.file_path").alias("graph_id"), "value"))


def to_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, value: each graph as JSON, nodes by id and edges by pos."""
    fields = F.struct(*[F.col(c) for c in EDGE_COLUMNS])
    e = edges.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", fields.alias("e")))), lambda x: x["e"]).alias("edges"))

    @F.pandas_udf("string")
    def text(n: pd.Series, e: pd.Series) -> pd.Series:
        def one(ns, es):
            ns = [] if ns is None else [json.loads(x) for x in ns]
            return json.dumps({"nodes": ns, "edges": [] if es is None else [json.loads(x) for x in es]}, ensure_ascii=False, indent=2)

        return pd.Series([one(a, b) for a, b in zip(n, e, strict=True)])

    @F.pandas_udf("string")
    def attributes(keys: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([json.dumps({k: json.loads(v) for k, v in zip(ks, vs, strict=True)}, ensure_ascii=False) for ks, vs in zip(keys, values, strict=True)])

    flat = nodes.select("graph_id", "node_id", attributes(F.map_keys("attributes"), F.map_values("attributes")).alias("a"))
    n = flat.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "a"))), lambda x: F.concat(F.lit('{"node_id": '), F.to_json(F.array(x["node_id"])).substr(F.lit(2), F.length(F.to_json(F.array(x["node_id"]))) - 2), F.lit(', "attributes": '), x["a"], F.lit("}"))).alias("nodes"))
    e = e.select("graph_id", F.transform("edges", lambda x: F.to_json(x)).alias("edges"))
    return n.join(e, "graph_id", "full_outer").select("graph_id", text("nodes", "edges").alias("value"))


def write_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    to_documents(nodes, edges).select("value").write.mode("overwrite").text(path, lineSep="\n")


def read_parquet(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_parquet(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


class _Plain(pickle.Unpickler):
    """Reads plain containers only: a pickle that names any class or function is refused."""

    def find_class(self, module, name):
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed")


def read_pickle(spark: SparkSession, path: str, trusted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Legacy pickles of plain graph dicts. Off unless ``trusted``; even then only plain containers are read."""
    if not trusted:
        raise ValueError("pickle files are read only with trusted=True")

    @F.pandas_udf("string")
    def text(col: pd.Series) -> pd.Series:
        return col.map(lambda b: json.dumps(_Plain(io.BytesIO(b)).load(), ensure_ascii=False))

    files = spark.read.format("binaryFile").load(path)
    return from_documents(files.select(F.col("path").alias("graph_id"), text("content").alias("value")))


def write_pickle(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph of one document's size as a pickle of plain containers."""
    row = to_documents(nodes.withColumn("graph_id", F.lit(0)), edges.withColumn("graph_id", F.lit(0))).first()
    with open(path, "wb") as f:
        pickle.dump(json.loads(row["value"]) if row else {"nodes": [], "edges": []}, f)


def read_files(spark: SparkSession, path: str, trusted: bool = False) -> DataFrame:
    """graph_id (the file), value (its JSON text), bytes, error: every .json and .pickle below a folder; one that is no graph says why."""
    def one(name: str, raw: bytes) -> str:
        if name.endswith(".json"):
            doc = json.loads(raw)
        elif trusted:
            doc = _Plain(io.BytesIO(raw)).load()
        else:
            raise ValueError("pickle files are read only if trusted")
        if not isinstance(doc, dict) or not all(isinstance(doc.get(k, []), list) for k in ("nodes", "edges")):
            raise ValueError("no graph")
        if not all(isinstance(x, dict) and isinstance(x.get(i), str) for k, i in (("nodes", "node_id"), ("edges", "edge_id")) for x in doc.get(k, [])):
            raise ValueError("a node or edge without an id")
        return json.dumps(doc, ensure_ascii=False)

    @F.pandas_udf("struct<value: string, error: string>")
    def opened(names: pd.Series, raws: pd.Series) -> pd.DataFrame:
        out = []
        for name, raw in zip(names, raws, strict=True):
            try:
                out.append((one(name, bytes(raw)), None))
            except Exception as e:  # noqa: BLE001
                out.append((None, f"{type(e).__name__}: {e}"[:300]))
        return pd.DataFrame(out, columns=["value", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,pickle}").load(path)
    o = files.select(F.col("path").alias("graph_id"), F.col("length").alias("bytes"), opened("path", "content").alias("o"))
    return o.select("graph_id", "bytes", "o.value", "o.error")


READERS: dict[str, Callable] = {".json": read_json, ".parquet": read_parquet}


def read(spark: SparkSession, path: str, trusted: bool = False) -> tuple[DataFrame, DataFrame]:
    """By suffix: .json, .parquet, else pickle."""
    for suffix, reader in READERS.items():
        if path.endswith(suffix):
            return reader(spark, path)
    return read_pickle(spark, path, trusted)


def parse_ntriples(lines: DataFrame) -> DataFrame:
    """lines(value) -> s, p, o. Blank and # lines are skipped; a triple has four tokens at least, the last a full stop."""
    t = lines.select(F.trim("value").alias("v")).filter((F.col("v") != "") & ~F.col("v").startswith("#"))
    t = t.select(F.split("v", r"\s+").alias("t")).filter((F.size("t") >= 4) & (F.element_at("t", -1) == "."))
    part = lambda k: F.regexp_replace(F.col("t")[k], "^[<>]+|[<>]+$", "")
    return t.select(part(0).alias("s"), part(1).alias("p"), part(2).alias("o"))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_ntriples(spark.read.text(path))


def triples_to_graph(triples: DataFrame, name: str = "kg") -> tuple[DataFrame, DataFrame]:
    """triples(s, p, o) -> nodes (type entity) and edges; a triple from a node to itself has one member."""
    edges = triples.select(F.concat_ws(":", F.lit(name), F.lit("edge"), "s", "p", "o").alias("edge_id"), sorted_set(F.array("s", "o")).alias("nodes"), F.col("p").alias("predicate"), F.lit(1.0).alias("I_value"))
    nodes = triples.select(F.col("s").alias("node_id")).union(triples.select("o")).distinct()
    return nodes.withColumn("attributes", F.create_map(F.lit("type"), F.lit('"entity"'))), with_defaults(edges)


def read_packets(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, packet of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("content").alias("packet"))


def write_packets(packets: DataFrame, path: str) -> None:
    """packets(part or graph_id, packet) as Parquet."""
    packets.write.mode("overwrite").parquet(path)


def read_kb(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """Patterns and their stored signature, from {"patterns": [..], "sig": ..}."""
    from ..operators.knowledge import PATTERN

    from ..operators.knowledge import MAX_PATTERNS

    doc = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    if len(doc.get("patterns", [])) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns")
    rows = [(k, p["edge_id"], sorted(p.get("nodes", [])), p.get("predicate", ""), float(p.get("I_value", 0)), float(p.get("base_weight", 1)), float(p.get("dir_factor", 1)), sorted(p.get("attr_types", []))) for k, p in enumerate(doc.get("patterns", []))]
    return spark.createDataFrame(rows, PATTERN), doc.get("sig", "")


def write_kb(kb: DataFrame, path: str) -> None:
    from ..operators.knowledge import signature

    from ..operators.knowledge import checked

    rows = [{k: v for k, v in r.asDict().items() if k != "pat_pos"} for r in checked(kb).orderBy("pat_pos").collect()]
    text = json.dumps({"patterns": rows, "sig": signature(kb)}, ensure_ascii=False)
    kb.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

