"""Command line: compress, decompress, batch-compress, distributed-compress, info, incremental-*, image/audio-to-graph, graph-to-image, web.

Verbs that write plain files write them from the driver, one at a time.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import codec
from .model import KAPPA, THETA
from .operators import graph, knowledge
from .plans import compress as plans
from .plans import report as reports
from .sources import graphs, media


def session() -> SparkSession:
    return SparkSession.builder.appName("hyperloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hyperloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def verb(name: str, *paths: str, kb: bool = True, stages: bool = False) -> argparse.ArgumentParser:
        v = sub.add_parser(name)
        for x in paths:
            v.add_argument(x)
        v.add_argument("--trusted", action="store_true", help="read pickles of plain containers")
        if kb:
            v.add_argument("--kb")
            v.add_argument("--use-builtin-kb", action="store_true")
        if stages:
            v.add_argument("--theta-dead", type=float, default=THETA)
            v.add_argument("--keep-ratio", type=float, default=KAPPA)
            v.add_argument("--report")
            v.add_argument("--report-format", choices=("text", "json"), default="text")
        return v

    verb("compress", "input", "output", stages=True)
    verb("decompress", "input", "output")
    verb("batch-compress", "input", "output", stages=True)
    verb("distributed-compress", "input", "output", stages=True).add_argument("--workers", type=int, default=4)
    verb("distributed-decompress", "input", "output")
    verb("info", "input", kb=False)
    verb("incremental-compress", "old", "new", "output")
    verb("incremental-decompress", "old", "delta", "output")
    verb("image-to-graph", "input", "output", kb=False)
    verb("audio-to-graph", "input", "output", kb=False)
    verb("graph-to-image", "input", "output", kb=False)
    web = verb("web", kb=False)
    web.add_argument("--host", default="127.0.0.1")
    web.add_argument("--port", type=int, default=8080)
    return p


def patterns(spark: SparkSession, args):
    """A pattern file goes before the built-in patterns."""
    if args.kb:
        return graphs.read_kb(spark, args.kb)[0]
    return knowledge.builtin(spark) if args.use_builtin_kb else None


def _whole(path: str, trusted: bool = False) -> tuple:
    spark = session()
    nodes, edges = graphs.read(spark, path, trusted)
    return spark, nodes.drop("graph_id"), edges.drop("graph_id")


def empty_packet(c: plans.Compressed) -> bytes:
    return codec.pack(codec.canonical_json({"V_star": [], "E_star": [], "theta_dead": c.theta, "kb_sig": c.sig, "pruned_summary": [], "absorb_records": []}))


def one_packet(c: plans.Compressed) -> bytes:
    row = c.packets().first()
    return empty_packet(c) if row is None else bytes(row["packet"])


def run(args: argparse.Namespace) -> int:
    spark, began = session(), time.time()
    if args.command == "compress":
        _, nodes, edges = _whole(args.input, args.trusted)
        c = plans.Compressed(edges, patterns(spark, args), args.theta_dead, args.keep_ratio)
        packet = one_packet(c)
        Path(args.output).write_bytes(packet)
        if args.report:
            source = Path(args.input)
            size = source.stat().st_size if source.is_file() else sum(f.stat().st_size for f in source.rglob("*") if f.is_file())
            r = reports.gather(c, nodes.count(), size, len(packet), began)
            Path(args.report).write_text(reports.as_json(r) if args.report_format == "json" else reports.as_text(r))
            print(reports.as_text(r))
    elif args.command == "decompress":
        packets = spark.createDataFrame([(0, bytearray(Path(args.input).read_bytes()))], "part int, packet binary")
        save(plans.decompress(packets, patterns(spark, args)), args.output)
    elif args.command == "batch-compress":
        batch(args, patterns(spark, args))
    elif args.command == "distributed-compress":
        _, nodes, edges = _whole(args.input, args.trusted)
        c = plans.Compressed(edges, patterns(spark, args), args.theta_dead, args.keep_ratio, parts=max(2, args.workers))
        write_parts(c, args, nodes.count(), edges.count())
    elif args.command == "distributed-decompress":
        files = graphs.read_packets(spark, args.input, "partition_*.esz")
        part = F.regexp_extract("path", r"partition_(\d+)\.esz$", 1).cast("int")
        save(plans.decompress(files.select(part.alias("part"), "packet"), patterns(spark, args)), args.output)
    elif args.command == "info":
        _, nodes, edges = _whole(args.input, args.trusted)
        for r in graph.describe(nodes, edges).collect():
            print(r["kind"], r["name"], r["n"])
        for r in graph.preview(edges).collect():
            print(" ", r["edge_id"], r["information"])
    elif args.command == "incremental-compress":
        Path(args.output).write_bytes(plans.compress_incremental(_whole(args.old, args.trusted)[1:], _whole(args.new, args.trusted)[1:]))
    elif args.command == "incremental-decompress":
        save(plans.decompress_incremental(_whole(args.old, args.trusted)[1:], Path(args.delta).read_bytes(), patterns(spark, args)), args.output)
    elif args.command in ("image-to-graph", "audio-to-graph"):
        nodes, edges = (media.image_graphs if args.command == "image-to-graph" else media.audio_graphs)(spark, args.input, pattern="*")
        row = graphs.to_documents(nodes, edges).first()
        Path(args.output).write_text(row["value"])
    elif args.command == "graph-to-image":
        Path(args.output).write_bytes(media.graph_image(_whole(args.input, args.trusted)[1]))
    elif args.command == "web":
        from .web import serve

        serve(args.host, args.port)
    return 0


def write_parts(c: plans.Compressed, args: argparse.Namespace, nodes: int, edges: int) -> None:
    """partition_NNN.esz for each shard, empty ones too, and distributed_summary.json."""
    out = Path(args.output)
    out.mkdir(parents=True, exist_ok=True)
    sizes = {}
    for r in c.packets().select("part", "packet").toLocalIterator():
        path = out / f"partition_{r['part']:03d}.esz"
        path.write_bytes(r["packet"])
        sizes[r["part"]] = len(r["packet"])
    rows = []
    for k in range(max(2, args.workers)):
        path = out / f"partition_{k:03d}.esz"
        if k not in sizes:
            path.write_bytes(empty_packet(c))
        rows.append({"index": k, "path": str(path), "size_bytes": path.stat().st_size})
    summary = {"input": args.input, "n_workers": args.workers, "n_partitions": len(rows), "total_original_nodes": nodes, "total_original_edges": edges, "partitions": rows}
    (out / "distributed_summary.json").write_text(json.dumps(summary, indent=2))


def save(graph_tables: tuple, path: str) -> None:
    """One file for a graph that one packet held."""
    nodes, edges = graph_tables
    n, e = nodes.withColumn("graph_id", F.lit(0)), edges.withColumn("graph_id", F.lit(0)).withColumn("pos", F.row_number().over(_by_id()) - 1)
    row = graphs.to_documents(n, e).first()
    Path(path).write_text(row["value"] if row else '{"nodes": [], "edges": []}')


def _by_id():
    from pyspark.sql import Window

    return Window.orderBy("edge_id")


def batch(args: argparse.Namespace, kb) -> None:
    """Every graph file of a folder to a packet beside its name, all in one run; a bad file is reported and passed over."""
    spark, root, out = session(), Path(args.input).resolve(), Path(args.output)
    docs = graphs.read_files(spark, str(root), args.trusted)
    good, bad = docs.filter("error is null").select("graph_id", "value", "bytes"), docs.filter("error is not null")
    edges = graphs.from_documents(good.select("graph_id", "value"))[1]
    c = plans.Compressed(edges, kb, args.theta_dead, args.keep_ratio, group="graph_id", order=("graph_id", "pos"))
    local = lambda uri: Path(unquote(urlparse(uri).path))
    sizes = {}
    for r in c.packets().select("part", "packet").toLocalIterator():
        to = (out / local(r["part"]).relative_to(root)).with_suffix(".esz")
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_bytes(r["packet"])
        sizes[r["part"]] = len(r["packet"])
    found = {r["graph_id"]: r for r in c.report().collect()}
    files = []
    for r in good.select("graph_id", "bytes").collect():
        name = local(r["graph_id"]).relative_to(root)
        if r["graph_id"] not in sizes:  # a graph without edges
            to = (out / name).with_suffix(".esz")
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(empty_packet(c))
            sizes[r["graph_id"]] = to.stat().st_size
        own = found.get(r["graph_id"])
        files.append({"input": str(name), "output": str(name.with_suffix(".esz")), "original_bytes": r["bytes"], "compressed_bytes": sizes[r["graph_id"]], "original_edges": own["original_edges"] if own else 0, "compressed_edges": own["compressed_edges"] if own else 0, "scr_anchor": own["scr_anchor"] if own else 0.0, "success": True})
    files += [{"input": str(local(r["graph_id"]).relative_to(root)), "success": False, "error": r["error"]} for r in bad.select("graph_id", "error").collect()]
    ok = [f for f in files if f["success"]]
    total = {"total_files": len(files), "failed": len(files) - len(ok)} | {f"total_{k}": sum(f[k] for f in ok) for k in ("original_bytes", "compressed_bytes", "original_edges", "compressed_edges")}
    total["overall_scr"] = total["total_original_edges"] / total["total_compressed_edges"] if total["total_compressed_edges"] else 0.0
    total["overall_bit_ratio"] = total["total_original_bytes"] / total["total_compressed_bytes"] if total["total_compressed_bytes"] else 0.0
    out.mkdir(parents=True, exist_ok=True)
    report = {"input_dir": str(root), "output_dir": str(out), "files": sorted(files, key=lambda f: f["input"]), "summary": total}
    (out / "batch_report.json").write_text(json.dumps(report, ensure_ascii=False, indent=2))
    print(f"{len(ok)} of {len(files)} files; overall ratio {total['overall_scr']:.2f}x")


def main(argv: list[str] | None = None) -> int:
    return run(parser().parse_args(argv))


if __name__ == "__main__":
    sys.exit(main())
