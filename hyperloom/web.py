"""HTTP wrapper: a page at /, and POST JSON to /api/{compress, decompress, incremental-compress, incremental-decompress}."""

from __future__ import annotations

import base64
import json
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cli import one_packet, session
from .model import KAPPA, THETA
from .operators import knowledge
from .plans import compress as plans
from .sources import graphs


#: The page that shows, edits, compresses and expands a graph.
PAGE = Path(__file__).with_name("page.html")


def _graph(doc: dict) -> tuple[DataFrame, DataFrame]:
    """Nodes as a list, or as a dict by id."""
    nodes = doc.get("nodes", [])
    if isinstance(nodes, dict):
        nodes = [{"node_id": k, "attributes": v.get("attributes", v) if isinstance(v, dict) else {}} for k, v in nodes.items()]
    text = json.dumps({"nodes": nodes, "edges": doc.get("edges", [])}, ensure_ascii=False)
    n, e = graphs.from_documents(session().createDataFrame([(0, text)], "graph_id int, value string"))
    return n.drop("graph_id"), e.drop("graph_id")


def _document(nodes: DataFrame, edges: DataFrame) -> dict:
    n = nodes.withColumn("graph_id", F.lit(0))
    e = edges.withColumn("graph_id", F.lit(0)).withColumn("pos", F.monotonically_increasing_id())
    row = graphs.to_documents(n, e).first()
    return json.loads(row["value"]) if row else {"nodes": [], "edges": []}


def handle(path: str, body: dict) -> dict:
    spark = session()
    kb = knowledge.builtin(spark) if body.get("use_builtin_kb") else None
    raw = lambda k: base64.b64decode(body[k])
    text = lambda b: base64.b64encode(b).decode()
    if path == "/api/compress":
        nodes, edges = _graph(body)
        packet = one_packet(plans.Compressed(edges, kb, float(body.get("theta_dead", THETA)), float(body.get("keep_ratio", KAPPA))))
        return {"data": text(packet), "bytes": len(packet)}
    if path == "/api/decompress":
        packets = spark.createDataFrame([(0, bytearray(raw("data")))], "part int, packet binary")
        return _document(*plans.decompress(packets, kb))
    if path == "/api/incremental-compress":
        return {"data": text(plans.compress_incremental(_graph(body["old"]), _graph(body["new"])))}
    if path == "/api/incremental-decompress":
        return _document(*plans.decompress_incremental(_graph(body["old"]), raw("data"), kb))
    raise KeyError(path)


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *args) -> None:
        pass

    def _send(self, status: int, body: bytes, kind: str) -> None:
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self) -> None:
        if self.path == "/":
            self._send(200, PAGE.read_bytes(), "text/html; charset=utf-8")
        else:
            self._send(404, b"{}", "application/json")

    def do_POST(self) -> None:
        try:
            size = int(self.headers.get("Content-Length", 0))
            out, status = handle(self.path, json.loads(self.rfile.read(size) or b"{}")), 200
        except KeyError as e:
            out, status = {"error": f"not found: {e}"}, 404
        except Exception as e:  # noqa: BLE001
            out, status = {"error": str(e)[:500]}, 500
        self._send(status, json.dumps(out, ensure_ascii=False).encode(), "application/json")


def serve(host: str = "127.0.0.1", port: int = 8080) -> None:
    HTTPServer((host, port), Handler).serve_forever()
