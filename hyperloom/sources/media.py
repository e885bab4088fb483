"""Images and sound as graphs, and graphs as images.

Files are read as binary rows and decoded in the workers: WAV (16 bits) by the
standard library, PNG (8 bits, not interlaced) and PPM here, all else by Pillow
where it is installed. A file that can't be decoded becomes a graph of one node
that says why. An image beyond the greatest number of patches is shrunk by
averaging whole blocks of pixels.
"""

from __future__ import annotations

import io
import json
import struct
import wave
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entropy
from ..model import with_defaults
from ..operators import features

PNG = b"\x89PNG\r\n\x1a\n"


def decode_wav(raw: bytes) -> np.ndarray:
    """The first channel's samples."""
    with wave.open(io.BytesIO(raw), "rb") as f:
        if f.getsampwidth() != 2:
            raise ValueError(f"{8 * f.getsampwidth()} bits a sample; only 16 are read")
        return np.frombuffer(f.readframes(f.getnframes()), "<i2")[:: f.getnchannels()].astype(np.int64)


def encode_wav(samples: np.ndarray, rate: int = 8000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()


def encode_png(pixels: np.ndarray) -> bytes:
    """Pixels (height x width x 3, 8 bits) as a PNG."""
    h, w, _ = pixels.shape
    lines = np.concatenate((np.zeros((h, 1), np.uint8), np.asarray(pixels, np.uint8).reshape(h, -1)), axis=1)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def _png(raw: bytes) -> np.ndarray:
    at, body, palette = 8, b"", np.zeros((0, 3), np.uint8)
    w = h = depth = kind = laced = 0
    while at + 8 <= len(raw):
        size, name = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        data = raw[at + 8 : at + 8 + size]
        if name == b"IHDR":
            w, h, depth, kind, _, _, laced = struct.unpack(">IIBBBBB", data)
        elif name == b"PLTE":
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body += data
        at += 12 + size
    planes = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind, 0)
    if depth != 8 or laced or not planes:
        raise ValueError("only PNG files of 8 bits that are not interlaced are read without Pillow")
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * planes)
    out = np.zeros((h, w * planes), np.int64)
    for y in range(h):
        way, line, up = int(lines[y, 0]), lines[y, 1:].astype(np.int64), out[y - 1] if y else np.zeros(w * planes, np.int64)
        if way == 0:
            out[y] = line
        elif way == 1:  # a running sum for each plane
            out[y] = np.cumsum(line.reshape(w, planes), axis=0).reshape(-1) & 255
        elif way == 2:
            out[y] = (line + up) & 255
        else:  # each pixel needs the one before it
            for x in range(w * planes):
                a = int(out[y, x - planes]) if x >= planes else 0
                b, c = int(up[x]), int(up[x - planes]) if x >= planes else 0
                if way == 3:
                    guess = (a + b) // 2
                else:
                    near = a + b - c
                    guess = min(((abs(near - v), k, v) for k, v in enumerate((a, b, c))))[2]
                out[y, x] = (line[x] + guess) & 255
    px = out.reshape(h, w, planes).astype(np.uint8)
    return palette[px[:, :, 0]] if kind == 3 else np.repeat(px[:, :, :1], 3, axis=2) if planes < 3 else px[:, :, :3]


def _ppm(raw: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at)
            continue
        end = at
        while raw[end : end + 1].isdigit():
            end += 1
        fields.append(int(raw[at:end]))
        at = end
    w, h, top = fields
    if top != 255:
        raise ValueError("only PPM files of 8 bits are read")
    return np.frombuffer(raw[at + 1 : at + 1 + 3 * w * h], np.uint8).reshape(h, w, 3)


def decode_image(raw: bytes) -> np.ndarray:
    """Pixels, height x width x 3, 8 bits."""
    if raw[:8] == PNG:
        return _png(raw)
    if raw[:2] == b"P6":
        return _ppm(raw)
    try:
        from PIL import Image
    except ImportError:
        raise ValueError("neither PNG nor PPM, and Pillow is not installed") from None
    return np.asarray(Image.open(io.BytesIO(raw)).convert("RGB"))


def shrink(pixels: np.ndarray, most: int) -> np.ndarray:
    """Pixels averaged over whole blocks, so that neither side is beyond ``most``."""
    k = max(1, -(-max(pixels.shape[:2]) // most))
    if k == 1:
        return pixels
    h, w = (max(1, n // k) for n in pixels.shape[:2])
    p = pixels[: h * k, : w * k] if min(pixels.shape[:2]) >= k else pixels
    rows = np.add.reduceat(p.astype(np.int64), np.arange(0, p.shape[0], k)[:h], axis=0)
    both = np.add.reduceat(rows, np.arange(0, p.shape[1], k)[:w], axis=1)
    area = np.outer(np.diff(np.append(np.arange(0, p.shape[0], k)[:h], p.shape[0])), np.diff(np.append(np.arange(0, p.shape[1], k)[:w], p.shape[1])))
    return (both // area[:, :, None]).astype(np.uint8)


def patch_means(pixels: np.ndarray, size: int = 16, most: int = 256) -> list[tuple[int, int, int, int, int]]:
    """(px, py, r, g, b) of each patch, row by row, ``most`` at most; an image below a patch is one."""
    p = shrink(pixels, int(most**0.5) * size)
    h, w = p.shape[:2]
    out = [(x, y, *(int(v) for v in p[y * size : (y + 1) * size, x * size : (x + 1) * size].reshape(-1, 3).mean(axis=0))) for y in range(max(1, h // size)) for x in range(max(1, w // size))]
    return out[:most]


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("graph_id"), "content")


def _decoded(files: DataFrame, one: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    """files(graph_id, content) -> graph_id, error, and the rows that ``one`` gives; a row of nulls with the error else."""
    names = ["graph_id", "error", *(c.split()[0] for c in schema.split(", "))]
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    types = [pa.string(), pa.string(), *(kinds[c.split()[1]] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for graph, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = [(graph, None, *r) for r in one(raw.as_py())]
                except Exception as e:  # noqa: BLE001
                    rows = [(graph, f"{type(e).__name__}: {e}"[:300], *[None] * (len(names) - 2))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return files.mapInArrow(run, f"graph_id string, error string, {schema}")


def _text(**values) -> F.Column:
    """Attributes as a map of JSON texts."""
    entries = [x for k, v in values.items() for x in (F.lit(k), v)]
    return F.create_map(*entries)


def _quoted(c) -> F.Column:
    t = F.to_json(F.array(c))
    return t.substr(F.lit(2), F.length(t) - 2)


def image_graphs(spark: SparkSession, path: str, size: int = 16, most: int = 256, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """Image files -> nodes, edges with graph_id: a node for each patch, an edge for each with its neighbours."""
    rows = _decoded(_files(spark, path, pattern), lambda raw: patch_means(decode_image(raw), size, most), "px int, py int, r int, g int, b int")
    cells, bad = rows.filter("error is null"), rows.filter("error is not null")
    name = F.concat(F.lit("patch:"), F.col("px").cast("string"), F.lit("_"), F.col("py").cast("string"))
    number = lambda c: c.cast("string")
    color = F.lower(F.lpad(F.hex(F.shiftleft("r", 16).bitwiseOR(F.shiftleft("g", 8)).bitwiseOR(F.col("b"))), 6, "0"))
    attrs = _text(type=F.lit('"image_patch"'), px=number(F.col("px")), py=number(F.col("py")), avg_color=_quoted(color), x0=number(F.col("px") * size), y0=number(F.col("py") * size))
    nodes = cells.select("graph_id", name.alias("node_id"), attrs.alias("attributes")).union(_bad_nodes(bad, "image"))
    e = features.grid_edges(cells, by=("graph_id",), sep="_")
    info = F.least(F.lit(1.0), F.lit(0.7) + entropy.stable_bucket(F.concat(F.lit("patch:"), F.col("px").cast("string"), F.lit("_"), F.col("py").cast("string")), 30) / F.lit(100.0))
    # a graph has ``most`` patches at most: numbering them is a small window
    from pyspark.sql import Window

    e = e.withColumn("pos", (F.row_number().over(Window.partitionBy("graph_id").orderBy("py", "px")) - 1).cast("long"))
    e = e.select("graph_id", "pos", F.concat(F.lit("spatial:"), F.col("pos").cast("string")).alias("edge_id"), "nodes", F.lit("spatial_adj").alias("predicate"), info.alias("I_value"))
    return nodes, with_defaults(e.union(_bad_edges(bad, "image")))


def window_rows(samples: np.ndarray, size: int = 1024, most: int = 512, least: int = 32) -> list[tuple]:
    """(win, start, end, energy, zcr, feat) of fixed windows; the first one below ``least`` samples ends them."""
    out = []
    for k in range(min(most, -(-len(samples) // size))):
        w = samples[k * size : (k + 1) * size]
        if len(w) < least:
            break
        energy = int((w * w).sum()) / len(w)
        zcr = int((w[1:] * w[:-1] < 0).sum()) / len(w)
        out.append((k, k * size, k * size + len(w), round(energy, 4), round(zcr, 4), int(energy * 1000) % 65536))
    return out


def audio_graphs(spark: SparkSession, path: str, size: int = 1024, most: int = 512, pattern: str = "*.wav") -> tuple[DataFrame, DataFrame]:
    """WAV files -> nodes, edges with graph_id: a node for each window, an edge over three in a row."""
    rows = _decoded(_files(spark, path, pattern), lambda raw: window_rows(decode_wav(raw), size, most), "win int, start long, end long, energy double, zcr double, feat long")
    cells, bad = rows.filter("error is null"), rows.filter("error is not null")
    number = lambda c: F.col(c).cast("string")
    name = F.concat(F.lit("audio:"), F.col("win").cast("string"))
    attrs = _text(type=F.lit('"audio_window"'), start_sample=number("start"), end_sample=number("end"), energy=number("energy"), zcr=number("zcr"), feat=number("feat"))
    nodes = cells.select("graph_id", name.alias("node_id"), attrs.alias("attributes")).union(_bad_nodes(bad, "audio"))
    e = features.temporal_edges(cells, "graph_id", ["win"], name, predicate="audio_temporal")
    e = e.select("graph_id", F.col("i").cast("long").alias("pos"), F.concat(F.lit("audio:seq:"), F.col("i").cast("string")).alias("edge_id"), "nodes", "predicate", "I_value")
    return nodes, with_defaults(e.union(_bad_edges(bad, "audio")))


def _bad_nodes(bad: DataFrame, kind: str) -> DataFrame:
    return bad.select("graph_id", F.lit(f"{kind}:dummy").alias("node_id"), _text(type=F.lit(json.dumps(kind)), error=_quoted(F.col("error"))).alias("attributes"))


def _bad_edges(bad: DataFrame, kind: str) -> DataFrame:
    return bad.select("graph_id", F.lit(0).cast("long").alias("pos"), F.lit(f"{kind}:dummy:edge").alias("edge_id"), F.array(F.lit(f"{kind}:dummy")).alias("nodes"), F.lit(f"{kind}_dummy").alias("predicate"), F.lit(0.5).alias("I_value"))


def graph_image(nodes: DataFrame, width: int = 256, height: int = 256) -> bytes:
    """A graph's patches painted as a PNG; width x height pixels at most come to the driver."""
    out = np.zeros((height, width, 3), np.uint8)
    got = features.paint_nodes(nodes, width=width, height=height).toPandas()
    out[got["y"], got["x"]] = got[["r", "g", "b"]].to_numpy()
    return encode_png(out)


# ---------------------------------------------------------------- embeddings


def moments(pixels: np.ndarray, size: int = 16) -> np.ndarray:
    """A plain encoder: mean, spread and gradients of the colours of each patch (patches x 12), rows of patches first."""
    h, w = (max(1, n // size) for n in pixels.shape[:2])
    out = []
    for y in range(h):
        for x in range(w):
            p = pixels[y * size : (y + 1) * size, x * size : (x + 1) * size].astype(float) / 255
            flat = p.reshape(-1, 3)
            slope = [np.diff(p, axis=k).mean(axis=(0, 1)) if p.shape[k] > 1 else np.zeros(3) for k in (0, 1)]
            out.append(np.concatenate((flat.mean(axis=0), flat.std(axis=0), *slope)))
    return np.array(out)


def embed_patches(spark: SparkSession, path: str, encoder: Callable[[np.ndarray], np.ndarray] = moments, pattern: str = "*") -> DataFrame:
    """Image files -> graph_id, id (the patch's number), v: the vectors that ``encoder`` gives for an image's pixels.

    Any model fits that a worker can load: a function of pixels (height x width
    x 3) that returns a row for each patch. Files that can't be read are left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for graph, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    v = np.asarray(encoder(decode_image(raw.as_py())), float)
                except (ValueError, zlib.error, struct.error):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([graph] * len(v)), pa.array(range(len(v)), pa.int64()), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["graph_id", "id", "v"])

    return _files(spark, path, pattern).mapInArrow(run, "graph_id string, id long, v array<double>")


def embed_images(spark: SparkSession, path: str, encoder: Callable[[np.ndarray], np.ndarray] = moments, pattern: str = "*") -> DataFrame:
    """graph_id, v: the mean of each image's patch vectors."""
    p = embed_patches(spark, path, encoder, pattern).select("graph_id", F.posexplode("v").alias("k", "x"))
    m = p.groupBy("graph_id", "k").agg(F.avg("x").alias("x")).groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("s"))
    return m.select("graph_id", F.transform("s", lambda s: s["x"]).alias("v"))


def attention(spark: SparkSession, path: str, encoder: Callable[[np.ndarray], np.ndarray], pattern: str = "*") -> DataFrame:
    """graph_id, head, i, j, w: the attention that ``encoder`` gives for an image's pixels (heads x patches x patches)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for graph, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    w = np.asarray(encoder(decode_image(raw.as_py())), float)
                except (ValueError, zlib.error, struct.error):
                    continue
                h, i, j = (x.reshape(-1) for x in np.indices(w.shape))
                yield pa.RecordBatch.from_arrays([pa.array([graph] * w.size), *(pa.array(x.astype(np.int64)) for x in (h, i, j)), pa.array(w.reshape(-1))], names=["graph_id", "head", "i", "j", "w"])

    return _files(spark, path, pattern).mapInArrow(run, "graph_id string, head long, i long, j long, w double")
