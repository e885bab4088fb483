"""Suffix-array dedup: remove bytes covered by a string of ``length`` bytes that also starts elsewhere.

1. Every ``length``-byte window of a text picks the least of its ``GRAM``-byte
   hashes (the first, on ties): its anchor. Equal windows pick equal anchors at
   equal offsets, so equal windows meet if they are dealt by anchor. Consecutive
   windows that pick one anchor form a region, of about 1.4 x ``length`` bytes.
2. Regions whose anchor occurs once hold nothing repeated. The others are
   counted by (anchor, digest): equal regions are one string with a count.
3. Each distinct region's bytes go to its anchor's shard. A shard's suffixes are
   sorted by external induction with common-prefix values (``induced_sort``), in
   memory that does not grow with the shard; a window is repeated if a neighbour
   shares ``length`` bytes, or if its whole region occurs more than once.
4. Repeated windows go back to every text that has the region, as spans.

Texts are known by 128 bits of their SHA-256, so copies of a text are judged
together, and no document, group of copies or anchor is gathered: counts are
aggregated in part before they are dealt, and spans of one text are bounded by
its length. Rows of an anchor (or of a region) that has more than 1/``HOT`` of
them are dealt by a salt too. An anchor with more than ``WIDE`` distinct regions,
as one common passage in ever new surroundings has, is split once more: its
windows are grouped by their offset to the anchor, ``GRAM`` at a time; all windows
of a group hold the same ``length`` - ``GRAM`` bytes around it, whose hash is the
key, and equal windows have equal keys. So surroundings part, and what is within
the passage is equal and counted.

Texts are exchanged once: the exchange that brings them to the regions they lend
their bytes to is the one that brings them to their spans.

Defined results: null is empty; shorter texts keep all bytes; repeated rows
repeat each other's bytes, as all copies do; the same holds for a null or
repeated doc_id; an empty table gives an empty result; other columns are
ignored by ``measure`` and kept by ``clean``. ``clean`` drops the halves of
characters that a removed span has cut.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, cut, mix, prefix_hash, release, span_hash, steps
from .induced_sort import BATCH, Scratch, repeated_starts

LENGTH, GRAM = 400, 48
#: Bytes of regions that a shard takes, about.
SHARD_BYTES = 3 << 20
#: Keys with more than one row in HOT are salted (so there are HOT of them at most), SALTS ways.
HOT, SALTS = 1024, 64
#: Distinct regions of an anchor beyond which it is split.
WIDE = 4096


def regions_of(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, start in the row, windows, anchor, digest) of every region of a run of texts."""
    n, w = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none
    h = prefix_hash(data)
    p = np.arange(n - gram + 1)
    # the hash's high half, then the place: the least is the first of the least hashes
    v = (span_hash(h, p, p + gram) & U(0xFFFFFFFF00000000)) | p.astype(np.uint64)
    m = -(-len(v) // w) * w
    v = np.concatenate((v, np.full(m - len(v), ~U(0)))).reshape(-1, w)
    head = np.minimum.accumulate(v, axis=1).reshape(-1)
    tail = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    count = n - length + 1
    place = (np.minimum(tail[:count], head[w - 1 : w - 1 + count]) & U(0xFFFFFFFF)).astype(np.int64)
    ok = np.ones(count, bool)
    for end in offs[1:-1].tolist():  # windows that would cross into the next text
        ok[max(0, end - length + 1) : end] = False
    first = ok.copy()
    first[1:] &= (place[1:] != place[:-1]) | ~ok[:-1]
    start = np.flatnonzero(first)
    stop = np.flatnonzero(ok & np.append((place[1:] != place[:-1]) | ~ok[1:], True)) + 1
    at = place[start]
    row = np.searchsorted(offs, start, "right") - 1
    return row, start - offs[row], stop - start, span_hash(h, at, at + gram).view(np.int64), span_hash(h, start, stop - 1 + length).view(np.int64)


_REGION = "start long, windows int, anchor long, digest long"


def scan(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """key (of the text), regions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in steps(batch.column("text")):
                row, start, windows, anchor, digest = regions_of(data, offs, length)
                key = [hashlib.sha256(data[a:b]).digest()[:16] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(row, np.arange(len(offs))), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(start), pa.array(windows.astype(np.int32)), pa.array(anchor), pa.array(digest)], names=["start", "windows", "anchor", "digest"]),
                )
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), lists], names=["key", "regions"])

    return docs.select("text").mapInArrow(run, "key binary, regions array<struct<start: long, windows: int, anchor: long, digest: long>>")


def _keyed(docs: DataFrame, scanned: DataFrame) -> tuple[DataFrame, list]:
    """docs with __key and __salt, and the keys of hot texts, whose copies are dealt by doc_id too.

    The key is not null, for then an inner and an outer join need the same rows and share one exchange.
    """
    total = scanned.count()
    hot = [r["key"] for r in scanned.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > max(WIDE, total // HOT)).select("key").collect()]  # HOT at most
    key = F.coalesce(F.unhex(F.left(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256), F.lit(32))), F.lit(b""))
    keyed = docs.withColumn("__key", key)
    return keyed.withColumn("__salt", _salt("__key", hot, F.xxhash64("doc_id"))), hot


def _parts(body: np.ndarray, anchor: int, windows: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(key, digest, first window, windows) of a region's groups of windows by their offset to the anchor."""
    h = prefix_hash(body)
    p = np.arange(len(body) - GRAM + 1)
    place = int(np.flatnonzero(span_hash(h, p, p + GRAM).view(np.int64) == anchor)[0])
    for group in range(place // GRAM + 1):
        first, last = place - GRAM * (group + 1) + 1, place - GRAM * group  # all windows of the group, here or elsewhere
        lo, hi = max(first, 0), min(last, windows - 1)
        if lo <= hi:
            # what all of them have in common, and what those here have together
            own = span_hash(h, np.array([last, lo]), np.array([first + length, hi + length]))
            key = mix(own[:1] + U(group + 1) * U(0x9E3779B97F4A7C15)).view(np.int64)
            yield int(key[0]), int(own.view(np.int64)[1]), lo, hi - lo + 1


_SPOT = "shard long, anchor long, digest long, first int, part long, copies long, windows int, body binary"


def _cut_out(found: DataFrame, length: int, wide: bool) -> DataFrame:
    """(text, spots) -> the bytes of each region by the shard that it goes to; or (``wide``) of the parts of regions that are split."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _SPOT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            spots, out, held = batch.column("__spots").to_pylist(), [], 0
            for text, regions in zip(batch.column("text").cast(pa.binary()), spots, strict=True):
                raw = text.as_buffer()
                for r in regions:
                    if r["wide"] != wide:
                        continue
                    a, n = r["start"], r["windows"]
                    if not wide:
                        out.append((r["anchor"], r["anchor"], r["digest"], 0, r["digest"], r["copies"], n, raw[a : a + n - 1 + length].to_pybytes()))
                        held += n + length
                        continue
                    body = np.frombuffer(raw, np.uint8)[a : a + n - 1 + length]
                    for key, digest, lo, size in _parts(body, r["anchor"], n, length):
                        out.append((key, r["anchor"], r["digest"], lo, digest, r["copies"], size, body[lo : lo + size - 1 + length].tobytes()))
                        held += size + length
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=names)
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=names)

    return found.mapInArrow(run, _SPOT)


def sort_shard(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """shard, anchor, digest, first, part, spans for each (.., copies, windows, body): the runs [from, to) of windows that are repeated.

    Bodies go to a file as symbols and the rest to another as it comes; nothing is held but a batch.
    """
    with tempfile.TemporaryDirectory() as folder:  # scratch of this task, gone with it
        scratch, n, rows = Scratch(folder), 0, 0
        strings, rest = scratch.path(), scratch.path()
        writer = None
        with open(strings, "wb") as f, pa.OSFile(rest, "wb") as g:
            for batch in batches:
                if not batch.num_rows:
                    continue
                body = batch.column("body").cast(pa.large_binary())
                offs = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
                data = np.frombuffer(body.buffers()[2], np.uint8)[offs[0] : offs[-1]]
                size = np.diff(offs)
                begin = offs[:-1] - offs[0] + np.arange(len(size))  # each string has an end symbol more
                text = np.zeros(len(data) + len(size), np.uint16)
                own = np.ones(len(text), bool)
                own[begin + size] = False
                text[own] = data
                text[own] += 1
                f.write(text.tobytes())
                part = batch.drop_columns(["body"]).append_column("begin", pa.array(begin + n))
                writer = writer or pa.ipc.new_stream(g, part.schema)
                writer.write_batch(part)
                n, rows = n + len(text), rows + len(size)
            if writer is None:
                return
            writer.close()
        hit = repeated_starts(scratch.mapped(strings, np.uint16, n), length, scratch)
        with pa.OSFile(rest) as g:
            for part in pa.ipc.open_stream(g):
                windows, begin = np.asarray(part.column("windows"), np.int64), np.asarray(part.column("begin"))
                base, end = int(begin[0]), int(begin[-1] + windows[-1])
                inside = np.zeros(end - base + 1, np.int8)  # 1 where a region's windows begin, -1 after them
                inside[begin - base] += 1
                inside[begin + windows - base] -= 1
                on = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
                more = np.asarray(part.column("copies")) > 1
                often = np.zeros(end - base + 1, np.int8)
                often[begin[more] - base] += 1
                often[(begin + windows)[more] - base] -= 1
                on &= hit[base:end] | np.cumsum(often[:-1], dtype=np.int8).view(bool)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], on.view(np.int8), [0])))) + base
                a, z = edge[::2], edge[1::2]
                row = np.searchsorted(begin, a, "right") - 1
                spans = pa.StructArray.from_arrays([pa.array((a - begin[row]).astype(np.int32)), pa.array((z - begin[row]).astype(np.int32))], names=["from", "to"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(begin) + 1)).astype(np.int32)), spans)
                names = ["shard", "anchor", "digest", "first", "part"]
                got = pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists], names=[*names, "spans"])
                yield got.filter(pa.array(np.diff(np.searchsorted(row, np.arange(len(begin) + 1))) > 0))
                scratch.relax(4 * BATCH)
    release()


_FOUND = "shard long, anchor long, digest long, first int, part long, spans array<struct<from: int, to: int>>"


def _shards(regions: DataFrame, n_bytes: int, length: int) -> DataFrame:
    return regions.repartition(max(1, int(n_bytes // SHARD_BYTES)), "shard").mapInArrow(lambda batches: sort_shard(batches, length), _FOUND)


def _salt(key: str, hot: list[int], by: Column) -> Column:
    return F.when(F.col(key).isin(hot), F.pmod(by, F.lit(SALTS)).cast("int")).otherwise(F.lit(0)) if hot else F.lit(0)


def _salts(key: str, hot: list[int]) -> Column:
    """All salts that a key's rows can have."""
    return F.explode(F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0)))


def with_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with __spans: the runs [from, to) of the starts of repeated windows in each text, or null."""
    scanned = cut(scan(docs, length))
    texts, hot_texts = _keyed(docs, scanned)
    runs = scanned.select("key", F.explode("regions").alias("r")).select("key", "r.*")
    anchors = cut(runs.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"))
    total = anchors.agg(F.sum("n")).first()[0] or 0
    hot = [r["anchor"] for r in anchors.filter(F.col("n") > max(WIDE, total // HOT)).select("anchor").collect()]  # HOT at most
    twice = anchors.select("anchor", _salts("anchor", hot).alias("salt"))
    runs = cut(runs.withColumn("salt", _salt("anchor", hot, F.col("digest"))).join(twice, ["anchor", "salt"], "left_semi").drop("salt"))

    distinct = cut(runs.groupBy("anchor", "digest").agg(F.count("*").alias("copies"), F.min(F.struct("key", "start", "windows")).alias("one")))
    split = cut(distinct.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > WIDE).select("anchor", F.lit(True).alias("wide")))
    any_wide = not split.isEmpty()
    marked = distinct.join(split, "anchor", "left") if any_wide else distinct.withColumn("wide", F.lit(False))
    spot = F.struct("one.start", "one.windows", "anchor", "digest", "copies", F.coalesce("wide", F.lit(False)).alias("wide"))
    spots = marked.groupBy(F.col("one.key").alias("__key")).agg(F.collect_list(spot).alias("__spots")).withColumn("__salt", _salts("__key", hot_texts))
    # of the copies of a text, one lends its bytes (of a hot text, one for each salt: all that it has is repeated anyhow);
    # all columns come along, so that the exchange is that of the last join
    found = texts.join(spots, ["__key", "__salt"]).groupBy("__key", "__salt").agg(*[F.first(c).alias(c) for c in (*docs.columns, "__spots")])
    n_bytes = distinct.agg(F.sum(F.col("one.windows") + length)).first()[0] or 0
    repeated = _shards(_cut_out(found, length, False), n_bytes, length).select("anchor", "digest", "spans")
    if any_wide:
        parts = _cut_out(found, length, True)
        once = parts.groupBy("shard", "part").agg(F.sum("copies").alias("copies"), F.first("windows").alias("windows"), F.first("body").alias("body"))
        once = once.select("shard", F.lit(0).cast("long").alias("anchor"), F.lit(0).cast("long").alias("digest"), F.lit(0).alias("first"), "part", "copies", "windows", "body")
        sorted_parts = _shards(once, n_bytes, length).select("shard", "part", "spans")
        moved = F.transform("spans", lambda x: F.struct((x["from"] + F.col("first")).alias("from"), (x["to"] + F.col("first")).alias("to")))
        repeated = repeated.union(parts.select("shard", "part", "anchor", "digest", "first").join(sorted_parts, ["shard", "part"]).select("anchor", "digest", moved.alias("spans")))

    often = [r["digest"] for r in distinct.filter(F.col("copies") > max(WIDE, total // HOT)).select("digest").distinct().collect()]  # HOT at most
    back = repeated.withColumn("salt", _salts("digest", often))
    hits = runs.withColumn("salt", _salt("digest", often, F.xxhash64("key", "start"))).join(back, ["anchor", "digest", "salt"]).select("key", "start", F.explode("spans").alias("s"))
    spans = F.struct((F.col("start") + F.col("s.from")).alias("from"), (F.col("start") + F.col("s.to")).alias("to"))
    by_key = hits.groupBy(F.col("key").alias("__key")).agg(F.array_sort(F.collect_set(spans)).alias("__spans")).withColumn("__salt", _salts("__key", hot_texts))
    return texts.join(by_key, ["__key", "__salt"], "left").select(*docs.columns, "__spans")


def removed(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes, from sorted runs of window starts."""
    out: list[list[int]] = []
    for s in spans:
        a, b = s["from"], s["to"] - 1 + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def measure(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, n, sha = [], [], [], []
            for text, s in zip(batch.column("text").cast(pa.binary()), batch.column("__spans").to_pylist(), strict=True):
                raw, cuts, at = text.as_buffer() if text.is_valid else pa.py_buffer(b""), removed(s or [], length), 0
                h = hashlib.sha256()
                for a, b in cuts:
                    h.update(raw[at:a])
                    at = b
                h.update(raw[at:])
                size.append(raw.size)
                gone.append(sum(b - a for a, b in cuts))
                n.append(len(cuts))
                sha.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, gone, n)), pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(docs.select("doc_id", "text"), length).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def clean(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes taken out of ``text``; all rows and columns stay."""
    cols = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, s in zip(batch.column("text"), batch.column("__spans").to_pylist(), strict=True):
                if not s or not text.is_valid:
                    texts.append(text.as_py())
                    continue
                raw, out, at = text.as_py().encode(), [], 0
                for a, b in removed(s, length):
                    out.append(raw[at:a])
                    at = b
                texts.append((b"".join(out) + raw[at:]).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in cols], names=cols)

    return with_spans(docs, length).mapInArrow(run, docs.schema)
