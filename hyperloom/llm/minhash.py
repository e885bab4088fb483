"""MinHash near-duplicates: universal hash minima, banding, verification, components.

1. Each text becomes the set of its distinct 5-word shingles (64-bit hashes).
   Texts with equal sets are one class, known by a 128-bit digest; everything
   after works on classes, so copies are never paired.
2. Bands of ``ROWS`` minima of multiply-add hashes (64-bit, high half): as many
   bands as it takes that a pair at the threshold (``SIMILAR`` percent unless
   given) shares fewer than two with probability 1.4e-6 at most: 29 at 85, 42 at 80.
3. Links are sought bucket by bucket in two passes. First every member is
   compared with its bucket's least class; components of these links are found.
   Then only classes that share two bands but are still in different components
   are compared, in the bucket of the first that they share: those outside the
   bucket's largest component with all, in blocks. In both passes a pair goes on
   if enough of its minima agree (for a pair at the threshold this fails with
   probability below 1e-7).
4. Every candidate is confirmed on the full sets, by integers:
   100 * |A n B| >= threshold * |A u B|.
5. Links become components by large-star and small-star steps.

No pair of one component is compared after the first pass, and no bucket is
expanded into pairs: inside a block, pairs are tested in place, and a row comes
out for each join of components. A bucket with more than ``BLOCK`` rows outside
its largest component is split by a second band: a pair goes to the bucket of the
first two bands that it shares. Two bands are asked for in every bucket, so the
same pairs are compared however wide it is and wherever it is split. (The first
pass takes its pairs at one band, in all buckets: links beyond that bound.)
What is still large is cut into blocks of ``BLOCK`` rows and
``BLOCK_BYTES`` of sets at most, and every pair of blocks is a group of its own, so
no bucket is gathered in one task and none is skipped.

Defined results: null, empty and blank texts have an empty set, are linked with
nothing and kept; rows of one doc_id with different texts are rows of their own
that may end in different components; repeated rows share a component; a null
doc_id is less than none (a component's least id ignores it, and a component of
null ids only has a null component_id and is kept); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U, cut, mix, prefix_hash, span_hash, steps, words_of
from .components import components

WORDS, SIMILAR = 5, 85
ROWS = 5
#: Chances that a pair at the threshold shares fewer than two bands, and that fewer of its minima agree than the bar.
BAND_MISS, SIGN_MISS = 1.4e-6, 1e-7
BLOCK, BLOCK_BYTES = 2048, 8 << 20
_rng = np.random.Generator(np.random.PCG64(8128))
_MULT = [U(int(x)) for x in _rng.integers(0, 2**62, max(WORDS, ROWS), dtype=np.uint64) * U(4) + U(3)]


@lru_cache(maxsize=8)
def n_bands(similarity: int) -> int:
    """The number of bands at a similarity in percent, of which a pair shares two but with a chance of BAND_MISS: 29 at 85, 42 at 80."""
    p, n = (similarity / 100) ** ROWS, 2
    while (1 - p) ** n + n * p * (1 - p) ** (n - 1) > BAND_MISS:
        n += 1
    return n


@lru_cache(maxsize=8)
def sign_least(similarity: int) -> int:
    """The number of agreeing minima that a pair at the threshold has but with a chance below SIGN_MISS."""
    n, p = n_bands(similarity) * ROWS, similarity / 100
    total, k = 0.0, 0
    while (total := total + math.comb(n, k) * p**k * (1 - p) ** (n - k)) < SIGN_MISS:
        k += 1
    return k


@lru_cache(maxsize=8)
def _hashes(bands: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(8128))
    a = rng.integers(0, 2**63, bands * ROWS, dtype=np.uint64) * U(2) + U(1)
    return a, rng.integers(0, 2**63, bands * ROWS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a run."""
    data = LOWER[data]
    s, e, doc = words_of(data, offs)
    w = span_hash(prefix_hash(data), s, e)
    n = len(w)
    if n >= WORDS:
        x = w[: n - WORDS + 1] * _MULT[0]
        for k in range(1, WORDS):
            x += mix(w[k : n - WORDS + 1 + k] + U(k)) * _MULT[k]
        x = mix(x)
    at = np.searchsorted(doc, np.arange(len(offs)))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(x[a : b - WORDS + 1]))
        elif b > a:  # the whole sequence as one shingle
            h = np.array([b - a], np.uint64)
            for k in range(a, b):
                h = mix(h * _MULT[0] + w[k])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(x: np.ndarray, bands: int) -> np.ndarray:
    """The minima of all hash functions over a set, 32 bits each."""
    a, b = _hashes(bands)
    x = x & U(0xFFFFFFFF) ^ (x >> U(32))
    low = np.full(len(a), ~U(0))
    for k in range(0, len(x), 512):
        h = np.multiply.outer(a, x[k : k + 512])
        h += b[:, None]
        np.minimum(low, h.min(axis=1), out=low)
    return (low >> U(32)).astype(np.uint32)


def bucket_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band (rows: signatures)."""
    n = sig.shape[1] // ROWS
    x = np.zeros(sig.shape[:1] + (n,), np.uint64)
    bands = sig.reshape(-1, n, ROWS).astype(np.uint64)
    for k in range(ROWS):
        x = mix(x * _MULT[k] + bands[:, :, k])
    return mix(x + np.arange(n, dtype=np.uint64) * _MULT[0])


def _digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def classify(docs: DataFrame, similarity: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, cls (null if the set is empty), bands (the bucket keys)."""
    n = n_bands(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in steps(batch.column("text")):
                sets = shingle_sets(data, offs)
                full = [x for x in sets if len(x)]
                keys = bucket_keys(np.stack([signature(x, n) for x in full])).view(np.int64).reshape(-1) if full else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(n * np.concatenate(([0], np.cumsum([len(x) > 0 for x in sets]))), pa.int32()), pa.array(keys))
                cols = [batch.column("doc_id").slice(lo, hi - lo), pa.array([len(x) for x in sets], pa.int64()), pa.array([_digest(x) if len(x) else None for x in sets], pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "cls", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, cls binary, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """cls, shingles of each text that has any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in steps(batch.column("text")):
                sets = [x for x in shingle_sets(data, offs) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["cls", "shingles"])

    return docs.select("text").mapInArrow(run, "cls binary, shingles binary")


def _signed(sets: DataFrame, similarity: int) -> DataFrame:
    """cls, n_shingles, sig (32-bit minima)."""
    n = n_bands(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.frombuffer(s.as_buffer(), np.uint64) for s in batch.column("shingles")]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array([len(s) for s in x], pa.int64()), pa.array([signature(s, n).tobytes() for s in x], pa.binary())], names=["cls", "n_shingles", "sig"])

    return sets.mapInArrow(run, "cls binary, n_shingles long, sig binary")


def _likely(pairs: DataFrame, signed: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow a link."""
    least = sign_least(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("ga", "gb"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    with_a = pairs.join(signed.select(F.col("cls").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("ga")), "a")
    both = with_a.join(signed.select(F.col("cls").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("gb")), "b")
    return both.filter(100 * F.least("na", "nb") >= similarity * F.greatest("na", "nb")).select("a", "b", "ga", "gb").mapInArrow(run, "a binary, b binary")


def _confirm(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) that are similar on their full sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("sa"), batch.column("sb"), strict=True)
            ok = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), similarity) for x, y in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    with_a = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a")
    return with_a.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _candidates(t: pa.Table, n: np.ndarray, sig: np.ndarray, similarity: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, partners, component numbers) of a pair of blocks: left and right rows of other components whose sizes and signatures allow a link, where they share two bands and this is the bucket of the first, or of the first two.

    Component numbers may be changed meanwhile; what has become one is passed over.
    """
    _, root = np.unique(np.array([v.hex() for v in t.column("label").to_pylist()]), return_inverse=True)
    _, place = np.unique(np.array([v.hex() for v in t.column("cls").to_pylist()]), return_inverse=True)
    side, both = np.asarray(t.column("side")), np.asarray(t.column("both"))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    key, other = t.column("key")[0].as_py(), t.column("other")[0].as_py()
    band = bucket_keys(sig).view(np.int64)
    for i in left.tolist():
        r = right[(root[right] != root[i]) & (100 * np.minimum(n[right], n[i]) >= similarity * np.maximum(n[right], n[i]))]
        r = r[~both[r] | (place[r] > place[i])]  # rows that are on both sides meet once
        r = r[(sig[r] == sig[i]).sum(axis=1) >= sign_least(similarity)]
        if len(r):
            same = band[r] == band[i]
            first = same.argmax(axis=1)
            ok = band[i, first] == key
            same[np.arange(len(r)), first] = False
            ok &= same.any(axis=1)  # a second band in any bucket: what is compared does not hang on its width
            if other is not None:
                ok &= band[i, same.argmax(axis=1)] == other
            r = r[ok]
        if len(r):
            yield i, r, root


def _buckets(members: DataFrame) -> DataFrame:
    """members(key, other, cls, label, n_shingles) -> key, other, big (the largest component), few (rows outside it), x, y (blocks of these and of all)."""
    by = members.groupBy("key", "other", "label").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("size"))
    b = by.groupBy("key", "other").agg(F.sum("rows").alias("rows"), F.sum("size").alias("size"), F.max(F.struct("rows", "label", "size")).alias("top"))
    b = b.withColumn("few", F.col("rows") - F.col("top.rows")).filter("few > 0")
    blocks = lambda rows, size: F.ceil(F.greatest(rows / BLOCK, 8 * size / BLOCK_BYTES)).cast("int")
    return b.select("key", "other", F.col("top.label").alias("big"), "few", blocks(F.col("few"), F.col("size") - F.col("top.size")).alias("x"), blocks(F.col("rows"), F.col("size")).alias("y"))


def _on(a: DataFrame, b: DataFrame) -> DataFrame:
    """a joined with b's buckets."""
    b = b.withColumnsRenamed({"key": "__key", "other": "__other"})
    return a.join(b, (F.col("key") == F.col("__key")) & F.col("other").eqNullSafe(F.col("__other"))).drop("__key", "__other")


def _pair_blocks(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """members with x, y, side, both: a row for each pair of blocks; left (0) the rows outside the largest component, right (1) all."""
    m = _on(members, buckets).withColumn("both", F.col("label") != F.col("big"))
    block = lambda n: F.pmod(F.xxhash64("cls"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    cols = ["key", "other", "cls", "label", "both"]
    a = m.filter("both").select(*cols, F.lit(0).alias("side"), block(F.col("x")).alias("i"), upto(F.col("y")).alias("j"))
    return a.union(m.select(*cols, F.lit(1).alias("side"), upto(F.col("x")).alias("i"), block(F.col("y")).alias("j")))


def _across(members: DataFrame, bands: DataFrame, signed: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """members(key, cls, label) of buckets with several components, bands(cls, bands) -> links (a, b) that join components.

    Pairs of blocks are dealt by (bucket, block pair). A first look at signatures
    keeps the rows that have a partner; a second one has their full sets, and
    confirms pairs in place. Once two components are joined in a block, no more
    pairs of theirs are compared there. So what comes out is a row for each
    member, then a row for each join: never a row for each pair.
    """
    def look(t: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(t.num_rows, -1)
        keep = np.zeros(t.num_rows, bool)
        for i, r, _ in _candidates(t, np.asarray(t.column("n_shingles")), sig, similarity):
            keep[i] = True
            keep[r] = True
        return t.select([c.split()[0] for c in named.split(", ")]).filter(pa.array(keep))

    def join(t: pa.Table) -> pa.Table:
        cls = t.column("cls").to_pylist()
        full = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        sig = np.stack([signature(x, n_bands(similarity)) for x in full])
        out: list[tuple[bytes, bytes]] = []
        for i, partners, root in _candidates(t, np.array([len(x) for x in full]), sig, similarity):
            for k in partners.tolist():
                if root[k] != root[i] and similar(full[i], full[k], similarity):
                    out.append((cls[i], cls[k]))
                    root[root == root[k]] = root[i]
        return pa.table({"a": pa.array([min(p) for p in out], pa.binary()), "b": pa.array([max(p) for p in out], pa.binary())})

    members = cut(members.join(signed.select("cls", "n_shingles"), "cls").withColumn("other", F.lit(None).cast("long")), free=True)
    buckets = cut(_buckets(members), free=True)
    rows = _pair_blocks(members, buckets.filter(F.col("few") <= BLOCK))
    wide = buckets.filter(F.col("few") > BLOCK)
    if not wide.isEmpty():
        again = _on(members, wide.select("key", "other")).join(bands, "cls")
        later = F.expr("slice(bands, cast(array_position(bands, key) as int) + 1, size(bands))")
        again = again.select("key", F.explode(later).alias("other"), "cls", "label", "n_shingles")
        rows = rows.union(_pair_blocks(again, _buckets(again)))
    group = ["key", "other", "i", "j"]
    named = "key long, other long, i int, j int, cls binary, label binary, both boolean, side int"
    kept = rows.join(signed, "cls").groupBy(*group).applyInArrow(look, named)
    return kept.join(sets, "cls").groupBy(*group).applyInArrow(join, "a binary, b binary").distinct()


def similar(x: np.ndarray, y: np.ndarray, similarity: int = SIMILAR) -> bool:
    """Whether two sorted sets have 100 * |x n y| >= similarity * |x u y|."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < similarity * len(y):
        return False
    both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    return 100 * both >= similarity * (len(x) + len(y) - both)


def near_duplicates(docs: DataFrame, similarity: int = SIMILAR) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept."""
    rows = cut(classify(docs, similarity))
    some = rows.filter("cls is not null")
    buckets = some.select("cls", F.explode("bands").alias("key"))
    hubs = buckets.groupBy("key").agg(F.min("cls").alias("hub"), F.max("cls").alias("last")).filter("hub <> last").select("key", "hub")
    shared = cut(buckets.join(hubs, "key").select("key", "hub", "cls").distinct(), free=True)
    known = shared.select("cls").distinct()
    # the full sets of the classes that share a bucket, from a text of each; a doc_id on several rows brings all of their sets
    ids = some.select("cls", "doc_id").join(known, "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("id")).select("id").distinct()
    d = docs.select("doc_id", "text")
    sets = _sets(d.join(ids, d.doc_id.eqNullSafe(ids.id), "left_semi"))
    if repeats(rows):
        sets = sets.groupBy("cls").agg(F.first("shingles").alias("shingles"))
    sets = cut(sets, free=True)
    signed = cut(_signed(sets, similarity))

    pairs = shared.filter("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()
    links = cut(_confirm(_likely(pairs, signed, similarity), sets, similarity), free=True)
    label = cut(components(links), free=True)
    by = shared.join(label.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("label", "cls").alias("label"))
    apart = by.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
    members = by.join(apart, "key", "left_semi")
    more = cut(_across(members, some.select("cls", "bands").dropDuplicates(["cls"]), signed, sets, similarity), free=True)
    if not more.isEmpty():
        label = cut(components(links.union(more)), free=True)
    member = some.groupBy("cls").agg(F.min("doc_id").alias("least")).join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = member.groupBy("label").agg(F.min("least").alias("component_id"))
    final = member.join(least, "label").select("cls", "component_id")
    out = rows.select("doc_id", "n_shingles", "cls").join(final, "cls", "left")
    comp = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def repeats(docs: DataFrame) -> bool:
    """Whether some doc_id is on several rows."""
    return not docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def survivors(docs: DataFrame, similarity: int = SIMILAR) -> DataFrame:
    """The rows of docs that are kept, with their columns: one of each component, and one row of each of their doc_ids."""
    kept = near_duplicates(docs, similarity).filter("kept").select(F.col("doc_id").alias("__kept")).distinct()
    out = docs.join(kept, docs.doc_id.eqNullSafe(F.col("__kept")), "left_semi")
    return out.dropDuplicates(["doc_id"]) if repeats(docs.select("doc_id")) else out
