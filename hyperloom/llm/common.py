"""Shared pieces: tables, checkpoints, and vectorised word handling on Arrow buffers.

Text operators work on the UTF-8 buffers that Arrow hands over, so no Python
string is made per word. A word is a run of bytes outside the six ASCII blanks
``\\x20 \\x09-\\x0D``; it is identified by a 64-bit hash.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as a regular expression of the JVM.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step takes (a longer text is taken alone).
STEP_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the cluster's shared folder.

    The folder is the session's ``spark.checkpoint.dir``; only where that is
    unset (tests on one machine) an own folder is made. ``free``: the shuffle
    files that made it go at once, so df itself is not to be used again.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    if free:
        free_shuffles(df)
    return out


def free_shuffles(df: DataFrame) -> None:
    """Remove the shuffle files of df's own run, which else stay until the driver happens to collect its garbage.

    As Spark does after a write with ``spark.sql.classic.shuffleDependency.fileCleanup.enabled``, which leaves checkpoints and results out.
    """
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        files = df.sparkSession.sparkContext._jsc.sc().shuffleDriverComponents()
        for k in list(plan.context().shuffleIds().keySet()):
            files.removeShuffle(k, False)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all of the cluster shares, set if need be; an own one is made only on one machine."""
    sc, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if named is None and not (sc.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loom-checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def is_fold(doc_id: str, fold: int, folds: int = 5):
    """crc32(doc_id as text) mod ``folds`` equals ``fold``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


# ---------------------------------------------------------------- vectorised text

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15 & ~7 | 5)
_BASE_INV = U(pow(int(_BASE), -1, 1 << 64))
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> None:
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _BASE_INV)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)


def release() -> None:
    """Hand memory that is free back to the system: workers stay alive, idle, beside the JVM's next stages."""
    for k, p in enumerate(_powers):
        if len(p) > 4 * STEP_BYTES:
            _powers[k] = p[: 4 * STEP_BYTES].copy()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; distinct inputs stay distinct."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes, mod 2**64."""
    n = len(data)
    _grow(n + 1)
    h = np.empty(n + 1, np.uint64)
    h[0] = 0
    np.multiply(_BYTE[data], _powers[0][:n], out=h[1:])
    np.cumsum(h[1:], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), equal for equal bytes wherever they stand."""
    x = h[end] - h[start]
    x *= _powers[1][start]
    x += (end - start).astype(np.uint64) * U(0x9FB21C651E98DF25)
    return mix(x)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``span_hash`` of ascending spans that don't overlap, in steps: memory is that of STEP_BYTES of text, whatever the text or a span."""
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        a, b = int(start[i]), int(end[i])
        if b - a > STEP_BYTES:
            total = sum(int(prefix_hash(data[x : min(b, x + STEP_BYTES)])[-1]) * pow(int(_BASE), x - a, 1 << 64) for x in range(a, b, STEP_BYTES))
            whole = np.array([0, total % (1 << 64)], np.uint64)
            out[i] = mix(whole[1:] + np.array([b - a], np.uint64) * U(0x9FB21C651E98DF25))[0]
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(end, a + STEP_BYTES, "right")))
        h = prefix_hash(data[a : end[j - 1]])
        out[i:j] = span_hash(h, start[i:j] - a, end[i:j] - a)
        i = j
    return out


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def steps(col: pa.Array, step: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) for runs of rows of about ``step`` bytes."""
    data, offs = text_buffers(col)
    step, lo, n = step or STEP_BYTES, 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + step, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
    release()


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; words never cross rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    blank = BLANK[data]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    start = ~blank
    start[1:] &= blank[:-1] | first[1:n]
    end = ~blank
    end[:-1] &= blank[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1


def per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` (one per byte) for each row."""
    out, some = np.zeros(len(offs) - 1, np.int64), np.flatnonzero(offs[1:] > offs[:-1])
    if len(some):
        out[some] = np.add.reduceat(flags.view(np.uint8), offs[some], dtype=np.int64)
    return out


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts(.., n) whose n reaches the least bar that at most ``most`` rows reach.

    Bars are steps of 1/64 of a power of two, so the driver sees 4,096 rows at most and nothing is sorted.
    """
    step = F.floor(F.log2(F.col("n").cast("double")) * 64).cast("int")
    bins = counts.filter("n > 0").groupBy(step.alias("b")).agg(F.count("*").alias("rows")).collect()
    bar, total = 1 << 20, 0
    for r in sorted(bins, key=lambda r: -r["b"]):
        total += r["rows"]
        if total > most:
            break
        bar = r["b"]
    return counts.filter((F.col("n") > 0) & (step >= bar))
