"""Byte histograms, code lengths, and vector expressions."""

from __future__ import annotations

import bz2
import gzip
import lzma
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .codec import SCALE, cumulative, normalise


def byte_histogram(texts: DataFrame, col: str) -> DataFrame:
    """sym (0..255), n over the UTF-8 bytes of a column; counted batch by batch on Arrow buffers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for b in batches:
            for x in b.column(0).cast(pa.large_binary()).drop_null():
                total += np.bincount(np.frombuffer(x.as_buffer(), np.uint8), minlength=256)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["sym", "n"])

    return texts.select(col).mapInArrow(run, "sym int, n long").groupBy("sym").agg(F.sum("n").alias("n"))


def normalised(hist: DataFrame) -> DataFrame:
    """sym, n, freq, cum: the coder's frequencies of a histogram (256 rows at most)."""
    def run(t: pa.Table) -> pa.Table:
        counts = np.zeros(256, np.int64)
        counts[np.asarray(t.column("sym"))] = np.asarray(t.column("n"))
        freq = normalise(counts)
        at = np.flatnonzero(freq)
        return pa.table({"sym": pa.array(at.astype(np.int32)), "n": pa.array(counts[at]), "freq": pa.array(freq[at]), "cum": pa.array(cumulative(freq)[at])})

    return hist.groupBy(F.lit(0).alias("__all")).applyInArrow(run, "sym int, n long, freq long, cum long")


def exclusive_sum(hist: DataFrame) -> DataFrame:
    """sym, n, before: the sum of the symbols before it (256 rows at most)."""
    w = Window.orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def coded_bits(freqs: DataFrame) -> DataFrame:
    """bytes, bits: what the frequencies cost for the counts."""
    bits = F.sum(-F.col("n") * F.log2(F.col("freq") / F.lit(float(SCALE))))
    return freqs.agg(F.sum("n").alias("bytes"), F.round(bits, 3).alias("bits"))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    # maximum and sum are bound once: inside a lambda they would be worked out for every element
    bound = lambda v, f, g: F.transform(F.transform(F.array(v), lambda z: F.struct(z.alias("z"), f(z).alias("c"))), lambda s: F.transform(s["z"], lambda x: g(x, s["c"])))[0]
    e = bound(logits, F.array_max, lambda x, top: F.exp((x - top) / F.lit(temperature)))
    return bound(e, lambda z: F.aggregate(z, F.lit(0.0), lambda a, b: a + b), lambda x, total: x / total)


def expected_bits(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - x * F.log(x + F.lit(1e-10))) / F.log(F.lit(2.0))


def code_length(p: Column, symbol: Column) -> Column:
    return -F.log2(F.element_at(p, symbol + 1) + F.lit(1e-10))


def expected_ratio(bits: Column) -> Column:
    return F.lit(8.0) / F.greatest(bits, F.lit(0.01))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def unit(v: Column) -> Column:
    """A vector at length 1; a zero vector stays as it is."""
    sized = F.transform(F.array(v), lambda z: F.struct(z.alias("z"), F.when(norm(z) == 0, 1.0).otherwise(norm(z)).alias("n")))
    return F.transform(sized, lambda s: F.transform(s["z"], lambda x: x / s["n"]))[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; a zero vector counts as of length 1."""
    safe = lambda v: F.when(norm(v) == 0, 1.0).otherwise(norm(v))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / (safe(a) * safe(b))


def information(similarity: Column) -> Column:
    """A similarity in [-1, 1] as information: scaled to [0, 1], clamped to [0.01, 1], four digits."""
    return F.round(F.greatest(F.lit(0.01), F.least(F.lit(1.0), (similarity + 1) / 2)), 4)


def fingerprint(v: Column) -> Column:
    """12 hex digits of the MD5 of the first 16 components as little-endian float32."""
    import hashlib

    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda x: None if x is None else hashlib.md5(np.asarray(x[:16], "<f4").tobytes()).hexdigest()[:12])

    return run(v)


def baseline_sizes(col: Column) -> Column:
    """Sizes of text under gzip, bzip2 and lzma."""
    @F.pandas_udf("struct<gzip: long, bzip2: long, lzma: long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        raw = [t.encode() for t in texts]
        return pd.DataFrame({"gzip": [len(gzip.compress(t)) for t in raw], "bzip2": [len(bz2.compress(t)) for t in raw], "lzma": [len(lzma.compress(t)) for t in raw]})

    return run(col)


def edge_features() -> Column:
    """Eight structural features of an edge."""
    n, a = F.size("nodes"), F.size("attr_types")
    over = lambda k: F.when(n > k, 1.0).otherwise(0.0)
    return F.array(n / F.lit(10.0), F.col("I_value"), F.col("base_weight"), F.col("dir_factor"), a / F.lit(10.0), over(2), over(3), over(4))


def stable_bucket(col: Column, n: int) -> Column:
    """A reproducible hash bucket: the first 8 hex digits of the MD5, modulo n."""
    return F.pmod(F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")
