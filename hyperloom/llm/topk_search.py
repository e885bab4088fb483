"""Exact top-k inner products by a pivot-distance index.

Vectors become integers, floor(scale * x). One component more, sqrt(M - |x|^2)
with M the largest squared norm, turns the largest inner product into the least
distance: |q - x|^2 = |q|^2 + M - 2 q.x, queries having 0 there.

Index: every vector is keyed by its nearest pivot and the ring of its distance
to it (a cell). Pivots and ring borders are fitted on ``SAMPLE`` rows at most;
every row is indexed. The driver keeps each cell's count and least and largest
distance: ``LENGTHS`` x ``PIVOTS`` x ``RINGS`` rows at most, for the ``LENGTHS``
most frequent lengths. A vector of another length is in the one cell of its
length (``PLAIN``), and one with a component beyond ``WILD``, whose squares
floats don't carry, in its length's cell ``FAR``; these cells are visited by all
queries of that length, and a query that is itself beyond ``WILD`` visits all.

Search: a query sorts the cells by their least possible distance
max(0, d(q,p) - far, near - d(q,p)). It first visits the nearest cells, which
gives its k-th score so far; then the further cells in order, up to the first
whose best possible score is below that (equal scores are visited: ties go to
the smaller id). So the result is exact. Cells are cut into blocks of about
``BLOCK`` rows, queries into blocks of about ``QUERY_BLOCK``, and a task takes
one pair of blocks.

Defined results: vectors that are null or hold null or non-finite components
take no part; vectors of another length are not comparable and score among
their own length only, of which there may be any number; rows with the query's
id are not candidates; repeated queries are answered once (the least of their
vectors); repeated candidates are rows of their own; inner products are exact
whole numbers, whatever the size of the components, and only a score beyond the
range of a long takes its end (components beyond a double's range take its end
too); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SAMPLE, PIVOTS, RINGS, LENGTHS = 4096, 32, 8, 256
#: Cells (as pivots) of the lengths without pivots, and of large components; the least of the latter.
PLAIN, FAR, WILD = -1, -2, 2.0**40
BLOCK, QUERY_BLOCK = 2048, 16384
#: Rows that the first visit should reach, for each result.
FIRST = 64


def _matrix(col, dim: int) -> np.ndarray:
    """Vectors of one length as rows: 4 bytes a component where that is enough, else 8."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    rows = [np.frombuffer(raw, np.int32 if len(raw) == 4 * dim else np.float64) for raw in (x.as_buffer() for x in col)]
    return np.stack(rows).astype(np.float64) if rows else np.zeros((0, dim))


def _exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows, in the least kind of number that carries them; saturated to a long."""
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] if a.size and b.size else 0.0
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**62 and max(np.abs(a).max(), np.abs(b).max()) < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object)
    return np.clip(whole(a) @ whole(b).T, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """vec_id long, dim, vec (little endian: int32, or double if that is too short), norm2, wild of the vectors that take part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.finfo(np.float64).max
        for b in batches:
            col = b.column("v")
            size = np.diff(np.asarray(col.offsets))
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(np.asarray(col.flatten(), np.float64) * scale), -top, top)
            at = np.concatenate(([0], np.cumsum(size))).tolist()
            vecs, norms, wild = [], [], []
            for i, j in zip(at[:-1], at[1:], strict=True):
                v = x[i:j]
                most = float(np.abs(v).max()) if j > i else 0.0
                vecs.append(v.astype("<i4" if most < 2.0**31 else "<f8").tobytes())
                wild.append(most > WILD)
                norms.append(0.0 if wild[-1] else float((v**2).sum()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(size.astype(np.int32)), pa.array(vecs, pa.binary()), pa.array(norms, pa.float64()), pa.array(wild, pa.bool_())], names=["vec_id", "dim", "vec", "norm2", "wild"])

    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    v = v.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return v.mapInArrow(run, "vec_id long, dim int, vec binary, norm2 double, wild boolean")


def fit(vectors: DataFrame, sample: int = SAMPLE, pivots: int = PIVOTS, rings: int = RINGS) -> dict:
    """Pivots and ring borders for each frequent length, from the ``sample`` rows that come first by hash."""
    tame = vectors.filter(~F.col("wild"))
    top = {r["dim"]: r["m"] for r in tame.groupBy("dim").agg(F.max("norm2").alias("m"), F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("dim")).limit(LENGTHS).collect()}
    rows = tame.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec").limit(sample).select("dim", "vec").collect()
    by_dim: dict[int, list] = {}
    for r in rows:
        by_dim.setdefault(r["dim"], []).append(r["vec"])
    model = {}
    for dim, m in top.items():
        own = _matrix(pa.array([bytes(x) for x in by_dim.get(dim, ())], pa.binary()), dim)
        x = _augment(own if len(own) else np.zeros((1, dim)), m)
        rng = np.random.Generator(np.random.PCG64(11))
        p = np.unique(x, axis=0)
        p = p[np.sort(rng.permutation(len(p))[:pivots])]
        for _ in range(8):
            near = _distances(x, p).argmin(axis=1)
            p = np.stack([x[near == k].mean(axis=0) if (near == k).any() else p[k] for k in range(len(p))])
        d = _distances(x, p)
        near = d.argmin(axis=1)
        d = d[np.arange(len(x)), near]
        q = np.linspace(0, 1, rings + 1)[1:-1]
        model[dim] = (m, p, np.stack([np.quantile(d[near == k], q) if (near == k).any() else np.zeros(rings - 1) for k in range(len(p))]))
    return model


def _augment(x: np.ndarray, m: float) -> np.ndarray:
    return np.column_stack((x, np.sqrt(np.maximum(0.0, m - (x**2).sum(axis=1)))))


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x**2).sum(axis=1)[:, None] + (p**2).sum(axis=1) - 2 * x @ p.T))


def assign(vectors: DataFrame, model: dict) -> DataFrame:
    """vec_id, dim, pivot, ring, dist, vec."""
    known = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, wild = np.asarray(b.column("dim")), np.asarray(b.column("wild"))
            pivot, ring, dist = np.where(wild, FAR, PLAIN).astype(np.int32), np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims[~wild]).tolist():
                if dim not in known.value:
                    continue
                m, p, borders = known.value[dim]
                at = np.flatnonzero((dims == dim) & ~wild)
                d = _distances(_augment(_matrix(b.column("vec").take(pa.array(at)), dim), m), p)
                near = d.argmin(axis=1)
                dist[at] = d = d[np.arange(len(d)), near]
                pivot[at], ring[at] = near, (d[:, None] > borders[near]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("dim"), pa.array(pivot), pa.array(ring), pa.array(dist), b.column("vec")], names=["vec_id", "dim", "pivot", "ring", "dist", "vec"])

    return vectors.select("vec_id", "dim", "vec", "wild").mapInArrow(run, "vec_id long, dim int, pivot int, ring int, dist double, vec binary")


def _visits(queries: DataFrame, model: dict, cells: dict, k: int, later: bool) -> DataFrame:
    """qid, dim, pivot, ring, tau, vec: the cells that a query visits first, or (``later``) the rest that can matter."""
    known = queries.sparkSession.sparkContext.broadcast((model, cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cells = known.value
        for b in batches:
            dims, wild, out = np.asarray(b.column("dim")), np.asarray(b.column("wild")), []
            tau = b.column("tau").to_pylist()
            if not later:  # the cells without bounds; if there is no such cell, the visit joins nothing
                out += [(i, np.array([PLAIN, FAR]), np.zeros(2, np.int64)) for i in range(len(dims))]
            for dim in np.unique(dims).tolist():
                if dim not in cells:
                    continue
                c = cells[dim]
                if not later:
                    out += [(i, c["pivot"], c["ring"]) for i in np.flatnonzero((dims == dim) & wild).tolist()]
                at = np.flatnonzero((dims == dim) & ~wild)
                m, p, _ = model[dim]
                x = _matrix(b.column("vec").take(pa.array(at)), dim)
                dp = _distances(np.column_stack((x, np.zeros(len(x)))), p)[:, c["pivot"]]
                # distances come from float sums: a margin keeps the bound on the safe side
                slack = 1e-6 * (dp + c["far"] + 1)
                least = np.maximum(0.0, np.maximum(dp - c["far"], c["near"] - dp) - slack)
                best = ((x**2).sum(axis=1)[:, None] + m - least**2) / 2
                for row, i in enumerate(at.tolist()):
                    o = np.argsort(least[row], kind="stable")
                    # the first visit must not see only the query itself
                    n_first = int(np.searchsorted(np.cumsum(c["rows"][o]), FIRST * k + 1)) + 1
                    t = tau[i]
                    if later:
                        o = o[n_first:]
                        if t is not None:
                            below = np.flatnonzero(best[row][o] * (1 + 1e-9) + 1 < t)
                            o = o[: below[0]] if len(below) else o
                    else:
                        o = o[:n_first]
                    out.append((i, c["pivot"][o], c["ring"][o]))
            idx = pa.array(np.concatenate([np.full(len(p), i) for i, p, _ in out]) if out else np.zeros(0, np.int64), pa.int64())
            cat = lambda j: pa.array(np.concatenate([x[j] for x in out]).astype(np.int32) if out else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(idx), b.column("dim").take(idx), cat(1), cat(2), b.column("tau").take(idx), b.column("vec").take(idx)], names=["qid", "dim", "pivot", "ring", "tau", "vec"])

    return queries.select("vec_id", "dim", "vec", "wild", "tau").mapInArrow(run, "qid long, dim int, pivot int, ring int, tau long, vec binary")


def _score(visits: DataFrame, index: DataFrame, blocks: DataFrame, k: int, query_blocks: int) -> DataFrame:
    """qid, vec_id, score: the k best of each visited block."""
    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        ids: list[np.ndarray] = []
        if q.num_rows and v.num_rows:
            vid, dim = np.asarray(v.column("vec_id").combine_chunks()), v.column("dim")[0].as_py()
            o = np.argsort(vid, kind="stable")
            vid, x = vid[o], _matrix(v.column("vec"), dim)[o]
            qid, tau = np.asarray(q.column("qid").combine_chunks()), q.column("tau").to_pylist()
            for lo in range(0, len(qid), 512):
                y = _matrix(q.column("vec").slice(lo, 512), dim)
                s = _exact_dot(y, x)
                for r in range(len(s)):
                    ok = vid != qid[lo + r]
                    if tau[lo + r] is not None:
                        ok &= s[r] >= tau[lo + r]
                    c = np.flatnonzero(ok)
                    c = c[np.argsort(-s[r][c], kind="stable")[:k]]
                    ids.append(np.stack((np.full(len(c), qid[lo + r]), vid[c], s[r][c])))
        t = np.concatenate(ids, axis=1) if ids else np.zeros((3, 0), np.int64)
        return pa.table({"qid": t[0].astype(np.int64), "vec_id": t[1].astype(np.int64), "score": t[2].astype(np.int64)})

    key = ["dim", "pivot", "ring", "block", "qblock"]
    left = visits.join(blocks, ["dim", "pivot", "ring"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("qblock", F.pmod(F.xxhash64("qid"), F.lit(query_blocks)).cast("int"))
    right = index.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    return left.select(*key, "qid", "tau", "vec").groupBy(*key).cogroup(right.select(*key, "vec_id", "vec").groupBy(*key)).applyInArrow(run, "qid long, vec_id long, score long")


def search(vectors: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The k best of all other rows for each row that the predicate ``queries`` (on vec_id) holds for.

    query_id, rank (from 1), vec_id, score.
    """
    v = cut(integers(vectors, id_col, vec_col, scale))
    model = fit(v)
    index = cut(assign(v, model))
    stats = cut(index.groupBy("dim", "pivot", "ring").agg(F.count("*").alias("rows"), F.min("dist").alias("near"), F.max("dist").alias("far")))
    cells: dict[int, dict] = {}
    for r in stats.filter("pivot >= 0").collect():  # LENGTHS x PIVOTS x RINGS at most
        cells.setdefault(r["dim"], []).append(r)
    cells = {dim: {c: np.array([r[c] for r in own]) for c in ("pivot", "ring", "rows", "near", "far")} for dim, own in cells.items()}
    blocks = cut(stats.select("dim", "pivot", "ring", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")))
    index = index.join(blocks, ["dim", "pivot", "ring"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("blocks")).cast("int"))
    asked = v.filter(queries(F.col("vec_id"))).groupBy("vec_id").agg(F.min(F.struct("dim", "vec", "wild")).alias("one")).select("vec_id", "one.*")
    asked = cut(asked)
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    first = cut(ranked(_score(_visits(asked.withColumn("tau", F.lit(None).cast("long")), model, cells, k, False), index, blocks, k, query_blocks)))
    kth = first.filter(F.col("rank") == k).select(F.col("qid").alias("vec_id"), F.col("score").alias("tau"))
    rest = _score(_visits(asked.join(kth, "vec_id", "left"), model, cells, k, True), index, blocks, k, query_blocks)
    out = ranked(first.select("qid", "vec_id", "score").union(rest))
    return out.select(F.col("qid").alias("query_id"), "rank", "vec_id", "score")
