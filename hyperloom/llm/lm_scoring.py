"""Hidden Markov language model, and the unigram base score beside it.

Words fall into ``CLASSES`` classes by their hash; the end of a text is a class
of its own. A hidden state emits a class, and a class emits a word as the
smoothed unigram model does:

    P(word | state) = P(class | state) * U(word) / U(class)

U is the base model. So a text's likelihood is exact over the whole vocabulary,
the trained parameters have a fixed size (``STATES`` x ``CLASSES`` and
``STATES``^2 numbers), and

    score = forward(classes of the text) + base_score - sum of log10 U(class).

Training: Baum-Welch. Each task runs scaled forward-backward recursions over its
training texts and emits one vector of expected counts; vectors are added up in
a tree, ``FAN_IN`` at a time. ``START_ROUNDS`` + ``ROUNDS`` rounds, each over all
training texts, from a random model.
Texts' classes are computed once and kept as bytes in a checkpoint.

Base: word counts over all training texts by 64-bit word hash. The ``COMMON``
most frequent words go to every task (a fixed bound); tokens outside them are
counted per text and joined with the table of counts.

Defined results: null and blank texts are one token, the end; with no training
texts V = N = 0, every word is unknown and the base gives 0.5 / 0.5 = 1 a word
(the same formula); rows are scored each for itself, and repeated rows train
repeatedly; a null doc_id counts as the text '' in the split; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U, cut, frequent, is_fold, prefix_hash, span_hash, steps, words_of

STATES, CLASSES, ROUNDS = 8, 4096, 3
START_ROUNDS = 12
COMMON = 1 << 18
#: Bytes of classes that a task takes in a round, about; vectors of counts that are added up by one task, or by the driver.
TASK_BYTES, FAN_IN = 16 << 20, 64
#: The end of a text, as a word.
END = np.int64(-6148914691236517206)
#: Tokens that one forward or backward pass takes together, about, and tokens whose probabilities are held at once.
PASS_TOKENS, SEGMENT_TOKENS = 1 << 20, 1 << 16


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a run of texts, and where each text's words begin."""
    data = LOWER[data]
    s, e, doc = words_of(data, offs)
    return span_hash(prefix_hash(data), s, e).view(np.int64), np.searchsorted(doc, np.arange(len(offs)))


def classes_of(words: np.ndarray, classes: int) -> np.ndarray:
    return (words.view(np.uint64) % U(classes)).astype(np.uint16)


def _prepare(docs: DataFrame, classes: int) -> DataFrame:
    """The classes of each training text's words, two bytes a word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in steps(batch.column("text")):
                w, at = word_hashes(data, offs)
                raw = classes_of(w, classes).tobytes()
                cut_at = pa.py_buffer((2 * at).astype(np.int32).tobytes())
                col = pa.Array.from_buffers(pa.binary(), hi - lo, [None, cut_at, pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([col], names=["classes"])

    return docs.filter(~is_fold("doc_id", 1)).select("text").mapInArrow(run, "classes binary")


def count_words(docs: DataFrame) -> DataFrame:
    """word (hash), n: tokens of the training texts, ends included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_w, held_n, held = [], [], 0

        def merge():
            w, inv = np.unique(np.concatenate(held_w), return_inverse=True)
            return w, np.bincount(inv, weights=np.concatenate(held_n)).astype(np.int64)

        for batch in batches:
            for lo, hi, data, offs in steps(batch.column("text")):
                w, _ = word_hashes(data, offs)
                w, n = np.unique(np.append(w, np.full(hi - lo, END)), return_counts=True)
                held_w.append(w)
                held_n.append(n)
                held += len(w)
                if held > 1 << 21:
                    w, n = merge()
                    if len(w) > 1 << 20:  # bounded: hand on what there is
                        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n)], names=["word", "n"])
                        held_w, held_n, held = [], [], 0
                    else:
                        held_w, held_n, held = [w], [n], len(w)
        if held_w:
            w, n = merge()
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n)], names=["word", "n"])

    return docs.filter(~is_fold("doc_id", 1)).select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Hmm:
    """Start, transition and emission probabilities over classes; the end is class ``classes``."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def random(cls, states: int, classes: int) -> Hmm:
        rng = np.random.Generator(np.random.PCG64(7))
        move = np.full((states, states), 0.3 / max(1, states - 1)) + np.eye(states) * (0.7 - 0.3 / max(1, states - 1))
        return cls(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), rng.dirichlet(np.ones(classes + 1), states))

    @classmethod
    def from_counts(cls, start, move, emit) -> Hmm:
        norm = lambda x: x / x.sum(axis=-1, keepdims=True)
        return cls(norm(start + 1e-3), norm(move + 1e-3), norm(emit + 1e-3))


def _runs(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Rows by falling length, in groups of about PASS_TOKENS tokens."""
    order = np.argsort(-lengths, kind="stable")
    total = np.cumsum(lengths[order])
    at = 0
    while at < len(order):
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + PASS_TOKENS, "right")))
        yield order[at:end]
        at = end


def _layout(seqs: list[np.ndarray], rows: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the rows (longest first), time by time; and where each time's symbols begin."""
    lengths = np.array([len(seqs[r]) + 1 for r in rows])
    alive = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
    at = np.concatenate(([0], np.cumsum(alive)))
    sym = np.empty(at[-1], np.int32)
    for k, r in enumerate(rows.tolist()):
        place = at[: lengths[k]] + k
        sym[place[:-1]] = seqs[r]
        sym[place[-1]] = end
    return sym, at


def _segments(at: np.ndarray) -> list[tuple[int, int]]:
    """Runs of times with about SEGMENT_TOKENS tokens each."""
    out, lo, last = [], 0, len(at) - 1
    while lo < last:
        hi = min(last, max(lo + 1, int(np.searchsorted(at, at[lo] + SEGMENT_TOKENS, "right")) - 1))
        out.append((lo, hi))
        lo = hi
    return out


def _ahead(hmm: Hmm, move_t: np.ndarray, emit: np.ndarray, sym: np.ndarray, at: np.ndarray, times: tuple[int, int], enter: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward probabilities (states x tokens) of a run of times, the tokens' emissions and their scales."""
    lo, hi = times
    base = int(at[lo])
    b = np.take(emit, sym[base : at[hi]], axis=1)
    alpha, scale = np.empty_like(b), np.empty(b.shape[1], b.dtype)
    prev, places = enter, (at[lo : hi + 1] - base).tolist()
    for x, y in zip(places[:-1], places[1:], strict=True):
        a = alpha[:, x:y]
        np.multiply(hmm.start.astype(b.dtype)[:, None] if prev is None else move_t @ prev[:, : y - x], b[:, x:y], out=a)
        c = scale[x:y]
        np.add.reduce(a, axis=0, out=c)
        np.divide(a, c, out=a)
        prev = a
    return alpha, b, scale


def forward(hmm: Hmm, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each sequence with its end, by the scaled forward recursion."""
    out = np.zeros(len(seqs))
    move_t, end = np.ascontiguousarray(hmm.move.T), hmm.emit.shape[1] - 1
    for rows in _runs(np.array([len(s) + 1 for s in seqs], np.int64)) if seqs else ():
        sym, at = _layout(seqs, rows, end)
        ll, enter = np.zeros(len(rows)), None
        for lo, hi in _segments(at):
            alpha, _, scale = _ahead(hmm, move_t, hmm.emit, sym, at, (lo, hi), enter)
            np.log10(scale, out=scale)
            places = (at[lo : hi + 1] - at[lo]).tolist()
            for x, y in zip(places[:-1], places[1:], strict=True):
                ll[: y - x] += scale[x:y]
            enter = alpha[:, places[-2] :].copy()
        out[rows] = ll
    return out


def expect(hmm: Hmm, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts (start, move, emit) of one Baum-Welch step over the sequences.

    Probabilities are 32-bit (they are scaled at every token), sums 64-bit. Only
    the states that enter a run of times are kept over a sequence; the rest is
    computed again on the way back, so memory does not grow with its length
    but for the symbols and one vector for each ``SEGMENT_TOKENS`` tokens.
    """
    k, m = hmm.emit.shape
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, m))
    by_class, forth = hmm.emit.astype(np.float32), hmm.move.astype(np.float32)
    move_t = np.ascontiguousarray(forth.T)
    for rows in _runs(np.array([len(s) + 1 for s in seqs], np.int64)) if seqs else ():
        sym, at = _layout(seqs, rows, m - 1)
        times, entries = _segments(at), [None]
        for part in times[:-1]:
            alpha = _ahead(hmm, move_t, by_class, sym, at, part, entries[-1])[0]
            entries.append(alpha[:, at[part[1] - 1] - at[part[0]] :].copy())
        beta, after = np.ones((k, len(rows)), np.float32), np.zeros((k, 0), np.float32)  # after: scaled emissions of the next time
        for (lo, hi), enter in zip(reversed(times), reversed(entries), strict=True):
            alpha, b, scale = _ahead(hmm, move_t, by_class, sym, at, (lo, hi), enter)
            b /= scale
            places, pairs = (at[lo : hi + 1] - at[lo]).tolist(), np.zeros((k, k), np.float32)
            for x, y in zip(reversed(places[:-1]), reversed(places[1:]), strict=True):
                n = after.shape[1]
                if n:
                    w = after * beta[:, :n]
                    pairs += alpha[:, x : x + n] @ w.T
                    beta[:, :n] = forth @ w
                alpha[:, x:y] *= beta[:, : y - x]  # the state's probability at this time
                after = b[:, x:y]
            after = after.copy()
            move += hmm.move * pairs
            if lo == 0:
                start += alpha[:, : at[1]].sum(axis=1, dtype=np.float64)
            own = sym[at[lo] : at[hi]]
            for s in range(k):
                emit[s] += np.bincount(own, alpha[s], minlength=m)
    return start, move, emit


def _sequences(col: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint16) for x in col]


def _baum_welch(prepared: DataFrame, hmm: Hmm, tasks: int) -> Hmm:
    """One round over all partitions, ``tasks`` at most: a vector of counts from each, added up FAN_IN at a time."""
    k, m = hmm.emit.shape
    model = prepared.sparkSession.sparkContext.broadcast((hmm.start, hmm.move, hmm.emit))
    flat = lambda counts: np.concatenate([x.reshape(-1) for x in counts])
    row = lambda x: pa.RecordBatch.from_arrays([pa.array([x.astype("<f4").tobytes()], pa.binary())], names=["counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = Hmm(*model.value), None
        for batch in batches:
            got = flat(expect(own, _sequences(batch.column("classes"))))
            total = got if total is None else total + got
        if total is not None:
            yield row(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("counts"):
                own = np.frombuffer(x.as_buffer(), "<f4").astype(float)
                total = own if total is None else total + own
        if total is not None:
            yield row(total)

    got = prepared.coalesce(tasks).mapInArrow(run, "counts binary")
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        got = got.repartition(tasks).mapInArrow(add, "counts binary")
    total = sum(np.frombuffer(r["counts"], "<f4").astype(float) for r in got.collect())  # FAN_IN rows at most
    model.destroy()
    return Hmm.from_counts(total[:k], total[k : k + k * k].reshape(k, k), total[k + k * k :].reshape(k, m))


def train(prepared: DataFrame, states: int = STATES, classes: int = CLASSES, rounds: int = ROUNDS) -> Hmm:
    hmm = Hmm.random(states, classes)
    n_bytes = prepared.agg(F.sum(F.octet_length("classes") + F.lit(2).cast("long"))).first()[0]
    tasks = max(2 * prepared.sparkSession.sparkContext.defaultParallelism, (n_bytes or 0) // TASK_BYTES)
    for _ in range(0 if n_bytes is None else START_ROUNDS + rounds):
        hmm = _baum_welch(prepared, hmm, tasks)
    return hmm


def score(docs: DataFrame, states: int = STATES, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    counts = cut(count_words(docs))
    hmm = train(cut(_prepare(docs, classes)), states, classes, rounds)
    sums = counts.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    v, total = sums["v"], sums["n"] or 0
    unseen = 0.5 / (total + 0.5 * (v + 1))
    # U(class): its words' probabilities and that of an unknown word, so that P(. | state) sums to 1 over words and one unknown word a class
    by_class = counts.filter(F.col("word") != int(END)).groupBy(F.expr(f"cast(pmod(cast(word as decimal(20,0)), {1 << 64}) % {classes} as int)").alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    u = np.full(classes + 1, unseen)
    u[by_class["c"].to_numpy(int)] += ((by_class["n"] + 0.5 * by_class["v"]) / (total + 0.5 * (v + 1))).to_numpy(float)
    ends = counts.filter(F.col("word") == int(END)).first()
    n_ends = ends["n"] if ends else 0
    u[classes] = (n_ends + 0.5) / (total + 0.5 * (v + 1))
    common = frequent(counts.filter(F.col("word") != int(END)), COMMON).toPandas().sort_values("word")
    model = spark.sparkContext.broadcast((hmm.start, hmm.move, hmm.emit, np.log10(u), common["word"].to_numpy(np.int64), common["n"].to_numpy(np.int64)))
    denominator, end_known = float(total + 0.5 * (v + 1)), n_ends > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit, log_u, words, n = model.value
        own, log_p = Hmm(start, move, emit), np.log10((n + 0.5) / denominator)
        log_end = np.log10((n_ends + 0.5) / denominator)
        for batch in batches:
            for lo, hi, data, offs in steps(batch.column("text"), 8 << 20):
                w, at = word_hashes(data, offs)
                rows = hi - lo
                doc = np.repeat(np.arange(rows), np.diff(at))
                c = classes_of(w, emit.shape[1] - 1)
                hmm_score = forward(own, [c[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
                hmm_score -= np.bincount(doc, log_u[c], minlength=rows) + log_u[-1]
                if len(words):
                    k = np.minimum(np.searchsorted(words, w), len(words) - 1)
                    known = words[k] == w
                else:
                    k, known = np.zeros(len(w), np.int64), np.zeros(len(w), bool)
                base = np.bincount(doc[known], log_p[k[known]], minlength=rows) + log_end
                seen = np.bincount(doc[known], minlength=rows) + int(end_known)
                # tokens outside the common words, as (word, times) of each text
                tail, tail_doc = w[~known], doc[~known]
                o = np.lexsort((tail, tail_doc))
                tail, tail_doc = tail[o], tail_doc[o]
                new = np.flatnonzero(np.concatenate(([True], (tail[1:] != tail[:-1]) | (tail_doc[1:] != tail_doc[:-1])))) if len(tail) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(tail)))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(tail_doc[new], np.arange(rows + 1)), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(tail[new]), pa.array(times.astype(np.int32))], names=["word", "times"]),
                )
                part = batch.slice(lo, rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(np.diff(at) + 1), pa.array(seen.astype(np.int64)), pa.array(base), pa.array(hmm_score), lists], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "more", "tail"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", is_fold("doc_id", 1).alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, more double, tail array<struct<word: long, times: int>>"
    )
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()))
    tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.*").join(counts, "word", "left")
    log_tail = F.log10((F.coalesce("n", F.lit(0)) + F.lit(0.5)) / F.lit(denominator))
    tail = tail.groupBy("row").agg(F.sum(log_tail * F.col("times")).alias("tail_score"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("tail_known"))
    out = scored.drop("tail").join(tail, "row", "left")
    base = F.col("base") + F.coalesce("tail_score", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("more")).alias("score"))
