"""Quality rules from a suffix array of every document's words.

Word sequences of a run of documents are ranked together by prefix doubling
over the groups that are still tied (the document is part of the first key, so
suffixes of different documents are never tied). The longest common prefixes of
neighbours in the suffix array are found bit by bit, by 64-bit hashes of word
sequences. From the prefix intervals follow, for each word, the longest repeat
that starts there; the union of these spans is the union of all maximal repeats.

A document is kept if it passes the base rules, at most ``max_covered`` of its
words lie in repeats of ``min_repeat`` words or more, and no repeat is longer
than ``max_repeat`` words.

Defined results: a null text has no words (base_failed, not kept); symbols and
lines of a blank text are counted as usual; each row is judged by itself, so
ties and repeated rows are judged alike; an empty table gives an empty result;
other columns are ignored. Arrow batches are worked off in steps of ``STEP_BYTES``, a
longer text alone: it takes about 9 bytes for each of its bytes and 70 for each
of its words, however repetitive it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BLANK, mix, per_row, span_hashes, steps, words_of

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
#: Limits of the suffix-array rule: words of the shortest repeat that counts,
#: share of the words that such repeats may cover, words of the longest repeat.
MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 5, 0.30, 400
#: Neighbours in the suffix array whose common prefixes are found together.
PAIRS = 1 << 18
_FORTH = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_FORTH), -1, 1 << 64))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def longest_repeats(symbols: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest sequence from there that occurs again in its group.

    ``group`` is ascending. Occurrences may overlap.
    """
    n = len(symbols)
    best = np.zeros(n, np.int32 if n < 1 << 30 else np.int64)
    if n < 2:
        return best
    kind = best.dtype
    end = np.searchsorted(group, group, "right").astype(kind)
    order = np.lexsort((symbols, group)).astype(kind)
    x, y = order[1:], order[:-1]
    new = np.flatnonzero(np.concatenate(([True], (symbols[x] != symbols[y]) | (group[x] != group[y]))))
    size = np.diff(np.append(new, n))
    rank = np.empty(n, kind)
    rank[order] = np.repeat(new.astype(kind), size)
    active, h = order[np.repeat(size, size) > 1], 1
    first = rank.copy()
    del order, x, y, new, size
    while len(active):
        key = rank[active].astype(np.int64) * (n + 1)
        inside = np.flatnonzero(active + kind.type(h) < end[active])
        key[inside] += rank[active[inside] + kind.type(h)] + 1
        o = np.argsort(key, kind="stable")
        active, key = active[o], key[o]
        del o, inside
        k1 = (key // (n + 1)).astype(kind)
        s = np.concatenate(([True], key[1:] != key[:-1]))
        g = np.concatenate(([True], k1[1:] != k1[:-1]))
        del key
        begins, heads = np.flatnonzero(s).astype(kind), np.flatnonzero(g).astype(kind)
        size = np.diff(np.append(begins, kind.type(len(active))))
        rank[active] = k1 + np.repeat(begins, size) - np.repeat(heads, np.diff(np.append(heads, kind.type(len(active)))))
        active = active[np.repeat(size, size) > 1]
        del k1, s, g, begins, heads, size
        h *= 2
    sa = np.empty(n, kind)
    sa[rank] = np.arange(n, dtype=kind)
    del rank
    back = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, _BACK))))
    sums = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, _FORTH))))
    sums *= symbols
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(sums)))
    for lo in range(0, n - 1, PAIRS):
        a, b = sa[lo : min(lo + PAIRS, n - 1)], sa[lo + 1 : min(lo + PAIRS, n - 1) + 1]
        tied = first[a] == first[b]
        a, b = a[tied].astype(np.int64), b[tied].astype(np.int64)
        most = np.minimum(end[a] - a, end[b] - b)
        lcp = np.zeros(len(a), np.int64)
        for k in range(int(most.max()).bit_length() - 1 if len(a) else -1, -1, -1):  # the longest equal prefix, bit by bit
            f = np.flatnonzero(lcp + (1 << k) <= most)
            x, y = a[f] + lcp[f], b[f] + lcp[f]
            same = (sums[x + (1 << k)] - sums[x]) * back[x] == (sums[y + (1 << k)] - sums[y]) * back[y]
            lcp[f[same]] += 1 << k
        best[a] = np.maximum(best[a], lcp)
        best[b] = np.maximum(best[b], lcp)
    return best


def covered(best: np.ndarray, least: int, length: int | None = None) -> np.ndarray:
    """Positions in the union of the spans [i, i + best[i]) with best[i] >= least (or of ``length`` each)."""
    n = len(best)
    at = np.flatnonzero(best >= least)
    d = np.bincount(at + (best[at] if length is None else length), minlength=n + 1)
    np.negative(d, out=d)
    d[at] += 1
    return np.cumsum(d, out=d)[:-1] > 0


def measure(data: np.ndarray, offs: np.ndarray, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """Counts for each text of a run."""
    n = len(offs) - 1
    s, e, doc = words_of(data, offs)
    best = longest_repeats(span_hashes(data, s, e), doc)
    rows = lambda flags: np.bincount(doc[flags], minlength=n)
    nl = np.flatnonzero(data == 10)
    a = np.unique(np.concatenate((offs[:-1], nl + 1)))
    a = a[a < len(data)]
    b = np.append(a[1:], len(data))[: len(a)]
    b = b - (data[b - 1] == 10)  # a line does not hold its line feed
    owner = np.searchsorted(offs, a, "right") - 1
    has = np.searchsorted(s, b) > np.searchsorted(s, a)
    a, b, owner = a[has], b[has], owner[has]
    _, first = np.unique(mix(span_hashes(data, a, b) + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)
    dup = np.ones(len(a), bool)
    dup[first] = False
    longest = np.zeros(n, np.int64)
    some = np.flatnonzero(np.diff(doc, prepend=-1))  # the first word of each text that has any
    longest[doc[some]] = np.maximum.reduceat(best, some) if len(some) else 0
    return {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": per_row(~BLANK[data] & ((data & 0xC0) != 0x80), offs),
        "n_symbols": per_row(_SYMBOL[data], offs),
        "n_dup_lines": np.bincount(owner[dup], minlength=n),
        "n_repeat_words": rows(covered(best, WINDOW, WINDOW)),
        "covered_words": rows(covered(best, min_repeat)),
        "longest_repeat": longest,
    }


def verdict(m: dict[str, np.ndarray], max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    return failed, ~failed & (m["covered_words"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_repeat)


def judge(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text) -> doc_id, the counts, base_failed, kept (and the columns ``keep`` as they are)."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in steps(batch.column("text")):
                m = measure(data, offs, min_repeat)
                failed, kept = verdict(m, max_covered, max_repeat)
                rows = batch.slice(lo, hi - lo)
                cols = [rows.column("doc_id"), *(pa.array(m[c], pa.int64()) for c in counts), pa.array(failed), pa.array(kept), *(rows.column(c) for c in keep)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *counts, "base_failed", "kept", *keep])

    d = docs.select("doc_id", "text", *(c for c in keep if c not in ("doc_id", "text")))
    kinds = {f.name: f.dataType.simpleString() for f in d.schema}
    schema = ", ".join([f"doc_id {kinds['doc_id']}", *(f"{c} long" for c in counts), "base_failed boolean", "kept boolean", *(f"`{c}` {kinds[c]}" for c in keep)])
    return d.mapInArrow(run, schema)


def passing(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their columns, in one pass over the texts."""
    cols = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in steps(batch.column("text")):
                m = measure(data, offs)
                yield batch.slice(lo, hi - lo).filter(pa.array(verdict(m)[1]))

    return docs.select(*cols).mapInArrow(run, docs.schema)
