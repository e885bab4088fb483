"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary.

Every language has a probability for each piece of the vocabulary (A-Z lower-cased, without its space mark) and for each single byte. A word's probability under
a language is the sum over all its segmentations into pieces, of any length, of
the product of the pieces' probabilities, by a forward recursion over byte
positions; pieces never cross blanks, so a text's log probability is the sum
over its words. The best language wins; ``score`` is its posterior under equal
priors.

Training: expectation-maximisation of the piece probabilities over word counts
of at most ``TRAIN_DOCS`` labelled texts for each language (the first by hash of
doc_id, then of the text; repeated rows are one; whole texts, words of any
length), a task for each language; ``ROUNDS`` rounds from uniform probabilities.
The sample is chosen by hashes in two steps, so neither texts nor all rows of a
language meet in one task. All languages are learned; a language is a column of
about 180 KB in the broadcast matrix.

Prediction: distinct words of a run of texts are scored once, under ``LANGS``
languages at a time; words that a worker has seen lately are looked up
(``CACHE`` times ``LANGS`` scores at most).

Defined results: ``und`` with score 0 if the text is null or has no letters
(Unicode categories L*), or if nothing was learned; ties go to the language
first by code point; rows are judged each for itself; a null doc_id counts as
the text '' in the split; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations


from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, LOWER, cut, is_fold, prefix_hash, span_hash, steps, text_buffers, words_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
TRAIN_DOCS, ROUNDS, SALTS = 300, 4, 64
CACHE, LANGS = 1 << 18, 16
#: Hashes of chosen texts that are sent to every task at most.
SENT = 200_000
#: Pseudo-count of every piece in every language.
SMOOTH = 0.05


class Pieces:
    """The vocabulary's pieces of 2 bytes or more (ids from 256; single bytes are ids 0..255) and their prefixes, by length and hash."""

    def __init__(self, texts: list[bytes]):
        self.texts = sorted({t for t in texts if len(t) > 1})
        self.n = 256 + len(self.texts)
        ids = {t: 256 + k for k, t in enumerate(self.texts)}
        self.longest = max(map(len, self.texts), default=1)
        #: For each length, the sorted hashes of all prefixes of that length, and the piece that a prefix is (or -1).
        self.tables = []
        for n in range(2, self.longest + 1):
            own = sorted({t[:n] for t in self.texts if len(t) >= n})
            at = n * np.arange(len(own) + 1)
            h = span_hash(prefix_hash(np.frombuffer(b"".join(own), np.uint8)), at[:-1], at[1:])
            o = np.argsort(h)
            self.tables.append((h[o], np.array([ids.get(t, -1) for t in own], np.int64)[o]))


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return Pieces([sp.id_to_piece(i).replace("▁", "").encode().lower() for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))])


def lattice(data: np.ndarray, start: np.ndarray, end: np.ndarray, known: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All edges of the words' lattices: (word, from, to, piece), ``from`` and ``to`` relative to the word."""
    h = prefix_hash(data)
    size = end - start
    word = np.repeat(np.arange(len(start)), size)
    p = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    at, left = start[word] + p, size[word] - p
    out = [(word, p, p + 1, data[at].astype(np.int64))]
    f = np.arange(len(word))
    for n, (keys, ids) in enumerate(known.tables, 2):
        f = f[left[f] >= n]
        if not len(f):
            break
        x = span_hash(h, at[f], at[f] + n)
        k = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        on = keys[k] == x  # only what some longer piece begins with is looked at further
        f, k = f[on], k[on]
        hit = ids[k] >= 0
        g = f[hit]
        out.append((word[g], p[g], p[g] + n, ids[k[hit]]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _by_step(key: np.ndarray, *cols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    o = np.argsort(key, kind="stable")
    return np.searchsorted(key[o], np.arange(int(key.max()) + 2 if len(key) else 1)), [c[o] for c in cols]


def word_scores(data: np.ndarray, start: np.ndarray, end: np.ndarray, prob: np.ndarray, known: Pieces) -> np.ndarray:
    """Natural log of each word's probability under each language (rows: words). ``prob``: pieces x languages."""
    n, langs = len(start), prob.shape[1]
    out = np.zeros((n, langs))
    size = end - start
    for rows in _groups(size):
        word, a, b, piece = lattice(data, start[rows], end[rows], known)
        at, (word, a, piece) = _by_step(b, word, a, piece)
        longest = int(size[rows].max())
        turn = min(known.longest, longest) + 1
        alpha = np.zeros((turn, len(rows), langs))  # of the last positions, in turn
        alpha[0] = 1
        scale = np.zeros(len(rows))
        for t in range(1, longest + 1):
            x, y = at[t], at[t + 1]
            w = word[x:y]
            part = alpha[a[x:y] % turn, w] * prob[piece[x:y]]
            new = np.zeros((len(rows), langs))
            for k in range(langs):
                new[:, k] = np.bincount(w, part[:, k], minlength=len(rows))
            alpha[t % turn] = new
            low = np.flatnonzero((new.max(axis=1) < 1e-100) & (new.max(axis=1) > 0))
            if len(low):  # keep within range: all positions of the word share one scale
                alpha[:, low] *= 1e100
                scale[low] -= np.log(1e100)
            done = np.flatnonzero(size[rows] == t)
            out[rows[done]] = np.log(np.maximum(alpha[t % turn, done], 1e-300)) + scale[done, None]
    return out


def _groups(size: np.ndarray, most: int = 1 << 18) -> Iterator[np.ndarray]:
    """Words by length, in groups whose number times their greatest length is bounded (a longer word is alone)."""
    order = np.argsort(size, kind="stable")
    size, at = size[order], 0
    while at < len(order):
        own = size[at : at + most]
        stop = at + max(1, int(np.searchsorted(own * np.arange(1, len(own) + 1), most, "right")))
        yield order[at:stop]
        at = stop


def piece_counts(data: np.ndarray, start: np.ndarray, end: np.ndarray, weight: np.ndarray, prob: np.ndarray, known: Pieces) -> np.ndarray:
    """Expected number of times that each piece is used, words weighted (one language: ``prob`` is a vector).

    Sums over beginnings and ends are kept as logarithms, so a word may have any length.
    """
    out = np.zeros(len(prob))
    size = end - start
    for rows in _groups(size):
        lo, hi = int(start[rows].min()), int(end[rows].max())
        word, a, b, piece = lattice(data[lo:hi], start[rows] - lo, end[rows] - lo, known)
        longest = int(size[rows].max())
        ahead = np.zeros((longest + 1, len(rows)))
        at, (w, i, q) = _by_step(b, word, a, piece)
        for t in range(1, longest + 1):
            s = slice(at[t], at[t + 1])
            last = ahead[t - 1]
            new = np.bincount(w[s], np.exp(ahead[i[s], w[s]] - last[w[s]]) * prob[q[s]], minlength=len(rows))
            ahead[t] = last + np.log(np.where(new > 0, new, 1))  # a word that has ended has no more edges
        back = np.zeros_like(ahead)
        at, (w, j, q) = _by_step(a, word, b, piece)
        for t in range(longest - 1, -1, -1):
            s = slice(at[t], at[t + 1])
            last = back[t + 1]
            new = np.bincount(w[s], np.exp(back[j[s], w[s]] - last[w[s]]) * prob[q[s]], minlength=len(rows))
            back[t] = last + np.log(np.where(new > 0, new, 1))
        use = np.exp(ahead[a, word] + back[b, word] - ahead[size[rows], np.arange(len(rows))][word]) * prob[piece]
        out += np.bincount(piece, use * weight[rows][word], minlength=len(prob))
    return out


def word_counts(texts: DataFrame) -> DataFrame:
    """texts(lang, text) -> lang, word (its bytes in lower case), n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in steps(batch.column("text")):
                s, e, doc = words_of(data, offs)
                at = np.concatenate(([0], np.cumsum(e - s))).astype(np.int32)
                words = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(LOWER[data[~BLANK[data]]].tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(lo, hi - lo).take(pa.array(doc)), words], names=["lang", "word"])

    return texts.select("lang", "text").mapInArrow(run, "lang string, word binary").groupBy("lang", "word").agg(F.count("*").alias("n"))


def sample(docs: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """lang, text of the rows to learn from: ``most`` different ones for each language."""
    own = docs.filter(~is_fold("doc_id", 0) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    own = own.select("lang", "text", F.xxhash64("doc_id", F.lit(29)).alias("__h"), F.xxhash64("text", F.lit(31)).alias("__t"))
    # the first by hash: of each share of a language, then of those; hashes only, the partial steps keep ``most`` rows a task
    first = own.select("lang", "__h", "__t", F.pmod("__t", F.lit(SALTS)).alias("salt"))
    for by in (("lang", "salt"), ("lang",)):
        first = first.withColumn("n", F.dense_rank().over(Window.partitionBy(*by).orderBy("__h", "__t"))).filter(F.col("n") <= most).drop("n").distinct()
    first = cut(first.drop("salt"))
    # a few hundred hashes a language: sent to the texts as long as they are few, so that no text is exchanged
    few = first.count() <= SENT
    chosen = own.join(F.broadcast(first) if few else first, ["lang", "__h", "__t"], "left_semi")
    return chosen.dropDuplicates(["lang", "__h", "__t"]).select("lang", "text")


def learn(words: pa.Array, n: np.ndarray, known: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """The piece probabilities of one language from its words (bytes) and their counts."""
    order = np.lexsort((np.arange(len(words)), np.asarray(pc.binary_length(words))))
    data, offs = text_buffers(words.take(pa.array(order)))
    data, offs = data[offs[0] : offs[-1]], offs - offs[0]
    prob = np.full(known.n, 1 / known.n)
    for _ in range(rounds):
        c = piece_counts(data, offs[:-1], offs[1:], n[order], prob, known) + SMOOTH
        prob = c / c.sum()
    return prob


def fit(docs: DataFrame, path: str = VOCABULARY) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order, and pieces x languages probabilities."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(pieces(path))
    texts = cut(sample(docs))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("word")
        prob = learn(t.column("word").combine_chunks(), np.asarray(t.column("n"), float), vocabulary.value)
        return pa.table({"lang": t.column("lang").slice(0, 1), "prob": pa.array([prob.tolist()], pa.list_(pa.float64()))})

    got = {r["lang"]: r["prob"] for r in word_counts(texts).groupBy("lang").applyInArrow(run, "lang string, prob array<double>").collect()}
    # a language whose texts have no words is learned as uniform
    langs = sorted(r["lang"] for r in texts.select("lang").distinct().collect())
    n = vocabulary.value.n
    return langs, np.array([got.get(lang) or [1 / n] * n for lang in langs]).reshape(len(langs), n).T


_letters = r"\p{L}"


def _looked_up(h: np.ndarray, known: np.ndarray, value: np.ndarray, most: int, score: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The scores of words by their hashes, and what is known then; ``score`` gives those of new words by position."""
    got = np.empty((len(h), value.shape[1]))
    k = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
    hit = known[k] == h if len(known) else np.zeros(len(h), bool)
    got[hit] = value[k[hit]]
    new = np.flatnonzero(~hit)
    got[new] = score(new)
    if len(h) + len(known) <= most:
        known, value = np.concatenate((known, h[new])), np.concatenate((value, got[new]))
    elif len(h) <= most:
        known, value = h, got
    else:
        known, value = h[:most], got[:most]
    o = np.argsort(known)
    return got, (known[o], value[o])


def predict(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """docs(doc_id, text, lang) -> doc_id, held_out, lang_pred, score."""
    langs, prob = fit(docs.select("doc_id", "text", "lang"), path)
    model = docs.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray(prob), pieces(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prob, known = model.value
        blocks = [slice(k, min(k + LANGS, len(langs))) for k in range(0, len(langs), LANGS)]
        seen = [(np.zeros(0, np.uint64), np.zeros((0, b.stop - b.start))) for b in blocks]
        for batch in batches:
            for lo, hi, data, offs in steps(batch.column("text")):
                rows = hi - lo
                part = batch.slice(lo, rows)
                low = LOWER[data]
                s, e, doc = words_of(low, offs)
                h, one, inv = np.unique(span_hash(prefix_hash(low), s, e), return_index=True, return_inverse=True)
                total = np.zeros((rows, max(1, len(langs))))
                for k, block in enumerate(blocks):
                    got, seen[k] = _looked_up(h, *seen[k], CACHE // len(blocks), lambda new: word_scores(low, s[one[new]], e[one[new]], prob[:, block], known))  # noqa: B023
                    for j in range(got.shape[1]):
                        total[:, block.start + j] = np.bincount(doc, got[inv, j], minlength=rows)
                best = total.argmax(axis=1)
                post = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                has = np.asarray(pc.fill_null(pc.match_substring_regex(part.column("text"), _letters), False))
                ok = has & bool(langs)
                pred = pa.array([langs[b] if o else "und" for b, o in zip(best.tolist(), ok.tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pred, pa.array(np.where(ok, post, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", is_fold("doc_id", 0).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
