"""SentencePiece encoding and decoding on a relational lattice.

A text is cut into words that together are the text: between two bytes that
stand side by side in no piece of the vocabulary (and never inside a
character). No piece crosses such a place, so the best segmentation of a text
is that of its words, whatever they are: runs of spaces, unspaced scripts and
long strings stay whole as far as pieces reach. Distinct words are encoded once:

1. Each word's substrings of up to the longest piece's characters are exploded
   and equi-joined to the piece table (a fixed vocabulary: broadcast).
2. The edges are grouped by word. Words are hash-dealt before the explosion, so
   grouping them needs no further exchange.
3. A higher-order ``aggregate`` folds Viterbi over the edges in order of their
   ends: the best sum of piece scores, ties to the later start, then the
   greater id. Characters outside the vocabulary are their UTF-8 bytes' pieces.
   An edge is one long (end, length, cost, id), and so is the best way to an
   end (sum, length, id): this vocabulary's scores are whole numbers, costs are
   their negatives.

Spark's fold copies its state for each edge, which is quadratic; a word of more
than ``FOLD`` characters takes the same recurrence with the same ties in a
worker, in time and memory linear in the word (``viterbi``).

The result is the segmentation of the greatest sum of scores. The vocabulary
that is used is a BPE one whose scores are minus ranks: its own tokenizer merges
greedily and puts a space mark before the text, so its ids differ from these.

Texts are put together from the words. The most frequent words go to every task,
as far as they take ``COMMON`` bytes together (a fixed bound); every other word
is a row of its own that is joined to its encoding. Rows are numbered once, in a
checkpoint. No text is shuffled. Words are found by 64-bit hashes and compared
byte by byte with what their ids decode to; a word without encoding stops the job.

Defined results: null is the empty text, with no pieces and one empty part;
every other text decodes to itself, whatever its characters (the mark U+2581 is
encoded by its bytes); each row has parts of its own, so repeated rows and null
doc_ids are no special case; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, cut, mix, prefix_hash, span_hash, steps, text_buffers

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of the words that go to every task (with 16 more for each).
COMMON = 8 << 20
#: Characters of the longest word that Spark's fold takes.
FOLD = 4096
#: Characters of the words whose lattices a task builds.
TASK_CHARS = 1 << 19
#: Bytes of text that are cut into words and counted together.
COUNT_BYTES = 4 << 20
#: Score of a character that is given by its bytes; pieces below it are never used.
BYTES_SCORE = -10_000_000


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[list[tuple[str, int, int]], list[bytes], int]:
    """(piece text, id, score) of all ordinary pieces; the bytes of every id; the id of byte 0."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    table, raw, byte0 = [], [b""] * sp.vocab_size(), -1
    for i in range(sp.vocab_size()):
        if sp.is_byte(i):
            value = int(sp.id_to_piece(i)[3:5], 16)
            raw[i] = bytes([value])
            byte0 = i if value == 0 else byte0
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            text = sp.id_to_piece(i).replace("▁", " ")
            raw[i] = text.encode()
            if sp.get_score(i) > BYTES_SCORE:
                table.append((text, i, int(sp.get_score(i))))
    if any(s != sp.get_score(i) or not BYTES_SCORE < s <= 0 or i >= 65535 or len(t) > 255 for t, i, s in table):
        raise ValueError("scores must be whole numbers, ids below 65535, and pieces of 255 characters at most")
    return table, raw, byte0


def inside(path: str) -> np.ndarray:
    """256 x 256: whether two bytes stand side by side in some piece."""
    out = np.zeros((256, 256), bool)
    for text, _, _ in vocabulary(path)[0]:
        b = np.frombuffer(text.encode(), np.uint8)
        out[b[:-1], b[1:]] = True
    return out


def pieces(spark: SparkSession, path: str = VOCABULARY) -> DataFrame:
    return spark.createDataFrame(vocabulary(path)[0], "piece string, id int, score int")


def lattice(words: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """words(word) distinct -> word, edges (sorted by end, length).

    A task takes words of about ``TASK_CHARS`` characters: each of them becomes
    up to a piece's length of rows, which AQE can't see in the words' bytes.
    """
    table = vocabulary(path)[0]
    longest = max(len(t) for t, _, _ in table)
    n_chars = words.agg(F.sum(F.length("word"))).first()[0] or 0
    w = words.select("word").repartition(1 + n_chars // TASK_CHARS, "word").withColumn("n", F.length("word"))
    starts = w.withColumn("frm", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    subs = starts.select("word", "frm", F.explode(F.expr(f"sequence(frm + 1, least(n, frm + {longest}))")).alias("end"))
    subs = subs.withColumn("piece", F.expr("substring(word, frm + 1, end - frm)"))
    hits = subs.join(F.broadcast(pieces(words.sparkSession, path)), "piece", "left").filter("id is not null or end = frm + 1")
    high = F.shiftleft(F.col("end").cast("long"), 48).bitwiseOR(F.shiftleft((F.col("end") - F.col("frm")).cast("long"), 40))
    low = F.shiftleft(-F.coalesce("score", F.lit(BYTES_SCORE)).cast("long"), 16).bitwiseOR(F.coalesce("id", F.lit(-1)) + 1)
    return hits.select("word", high.bitwiseOR(low).alias("edge")).groupBy("word").agg(F.sort_array(F.collect_list("edge")).alias("edges"))


#: Viterbi: ``done`` has the best (2**38 - cost, 255 - length, id + 1) of every end before ``at``; ``best`` is that of ``at``.
_FOLD = """
aggregate(edges,
  named_struct('at', 1L, 'best', 0L, 'done', cast(array() as array<bigint>)),
  (a, e) -> transform(array(if(shiftright(e, 48) > a.at, concat(a.done, array(a.best)), a.done)), d ->
    named_struct('at', shiftright(e, 48), 'best', greatest(if(shiftright(e, 48) > a.at, 0L, a.best),
      shiftleft(if(shiftright(e, 48) = (shiftright(e, 40) & 255), 274877906944L, shiftright(d[cast(shiftright(e, 48) - (shiftright(e, 40) & 255) as int) - 1], 24)) - (shiftright(e, 16) & 16777215), 24)
      | shiftleft(255 - (shiftright(e, 40) & 255), 16) | (e & 65535)), 'done', d))[0],
  a -> concat(a.done, array(a.best)))"""
#: The path from the last end back to 0.
_BACK = """
aggregate(sequence(size(path), 1, -1),
  named_struct('at', size(path), 'ids', cast(array() as array<int>)),
  (s, p) -> if(p = s.at, named_struct('at', s.at - 255 + cast(shiftright(path[p - 1], 16) & 255 as int), 'ids', concat(if(path[p - 1] & 65535 > 0, array(cast(path[p - 1] & 65535 as int) - 1),
    transform(sequence(1, octet_length(substring(word, p, 1))), k -> cast(conv(substring(hex(encode(substring(word, p, 1), 'UTF-8')), 2 * k - 1, 2), 16, 10) as int) + {byte0})), s.ids)), s),
  s -> s.ids)"""


def viterbi(word: str, best_piece: dict[str, tuple[int, int]], longest: int, byte0: int) -> list[int]:
    """The ids of one word, by the recurrence of the fold."""
    low, way = [0], [(0, 0)]
    for end in range(1, len(word) + 1):
        found = None
        for n in range(1, min(longest, end) + 1):  # rising length: ties go to the later start
            hit = best_piece.get(word[end - n : end])
            if hit is None and n > 1:
                continue
            score, i = (BYTES_SCORE, -1) if hit is None else hit
            cost = low[end - n] - score
            if found is None or cost < found[0]:
                found = (cost, n, i)
        low.append(found[0])
        way.append(found[1:])
    out, at = [], len(word)
    while at:
        n, i = way[at]
        out.append([i] if i >= 0 else [byte0 + b for b in word[at - n : at].encode()])
        at -= n
    return [i for x in reversed(out) for i in x]


def _encode_long(words: DataFrame, path: str) -> DataFrame:
    table, _, byte0 = vocabulary(path)
    best: dict[str, tuple[int, int]] = {}
    for text, i, score in table:
        best[text] = max(best.get(text, (score, i)), (score, i))
    model = words.sparkSession.sparkContext.broadcast((best, max(map(len, best)), byte0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [viterbi(w.as_py(), *model.value) for w in batch.column("word")]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return words.select("word").mapInArrow(run, "word string, ids array<int>")


def encode_words(words: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """words(word) distinct, not empty -> word, ids."""
    best = lattice(words.filter(F.length("word") <= FOLD), path).select("word", F.expr(_FOLD).alias("path"))
    short = best.select("word", F.expr(_BACK.format(byte0=vocabulary(path)[2])).alias("ids"))
    return short.union(_encode_long(words.filter(F.length("word") > FOLD), path))


def tokens(data: np.ndarray, offs: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Where the words of a run of texts begin; ``pairs`` as of ``inside``."""
    if not len(data):
        return np.zeros(0, np.int64)
    start = np.zeros(len(data), bool)
    start[1:] = ~pairs[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
    start[offs[:-1][np.diff(offs) > 0]] = True
    return np.flatnonzero(start)


def _gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[at : at + size], one after the other."""
    to = np.cumsum(size)
    return flat[np.arange(to[-1] if len(to) else 0) + np.repeat(at - to + size, size)]


def _id_hashes(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ids."""
    at = 2 * np.concatenate(([0], np.cumsum(size)))
    return span_hash(prefix_hash(flat.astype("<u2").view(np.uint8)), at[:-1], at[1:])


def word_marks(id_hash: np.ndarray, index: np.ndarray) -> np.ndarray:
    """63 bits for each word of a text, of its ids and its place among the words."""
    return (mix(id_hash + mix(index.astype(np.uint64) + U(1))) & U((1 << 63) - 1)).view(np.int64)


class Dictionary:
    """Encodings of words by their hash, with what they decode to, as flat arrays."""

    def __init__(self, words: pa.Array, flat: np.ndarray, size: np.ndarray, raw: list[bytes]):
        """``flat`` has the ids of all words one after the other, ``size`` of them each."""
        data, offs = text_buffers(words)
        h = span_hash(prefix_hash(data[offs[0] : offs[-1]]), offs[:-1] - offs[0], offs[1:] - offs[0]) if len(words) else np.zeros(0, np.uint64)
        o = np.argsort(h)
        self.piece_size = np.array([len(x) for x in raw], np.int64)
        self.piece_at, self.piece_bytes = np.cumsum(self.piece_size) - self.piece_size, np.frombuffer(b"".join(raw), np.uint8)
        self.keys, self.size, self.at = h[o], size[o], (np.cumsum(size) - size)[o]
        self.flat, self.id_hash = flat, _id_hashes(flat, size)[o]
        upto = np.concatenate(([0], np.cumsum(self.piece_size[flat])))
        self.n_bytes = upto[self.at + self.size] - upto[self.at]

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for."""
        return _gather(self.piece_bytes, self.piece_at[ids], self.piece_size[ids])

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, whether it is the word: its ids decode to the word's bytes) of each word of a text."""
        if not len(self.keys):
            return np.zeros(len(start), np.int64), np.zeros(len(start), bool)
        h = span_hash(prefix_hash(data), start, end)
        k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = (self.keys[k] == h) & (self.n_bytes[k] == end - start)
        f = np.flatnonzero(hit)
        said = self.decoded(_gather(self.flat, self.at[k[f]], self.size[k[f]]))
        wrong = np.concatenate(([0], np.cumsum(said != _gather(data, start[f], (end - start)[f]))))
        upto = np.concatenate(([0], np.cumsum((end - start)[f])))
        hit[f[wrong[upto[1:]] > wrong[upto[:-1]]]] = False
        return k, hit

    def ids(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the entries, one after the other, and where each entry's begin."""
        return _gather(self.flat, self.at[k], self.size[k]), np.concatenate(([0], np.cumsum(self.size[k])))


def _binary(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Spans of bytes as a binary column."""
    at = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(_gather(data, start, size)))])


def count_words(docs: DataFrame, pairs) -> DataFrame:
    """word, n: how often each word is in the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in steps(batch.column("text"), COUNT_BYTES):
                start = tokens(data, offs, pairs.value)
                end = np.append(start[1:], len(data))[: len(start)]
                _, one, n = np.unique(span_hash(prefix_hash(data), start, end), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([_binary(data, start[one], (end - start)[one]), pa.array(n)], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).select(F.col("word").cast("string").alias("word"), "n")


def most_common(counts: DataFrame, most: int) -> DataFrame:
    """The words whose count reaches the least bar at which they take ``most`` bytes at most, 16 more for each word."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 64).cast("int")
    bins = counts.groupBy(step.alias("b")).agg(F.sum(F.octet_length("word") + F.lit(16).cast("long")).alias("bytes")).collect()
    bar, total = 1 << 20, 0
    for r in sorted(bins, key=lambda r: -r["b"]):  # 4,096 bins at most
        total += r["bytes"]
        if total > most:
            break
        bar = r["b"]
    return counts.filter(step >= bar).select("word")


def _prepare(docs: DataFrame, path: str, most: int) -> tuple:
    """Broadcasts of the byte pairs and of the dictionary of common words, and the encodings of all other words."""
    context = docs.sparkSession.sparkContext
    pairs = context.broadcast(inside(path))
    counts = cut(count_words(docs, pairs))
    often = cut(most_common(counts, most))
    got = encode_words(often, path).toArrow()
    lists = got.column("ids").combine_chunks()
    flat, size = np.asarray(lists.flatten(), np.uint16), np.asarray(lists.value_lengths(), np.int64)
    dictionary = Dictionary(got.column("word").combine_chunks(), flat, size, vocabulary(path)[1])
    del got, lists
    return pairs, context.broadcast(dictionary), encode_words(cut(counts.join(often, "word", "left_anti").select("word")), path)


def _joined(rest: DataFrame, seldom: DataFrame) -> DataFrame:
    """rest(.., word) with ids; a word without encoding stops the job."""
    ids = F.when(F.col("ids").isNull(), F.raise_error(F.lit("a word has no encoding"))).otherwise(F.col("ids"))
    return rest.join(seldom, "word", "left").withColumn("ids", ids)


def encode(docs: DataFrame, path: str = VOCABULARY, most: int = COMMON) -> DataFrame:
    """docs(doc_id, text) -> row, doc_id, part, words, body, ids: the parts of every row's text.

    A run of common words is a part, and so is every other word: a text's ids
    are its parts' in order, and so is its decoding.
    """
    pairs, common, seldom = _prepare(docs, path, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        for batch in batches:
            for lo, hi, data, offs in steps(batch.column("text")):
                start = tokens(data, offs, pairs.value)
                end = np.append(start[1:], len(data))[: len(start)]
                doc = np.searchsorted(offs, start, "right") - 1
                k, hit = known.find(data, start, end)
                new = ~hit
                if len(start):  # a part begins with a text, at a word that is not common, and after one
                    new[0] = True
                    new[1:] |= (doc[1:] != doc[:-1]) | ~hit[:-1]
                begin = np.flatnonzero(new)
                stop = np.append(begin[1:], len(start))[: len(begin)]
                flat, at = known.ids(k[hit])
                upto = at[np.concatenate(([0], np.cumsum(hit)))]  # ids of common words before each word
                out: list[list[dict]] = [[] for _ in range(hi - lo)]
                for d, a, z in zip(doc[begin].tolist(), begin.tolist(), stop.tolist(), strict=True):
                    own = flat[upto[a] : upto[z]].tolist() if hit[a] else None
                    out[d].append({"part": len(out[d]), "words": z - a, "body": data[start[a] : end[z - 1]].tobytes().decode(), "ids": own})
                for parts in out:  # texts without words still have one, empty, part
                    parts or parts.append({"part": 0, "words": 0, "body": "", "ids": []})
                kind = pa.list_(pa.struct([("part", pa.int32()), ("words", pa.int32()), ("body", pa.string()), ("ids", pa.list_(pa.int32()))]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(out, kind)], names=["doc_id", "parts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, parts array<struct<part: int, words: int, body: string, ids: array<int>>>")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    parts = rows.select("row", "doc_id", F.explode("parts").alias("p")).select("row", "doc_id", "p.*")
    rest = _joined(parts.filter("ids is null").drop("ids").withColumnRenamed("body", "word"), seldom).withColumnRenamed("word", "body")
    return parts.filter("ids is not null").unionByName(rest)


def said(batch: pa.RecordBatch, raw: list[bytes]) -> list[bytes]:
    """The bytes that each row's ids stand for."""
    col = batch.column("ids")
    flat = np.asarray(col.flatten()).tolist()
    at = np.concatenate(([0], np.cumsum(np.asarray(col.value_lengths(), np.int64)))).tolist()
    return [b"".join([raw[i] for i in flat[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)]


def decode(parts: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The parts with ``decoded``: the text that their ids stand for."""
    raw = parts.sparkSession.sparkContext.broadcast(vocabulary(path)[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back = pa.array([x.decode("utf-8", "replace") for x in said(batch, raw.value)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, back], names=[*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return parts.mapInArrow(run, f"{schema}, decoded string")


def summary(docs: DataFrame, path: str = VOCABULARY, most: int = COMMON) -> DataFrame:
    """doc_id, n_words, n_pieces, n_bytes, ids_hash, exact for each row, of its encoding and what that decodes to.

    ids_hash adds up ``word_marks`` over the text's words, mod 2**63; n_bytes
    counts decoded bytes; exact: every word's ids decode to its bytes.
    """
    pairs, common, seldom = _prepare(docs, path, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        for batch in batches:
            for lo, hi, data, offs in steps(batch.column("text")):
                start = tokens(data, offs, pairs.value)
                end = np.append(start[1:], len(data))[: len(start)]
                doc = np.searchsorted(offs, start, "right") - 1
                k, hit = known.find(data, start, end)
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                index = np.arange(len(start)) - first[doc]
                mark = np.zeros(len(start), np.int64)
                mark[hit] = word_marks(known.id_hash[k[hit]], index[hit])
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mark.view(np.uint64))))
                h = ((total[first[1:]] - total[first[:-1]]) & U((1 << 63) - 1)).view(np.int64)
                add = lambda x: pa.array(np.bincount(doc[hit], x[k[hit]], minlength=hi - lo).astype(np.int64))
                r = np.flatnonzero(~hit)
                words = pa.StructArray.from_arrays([pa.array(index[r].astype(np.int32)), _binary(data, start[r], (end - start)[r]).cast(pa.string())], names=["at", "word"])
                rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(r, first).astype(np.int32)), words)
                cols = [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(first)), add(known.size), add(known.n_bytes), pa.array(h), rest]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_pieces", "n_bytes", "h", "rest"])

    def add_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, raw = batch.column("ids"), [x.as_buffer().to_pybytes() for x in batch.column("word").cast(pa.binary())]
            size = np.asarray(col.value_lengths(), np.int64)
            back = said(batch, pieces_bytes.value)
            mark = word_marks(_id_hashes(np.asarray(col.flatten()), size), np.asarray(batch.column("at")))
            cols = [batch.column("row"), pa.array(size), pa.array([len(x) for x in back], pa.int64()), pa.array(mark), pa.array([x == y for x, y in zip(back, raw, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "pieces", "bytes", "mark", "ok"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces_bytes = docs.sparkSession.sparkContext.broadcast(vocabulary(path)[1])
    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_pieces long, n_bytes long, h long, rest array<struct<at: int, word: string>>")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    rest = _joined(rows.select("row", F.explode("rest").alias("r")).select("row", "r.*"), seldom)
    rest = rest.select("row", "at", "word", "ids").mapInArrow(add_rest, "row long, pieces long, bytes long, mark long, ok boolean")
    wide = F.col("mark").cast("decimal(38,0)")
    rest = rest.groupBy("row").agg(F.sum("pieces").alias("pieces"), F.sum("bytes").alias("bytes"), F.sum(wide).alias("mark"), F.bool_and("ok").alias("ok"))
    out = rows.drop("rest").join(rest, "row", "left")
    more = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    h = F.expr("cast((h + coalesce(mark, 0BD)) % 9223372036854775808BD as bigint)")
    return out.select("doc_id", "n_words", more("n_pieces", "pieces").alias("n_pieces"), more("n_bytes", "bytes").alias("n_bytes"), h.alias("ids_hash"), F.coalesce("ok", F.lit(True)).alias("exact"))
