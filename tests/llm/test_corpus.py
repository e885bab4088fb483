"""Operators over the whole corpus against brute force: language model, near-dedup, suffix dedup, mixing, search, pipeline."""

import hashlib
import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperloom.llm import common, components, induced_sort, lm_scoring, minhash, mixing, suffix_dedup, topk_search

from .helpers import documents, fold, low_words, prose, words

ODD = [None, "", "  \n", "one", "A b C d", "w" * 3000, "é漢 \x0b𝄞"]


# ------------------------------------------------------------- language model
def model(rng, k=3, m=6):
    return lm_scoring.Hmm(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(m), k))


def paths(h, x):
    for z in itertools.product(range(len(h.start)), repeat=len(x)):
        p = h.start[z[0]] * h.emit[z[0], x[0]]
        for t in range(1, len(x)):
            p *= h.move[z[t - 1], z[t]] * h.emit[z[t], x[t]]
        yield z, p


def test_recursions_against_all_paths():
    rng = np.random.default_rng(0)
    h = model(rng)
    seqs = [rng.integers(0, 5, n).astype(np.uint16) for n in (0, 3, 1, 4, 3)]
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 6))
    for s, f in zip(seqs, lm_scoring.forward(h, seqs), strict=True):
        x = [*s, 5]
        total = sum(p for _, p in paths(h, x))
        assert abs(f - math.log10(total)) < 1e-9
        for z, p in paths(h, x):
            start[z[0]] += p / total
            for t in range(len(x)):
                emit[z[t], x[t]] += p / total
                if t:
                    move[z[t - 1], z[t]] += p / total
    for got, want in zip(lm_scoring.expect(h, seqs), (start, move, emit), strict=True):
        assert np.allclose(got, want)
    assert len(lm_scoring.forward(h, [])) == 0


def test_scores(spark):
    texts = ODD + [prose(30, k, 40) for k in range(40)] + [prose(30, 3, 40), prose(25, 900)]
    ids = [*range(len(texts) - 1), None]
    got = {r.doc_id: r for r in lm_scoring.score(documents(spark, texts, ids, extra=True), states=3, classes=64, rounds=2).collect()}
    c = Counter(w for i, t in zip(ids, texts, strict=True) if fold(i) != 1 for w in [*low_words(t), None])
    n, v = sum(c.values()), len(c)
    for i, t in zip(ids, texts, strict=True):
        w, r = [*low_words(t), None], got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i) == 1, len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) < 1e-6
        assert math.isfinite(r.score) and r.score < 0


def test_expected_counts_in_segments(monkeypatch):
    """A long sequence is taken in runs of times; the counts are those of the whole."""
    rng = np.random.default_rng(4)
    h = model(rng, 4, 9)
    seqs = [rng.integers(0, 8, n).astype(np.uint16) for n in (3000, 2, 0, 700, 699, 1)]
    want, ll = lm_scoring.expect(h, seqs), lm_scoring.forward(h, seqs)
    monkeypatch.setattr(lm_scoring, "SEGMENT_TOKENS", 64)
    monkeypatch.setattr(lm_scoring, "PASS_TOKENS", 3000)
    assert all(np.allclose(x, y, rtol=1e-4, atol=1e-4) for x, y in zip(lm_scoring.expect(h, seqs), want, strict=True))
    assert np.allclose(lm_scoring.forward(h, seqs), ll, atol=1e-9)
    assert abs(want[2].sum() - sum(len(s) + 1 for s in seqs)) < 0.1 and abs(want[0].sum() - len(seqs)) < 1e-3


def test_score_against_the_formula(spark):
    """Train with brute-force counts of words, then P(word | state) = P(class | state) * U(word) / U(class) over all paths."""
    import pyarrow as pa

    texts = [prose(1 + k % 5, k, 12) for k in range(30)] + [None, " ", "NEW words here"]
    states, classes = 2, 5
    hashes = lambda t: lm_scoring.word_hashes(*common.text_buffers(pa.array([t or ""])))[0] if t else np.zeros(0, np.int64)
    cls = lambda t: lm_scoring.classes_of(hashes(t), classes).tolist()
    train = [t for i, t in enumerate(texts) if fold(i) != 1]
    h = lm_scoring.Hmm.random(states, classes)
    for _ in range(lm_scoring.START_ROUNDS + 2):
        h = lm_scoring.Hmm.from_counts(*lm_scoring.expect(h, [np.array(cls(t), np.uint16) for t in train]))
    c = Counter(w for t in train for w in [*low_words(t), None])
    n, v = sum(c.values()), len(c)
    u = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    by_class = [0.5 / (n + 0.5 * (v + 1))] * classes + [u(None)]
    for w in c:
        if w is not None:
            by_class[cls(w)[0]] += u(w)
    got = {r.doc_id: r.score for r in lm_scoring.score(documents(spark, texts), states, classes, 2).collect()}
    for i, t in enumerate(texts):
        w, x = [*low_words(t), None], [*cls(t), classes]
        seen = np.prod([u(a) / by_class[b] for a, b in zip(w, x, strict=True)])
        assert abs(got[i] - math.log10(sum(p for _, p in paths(h, x)) * seen)) < 2e-3, t


@pytest.mark.parametrize("fan_in", [64, 2])
def test_training_rounds_over_all_texts(spark, fan_in, monkeypatch):
    """Every round is one over all texts: many copies of one text are not all that the start sees, nor beginnings."""
    monkeypatch.setattr(lm_scoring, "FAN_IN", fan_in)
    rng = np.random.default_rng(9)
    seqs = [np.full(3, 1, np.uint16)] * 450 + [np.full(3, 2, np.uint16)] * 450 + [rng.integers(0, 8, 900).astype(np.uint16) for _ in range(3)]
    got = lm_scoring.train(spark.createDataFrame([(bytearray(x.tobytes()),) for x in seqs], "classes binary"), 2, 8, 1)
    want = lm_scoring.Hmm.random(2, 8)
    for _ in range(lm_scoring.START_ROUNDS + 1):
        want = lm_scoring.Hmm.from_counts(*lm_scoring.expect(want, seqs))
    assert all(np.allclose(x, y, atol=1e-3) for x, y in ((got.start, want.start), (got.move, want.move), (got.emit, want.emit)))


def test_scores_without_training_rows(spark):
    held = [i for i in range(100) if fold(i) == 1][:2]
    out = lm_scoring.score(documents(spark, ["a b", None], held)).collect()
    assert {(r.train_tokens, r.n_known, round(r.base_score, 9)) for r in out} == {(0, 0, 0.0)}
    assert lm_scoring.score(documents(spark, [])).count() == 0


def test_score_is_a_distribution(spark):
    """Over all one-word texts of known words, with one unknown word a class, probabilities of first words add up to 1."""
    texts = [prose(20, k, 15) for k in range(20)]
    ids = [i for i in range(200) if fold(i) != 1][:20]
    vocabulary = sorted({w for t in texts for w in low_words(t)})
    held = [i for i in range(1000, 9000) if fold(i) == 1]
    d = documents(spark, [*texts, *vocabulary], [*ids, *held[: len(vocabulary)]])
    out = lm_scoring.score(d, states=2, classes=8, rounds=1).filter("held_out").collect()
    assert 0 < sum(10**r.score for r in out) < 1


# ------------------------------------------------------------- near-duplicates
def shingles(t):
    w = low_words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(ids, texts):
    sets = [shingles(t) for t in texts]
    up = list(range(len(ids)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(ids)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            up[top(a)] = top(b)
    return [min((ids[k] for k in range(len(ids)) if top(k) == top(i) and ids[k] is not None), default=None) if sets[i] else ids[i] for i in range(len(ids))], [len(s) for s in sets]


def family(n, length, edits, seed):
    """Near copies: each with a few words of its own."""
    import random

    base, out = prose(length, seed).split(), []
    for k in range(n):
        rng, w = random.Random(seed * 1000 + k), list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"own{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block, size", [(2048, 8 << 20), (4, 8 << 20), (1, 3000)])
def test_near_duplicates(spark, block, size, monkeypatch):
    """With small blocks, wide buckets are split by a second band and cut into blocks, and nothing is lost."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", size)
    texts = ODD + ["a b C D", "a B c d", "a b c"] + family(12, 200, 2, 1) + family(10, 120, 3, 2) + family(8, 60, 1, 3) + [prose(80, 50)] * 5 + [prose(300, k) for k in range(60, 70)]
    ids = [None if k == 3 else 1000 - k for k in range(len(texts))]
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(documents(spark, texts, ids, extra=True)).collect())
    comp, size = brute_components(ids, texts)
    want = sorted(((i is None, i or 0), n, c, i == c) for i, c, n in zip(ids, comp, size, strict=True))
    assert got == want


def test_wide_bucket_is_not_expanded(spark, monkeypatch):
    """Many texts in one bucket that are not similar: rows stay far below the pairs, and the pairs that are similar are found."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = np.random.default_rng(3)
    n, bands = 300, minhash.n_bands(85)
    sig = rng.integers(0, 2**32, (n, bands * minhash.ROWS), dtype=np.uint32)
    sig[:, : minhash.ROWS] = 7  # all share the first band
    near = [(2 * k, 2 * k + 1) for k in range(60)]
    for a, b in near:
        sig[b] = sig[a]
    keys = minhash.bucket_keys(sig).view(np.int64)
    cls = [k.to_bytes(16, "big") for k in range(n)]
    sets = [rng.integers(0, 2**62, 40).astype(np.uint64) for _ in range(n)]
    for a, b in near:
        sets[b] = np.append(sets[a][:-1], sets[b][:1])
    monkeypatch.setattr(minhash, "signature", lambda x, _, known={np.sort(x).tobytes(): sig[k] for k, x in enumerate(sets)}: known[np.sort(x).tobytes()])
    m = spark.createDataFrame([(int(keys[k, j]), bytearray(cls[k]), bytearray(cls[k])) for k in range(n) for j in range(bands)], "key long, cls binary, label binary")
    m = m.join(m.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "key")
    signed = spark.createDataFrame([(bytearray(cls[k]), 40, bytearray(sig[k].tobytes())) for k in range(n)], "cls binary, n_shingles long, sig binary")
    full = spark.createDataFrame([(bytearray(cls[k]), bytearray(np.sort(sets[k]).tobytes())) for k in range(n)], "cls binary, shingles binary")
    bands_of = spark.createDataFrame([(bytearray(cls[k]), keys[k].tolist()) for k in range(n)], "cls binary, bands array<long>")
    rows: list = []
    pair_blocks = minhash._pair_blocks
    monkeypatch.setattr(minhash, "_pair_blocks", lambda *a: rows.append(x := pair_blocks(*a)) or x)
    got = minhash._across(m, bands_of, signed, full, 85).collect()
    assert {(bytes(r.a), bytes(r.b)) for r in got} == {(cls[a], cls[b]) for a, b in near}
    assert sum(x.count() for x in rows) < 12_000  # 300 * 300 / 16 a bucket, 44,850 pairs


@pytest.mark.parametrize("similarity", [85, 80])
def test_a_bucket_s_width_changes_no_link(spark, similarity, monkeypatch):
    """Pairs that share one band, two or all: the same are found whether their bucket is split or not."""
    rng, bands = np.random.default_rng(5), minhash.n_bands(similarity)
    p = (similarity / 100) ** minhash.ROWS
    assert (1 - p) ** bands + bands * p * (1 - p) ** (bands - 1) <= minhash.BAND_MISS
    n, near = 60, {1: [(0, 1), (2, 3)], 2: [(4, 5), (6, 7)], bands: [(8, 9)]}
    sig = rng.integers(0, 2**32, (n, bands, minhash.ROWS), dtype=np.uint32)
    sig[:, 0] = 7
    sets = [np.sort(rng.integers(0, 2**62, 40).astype(np.uint64)) for _ in range(n)]
    for shared, pairs in near.items():
        for a, b in pairs:
            sig[b], sets[b] = sig[a], np.sort(np.append(sets[a][:-1], sets[b][:1]))
            sig[b, shared:, 2] += 1  # one of five minima differs in each of the other bands
    sig = sig.reshape(n, -1)
    keys = minhash.bucket_keys(sig).view(np.int64)
    cls = [bytearray(k.to_bytes(16, "big")) for k in range(n)]
    monkeypatch.setattr(minhash, "signature", lambda x, _, known={x.tobytes(): sig[k] for k, x in enumerate(sets)}: known[x.tobytes()])
    members = spark.createDataFrame([(int(keys[k, j]), cls[k], cls[k]) for k in range(n) for j in range(bands)], "key long, cls binary, label binary")
    signed = spark.createDataFrame([(cls[k], 40, bytearray(sig[k].tobytes())) for k in range(n)], "cls binary, n_shingles long, sig binary")
    full = spark.createDataFrame([(cls[k], bytearray(sets[k].tobytes())) for k in range(n)], "cls binary, shingles binary")
    bands_of = spark.createDataFrame([(cls[k], keys[k].tolist()) for k in range(n)], "cls binary, bands array<long>")
    for block in (4, 2048):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = minhash._across(members, bands_of, signed, full, similarity).collect()
        assert {(bytes(r.a), bytes(r.b)) for r in got} == {(bytes(cls[a]), bytes(cls[b])) for shared, pairs in near.items() if shared > 1 for a, b in pairs}, block


def test_near_dedup_stage_at_80(spark):
    """The pipeline's stage joins pairs from 0.80 to 0.85 too, as brute force does at 80."""
    import corpus_pipeline

    texts = [t for k in range(30) for t in family(2, 200, 1 + k % 3, 100 + k)] + [prose(100, 70)]
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))
    between = 0
    for a, b in itertools.combinations(range(len(texts)), 2):
        both, all_ = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        between += 80 * all_ <= 100 * both < 85 * all_
        if 100 * both >= 80 * all_:
            up[:] = [up[a] if x == up[b] else x for x in up]
    want = sorted(min(k for k in range(len(texts)) if up[k] == root) for root in set(up))
    assert between
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, documents(spark, texts), "").collect()) == want


def test_near_duplicates_repeated_rows(spark):
    t = prose(50, 1)
    d = documents(spark, [t, t, prose(50, 2), None], [5, 5, 5, 6], extra=True)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(d).collect())
    assert got == [(5, 5, True)] * 3 + [(6, 6, True)]
    out = minhash.survivors(d)
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == [5, 6]
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def test_components(spark):
    import random

    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for a, b in edges if a != b for x in (a, b)}


def test_near_dedup_frees_its_shuffle_files(spark):
    """What the steps before the last one have exchanged is gone when the result is returned, without a collection of the driver's garbage."""
    import time

    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    shuffles = lambda: {f.getName().split("_")[1] for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(env.blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = shuffles()
    texts = family(12, 200, 2, 1) + family(8, 60, 1, 3) + [prose(300, 60)] * 3
    out = minhash.near_duplicates(documents(spark, texts))
    end = time.time() + 20
    while len(left := shuffles() - before) > 8 and time.time() < end:
        time.sleep(0.2)
    assert len(left) <= 8  # of the questions whether a table is empty; before, of every join and every round
    assert [r.component_id for r in out.orderBy("doc_id").collect()] == brute_components(list(range(len(texts))), texts)[0]


# ------------------------------------------------------------- suffix dedup
def tiny(monkeypatch, rng):
    """Batches, queues and files so small that all that happens to large shards happens."""
    for name, lo, hi in (("BATCH", 1, 30), ("SPILL_BYTES", 10, 500), ("MEMORY_BYTES", 0, 300)):
        monkeypatch.setattr(induced_sort, name, int(rng.integers(lo, hi)))
    monkeypatch.setattr(induced_sort, "BINS", int(2 ** rng.integers(1, 8)))


def test_suffix_order_against_sorting(monkeypatch, tmp_path):
    """The recursion over strings of names."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        tiny(monkeypatch, rng)
        x = rng.integers(0, rng.integers(1, 9), rng.integers(1, 40)).astype(np.uint32) * int(rng.choice([1, 50]))
        got = induced_sort.suffix_order(x, induced_sort.Scratch(str(tmp_path))).tolist()
        assert got[::-1] == sorted(range(len(x)), key=lambda i: [*x[i:].tolist(), 10**9])  # noqa: B023


def test_induced_sort_against_counts(monkeypatch, tmp_path):
    rng = np.random.default_rng(3)
    for _ in range(300):
        tiny(monkeypatch, rng)
        k, size = int(rng.integers(1, 5)), int(rng.integers(1, 12))
        strings: list = []
        for _ in range(rng.integers(1, 8)):
            x = strings[rng.integers(len(strings))].copy() if strings and rng.random() < 0.4 else rng.integers(0, k, rng.integers(1, 60)).astype(np.uint8)
            x[rng.integers(len(x))] = rng.integers(0, k)
            strings.append(x)
        c = Counter(bytes(x[i : i + size]) for x in strings for i in range(len(x) - size + 1))
        text = np.concatenate([np.append(x.astype(np.uint16) + 1, 0) for x in strings]).astype(np.uint16)
        inside = np.concatenate([np.append(np.arange(len(x)) + size <= len(x), False) for x in strings])
        want = np.concatenate([np.append([i + size <= len(x) and c[bytes(x[i : i + size])] > 1 for i in range(len(x))], False) for x in strings]).astype(bool)
        assert (induced_sort.repeated_starts(text, size, induced_sort.Scratch(str(tmp_path))) & inside == want).all()


def test_a_shard_beyond_memory():
    """24 million symbols are sorted with no more than 128 MB of memory of its own, queues on disk; the result is that of counting."""
    import os
    import subprocess
    import sys

    run = """
import resource, tempfile
import numpy as np
from hyperloom.llm import induced_sort
rng, spills = np.random.default_rng(1), []
spill = induced_sort.Queues.spill
induced_sort.Queues.spill = lambda self: (spills.append(1), spill(self))
n, size, at = 24 << 20, 40, [5, 1 << 20, 19 << 20]
with tempfile.TemporaryDirectory() as folder:
    scratch = induced_sort.Scratch(folder)
    text = scratch.array(n, np.uint16)
    for a in range(0, n, 1 << 20):
        text[a : a + (1 << 20)] = rng.integers(1, 257, 1 << 20)
    text[-1] = 0
    own = np.array(text[at[0] : at[0] + 100])
    for k in at:
        text[k : k + 100] = own
    # private memory only: what is mapped from files can be given back at any time
    taken = next(int(x.split()[1]) << 10 for x in open("/proc/self/status") if x.startswith("VmData"))
    resource.setrlimit(resource.RLIMIT_DATA, (taken + (128 << 20),) * 2)
    hit = induced_sort.repeated_starts(text, size, scratch)
    found = np.flatnonzero(hit).tolist()
    assert found == [k + j for k in at for j in range(100 - size + 1)], found[:9]
    import os
    print(len(spills), sum(os.path.getsize(os.path.join(folder, x)) for x in os.listdir(folder)) >> 20)
"""
    out = subprocess.run([sys.executable, "-c", run], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))), timeout=600)
    assert not out.returncode, out.stderr
    spills, on_disk = map(int, out.stdout.split())
    assert spills > 2 and on_disk > 200, out.stdout  # of files that are still there; others have been deleted on the way


def brute_removed(texts, size):
    raw = [(t or "").encode() for t in texts]
    c = Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if c[b[i : i + size]] > 1:
                gone[i : i + size] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_suffix_dedup(spark, hot, monkeypatch):
    """With ``hot``, all that is split or salted beyond a bound is so from two rows on."""
    if hot:
        monkeypatch.setattr(suffix_dedup, "WIDE", 2)
        monkeypatch.setattr(suffix_dedup, "HOT", 1 << 40)
        monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4000)
        monkeypatch.setattr(suffix_dedup, "SALTS", 3)
    shared = prose(90, 9)
    texts = ODD + [prose(60, 1) + shared + prose(30, 2), prose(10, 3) + shared, prose(50, 4) * 3, "ab" * 900, "x" * 401, "x" * 400, prose(200, 5), prose(200, 5), "é" * 500, "è" * 200 + "é" * 200]
    common = prose(200, 6)
    texts += [prose(40, 300 + k) + common[k * 7 : len(common) - k * 5] + prose(40, 400 + k % 3) for k in range(12)] + [prose(120, 7)] * 8 + [None, ""]
    ids = [None if k == 2 else k for k in range(len(texts))]
    docs = documents(spark, texts, ids, extra=True).withColumn("__spans", F.lit("clash")).drop("__spans")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.measure(docs).collect()}
    want = brute_removed(texts, 400)
    assert got == dict(zip(ids, want, strict=True))
    out = suffix_dedup.clean(docs)
    assert out.columns == docs.columns and out.count() == len(texts)
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[0] is None and all(len((kept[i] or "").encode()) <= n - gone for i, (n, gone, *_) in zip(ids, want, strict=True))
    assert suffix_dedup.measure(documents(spark, [])).count() == 0


def test_suffix_dedup_exchanges_texts_once(spark):
    docs = documents(spark, [prose(300, 1), prose(300, 1), prose(200, 2)])
    for out in (suffix_dedup.measure(docs), suffix_dedup.clean(docs)):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ReusedExchange" in plan or "ResultQueryStage" not in plan


# ------------------------------------------------------------- mixing
def brute_targets(sizes):
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, free, out = float(sum(sizes.values())), set(sizes), {}
    while True:
        w = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / w > 3 * sizes[s] + 1e-9] if w else []
        if not over:
            return out | {s: left * weights[s] / w for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)


def test_mixing(spark):
    source = ["b", None, "a", "c", "d"]
    texts, src = list(ODD), ["a"] * len(ODD)
    for k, s in enumerate(source):
        texts += [prose(50 + 7 * i, i + 100 * k) for i in range(4 + 12 * k)]
        src += [s] * (4 + 12 * k)
    d = documents(spark, texts, source=src, extra=True)
    got = {r.doc_id: r for r in mixing.mix(d).collect()}
    size = {i: len(words(t)) for i, t in enumerate(texts)}
    total = Counter()
    for i, s in enumerate(src):
        total[s] += size[i]
    target, taken = brute_targets(dict(total)), Counter()
    for i, s in enumerate(src):
        r = got[i]
        assert (r["size"], r.source_size) == (size[i], total[s]) and abs(r.target - target[s]) < 1e-6
        assert 0 <= r.taken <= 3 * size[i]
        taken[s] += r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= 4 * mixing.BLOCK
    assert {i: r.taken for i, r in got.items()} == {r.doc_id: r.taken for r in mixing.mix(d.repartition(7)).collect()}
    out = mixing.repeat(d)
    times = Counter(r.doc_id for r in out.collect())
    assert out.columns == d.columns and all(times[i] == math.floor(r.taken / max(1, r["size"]) + 0.5) for i, r in got.items())
    assert mixing.mix(documents(spark, [])).count() == 0
    assert {r.taken for r in mixing.mix(documents(spark, [None, ""])).collect()} == {0}


def test_targets_one_source_and_ties(spark):
    got = {r.doc_id: r.taken for r in mixing.mix(documents(spark, ["a b c", "a b c", "d"], [1, 1, 2])).collect()}
    assert set(got) == {1, 2}
    s = spark.createDataFrame([("x", 10), ("y", 10), ("z", 1000)], "source string, source_size long")
    t = {r.source: r.target for r in mixing.targets(s).collect()}
    assert t["x"] == 30 and t["y"] == 30 and abs(t["z"] - 960) < 1e-6


# ------------------------------------------------------------- search
def test_search(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 330)] + [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (50, rows[3][1]), (500, [1.0, 2.0]), (550, [2.0, 2.0]), (600, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got: dict = {}
    for r in topk_search.search(df, lambda c: c % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in sorted(ok, key=lambda r: (len(r[1]), np.array(r[1], "<i4").tobytes()), reverse=True):
        if i % 50 == 0:
            asked[i] = v
    for i, v in asked.items():
        best = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in ok if j != i and len(w) == len(v)))[:5]
        assert sorted(got.get(i, [])) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert topk_search.search(df.limit(0), lambda c: c % 50 == 0).count() == 0


def brute_top(rows, asked, k=5):
    """Exact whole-number products; scores beyond a long take its end."""
    whole = {i: [math.floor(x * 256) if abs(x) < 2**40 else int(x) * 256 for x in v] for i, v in rows}
    out = []
    for q in asked:
        best = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(whole[q], whole[i], strict=True)))), i) for i, v in rows if i != q and len(v) == len(whole[q]))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best[:k])]
    return sorted(out)


def test_search_large_components(spark):
    rows = [(0, [5e6, 1.0]), (1, [5e6, 1.0]), (2, [5e6, 2.0]), (3, [-4e6, 9.0]), (50, [1e12, 3.0]), (4, [1e12, -1e12]), (5, [1e150, 1.0]), (6, [1e300, -1e300]), (100, [-1e200, 0.0]), (7, [0.25, 0.5]), (150, [0.0, 3.0])]
    rows += [(k, [float(k), 1.0]) for k in range(1000, 1030)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.search(df, lambda c: c % 50 == 0).collect())
    assert got == brute_top(rows, [0, 50, 100, 150, 1000])
    few = topk_search.search(df.filter("vec_id < 3"), lambda c: c == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in few] == [(2, (256 * 5_000_000) ** 2 + 2 * 256**2), (1, (256 * 5_000_000) ** 2 + 256**2)]


def test_search_many_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=1 + i % 1100).round(2).tolist()) for i in range(2400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.search(df, lambda c: c % 50 == 0).collect())
    assert got == brute_top(rows, range(0, 2400, 50))


# ------------------------------------------------------------- pipeline
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    shared = prose(90, 9)
    texts = [*ODD, *family(5, 150, 1, 1), *[prose(80, 70)] * 3, prose(100, 20) + " " + shared, shared + " " + prose(120, 21), *[prose(90, k) for k in range(30, 40)]]
    documents(spark, texts, source=["ab"[k % 2] for k in range(len(texts))]).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids, counts = {r.doc_id for r in docs.collect()}, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / str(k)))
            docs = spark.read.parquet(str(tmp_path / str(k)))
            counts.append({r.doc_id: r.text for r in docs.collect()})
            assert set(counts[-1]) <= ids
    kept, near, cut = counts[:3]
    assert set(kept) == {i for i, t in enumerate(texts) if len(words(t)) >= 20}
    comp, _ = brute_components(list(kept), list(kept.values()))
    assert set(near) == {i for i, c in zip(kept, comp, strict=True) if i == c}
    assert set(cut) == set(near) and sum(len(t) for t in cut.values()) < sum(len(t) for t in near.values())
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == docs.count() and got.filter("not exact").count() == 0


def test_pipeline_odd_tables(spark, tmp_path):
    """Empty tables; null and repeated ids; clashing names; a text that suffix dedup empties."""
    import corpus_pipeline

    documents(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    shared = prose(120, 9)
    texts = [None, "", "few words", prose(60, 1), prose(60, 1), prose(70, 2), prose(70, 2), prose(60, 3) + " " + shared, shared + " " + prose(60, 4), prose(500, 5), prose(80, 6)]
    ids = [0, 1, 2, 3, 3, 5, None, 7, 8, 9, None]
    d = documents(spark, texts, ids, source=["a", None] * 5 + ["b"], extra=True)
    d.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "odd" / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == d.columns
        out.write.parquet(str(tmp_path / f"odd{k}"))
        docs = spark.read.parquet(str(tmp_path / f"odd{k}"))
        if k == 1:
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect()) == [(False, 3), (False, 5), (False, 7), (False, 8), (False, 9), (True, 0)]
    got = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    assert got.count() == docs.count() > 0 and got.filter("not exact").count() == 0


def test_mix_takes_blocks_by_the_schedule(spark):
    """taken, from the golden-ratio points and the blocks of each source's tokens, written out one by one."""
    from decimal import Decimal

    texts = [prose(1 + 37 * k % 211, k) for k in range(60)]
    src = ["b" if k % 3 else "a" for k in range(60)]
    d = documents(spark, texts, source=src)
    rows = d.select("doc_id", "source", F.xxhash64("doc_id", "source", F.lit(17)).alias("h")).collect()
    size = {i: len(words(t)) for i, t in enumerate(texts)}
    total = Counter()
    for i, s in enumerate(src):
        total[s] += size[i]
    target = brute_targets(dict(total))
    everything = sum(target.values())
    low, upto = {}, 0.0
    for s in sorted(target):
        low[s] = (upto / everything, (upto + target[s]) / everything)
        upto += target[s]
    drawn: dict = {s: Counter() for s in target}
    ranks: Counter = Counter()
    for k in range(math.ceil(everything / mixing.BLOCK)):
        u = float(Decimal((k + 1) * 6180339887498949 % 10**16) / 10**16)
        s = next(s for s, (lo, hi) in low.items() if lo <= u < hi or (u >= lo and hi >= 1))
        blocks = math.ceil(total[s] / mixing.BLOCK)
        if ranks[s] < 3 * blocks:
            drawn[s][ranks[s] % blocks] += 1
        ranks[s] += 1
    want, at = {}, Counter()
    chunk = lambda h: (h & ((1 << 64) - 1)) >> 54
    for r in sorted(rows, key=lambda r: (chunk(r.h), r.h, r.doc_id)):
        a, n = at[r.source], size[r.doc_id]
        at[r.source] += n
        want[r.doc_id] = sum(drawn[r.source][t // mixing.BLOCK] for t in range(a, a + n))
    assert {r.doc_id: r.taken for r in mixing.mix(d).collect()} == want


def test_pipeline_takes_passages_of_50_words(spark):
    """A passage of 51 words that two documents share goes from both; what stands around it stays."""
    import corpus_pipeline

    shared = " ".join(prose(400, 9).split()[:51]) + " and some more"
    assert len(shared.encode()) >= corpus_pipeline.PASSAGE_BYTES
    texts = [prose(80, 1) + " " + shared + " " + prose(80, 2), prose(70, 3) + " " + shared + " " + prose(90, 4), prose(200, 5)]
    got = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup_stage(spark, documents(spark, texts), "").collect()}
    # a few characters beside the passage may happen to agree too
    around = [[x.strip() for x in texts[i].split(shared)] for i in (0, 1)]
    assert got[2] == texts[2] and all(shared[20:-20] not in got[i] and got[i].startswith(a[:-10]) and got[i].endswith(b[10:]) for i, (a, b) in enumerate(around))


def test_a_text_beyond_a_step(spark):
    """Texts of more than STEP_BYTES through every operator on texts, with short ones beside them."""
    from hyperloom.llm import common, langid, quality_rules, sentencepiece_lattice

    long = prose(130_000, 1)
    assert len(long.encode()) > common.STEP_BYTES
    other = " ".join(w for k, w in enumerate(long.split()) if k % 1000)
    texts = ["short text", long, prose(50, 2), long, other, "x" * (common.STEP_BYTES + 7)]
    d = documents(spark, texts, list(range(2, 8)))
    n = [len(words(t)) for t in texts]
    q = {r.doc_id: r for r in quality_rules.judge(d).collect()}
    assert [q[i].n_words for i in range(2, 8)] == n and [q[i].word_chars for i in range(2, 8)] == [sum(map(len, words(t))) for t in texts]
    s = {r.doc_id: r for r in sentencepiece_lattice.summary(d).collect()}
    assert all(s[i].exact and s[i].n_bytes == len(t.encode()) for i, t in enumerate(texts, 2))
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(d).collect()}
    assert near == {i: (len(shingles(t)), 3 if t in (long, other) else i) for i, t in enumerate(texts, 2)}
    gone = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.measure(d).collect()}
    assert [gone[i][0] for i in range(2, 8)] == [len(t.encode()) for t in texts]
    assert gone[3] == gone[5] == (len(long.encode()),) * 2 and gone[2][1] == gone[4][1] == 0 and gone[7][1] == len(texts[5]) and 0 < gone[6][1] <= gone[6][0]
    m = {r.doc_id: r for r in lm_scoring.score(d, 2, 32, 1).collect()}
    assert [m[i].n_tokens for i in range(2, 8)] == [k + 1 for k in n] and all(math.isfinite(m[i].score) for i in m)
    assert {r.doc_id: r["size"] for r in mixing.mix(d).collect()} == dict(enumerate(n, 2))
    assert {r.lang_pred for r in langid.predict(d).collect()} == {"en"}
