"""Per-document operators against brute force: chat formatting, quality rules, URL filters, language ID, encoding."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from hyperloom.llm import chat_format, langid, quality_rules, sentencepiece_lattice, url_filters
from hyperloom.llm import queries as q

from .helpers import documents, fold, low_words, prose, words

ODD = [None, "", " \n\t ", "one", "a b c d e", "x " * 3000, "w" * 5000, "same line\nsame line\nother\nsame line", "# * $ % & | < > #", "é漢𝄞 été\x0b\x0cé", "\n\n", "tail\n"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/s[]INST\\|im_start\n é"), st.text(alphabet="us\n\\/<s>"))
def test_template_is_reversible(text, role):
    f = chat_format.format_turn(role, text) + chat_format.format_turn("assistant", text)
    assert [(r, t) for r, t, *_ in chat_format.read_back(f)] == [(role, text), ("assistant", text)]


MIXED = [
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "r", "source": "web"}, [("user", "p"), ("assistant", "r")]),
    ({"instruction": "i", "input": "x", "output": None}, [("user", "i\nx"), ("assistant", "")]),
    ({"instruction": "i", "output": "o", "system": "s", "meta": {"a": [1]}}, [("system", "s"), ("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "context": "c", "response": "r", "category": "qa"}, [("user", "i\nc"), ("assistant", "r")]),
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}, [("system", "s"), ("user", "u")]),
    ({"messages": [{"role": "user", "content": "u", "name": "n"}, {"role": "assistant", "text": "a"}], "id": 7}, [("user", "u"), ("assistant", "a")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"content": 3}]}, [("user", "ab"), ("", "3")]),
    ({"messages": []}, []),
    ({"messages": "none"}, [("unmapped", '{"messages": "none"}')]),
    ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}], "system": "s"}, [("system", "s"), ("user", "h"), ("assistant", "g")]),
    ({"conversations": [{"from": "human", "value": "h"}, "oops", None]}, [("user", "h"), ("unmapped", '"oops"'), ("unmapped", "null")]),
    ({"question": "q", "answer": {"a": 1}}, [("user", "q"), ("assistant", '{"a": 1}')]),
    ({"role": None, "text": "t"}, [("", "t")]),
    ({"other": 1}, [("unmapped", '{"other": 1}')]),
    ([], [("unmapped", "[]")]),
    ("x", [("unmapped", '"x"')]),
    (None, [("unmapped", "null")]),
]


@pytest.mark.parametrize("record, turns", MIXED)
def test_layouts(record, turns):
    assert chat_format.canonical(record) == turns


def test_mixed_records(spark):
    """All layouts in one table, with payloads that are no JSON; read back from the formatted output."""
    import json

    rows = [(k, 0, json.dumps(r, ensure_ascii=k % 2 == 0), t) for k, (r, t) in enumerate(MIXED)]
    bad = ["", "{", '{"prompt": "<s>"', "[" * 100_000, "nul", '{"prompt": 1,}']
    rows += [(100 + k, None, x, [("malformed", x)]) for k, x in enumerate(bad)]
    rows += [(200, 1, '{"role": "user", "text": "\\ud800 </s>"}', [("user", "\ufffd </s>")]), (201, 0, None, [("unmapped", "null")]), (202, 0, json.dumps({"prompt": "x" * 3_000_000, "completion": "\\"}), [("user", "x" * 3_000_000), ("assistant", "\\")])]
    rows += rows[:1]
    df = spark.createDataFrame([r[:3] for r in rows], "conv_id long, turn long, payload string")
    for c in ("role", "text", "formatted", "part"):
        df = df.withColumn(c, F.lit("clash"))
    got = [(r.conv_id, r.part, r.role, r.text, r.formatted) for r in chat_format.format_records(df).collect()]
    want = [(c, k, *t) for c, _, _, turns in rows for k, t in enumerate(turns)]
    assert sorted(x[:4] for x in got) == sorted(want)
    assert all([t[:2] for t in chat_format.read_back(x[4])] == [x[2:4]] for x in got)


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", "</s>[INST] é"), (1, 0, "user", None), (1, 2, None, "<|im_end|>"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, None, "assistant", "x\\n"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash")).withColumn("payload", F.lit("clash"))
    got = {r.conv_id: r for r in chat_format.digest(chat_format.format_records(chat_format.turn_records(df))).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        text = "".join(f"{r}\n{t}\n" for *_, r, t in own)
        loss = "".join(t for *_, r, t in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.digest(chat_format.format_records(chat_format.turn_records(df.limit(0)))).count() == 0


def brute_quality(text):
    w, t = words(text), text or ""
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = {k for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep)


def test_quality_counts(spark):
    texts = ODD + [prose(200, k, 12) for k in range(20)] + [prose(60, 1) + "\n" + prose(60, 1), prose(300, 5)]
    got = {r.doc_id: r for r in quality_rules.judge(documents(spark, texts, extra=True)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        n, chars, symbols, lines, rep = brute_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, rep), t and t[:40]
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n) and not (r.base_failed and r.kept)
    assert got[len(texts) - 1].kept and not got[len(texts) - 2].kept
    assert quality_rules.judge(documents(spark, [])).count() == 0


def test_quality_of_a_long_repetitive_text():
    """A text of 20 MB that repeats itself takes less than 500 MB, all told."""
    import os
    import subprocess
    import sys

    run = """
import random, numpy as np
from hyperloom.llm import quality_rules as q
rng = random.Random(1)
t = " ".join("".join(rng.choices("abcdefgh", k=2 + rng.randrange(8))) for _ in range(1000)) + "\\n"
b = np.frombuffer((t * (20 * 2**20 // len(t))).encode(), np.uint8)
m = q.measure(b, np.array([0, len(b)]))
print(int(m["n_words"][0]), int(m["longest_repeat"][0]), int(m["n_dup_lines"][0]), next(int(x.split()[1]) // 1024 for x in open("/proc/self/status") if x.startswith("VmHWM")))
"""
    out = subprocess.run([sys.executable, "-c", run], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))), timeout=300, check=True).stdout
    n, longest, dup, mb = map(int, out.split())
    assert longest == n - 1000 and dup == n // 1000 - 1 and mb < 500


def test_span_hashes_in_steps(monkeypatch):
    from hyperloom.llm import common

    data = np.random.default_rng(1).integers(0, 256, 4000).astype(np.uint8)
    at = np.array([0, 3, 3, 700, 701, 2500, 4000])
    want = common.span_hash(common.prefix_hash(data), at[:-1], at[1:])
    monkeypatch.setattr(common, "STEP_BYTES", 64)
    assert (common.span_hashes(data, at[:-1], at[1:]) == want).all()


def test_longest_repeats_brute():
    rng = np.random.default_rng(5)
    for _ in range(150):
        n = int(rng.integers(0, 30))
        s, g = rng.integers(0, 3, n).astype(np.uint64), np.sort(rng.integers(0, 3, n))
        got = quality_rules.longest_repeats(s, g)
        for i in range(n):
            best = 0
            for j in range(n):
                k = 0
                while i != j and max(i, j) + k < n and g[i] == g[min(i, j) + k] == g[max(i, j) + k] and s[i + k] == s[j + k]:
                    k += 1
                best = max(best, k)
            assert got[i] == best


def test_passing_keeps_rows_and_columns(spark):
    d = documents(spark, [prose(100, 1), None, "short", prose(100, 1)], ids=[7, 8, 9, 7], extra=True)
    out = quality_rules.passing(d)
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == [7, 7]


def test_urls(spark):
    urls = ["http://example.net", "http://example.net/", "https://A.B.Example.NET/en/x?y", "http://example.net/en", "http://example.com/de/", "http://xexample.com/de/", "ftp://org/fr/#z", "http://net/en/", None, "no scheme", "://", "http://.net/", "http://net./", "http://a.net?/en/", "http://EXAMPLE.com/de/a#b://c", "http://é.net/x"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filters.judge(df, q.URL_RULES).collect()}
    assert len(got) == len(urls) + 3
    for i, u in enumerate(urls):
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        cut = min([k for c in "/?#" if (k := rest.find(c)) >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        end = min([k for c in "?#" if (k := rest.find(c, cut)) >= 0], default=len(rest))
        path = rest[cut:end]
        fit = [(len(h), len(p), h + p, v) for v, h, p in q.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, _, rule, verdict = max(fit, default=(0, 0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), u
    clash = df.withColumn("host", F.lit("clash")).withColumn("path", F.lit("clash")).withColumn("rule", F.lit("clash")).withColumn("verdict", F.lit("block"))
    assert sorted(map(str, url_filters.judge(clash, q.URL_RULES).collect())) == sorted(map(str, url_filters.judge(df, q.URL_RULES).collect()))
    assert url_filters.judge(df.limit(0), q.URL_RULES).count() == 0


def segmentations(word, keys):
    """Every way to cut a word into pieces and single bytes, as ids."""
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if n == 1 or word[:n] in keys:
            for rest in segmentations(word[n:], keys):
                yield [word[0] if n == 1 else keys[word[:n]], *rest]


def brute_sums(word, prob, keys):
    """Probability of a word, and how often each piece is used, over all segmentations."""
    ways = [(z, float(np.prod([prob[i] for i in z]))) for z in segmentations(word, keys)]
    total, use = sum(p for _, p in ways), Counter()
    for z, p in ways:
        for i in z:
            use[i] += p / total
    return total, use


def piece_ids():
    """All pieces of the vocabulary, read here once more, by their ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=langid.VOCABULARY)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    names = {sp.id_to_piece(i).replace("▁", "").translate(low).encode() for i in range(3, sp.vocab_size()) if not sp.is_byte(i)}
    return {n: 256 + k for k, n in enumerate(sorted(n for n in names if len(n) > 1))}


def test_forward_sums_all_segmentations():
    known, keys = langid.pieces(langid.VOCABULARY), piece_ids()
    assert known.n == 256 + len(keys) and known.longest == max(map(len, keys)) > 10
    rng = np.random.default_rng(2)
    prob = rng.dirichlet(np.ones(known.n), 2).T
    long = max(keys, key=len)
    texts = [b"the", b"international", "été".encode(), b"a", long[:18], b"xyzzyxyzzyxyzzyxyzzy" * 8]
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = langid.word_scores(data, at[:-1], at[1:], prob, known)
    for w, row in list(zip(texts, got, strict=True))[:5]:
        for k in range(2):
            assert abs(row[k] - np.log(brute_sums(w, prob[:, k], keys)[0])) < 1e-9
    assert np.isfinite(got).all()
    # a word that is a long piece can be that piece
    data, sure = np.frombuffer(long, np.uint8), np.full((known.n, 1), 1e-9)
    sure[keys[long]] = 0.5
    assert abs(langid.word_scores(data, np.array([0]), np.array([len(long)]), sure, known)[0, 0] - np.log(0.5)) < 1e-6


def test_fit_and_score_against_brute_force(spark):
    """Expectation-maximisation by all segmentations, and the posterior of whole texts."""
    keys = piece_ids()
    texts = [("the them The", "en"), ("of the", "en"), ("été de la", "fr"), ("la de la", "fr"), ("the la été of", None), ("de  the\nétéxx", None), ("zz", None)]
    ids = [i for i in range(100) if i == 0 or fold(i) != 0]
    df = spark.createDataFrame([(ids[k], *t) for k, t in enumerate(texts)] + [(ids[0], *texts[0])], "doc_id long, text string, lang string").withColumn("word", F.lit("clash"))
    n, prob = 256 + len(keys), {}
    for lang in ("en", "fr"):
        count = Counter(w for t, x in texts if x == lang for w in low_words(t))
        p = np.full(n, 1 / n)
        for _ in range(langid.ROUNDS):
            c = np.full(n, langid.SMOOTH)
            for w, times in count.items():
                for i, use in brute_sums(w.encode(), p, keys)[1].items():
                    c[i] += times * use
            p = c / c.sum()
        prob[lang] = p
    langs, got = langid.fit(df)
    assert langs == ["en", "fr"] and np.allclose(got, np.stack([prob["en"], prob["fr"]], 1), rtol=1e-6)
    for r in langid.predict(df).collect():
        t = texts[ids.index(r.doc_id)][0]
        ll = {lang: sum(np.log(brute_sums(w.encode(), p, keys)[0]) for w in low_words(t)) for lang, p in prob.items()}
        best = max(sorted(ll), key=ll.get)
        assert r.lang_pred == best and abs(r.score - 1 / sum(np.exp(x - ll[best]) for x in ll.values())) < 1e-6


def test_language_with_clashing_names(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the of and", "en"), ("la de et", "fr")] * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clash = df
    for c in ("word", "n", "salt", "held_out", "lang_pred", "score", "prob", "__h"):
        clash = clash.withColumn(c, F.lit("clash"))
    assert sorted(langid.predict(clash).collect()) == sorted(langid.predict(df).collect())


def test_sample_takes_each_different_text_once(spark):
    rows = [(k, f"t{k % 50}", "en") for k in range(100)] * 3 + [(None, "t", "en"), (1, None, "en"), (2, "t", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.sample(df, 1000).count() == sum(fold(k) != 0 for k in [*range(100), None])
    assert langid.sample(df, 7).count() == 7


def test_language(spark):
    en, xx = ["the and of them that nothing"] * 40, ["être où déjà élève été"] * 40
    texts = en + xx + ODD + ["12 34 !!"]
    langs = ["en"] * 40 + ["fr"] * 40 + [None] * (len(ODD) + 1)
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))] + [(None, "the of them", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in langid.predict(df).collect()}
    assert all(got[i].lang_pred == "en" for i in range(40)) and all(got[i].lang_pred == "fr" for i in range(40, 80))
    assert {got[80 + k].lang_pred for k in (0, 1, 2, 8, 10)} == {"und"} and got[len(texts) - 1].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got.values()) and got[None].lang_pred == "en"
    assert langid.predict(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predict(df.filter("lang is null")).collect()} == {"und"}


def test_piece_counts_of_long_words():
    """The pieces used in a word cover it, whatever its length."""
    known, keys = langid.pieces(langid.VOCABULARY), piece_ids()
    prob = np.random.default_rng(4).dirichlet(np.ones(known.n))
    words = ["the", "漢字仮名" * 900, "a"]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    at = np.cumsum([0, *(len(w.encode()) for w in words)])
    size = np.array([1] * 256 + [len(n) for n in sorted(keys)])
    got = langid.piece_counts(data, at[:-1], at[1:], np.array([2.0, 1.0, 3.0]), prob, known)
    assert len(size) == len(got) and abs((got * size).sum() / (2 * 3 + len(words[1].encode()) + 3) - 1) < 1e-8


def test_language_without_spaces(spark):
    """Words of more than 64 bytes are learned, and what stands behind the 4,000th character too."""
    import random

    rng = random.Random(6)
    clause = lambda letters: "".join(rng.choices(letters, k=60))
    late = lambda word: "- " * 2500 + f"{word} " * 300
    texts = [(clause("日本語仮名"), "aa") for _ in range(40)] + [(clause("中文汉字简"), "bb") for _ in range(40)] + [(late("zebra"), "cc") for _ in range(9)] + [(late("quokka"), "dd") for _ in range(9)]
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(df).collect()}
    assert [got[i] for i in range(len(texts))] == [lang for _, lang in texts]


def test_more_languages_than_a_block(spark):
    """Every labelled language is learned, the rare ones too."""
    texts = [(f"{chr(0x4E00 + 7 * k)}{chr(0x4E03 + 7 * k)} " * 20, f"l{k:02}") for k in range(70) for _ in range(8 + (k < 64))]
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(df).collect()}
    assert [got[i] for i in range(len(texts))] == [lang for _, lang in texts]


def test_no_piece_crosses_words():
    import random
    import pyarrow as pa

    rng, pairs = random.Random(3), sentencepiece_lattice.inside(sentencepiece_lattice.VOCABULARY)
    table = [t for t, _, _ in sentencepiece_lattice.vocabulary(sentencepiece_lattice.VOCABULARY)[0] if len(t) > 1]
    for _ in range(100):
        texts = ["".join(rng.choice([" ", "    ", "é", "\n", "漢", ".”", rng.choice(table)]) for _ in range(rng.choice([0, 1, 4, 60]))) for _ in range(4)]
        ((_, _, data, offs),) = sentencepiece_lattice.steps(pa.array(texts), 1 << 30)
        at = [*sentencepiece_lattice.tokens(data, offs, pairs).tolist(), len(data)]
        got = [data[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)]
        assert "".join(got) == "".join(texts) and {0, *np.cumsum([len(t.encode()) for t in texts])} <= set(at) | {0}
        raw = data.tobytes().decode()
        inner = {len(data[:x].tobytes().decode()) for x in at[1:-1]} - set(np.cumsum([len(t) for t in texts]).tolist())
        for t in rng.sample(table, 300):
            k = raw.find(t)
            while k >= 0:
                assert not inner & set(range(k + 1, k + len(t)))
                k = raw.find(t, k + 1)


def brute_viterbi(word, table, byte0):
    best = [(0.0, 0, 0)]
    for e in range(1, len(word) + 1):
        edges = [(best[f][0] + table[word[f:e]][1], f, table[word[f:e]][0]) for f in range(max(0, e - 16), e) if word[f:e] in table]
        if word[e - 1 : e] not in table:
            edges.append((best[e - 1][0] + sentencepiece_lattice.BYTES_SCORE, e - 1, -1))
        best.append(max(edges))
    ids, e = [], len(word)
    while e:
        _, f, i = best[e]
        ids, e = ([i] if i >= 0 else [byte0 + b for b in word[f:e].encode()]) + ids, f
    return ids


LONG = ["w" * n for n in (48, 100, 1000)] + ["ab漢字" * 700, "é" * 300 + "x1" * 600, "a" * 10_000, "\U0001f9ff" * 300]


@pytest.mark.parametrize("common, fold", [(1 << 20, 4096), (100, 60), (0, 4096)])
def test_encoding(spark, common, fold, monkeypatch):
    """The best segmentation of the whole text, words of any length included."""
    monkeypatch.setattr(sentencepiece_lattice, "FOLD", fold)
    table, _, byte0 = sentencepiece_lattice.vocabulary(sentencepiece_lattice.VOCABULARY)
    by_text: dict = {}
    for t, i, s in table:
        by_text[t] = max(by_text.get(t, (i, s)), (i, s), key=lambda x: (x[1], x[0]))
    texts = [*ODD, *LONG, "▁ 漢字\x00 hello  the the", "the the the", "if x:\n        return “so”… .” ,”", prose(40, 3), " " * 40]
    d = documents(spark, [*texts, "the the the"], ids=[*range(len(texts)), None], extra=True)
    parts: dict = {}
    for r in sentencepiece_lattice.decode(sentencepiece_lattice.encode(d, most=common)).collect():
        parts.setdefault(r.doc_id, []).append(r)
    assert len(parts) == len(texts) + 1
    total = {r.doc_id: r for r in sentencepiece_lattice.summary(d, most=common).collect()}
    for i, t in enumerate(texts):
        own = sorted(parts[i], key=lambda r: r.part)
        assert [r.part for r in own] == list(range(len(own)))
        ids = [x for r in own for x in r.ids]
        assert ids == brute_viterbi(t or "", by_text, byte0)
        assert "".join(r.decoded for r in own) == (t or "") == "".join(r.body for r in own)
        assert (total[i].n_pieces, total[i].n_bytes, total[i].n_words, total[i].exact) == (len(ids), len((t or "").encode()), sum(r.words for r in own), True)
    if common:  # the hash of a text's ids does not depend on what is common
        other = {r.doc_id: r.ids_hash for r in sentencepiece_lattice.summary(d, most=0).collect()}
        assert other == {i: r.ids_hash for i, r in total.items()}


def test_encoding_summary(spark):
    d = documents(spark, ["the the", None, "the the"], ids=[1, 2, 1])
    out = sentencepiece_lattice.summary(d).collect()
    assert sorted((r.doc_id, r.n_words, r.n_bytes, r.exact) for r in out) == [(1, 2, 7, True), (1, 2, 7, True), (2, 0, 0, True)]
    assert len({r.ids_hash for r in out if r.doc_id == 1}) == 1
    assert sentencepiece_lattice.summary(d.limit(0)).count() == 0
