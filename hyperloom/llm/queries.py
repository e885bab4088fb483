"""The queries of the training-data operators, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, langid, lm_scoring, minhash, mixing, quality_rules, sentencepiece_lattice, suffix_dedup, topk_search, url_filters
from .common import table

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_format.digest(chat_format.format_records(chat_format.turn_records(rows)))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.summary(table(spark, sf_dir, "documents"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.measure(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_quality_rules": op2_quality_rules,
    "op3_url_filters": op3_url_filters,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_topk_search": op7_topk_search,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_source_mixing": op9_source_mixing,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op7_topk_search": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s)
select query_id, n::int as rank, vec_id, score from r where n <= 5""",
    "op1_chat_format": """
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc as (
  select *, regexp_replace(replace(text, '\\', '\\\\'), '(<|\\[)(\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|s>|/s>|INST\\]|/INST\\]|<SYS>>|</SYS>>)', '\\1\\\\\\2', 'g') as safe from rows)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(12 + length(role) + 1 + length(safe) + 11)::bigint as formatted_chars
from esc group by conv_id""",
    "op3_url_filters": """
with u as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r(verdict, rh, rp) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m as (
  select p.page_id, p.host, p.path, rh || rp as rule, verdict, row_number() over (partition by page_id order by length(rh) desc nulls last, length(rp) desc) as n
  from p left join r on (host = rh or suffix(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from m where n = 1""",
    "op2_quality_rules": r"""
with w as (select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
pos as (select r, w, len(w) as n, unnest(range(1, len(w) + 1)) as i from w),
win as (select r, i, k, hash(w[i:i + k - 1]) as h from pos, (values (1), (2), (3), (4), (5), (8)) v(k) where i + k - 1 <= n),
rep as (select r, i, k, h from (select *, count(*) over (partition by r, k, h) as c from win) where c > 1),
cov as (select r, k, count(distinct i + j) as words from rep, range(8) t(j) where k >= 5 and j < k group by r, k),
five as (select a.r, a.i, b.i - a.i as off from rep a join rep b on a.r = b.r and a.k = 5 and b.k = 5 and a.h = b.h and a.i < b.i),
runs as (select r, count(*) + 4 as n from (select r, off, i - row_number() over (partition by r, off order by i) as g from five) group by r, off, g),
longest as (select r, max(n) as n from (select r, n from runs union all select r, k from rep where k <= 5) group by r),
line as (select r, l, row_number() over (partition by r, l) as c from (select r, unnest(string_split(t, chr(10))) as l from w) where regexp_matches(l, '[^\x20\x09-\x0D]')),
dup as (select r, count(*) as n from line where c > 1 group by r),
m as (
  select w.r, doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines,
    coalesce(c8.words, 0)::bigint as n_repeat_words, coalesce(c5.words, 0)::bigint as covered_words, coalesce(longest.n, 0)::bigint as longest_repeat
  from w left join dup using (r) left join longest using (r) left join cov c8 on c8.r = w.r and c8.k = 8 left join cov c5 on c5.r = w.r and c5.k = 5)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, longest_repeat,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and covered_words <= 0.30 * n_words and longest_repeat <= 400 as kept from m""",
    "op5_minhash_dedup": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
cls as (select doc_id, md5(string_agg(s, chr(10) order by s)) as c from s group by doc_id),
rep as (select c, min(doc_id) as doc_id from cls group by c),
sr as (select s.* from s join rep using (doc_id)),
inter as (select a.doc_id as a, b.doc_id as b, count(*) as k from sr a join sr b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as (select a, b from inter join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
both_ as (select a, b from link union all select b, a from link),
reach(a, b) as (select doc_id, doc_id from rep union select r.a, l.b from reach r join both_ l on l.a = r.b),
top as (select a, min(b) as component_id from reach group by a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(component_id, d.doc_id) as component_id, d.doc_id = coalesce(component_id, d.doc_id) as kept
from documents d left join n using (doc_id) left join cls using (doc_id) left join rep using (c) left join top on top.a = rep.doc_id""",
    "op8_suffix_dedup": r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, row_number() over (order by doc_id) as r from documents),
win as (select r, i, hash(substr(h, 2 * i + 1, 800)) as k from (select r, h, unnest(range(0, greatest(length(h) // 2 - 399, 0))) as i from d)),
hit as (select r, i from (select r, i, count(*) over (partition by k) as n from win) where n > 1),
edge as (select r, i, case when i - lag(i) over (partition by r order by i) <= 400 then 0 else 1 end as new from hit),
grp as (select r, i, sum(new) over (partition by r order by i) as g from edge),
span as (select r, g, min(i) as a, max(i) + 400 as z from grp group by r, g),
keep as (select r, string_agg(substr(h, 2 * lo + 1, 2 * (a - lo)), '' order by a) as kept, max(z) as last, sum(z - a) as gone, count(*) as n
  from (select r, a, z, coalesce(lag(z) over (partition by r order by a), 0) as lo from span) join d using (r) group by r)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(n, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) as kept_sha256
from d left join keep using (r)""",
}
