"""The queries opN_<name> of the numbered operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from . import bpe, byte_bpe, decontaminate, jaccard_join, license_scan, masked_lm, periodic_runs, pii, quality, resampling, sharding, substring_dedup, url_filter
from .common import table


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "terms", "score")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return masked_lm.score_documents(docs, masked_lm.train(docs))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_components(table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"), with_hits=False)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents"), with_text=False)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(table(spark, sf_dir, "documents"), shards=40)
    return placed.selectExpr("doc_id", "size", "text_crc32", "law", "shard", "slot", "cast(null as int) as grown_shard", "source")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), word_bpe(), with_ids=False)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share=Fraction(10, 100))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.detect(periodic_runs.planted(table(spark, sf_dir, "documents")), with_runs=False, with_text=False)


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_lm_scoring, op3_decontamination, op4_jaccard_join, op5_license_scan,
    op6_substring_dedup, op7_pii, op8_sharding, op9_quality, op10_bpe,
    op11_byte_bpe, op12_resampling, op13_periodic_runs,
)}

_TERMS = {k: "[" + ",".join(f"'{t}'" for t in v) + "]" for k, v in (("strict", url_filter.STRICT), ("soft", url_filter.SOFT))}

ORACLE_SQL = {
    "op1_url_filter": f"""
with u as (
  select page_id, coalesce(url, '') as url,
    case when contains(url, '://') then regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') else '' end as hp
  from pages),
p as (
  select page_id, lower(url) as low,
    translate(split_part(hp, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    substr(hp, length(split_part(hp, '/', 1)) + 1) as path from u),
r as (
  select * from (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
    ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) t(v, h, q)),
m as (
  select page_id, arg_max(h || q, length(h || q)) as rule, arg_max(v, length(h || q)) as ruled
  from p join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, q) group by page_id),
t as (
  select page_id,
    list_filter({_TERMS['strict']}, lambda x: regexp_matches(low, '(^|[^a-z0-9])' || x || '($|[^a-z0-9])')) as k,
    list_filter({_TERMS['soft']}, lambda x: regexp_matches(low, '(^|[^a-z0-9])' || x || '($|[^a-z0-9])')) as s
  from p)
select p.page_id, host, path, rule, coalesce(ruled, case when len(k) * 2 + len(s) >= 2 then 'block' else 'allow' end) as verdict,
  cast(len(k) as bigint) as n_strict, cast(len(s) as bigint) as n_soft,
  array_to_string(list_sort(list_concat(k, s)), ',') as terms, least(1.0, (len(k) * 2 + len(s)) / 2.0)::double as score
from p join t using (page_id) left join m using (page_id)""",
    "op4_jaccard_join": r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select distinct doc_id, array_to_string(w[i : i + 2], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from o join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 90 * (p.n + q.n - c)),
e2 as (select x, y from e union all select y, x from e),
r(x, y) as (select x, y from e2 union select r.x, e2.y from r join e2 on r.y = e2.x)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) as component_id
from d left join n using (doc_id) left join (select x, min(y) as m from r group by x) c on c.x = d.doc_id""",
    "op6_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
x as (select doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
m as (select h, min(doc_id) as m from x group by h),
g as (select distinct doc_id, unnest(range(i, i + 50)) as p from x join m using (h) where m < doc_id),
k as (select doc_id, count(*) as n from g group by doc_id),
v as (select doc_id, string_agg(t, ' ' order by p) as s from (select doc_id, unnest(w) as t, unnest(range(1, len(w) + 1)) as p from d) anti join g using (doc_id, p) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(s, '')) as kept_sha256
from d left join k using (doc_id) left join v using (doc_id)""",
    "op3_decontamination": r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
bw as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + 9], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
ns as (select distinct n from bw),
dw as (
  select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, ns where len(w) >= n)),
h as (select doc_id, i, dw.n, item_id from dw join bw on dw.s = bw.s and dw.n = bw.n),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as s from (select distinct doc_id, cast(item_id as varchar) as x from h) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (doc_id) left join its using (doc_id)""",
}
