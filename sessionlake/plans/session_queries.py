"""More queries over the driver's tables: speakers, polish, summaries, regions, formats, and the library of voices."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake.functions import text
from sessionlake.operators import corpus, intervals, library, matching, measures, polish, redo, regions, registry, shaping, signals, speakers, summaries  # noqa: F401
from sessionlake.streaming import commands, fold

from . import calibration
from .bindings import _S, _spans, _t, bound

_ROLE = "case when o_orderkey % 3 = 0 then 'teacher' when o_orderkey % 3 = 1 then 'student' end"


@bound("""select o_orderkey, case when o_custkey % 5 = 0 then 'teacher' when o_custkey % 5 = o_orderkey % 5 then 'student' when o_orderstatus <> 'P' then o_orderpriority end as role from orders""")
def q_role(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").selectExpr("o_orderkey", "case when o_orderstatus <> 'P' or o_custkey % 5 in (0, o_orderkey % 5) then o_custkey % 5 end as p", "o_orderkey % 5 as s", "o_orderpriority as d")
    return rows.select("o_orderkey", speakers.role_of(F.col("p"), F.lit(0), F.col("s"), F.col("d")).alias("role"))


_LINES = "select l_orderkey as file_id, l_linenumber as n, 'p' || (l_suppkey % 7) as id, case when l_linenumber % 3 = 0 then 'teacher' else 'student' end as role from lineitem"


def _participants(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").selectExpr("l_orderkey as file_id", "l_linenumber as n", "concat('p', l_suppkey % 7) as id", "case when l_linenumber % 3 = 0 then 'teacher' else 'student' end as role")


@bound(f"""with p as ({_LINES}) select file_id, arg_max(id, (n, id)) filter (role = 'teacher') as teacher_id, arg_max(id, (n, id)) filter (role = 'student') as student_id from p group by 1""")
def q_index_entry(spark, sf_dir):
    each = F.array_sort(F.collect_list(F.struct("n", "id", "role")))
    transcripts = _participants(spark, sf_dir).groupBy("file_id").agg(each.alias("participants"))
    return speakers.index_entry(transcripts, ["file_id", "no_such_column"])


@bound(f"""with p as ({_LINES}) select file_id, coalesce(bool_or(id = 'p3' and role = 'teacher'), false) as takes_part from p group by 1""")
def q_has_participant(spark, sf_dir):
    transcripts = _participants(spark, sf_dir).groupBy("file_id").agg(F.collect_list(F.struct("id", "role")).alias("w"))
    return transcripts.select("file_id", speakers.has_participant(F.col("w"), "p3", "teacher").alias("takes_part"))


@bound(f"""with p as ({_LINES}) select o_orderkey as file_id, o_custkey from orders where o_orderkey in (select file_id from p where id = 'p3' and role = 'student') and o_orderkey in (select file_id from p where id = 'p1' and role = 'teacher')
and o_orderdate < timestamp '2000-01-01' and o_custkey in (select c_custkey from customer where c_acctbal < 5000)""")
def q_redo_participant(spark, sf_dir):
    sessions = _t(spark, sf_dir, "orders").selectExpr("o_orderkey as file_id", "o_custkey", "o_orderdate")
    stale = _t(spark, sf_dir, "customer").where("c_acctbal < 5000").selectExpr("c_custkey as o_custkey").join(sessions, "o_custkey").select("file_id")
    found = corpus.redo_candidates(
        sessions, sessions, "file_id", before=F.expr("o_orderdate < timestamp_ntz'2000-01-01 00:00:00'"), participants=_participants(spark, sf_dir), takes_part={"student": "p3", "teacher": "p1"}, only=stale
    )
    return found.select("file_id", "o_custkey")


@bound("""with a as (select s_suppkey % 500 as file_id, s_suppkey % 3 as cluster_label, min(case when s_suppkey % 11 <> 0 then s_suppkey % 97 end) as person_id, max(s_acctbal) as confidence,
  min(case when s_nationkey % 2 = 0 then '' else 'r' || s_nationkey end) as region from supplier group by 1, 2),
s as (select o_orderkey as file_id, o_custkey % 97 as teacher_id, o_orderkey % 97 as student_id from orders),
p as (select c_custkey as id, c_name as display_name, c_mktsegment as default_role from customer where c_custkey < 97)
select l_orderkey, l_linenumber, person_id as speaker_id, display_name as speaker_name,
case when person_id = teacher_id then 'teacher' when person_id = student_id then 'student' when person_id is not null then default_role end as speaker_role, confidence as speaker_confidence, nullif(region, '') as matched_region
from lineitem left join a on a.file_id = l_orderkey and a.cluster_label = l_linenumber % 3 left join s on s.file_id = a.file_id left join p on p.id = person_id""")
def q_speaker_columns(spark, sf_dir):
    assigned = _t(spark, sf_dir, "supplier").groupBy(F.expr("s_suppkey % 500").alias("file_id"), F.expr("s_suppkey % 3").alias("cluster_label")).agg(
        F.expr("min(case when s_suppkey % 11 <> 0 then s_suppkey % 97 end)").alias("person_id"), F.max("s_acctbal").alias("confidence"), F.expr("min(case when s_nationkey % 2 = 0 then '' else concat('r', s_nationkey) end)").alias("region"))
    sessions = _t(spark, sf_dir, "orders").selectExpr("o_orderkey as file_id", "o_custkey % 97 as teacher_id", "o_orderkey % 97 as student_id")
    persons = _t(spark, sf_dir, "customer").where("c_custkey < 97").selectExpr("c_custkey as id", "c_name as display_name", "c_mktsegment as default_role")
    segments = _t(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_orderkey as file_id", "l_linenumber % 3 as cluster_label")
    return speakers.speaker_columns(segments, assigned, sessions, persons, "file_id").drop("file_id", "cluster_label")


@bound("""select user_id, round(sum(case when event_id % 4 = 0 then 0 else value end) / count(*), 6) as mean_confidence, round(sum(value), 4) as seconds, count(*) filter (event_type = 'view' and value >= 50) as n_view
from events group by 1""")
def q_speaker_statistics(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").selectExpr("user_id", "event_type as region", "value as length", "case when event_id % 4 <> 0 then value end as confidence")
    told = speakers.speaker_statistics(rows, "user_id", 50)
    return told.select("user_id", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("seconds", 4).alias("seconds"), F.coalesce(F.try_element_at("clips", F.lit("view")), F.lit(0)).alias("n_view"))


@bound("""with w as (select l_orderkey, l_orderkey % 3 as current, case when l_linenumber % 5 <> 0 then l_partkey % 3 end as best, l_discount * 10 as s, 0.45 as c from lineitem),
n as (select l_orderkey, current, count(*) as n, count(*) filter (best <> current and s - c > 0.15) as f from w group by 1, 2),
v as (select l_orderkey, best, count(*) as k from w where best <> current group by 1, 2),
t as (select l_orderkey, best, k, row_number() over (partition by l_orderkey order by k desc, best) as rn from v)
select n.l_orderkey, n as n_words, f as n_flipped, case when f > 0 and k * 2 > n then best else current end as speaker_id from n left join t on t.l_orderkey = n.l_orderkey and rn = 1""")
def q_word_votes(spark, sf_dir):
    words = _t(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_orderkey % 3 as current", "case when l_linenumber % 5 <> 0 then l_partkey % 3 end as best", "l_discount * 10 as best_score", "0.45D as confidence")
    return speakers.word_votes(words, ["l_orderkey"], 0.15).drop("current")


@bound("""with c as (select distinct user_id, event_type from events) select a.user_id, a.event_type as label, b.event_type as other from c a join c b on a.user_id = b.user_id and a.event_type <> b.event_type""")
def q_other_clusters(spark, sf_dir):
    return speakers.other_clusters(_t(spark, sf_dir, "events"), "user_id", "event_type").withColumnRenamed("event_type", "label")


@bound("""select s_suppkey as a, s_suppkey + 1 as b, coalesce(x.c_name, cast(s_suppkey as varchar)) as name_a, coalesce(y.c_name, cast(s_suppkey + 1 as varchar)) as name_b
from supplier left join customer x on x.c_custkey = s_suppkey and x.c_custkey % 2 = 0 left join customer y on y.c_custkey = s_suppkey + 1 and y.c_custkey % 2 = 0""")
def q_named_pairs(spark, sf_dir):
    pairs = _t(spark, sf_dir, "supplier").selectExpr("s_suppkey as a", "s_suppkey + 1 as b")
    return speakers.named_pairs(pairs, _t(spark, sf_dir, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey as id", "c_name as display_name"))


@bound("select c_custkey, coalesce(case when c_custkey % 2 = 0 then c_nationkey end, 0) + coalesce(case when c_custkey % 3 = 0 then 5 end, 0) as n_sessions from customer")
def q_total_sessions(spark, sf_dir):
    persons = _t(spark, sf_dir, "customer").selectExpr("c_custkey", "case when c_custkey % 2 = 0 then c_nationkey end as n_sessions_as_teacher", "case when c_custkey % 3 = 0 then 5 end as n_sessions_as_student")
    return speakers.total_sessions(persons).select("c_custkey", "n_sessions")


_PATCH = """select l_orderkey as file_id, l_linenumber as patch_no, cast(case when l_partkey % 13 = 0 then -1 when l_partkey % 17 = 0 then 99 else l_linenumber end as int) as segment_index, cast(case when l_suppkey % 11 = 0 then -1 else l_suppkey % 4 end as int) as word_index,
  case when l_partkey % 19 = 0 then ' ' when l_partkey % 7 = 0 then 'other' else 'word' end as original, case l_suppkey % 5 when 0 then 'word' when 1 then 'term' when 2 then 'work' else 'ward' end as proposed from lineitem"""
_WORDS = "select l_orderkey as file_id, l_linenumber as segment_index, 0 as word_index, ' word ' as word, case when l_partkey % 3 = 0 then null else l_discount * 10 end as probability from lineitem"


@bound(f"""with p as ({_PATCH}),
w as ({_WORDS} union all select l_orderkey, l_linenumber, 1, 'word', l_tax * 10 from lineitem where l_linenumber % 2 = 0 union all select l_orderkey, l_linenumber, 2, case when l_suppkey % 2 = 0 then 'word' else 'else' end, 0.1 from lineitem),
s as (select distinct file_id, segment_index from w)
select p.file_id, p.patch_no, case when s.file_id is null or p.segment_index < 0 then 'invalid_segment_index' when p.word_index < 0 then 'invalid_word_index' when trim(original) = '' then 'empty_text' when trim(original) = proposed then 'no_change'
  when w.file_id is null then 'missing_word_metadata' when trim(word) <> trim(original) then 'original_mismatch' when probability is null and proposed <> 'term' then 'no_word_confidence_and_not_glossary'
  when probability >= 0.6 then 'word_confidence_above_threshold' when proposed <> 'term' and proposed[3] <> trim(original)[3] then 'phonetic_keys_differ' end as rejection_reason
from p left join s on s.file_id = p.file_id and s.segment_index = p.segment_index left join w on w.file_id = p.file_id and w.segment_index = p.segment_index and w.word_index = p.word_index""")
def q_patch_gate(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    sql = lambda s: spark.sql(s.replace("from lineitem", "from {lines}"), lines=lines)
    words = sql(f"{_WORDS} union all select l_orderkey, l_linenumber, 1, 'word', l_tax * 10 from lineitem where l_linenumber % 2 = 0 union all select l_orderkey, l_linenumber, 2, case when l_suppkey % 2 = 0 then 'word' else 'else' end, 0.1D from lineitem")
    alike = lambda a, b: F.substring(a, 3, 1) == F.substring(b, 3, 1)  # noqa: E731  the phonetic key is tested apart
    return polish.judge_patches(sql(_PATCH), words, ["Term"], 0.6, alike).select("file_id", "patch_no", "rejection_reason")


@bound("""select conv_id, turn, sha256(case when turn % 3 = 0 and turn % 2 = 0 then upper(role) || ' new' else text end) as text_sha, turn % 3 = 0 and turn % 2 = 0 as polished from conversations""")
def q_interleave(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations")
    back = rows.where("turn % 3 = 0").selectExpr("conv_id", "turn", "'x' as role", "case when turn % 2 = 0 then concat(upper(role), ' new') end as text")
    return polish.merge_polished(rows, back, ["conv_id", "turn"]).select("conv_id", "turn", F.sha2("text", 256).alias("text_sha"), "polished")


@bound("""select conv_id, count(*) as n_rows, sha256(string_agg(trim(text, ' ' || chr(9) || chr(10) || chr(13)), ' ' order by turn)) as text_sha from conversations group by 1""")
def q_ordered_text(spark, sf_dir):
    return polish.ordered_text(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "n_rows", F.sha2("text", 256).alias("text_sha"))


@bound("""select event_id, cast(row_number() over (partition by user_id order by case when event_id % 10 = 0 then 0 else cast(floor(value) as bigint) end, event_id) - 1 as int) as place, coalesce(event_type like 'p%', false) as is_sung from events""")
def q_in_order(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").selectExpr("user_id", "event_id as seg_idx", "case when event_id % 10 <> 0 then cast(floor(value) as bigint) end as start", "case when event_type like 'p%' then concat('sung_', event_type) when event_type = 'view' then null else event_type end as region")
    spoken, sung = polish.by_sung(rows)
    both = polish.in_order(spoken.withColumn("is_sung", F.lit(False)), sung.withColumn("is_sung", F.lit(True)), "user_id")
    return both.select(F.col("seg_idx").alias("event_id"), "place", "is_sung")


@bound("""with w as (select conv_id, turn, list_distinct(regexp_extract_all(text, '[A-Z][a-z]+')) as e, lag(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))) over (partition by conv_id order by turn) as b from conversations)
select conv_id, turn, array_to_string(list_sort(list_filter(e, lambda x: not list_contains(coalesce(b, []), x))), ',') as introduced from w""")
def q_introduced(spark, sf_dir):
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)))
    order = intervals.Window.partitionBy("conv_id").orderBy("turn")
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("e")).withColumn("b", F.lag("e").over(order))
    return rows.select("conv_id", "turn", F.array_join(polish.introduced(F.col("b"), F.col("e")), ",").alias("introduced"))


@bound("""select user_id, string_agg('{"start":' || event_id || ',"end":' || (event_id + 1) || ',"speaker_id":"' || event_type || '","text":"' || replace(props, '"', '\\"') || '"}', ',' order by event_id) as inner_json from events group by 1""")
def q_prompts(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").selectExpr("user_id", "event_id", "event_id as start", "event_id + 1 as end", "event_type as speaker_id", "props as text")
    return polish.prompts(rows, ["user_id"], "event_id").select("user_id", F.expr("substring(prompt, 2, length(prompt) - 2)").alias("inner_json"))


@bound("""select (select count(*) from orders) as n_sessions, (select count(*) from customer) as n_persons, (select cast(sum(cast(c_acctbal as decimal(18,2))) as varchar) from customer) as total_hours""")
def q_summary_row(spark, sf_dir):
    persons = _t(spark, sf_dir, "customer").select(F.col("c_acctbal").cast("decimal(18,2)").alias("total_hours"))
    return summaries.corpus_summary(_t(spark, sf_dir, "orders"), persons).withColumn("total_hours", F.col("total_hours").cast("string"))


@bound("""select c_nationkey as id, count(*) as n_sessions, string_agg(distinct c_mktsegment, ',' order by c_mktsegment) as regions from customer group by 1""")
def q_snapshot(spark, sf_dir):
    persons = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count(F.lit(1)).alias("n_sessions"), F.collect_set("c_mktsegment").alias("observed_regions"))
    return summaries.snapshot(persons).select("id", "entry.n_sessions", F.array_join("entry.regions", ",").alias("regions"))


@bound("""select n.n_nationkey as run, c.c_nationkey as id, 'v2' as version, cast(count(*) as bigint) as n_sessions from nation n, customer c group by 1, 2""")
def q_stamped(spark, sf_dir):
    persons = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count(F.lit(1)).alias("n_sessions"), F.collect_set("c_mktsegment").alias("observed_regions"))
    out = corpus.stamped(_t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("run")), summaries.snapshot(persons), version="v2")
    return out.select("run", "id", "version", "entry.n_sessions")


@bound("select count(*) as total, count(*) filter (doc_id in (select doc_id from labels)) as processed, count(*) filter (doc_id not in (select doc_id from labels)) as fresh from documents")
def q_scan_summary(spark, sf_dir):
    done = _t(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("d")).distinct()
    return summaries.scan_summary(_t(spark, sf_dir, "documents").join(done, "doc_id", "left"), F.coalesce("d", F.lit(False)))


@bound("select o_custkey as batch, count(*) filter (o_orderstatus = 'F') as n_ok, count(*) filter (o_orderstatus <> 'F') as n_failed from orders group by 1")
def q_batch_result(spark, sf_dir):
    return summaries.batch_result(_t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "batch"), F.col("o_orderstatus") == "F")


@bound("select o_orderkey, o_custkey from orders where o_orderstatus <> 'F'")
def q_batch_failures(spark, sf_dir):
    return summaries.batch_failures(_t(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey")


@bound("""with m as (select avg(case when event_type = 'view' and event_id % 3 <> 0 then value end) as a, avg(case when event_type = 'click' and event_id % 3 <> 0 then value end) as b from events)
select round(a, 6) as mean_old, round(b, 6) as mean_new, round(b - a, 6) as change from m""")
def q_mean_change(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").selectExpr("event_type", "case when event_id % 3 <> 0 then value end as v")
    told = summaries.mean_change(rows, "event_type", "v", "view", "click")
    return told.select(*[F.round(c, 6).alias(c) for c in told.columns])


@bound("select c_custkey, c_name from customer order by c_acctbal desc, c_custkey limit 1")
def q_best_by(spark, sf_dir):
    return summaries.best_by(_t(spark, sf_dir, "customer"), "c_acctbal", "c_custkey").select("c_custkey", "c_name")


@bound("""with e as (select user_id, quantile_cont(value, 0.05) as l, quantile_cont(value, 0.95) as h from events where value > 20 group by 1 having count(*) >= 40)
select c_custkey, round(least(c_nationkey * 3.0, coalesce(l, c_nationkey * 3.0)), 6) as low, round(greatest(c_nationkey * 20.0, coalesce(h, c_nationkey * 20.0)), 6) as high from customer left join e on user_id = c_custkey""")
def q_pitch_ranges(spark, sf_dir):
    persons = _t(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey * 3.0D as low", "c_nationkey * 20.0D as high")
    frames = _t(spark, sf_dir, "events").selectExpr("user_id as c_custkey", "case when value > 20 then value else 0 end as pitch")
    return summaries.pitch_ranges(frames, persons, "c_custkey", "pitch", 40).select("c_custkey", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


_BANDS = "values " + ", ".join(f"('{kind}', {', '.join(f'{lo}, {hi}' for lo, hi in pairs)})" for kind, *pairs in regions.BANDS)
_PERSON = "select c_custkey, case c_nationkey % 8 when 0 then 'BASS' when 1 then 'baritone' when 2 then 'Tenor' when 3 then 'alto' when 4 then 'mezzo' when 5 then 'soprano' when 6 then 'other' end as kind, case when c_custkey % 3 = 0 then 100.0 end as low, case when c_custkey % 3 = 0 then 60.0 + c_custkey % 500 end as high, abs(c_acctbal) / 10 as middle, case when c_custkey % 9 <> 0 then c_custkey % 20 / 100.0 end as spread, c_custkey % 5 = 0 as held from customer"


@bound(f"""with t(kind, sp1, sp2, lo1, lo2, mi1, mi2, hi1, hi2, fu1, fu2) as ({_BANDS}), p as ({_PERSON}),
b as (select p.*, low < high as own, t.* exclude (kind) from p join t on t.kind = case when lower(coalesce(p.kind, '')) in (select kind from t) then lower(p.kind) else '_default' end),
c as (select *, case when own then low else sp1 end as a, case when own then low + 0.35 * (high - low) else sp2 end as b, case when own then low else lo1 end as c, case when own then low + 0.5 * (high - low) else lo2 end as d,
 case when own then low + 0.5 * (high - low) else mi1 end as e, case when own then low + 0.75 * (high - low) else mi2 end as f from b)
select c_custkey, round(b::double, 6) as speech_end, round(d::double, 6) as low_end, case when c_custkey % 7 = 0 then 'speaking' when middle between a and b and spread <= 0.08 then 'speaking' when held then 'sung_full' when middle >= c and middle < d then 'sung_low' when middle >= e and middle < f then 'sung_mid' else 'sung_high' end as region from c""")
def q_pitch_region(spark, sf_dir):
    rows = spark.sql(_PERSON.replace("from customer", "from {persons}"), persons=_t(spark, sf_dir, "customer")).withColumn("bands", regions.person_bands(F.col("kind"), F.col("low"), F.col("high")))
    middle = F.when(F.col("c_custkey") % 7 != 0, F.col("middle"))
    region = regions.pitch_region(middle, F.col("spread"), F.col("held"), F.col("bands"))
    return rows.select("c_custkey", F.round("bands.speaking.hi", 6).alias("speech_end"), F.round("bands.sung_low.hi", 6).alias("low_end"), region.alias("region"))


@bound("""select vec_id, cast(f as int) as first, round(list_sum(e[f + 1 : f + 24]), 5) as total, cast(len(e[f + 1 : f + 24]) as int) as n from (select vec_id, embedding::double[] as e, unnest(range(0, len(embedding) - 24 + 1, 8)) as f from embeddings)""")
def q_sliding_windows(spark, sf_dir):
    rows = regions.sliding_windows(_t(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 24, 8)
    return rows.select("vec_id", "first", F.round(F.aggregate("window", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"), F.size("window").alias("n"))


@bound("""select event_id, greatest(0, cast(trunc((value - 100) * 16000) as bigint)) as first, least(3000000, cast(trunc((value + 0.5) * 16000) as bigint)) as after, value < 3.0 as is_short from events""")
def q_sample_bounds(spark, sf_dir):
    rows = _t(spark, sf_dir, "events")
    at = regions.sample_bounds(F.col("value") - 100, F.col("value") + 0.5, F.lit(3000000).cast("long"))
    return rows.select("event_id", at["first"].alias("first"), at["after"].alias("after"), regions.is_short_turn(F.lit(0.0), F.col("value")).alias("is_short"))


@bound("""select vec_id, string_agg(case when (i >= label and i < label + 5) or (i >= 20 and i < 20 + label) then '1' else '0' end, '' order by i) as mask from (select vec_id, label, unnest(range(0, 32)) as i from embeddings) group by 1""")
def q_speech_mask(spark, sf_dir):
    spans = F.array(F.struct(F.col("label").alias("first"), (F.col("label") + 5).alias("after")), F.struct(F.lit(20).alias("first"), (F.lit(20) + F.col("label")).alias("after")))
    mask = regions.speech_mask(F.lit(32), spans)
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(mask, lambda x: F.when(x, "1").otherwise("0")), "").alias("mask"))


@bound("""with m as (select label, pos, avg(x) as x from (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as pos from embeddings) group by 1, 2),
n as (select label, sqrt(sum(x * x)) + 1e-9 as n from m group by 1) select label, cast(pos - 1 as int) as pos, round(x / n, 6) as x from m join n using (label)""")
def q_universal_unit(spark, sf_dir):
    means = library.universal(_t(spark, sf_dir, "embeddings"), "label", "embedding")
    return means.select("label", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@bound("""with e as (select vec_id, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as pos from embeddings), n as (select vec_id, sqrt(sum(x * x)) + 1e-9 as n from e group by 1)
select vec_id as person_id, name, 0 as row_no, cast(pos - 1 as int) as pos, round(x / n, 6) as x from e join n using (vec_id), (values ('universal'), ('recent')) t(name)""")
def q_bootstrap(spark, sf_dir):
    rows = library.bootstrap(_t(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return rows.select("person_id", "name", "row_no", F.posexplode("vec").alias("pos", "x")).withColumn("x", F.round("x", 6))


def _clusters(spark, sf_dir):
    """Two vectors a file; the session's teacher and student are labels, of which those below 8 are registered."""
    vectors = _t(spark, sf_dir, "embeddings")
    clusters = vectors.selectExpr("vec_id div 2 as file_id", "concat('S', vec_id % 2) as cluster_label", "embedding as vec", "label")
    role = lambda k: F.max(F.when(F.col("cluster_label") == f"S{k}", F.col("label"))).cast("string")
    sessions = clusters.groupBy("file_id").agg(role(0).alias("teacher_id"), role(1).alias("student_id"))
    library_ = vectors.where("vec_id % 7 = 0").selectExpr("cast(label as string) as person_id", "concat('r', vec_id % 3) as name", "cast(vec_id as int) as row_no", "embedding as vec")
    persons = vectors.where("label < 8").selectExpr("cast(label as string) as id").distinct()
    return clusters.drop("label"), sessions, library_, persons


@bound("""with e as (select vec_id, label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as pos from embeddings),
n as (select vec_id, sqrt(sum(x * x)) + 1e-9 as n from e group by 1),
s as (select a.vec_id // 2 as file_id, a.label as t, b.label as s from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0),
p as (select vec_id, vec_id // 2 as file_id, vec_id % 2 as k, role, case role when 'teacher' then t else s end as who from embeddings join s on s.file_id = vec_id // 2, (values ('teacher'), ('student')) r(role)),
d as (select p.vec_id, role, l.vec_id as lib, sum(a.x * b.x) / (any_value(na.n) * any_value(nb.n)) as c from p join embeddings l on l.label = p.who and l.vec_id % 7 = 0 and l.label < 8
  join e a on a.vec_id = p.vec_id join e b on b.vec_id = l.vec_id and b.pos = a.pos join n na on na.vec_id = p.vec_id join n nb on nb.vec_id = l.vec_id group by 1, 2, 3),
b as (select p.vec_id, file_id, k, p.role, who, coalesce(max(c), -1) as score, coalesce(arg_max(lib, c), -1) as lib from p left join d on d.vec_id = p.vec_id and d.role = p.role group by all),
f as (select file_id, sum(score) filter ((k = 0) = (role = 'teacher')) >= sum(score) filter ((k = 0) <> (role = 'teacher')) as straight from b group by 1)
select file_id, 'S' || k as cluster_label, who::varchar as person_id, round(case when who < 8 then score else 1 end, 6) as confidence,
case when who >= 8 then 'universal' when lib < 0 then '' else 'r' || lib % 3 end as region, who >= 8 as is_new from b join f using (file_id) where ((k = 0) = (role = 'teacher')) = straight""")
def q_identify(spark, sf_dir):
    found, _ = redo.identify(*_clusters(spark, sf_dir))
    return found.withColumn("confidence", F.round("confidence", 6)).select("file_id", "cluster_label", "person_id", "confidence", "region", "is_new")


@bound("""with r as (select l_suppkey as p, l_orderkey as s, l_linenumber % 6 as reg, sum(l_quantity::bigint) as l, count(*) as n, sum(cast(l_tax * 100 as bigint)) as c, any_value(l_suppkey % 3) as role from lineitem group by 1, 2, 3),
g as (select p, s, case when reg in (0, 5) then 'speaking' else 'sung_' || ['low', 'mid', 'high', 'full'][reg] end as reg, sum(l) as l, sum(n) as n, sum(c) as c, any_value(role) as role from r group by 1, 2, 3),
u as (select p, s, sum(l) as seconds, (sum(c) / sum(n)::double + 60) / 100 as conf, max(l) >= 30 as long, any_value(role) as role from g group by 1, 2),
a as (select *, case when conf >= 0.65 then 1 else 0 end as ok, min(case when conf >= 0.65 and long then s end) over (partition by p) as first from u),
b as (select *, case when s > first and conf >= 0.67 and long then row_number() over (partition by p, s > first and conf >= 0.67 and long order by s) end as k from a),
t as (select *, max(case when k = 2 then s end) over (partition by p) as third from b),
j as (select *, case when ok = 0 then 'r' when s > first and s <= coalesce(third, s) and conf < 0.67 then 'h' when not long then 's' else 'u' end as d from t),
c as (select j.p, string_agg(reg || ':' || n, ',' order by reg) as counts from (select p, reg, count(*) as n from g join j using (p, s) where d = 'u' and l >= 30 group by 1, 2) j group by 1)
select p::varchar as person_id, count(*) filter (d = 'u') as n_updated, count(*) filter (d = 'h') as n_held, count(*) filter (d = 'r') as n_rejected, count(*) filter (d = 's') as n_short,
cast(coalesce(sum(seconds) filter (d = 'u'), 0) as bigint) as seconds, count(*) filter (d = 'u' and role = 0) as as_teacher, count(*) filter (d = 'u' and role = 1) as as_student,
cast(greatest(0, 3 - count(*) filter (d = 'u')) as int) as remaining, coalesce(max(counts), '') as counts, lpad((max(s) filter (d = 'u'))::varchar, 12, '0') as last_updated from j left join c using (p) group by p""")
def q_library_update(spark, sf_dir):
    """Orders as sessions, suppliers as persons: gates, counters, hours and trust over all lines; vectors are tested apart."""
    lines = _t(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as file_id", "cast(l_suppkey as string) as speaker_id", "element_at(array('speaking', 'sung_low', 'sung_mid', 'sung_high', 'sung_full', 'universal'), cast(l_linenumber % 6 + 1 as int)) as matched_region",
        "0D as start", "cast(cast(l_quantity as bigint) as double) as end", "(cast(l_tax * 100 as bigint) + 60) / 100D as speaker_confidence")
    persons = _t(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as string) as id", "cast(null as string) as first_seen")
    pairs = lines.select("file_id", F.col("speaker_id").alias("person_id")).distinct()
    roles = pairs.selectExpr("file_id", "person_id", "case when cast(person_id as bigint) % 3 = 0 then 'teacher' when cast(person_id as bigint) % 3 = 1 then 'student' end as role")
    voices = lines.selectExpr("file_id", "speaker_id as person_id", "case when matched_region = 'universal' then 'speaking' else matched_region end as region").distinct().withColumn("vec", F.expr("array(1D, 0D)"))
    blank = _t(spark, sf_dir, "orders").selectExpr("o_orderkey as file_id", "lpad(cast(o_orderkey as string), 12, '0') as date", "cast(null as string) as teacher_id", "cast(null as string) as student_id")
    updates = library.session_updates(lines, blank, voices).drop("role").join(roles, ["file_id", "person_id"])
    out = library.fold_library(updates, library.state_of(library.new_persons(persons), voices.limit(0).selectExpr("person_id", "region as name", "0 as row_no", "vec")), new_floor=0.67, min_seconds=30.0)
    told = F.array_join(F.transform(F.array_sort(F.map_entries("person.region_session_counts")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return out.join(pairs.select("person_id").distinct(), "person_id").select(
        "person_id", "n_updated", "n_held", "n_rejected", "n_short", F.round(F.col("person.total_hours") * 3600).cast("long").alias("seconds"), F.col("person.n_sessions_as_teacher").alias("as_teacher"), F.col("person.n_sessions_as_student").alias("as_student"),
        F.col("person.bootstrap_sessions_remaining").alias("remaining"), told.alias("counts"), F.col("person.last_updated").alias("last_updated"))


@bound("""with p as (select c_custkey, c_nationkey as k, c_mktsegment as r, c_custkey % 4 as n from customer),
o as (select k, r, min(case when c_custkey = m then 0 else 1 end) as own, min(c_custkey) as fst from p join (select k, min(c_custkey) as m from p group by 1) using (k) group by 1, 2),
c as (select k, string_agg(r || ':' || n, ',' order by r) as counts from (select k, r, sum(n)::bigint as n from p group by 1, 2) group by 1)
select t.m as id, t.n as n_sessions, regions, counts from (select k, min(c_custkey) as m, sum(n)::bigint as n from p group by 1) t join c using (k) join (select k, string_agg(r, ',' order by own, fst) as regions from o group by 1) z using (k)""")
def q_merge_whole(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer")
    first = rows.groupBy("c_nationkey").agg(F.min("c_custkey").alias("into"))
    merges = rows.join(first, "c_nationkey").where("c_custkey <> into").select(F.col("c_custkey").alias("id"), "into")
    persons = rows.selectExpr("c_custkey as id", "c_name as display_name", "c_custkey % 4 as n_sessions", "c_acctbal as hours", "array(c_mktsegment) as regions", "map(c_mktsegment, c_custkey % 4) as counts")
    told = F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return corpus.merge_into(persons, merges).select("id", "n_sessions", F.array_join("regions", ",").alias("regions"), told.alias("counts"))


@bound("""with m as (select s_suppkey as id, s_suppkey - 1 as into_ from supplier where s_suppkey % 4 = 3),
e as (select coalesce(x.into_, l_suppkey) as a, coalesce(y.into_, l_suppkey % 9 + 1) as b from lineitem left join m x on x.id = l_suppkey left join m y on y.id = l_suppkey % 9 + 1)
select distinct least(a, b) as a, greatest(a, b) as b from e where a <> b""")
def q_merge_edges(spark, sf_dir):
    merges = _t(spark, sf_dir, "supplier").where("s_suppkey % 4 = 3").selectExpr("s_suppkey as id", "s_suppkey - 1 as into")
    edges = _t(spark, sf_dir, "lineitem").selectExpr("l_suppkey as a", "l_suppkey % 9 + 1 as b")
    return corpus.merge_edges(edges, merges)


@bound("""select vec_id, label from embeddings where label not in (select s_suppkey from supplier where s_suppkey % 3 = 0)""")
def q_drop_merged(spark, sf_dir):
    merges = _t(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").selectExpr("cast(s_suppkey as int) as id")
    return corpus.drop_merged(_t(spark, sf_dir, "embeddings"), merges, "label").select("vec_id", "label")


@bound("""select a, b, l_orderkey, l_linenumber from (select *, row_number() over (partition by a, b order by l_orderkey * 10 + l_linenumber desc) as n from (select least(l_suppkey, l_partkey) as a, greatest(l_suppkey, l_partkey) as b, l_orderkey, l_linenumber from lineitem)) where n = 1""")
def q_last_of_pairs(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").selectExpr("l_suppkey as a", "l_partkey as b", "l_orderkey", "l_linenumber", "l_orderkey * 10 + l_linenumber as at")
    return corpus.last_of_pairs(rows, "a", "b", "at").select("a", "b", "l_orderkey", "l_linenumber")


@bound("""select event_id, case when event_id % 9 <> 0 then user_id end as id, case when event_id % 9 <> 0 and event_id % 2 = 0 then event_type end as name from events""")
def q_json_records(spark, sf_dir):
    lines = _t(spark, sf_dir, "events").selectExpr("event_id", "case when event_id % 9 = 0 then '{broken' when event_id % 2 = 0 then to_json(struct(user_id as id, event_type as name, 1 as unknown)) else to_json(struct(user_id as id)) end as line")
    return corpus.from_json_records(lines, "line", "id long, name string")


@bound("""select event_id, case event_id % 3 when 0 then value when 1 then cast(user_id as double) end as duration, case when event_id % 2 = 0 then event_type end as name from events""")
def q_aliased(spark, sf_dir):
    lines = _t(spark, sf_dir, "events").selectExpr("event_id", "to_json(struct(case when event_id % 3 = 0 then value end as duration_s, case event_id % 3 when 0 then 'x' when 1 then cast(user_id as string) else 'none' end as duration, case when event_id % 2 = 0 then event_type end as title)) as line")
    return corpus.aliased(lines, "line", {"duration": ("double", ["duration_s", "duration"]), "name": ("string", ["name", "title"])})


@bound("select distinct user_id, event_type from events where (user_id, event_type) not in (select user_id, event_type from events where value > 300)")
def q_unassigned(spark, sf_dir):
    rows = _t(spark, sf_dir, "events")
    given = rows.selectExpr("user_id", "event_type", "case when value > 300 then 1 end as person_id")
    return corpus.unassigned(rows.select("user_id", "event_type").distinct(), given, ["user_id", "event_type"])


@bound("""select event_id, cast(case when event_id % 5 = 0 then null else epoch_us(date_trunc('second', ts)) end as varchar) as at from events""")
def q_parse_time(spark, sf_dir):
    stamp = F.expr("case event_id % 5 when 0 then 'yesterday' when 1 then concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Z') when 2 then concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '+00:00') when 3 then concat(date_format(timestampadd(HOUR, 2, ts), \"yyyy-MM-dd'T'HH:mm:ss\"), '+02:00') else concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Z') end")
    return _t(spark, sf_dir, "events").select("event_id", F.unix_micros(text.parse_time(stamp)).cast("string").alias("at"))


@bound("""select event_id, case when value * 40 >= 3600 then cast(floor(value * 40 / 3600) as bigint) || 'h ' || cast(floor(value * 40 % 3600 / 60) as bigint) || 'm' when value * 40 >= 60 then cast(floor(value * 40 / 60) as bigint) || 'm ' || cast(floor(value * 40 % 60) as bigint) || 's' else cast(floor(value * 40) as bigint) || 's' end as long_form,
cast(floor(value / 60) as bigint) || ':' || lpad(cast(cast(floor(value % 60) as bigint) as varchar), 2, '0') as clock,
case when length(event_type || props || event_type) <= 16 then event_type || props || event_type else left(event_type || props || event_type, 7) || '…' || right(event_type || props || event_type, 7) end as cut,
least(1.0, greatest(0.0, (value - 50) / 200)) as share from events""")
def q_formats(spark, sf_dir):
    long = F.concat("event_type", "props", "event_type")
    return _t(spark, sf_dir, "events").select(
        "event_id", text.duration_text(F.col("value") * 40).alias("long_form"), text.clock_text(F.col("value")).alias("clock"), text.middle_cut(long, 16).alias("cut"), text.clamp01((F.col("value") - 50) / 200).alias("share")
    )


@bound("""with b as (select doc_id, n_chars * n_chars * (doc_id % 40) as n from documents) select doc_id, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f KB', floor(n / 1024.0::double * 10 + 0.5) / 10) when n < 1073741824 then printf('%.1f MB', floor(n / 1048576.0::double * 10 + 0.5) / 10) else printf('%.2f GB', floor(n / 1073741824.0::double * 100 + 0.5) / 100) end as size from b""")
def q_size_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.size_text(F.expr("cast(n_chars as bigint) * n_chars * (doc_id % 40)")).alias("size"))


@bound("""select user_id, count(*) filter (event_type = 'view') / count(*) as share, case when count(*) filter (event_type = 'view') > 0 then round(sum(value), 4) / count(*) filter (event_type = 'view') end as each from events group by 1""")
def q_progress(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("d"), F.count(F.lit(1)).alias("t"), F.round(F.sum("value"), 4).alias("s"))
    told = text.progress(F.col("d"), F.col("t"), F.col("s"))
    return rows.select("user_id", told["share"].alias("share"), told["each"].alias("each"))


_MESSAGE = "concat(c_name, case c_custkey % 6 when 0 then ': CUDA error' when 1 then ' Timed Out' when 2 then ' Connection reset by peer' when 3 then ' room' when 4 then ' no such file' else '' end)"


@bound("select c_custkey, c_custkey % 6 in (0, 1, 2, 3) as again from customer")
def q_transient(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", text.is_transient(F.expr(_MESSAGE).substr(F.lit(1), F.lit(200))).alias("again")).withColumn("again", F.col("again"))


@bound("""select doc_id, sha256(trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '_', 'g'), '_')) as id_sha from documents""")
def q_ascii_id(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce(text.ascii_id(F.col("text")), F.lit("")), 256).alias("id_sha"))


@bound("""select event_id, cast(case event_type when 'view' then 1 when 'click' then 2 else event_id % 7 end as bigint) as place from events""")
def q_phase_number(spark, sf_dir):
    name = F.expr(f"case event_type when 'view' then '{fold.PHASES[1]}' when 'click' then '{fold.PHASES[2]}' else 'none' end")
    return _t(spark, sf_dir, "events").select("event_id", fold.phase_number(name, F.expr("event_id % 7")).alias("place"))


@bound("""with e as (select user_id, event_id, event_type as k, user_id % 2 + event_id % 2 as f, case when event_type = 'signup' then 'p' || event_id end as p from events),
b as (select *, coalesce(sum(case when k = 'error' then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as g from e)
select event_id, coalesce(p, last_value(p ignore nulls) over (partition by user_id, g, f order by event_id rows between unbounded preceding and current row)) as resolved from b""")
def q_resolve_paths(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").selectExpr("user_id as run", "event_id as seq", "case event_type when 'error' then 'batch_done' when 'signup' then 'start' else event_type end as kind", "user_id % 2 + event_id % 2 as file_index", "case when event_type = 'signup' then concat('p', event_id) end as path")
    return fold.resolve_paths(rows).select(F.col("seq").alias("event_id"), "resolved")


@bound("""with f as (select user_id, max(event_id) filter (event_type = 'signup') as s, min(event_id) filter (event_type not in ('error', 'purchase')) as k from events group by 1 having k is not null),
e as (select e.* from events e join f using (user_id) where event_id >= coalesce(s, k))
select user_id, coalesce(string_agg(cast(event_id as varchar), ',' order by event_id) filter (event_type = 'purchase'), '') as completed, arg_max(props, event_id) filter (event_type = 'error') as message from e group by 1""")
def q_completed_phases(spark, sf_dir):
    kinds = "case event_type when 'signup' then 'start' when 'purchase' then 'phase_done' when 'error' then 'warning' else 'phase' end as kind"
    rows = _t(spark, sf_dir, "events").selectExpr("user_id", "event_id as seq", kinds, "cast(event_id as string) as phase", "props as message")
    return fold.completed_phases(rows, "user_id").select("user_id", F.array_join("completed", ",").alias("completed"), "message")


@bound("""select t::double as threshold, round(avg(value) filter (value < t), 6) as cost_flagged, round(avg(value) filter (value >= t), 6) as cost_unflagged, round(avg(value) filter (value < t) - avg(value) filter (value >= t), 6) as separation from events, (values (50), (100), (5000)) x(t) group by t""")
def q_sweep_costs(spark, sf_dir):
    swept = measures.sweep(_t(spark, sf_dir, "events"), "value", "value", [50, 100, 5000])
    return swept.select("threshold", *[F.round(c, 6).alias(c) for c in ("cost_flagged", "cost_unflagged", "separation")])


@bound("""with w as (select conv_id, turn, regexp_extract_all(text, '[^ \\t\\n\\r]+') as w, -length(text) / 1000.0 as l from conversations)
select conv_id, turn, (turn % 4 = 0 and conv_id % 2 = 0) or case when len(w) > 0 then len(list_filter(w, lambda x: length(x) / 10.0 < 0.2)) = 0 else coalesce(l > -0.3, false) end as skip from w""")
def q_polish_needless(spark, sf_dir):
    sure = F.transform(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), F.lit(0)), lambda w: F.length(w) / 10.0)
    skip = text.polish_needless(F.expr("turn % 4 = 0"), F.expr("conv_id % 2 = 0"), sure, -F.length("text") / 1000.0, 0.2)
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", skip.alias("skip"))


@bound(f"""with {_S}
select v.id, count(*) as n_points, string_agg(c.id || 'x', ' ' order by c.id) as heard from s v join s c on v.kind = 'view' and c.kind = 'click' and v.user_id = c.user_id and (c.st + c.en) // 2 between v.st and v.en group by v.id""")
def q_point_text(spark, sf_dir):
    rows = _spans(spark, sf_dir).withColumn("text", F.concat(F.lit(" "), F.col("id").cast("string"), F.lit("x ")))
    return intervals.texts_in(rows.where("kind = 'click'"), rows.where("kind = 'view'"), "user_id", "text")


@bound(f"""with {_S},
p as (select a.user_id, cast(sum(least(a.en, b.en) - greatest(a.st, b.st)) as bigint) as o from s a join s b on a.user_id = b.user_id and a.kind < b.kind and a.st < b.en and b.st < a.en group by 1),
l as (select user_id, max(en) as n from s group by 1)
select user_id, coalesce(o, 0) as overlap, least(1.0::double, coalesce(o, 0)::double / n) as ratio from l left join p using (user_id)""")
def q_overlap_of_end(spark, sf_dir):
    return intervals.overlap_ratio(_spans(spark, sf_dir), "user_id", "kind", from_zero=True)


_PIECES = """s as (select user_id as file_id, event_id as seg_idx, event_type as cluster_label, cast(floor(value * 10) / 10 as double) as st from events),
n as (select user_id as file_id, 400 as n from events group by 1),
g as (select file_id, seg_idx, cluster_label, cast(st * 4 as bigint) as f, (seg_idx % 9) / 4.0 as l from (select file_id, seg_idx, cluster_label, floor(st) as st from s)),
u as (select *, coalesce(sum(l) over (partition by file_id, cluster_label order by l desc, seg_idx rows between unbounded preceding and 1 preceding), 0) as used,
  row_number() over (partition by file_id, cluster_label order by l desc, seg_idx) - 1 as place from g join n using (file_id) where n - f >= 2),
t as (select *, least(l, 6 - least(6, used)) as take from u),
p as (select file_id, cluster_label, place::int as place, f as first, least(n, f + cast(floor(take * 4) as bigint)) as after from t where take > 0.1)"""


def _pieces(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    segments = events.selectExpr("user_id as file_id", "event_id as seg_idx", "event_type as cluster_label", "floor(floor(value * 10) / 10) * 1D as start").withColumn("end", F.col("start") + F.col("seg_idx") % 9 / 4)
    ends = events.select(F.col("user_id").alias("file_id")).distinct().withColumn("n", F.lit(400).cast("long"))
    return signals.cluster_pieces(segments, ends, budget=6.0, rate=4)


@bound(f"with {_PIECES} select * from p where after - first >= 2")
def q_cluster_pieces(spark, sf_dir):
    return _pieces(spark, sf_dir)


@bound(f"""with {_PIECES} select file_id, cluster_label, count(*) as n_samples, cast(sum(i * 7 + file_id % 13) as bigint) as total from (select file_id, cluster_label, unnest(range(first, after)) as i from p where after - first >= 2) group by 1, 2""")
def q_cut_pieces(spark, sf_dir):
    """Samples of files of 400, in blocks of 16, put together for each cluster."""
    blocks = _t(spark, sf_dir, "events").select(F.col("user_id").alias("file_id")).distinct().withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))))
    blocks = blocks.withColumn("samples", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (F.col("block") * 16 + i) * 7 + F.col("file_id") % 13))
    cut = signals.cut(_pieces(spark, sf_dir), blocks, 16)
    return cut.groupBy("file_id", "cluster_label").agg(F.sum(F.size("samples")).alias("n_samples"), F.sum(F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))


@bound(f"""with {_S},
w as (select user_id, id, k, st + k * ((en - st) // 4) as ws, st + (k + 1) * ((en - st) // 4) as we from s, (values (0), (1), (2), (3)) t(k)),
o as (select w.id, k, t.kind, sum(least(we, t.en) - greatest(ws, t.st)) as d from w join s t on t.user_id = w.user_id and t.id % 2 = 1 and ws < t.en and t.st < we group by 1, 2, 3),
b as (select id, k, arg_min(kind, (-d, kind)) as label from o group by 1, 2)
select id as event_id, string_agg(coalesce(label, '-'), ',' order by k) as labels from w left join b using (id, k) group by 1""")
def q_words_speakers(spark, sf_dir):
    """Events as segments of four words each, every second event as a turn of its kind."""
    rows = _spans(spark, sf_dir)
    quarter = (F.col("end") - F.col("start")).cast("long")
    quarter = F.floor(quarter / 4)
    word = lambda k: F.struct((F.col("start") + k * quarter).alias("start"), (F.col("start") + (k + 1) * quarter).alias("end"))
    segments = rows.select("user_id", "id", "start", "end", F.array(*[word(k) for k in range(4)]).alias("words"))
    out = shaping.speakers_of_words(segments, rows.where("id % 2 = 1"), "user_id", "words", "kind", bucket=6 * intervals.HOUR)
    return out.select(F.col("id").alias("event_id"), F.array_join(F.transform("words", lambda w: F.coalesce(w["cluster_label"], F.lit("-"))), ",").alias("labels"))


@bound(r"""with w as (select conv_id, turn, text, string_split(text, ' ') as w from conversations),
e as (select conv_id, turn, unnest(w) as x, generate_subscripts(w, 1) - 1 as i from w),
k as (select conv_id, turn, count(*) as n_words, string_agg(regexp_replace(x, '^\s+|\s+$', '', 'g'), '|' order by i) as said, sum(case when i % 3 = 0 then 0 else i end)::double as score from e where i % 5 <> 0 and i % 7 <> 0 group by 1, 2)
select conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') as text, coalesce(n_words, 0) as n_words, coalesce(said, '') as said, coalesce(score, 0) as score from w left join k using (conv_id, turn)""")
def q_aligned(spark, sf_dir):
    """Turns of conversations as segments; words at places divisible by 5 lack a start, by 7 an end, by 3 a score."""
    rows = _t(spark, sf_dir, "conversations")
    word = lambda x, i: F.struct(x.alias("word"), F.when(i % 5 != 0, i * 0.5).alias("start"), F.when(i % 7 != 0, i * 0.5 + 0.5).alias("end"), F.when(i % 3 != 0, i).alias("score"))
    out = shaping.aligned(rows.withColumn("words", F.transform(F.split("text", " "), word)))
    at = "words_wav2vec2"
    return out.select("conv_id", "turn", "text", F.size(at).cast("long").alias("n_words"), F.array_join(F.transform(at, lambda w: w["word"]), "|").alias("said"), F.aggregate(at, F.lit(0.0), lambda s, w: s + w["score"]).alias("score"))


@bound(r"""with i as (select l_orderkey, l_linenumber, l_linenumber % 7 = 0 as everything, case l_linenumber % 4 when 0 then '' when 1 then ' 12 h' when 2 then 'x' else l_quantity::bigint::varchar end as threshold,
case when l_suppkey % 3 = 0 then '  ' else ' p' || l_suppkey || ' ' end as student, case l_linenumber % 3 when 0 then '-0.5' when 1 then '.' || l_partkey || 'e-1z' else 'none' end as confidence from lineitem)
select l_orderkey, l_linenumber, case when everything then true end as "all", case when not everything then try_cast(regexp_extract(threshold, '^\s*([+-]?[0-9]+)', 1) as bigint) end as threshold,
case when not everything then nullif(trim(student), '') end as student, case when not everything and l_linenumber % 3 = 1 then nullif(round(('0.' || regexp_extract(confidence, '[0-9]+'))::double / 10, 9), 0) end as confidence_below from i""")
def q_redo_filters(spark, sf_dir):
    typed = _t(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_linenumber % 7 = 0 as everything", "case l_linenumber % 4 when 0 then '' when 1 then ' 12 h' when 2 then 'x' else cast(cast(l_quantity as bigint) as string) end as threshold",
        "case when l_suppkey % 3 = 0 then '  ' else concat(' p', l_suppkey, ' ') end as student", "cast(null as string) as teacher", "case l_linenumber % 3 when 0 then '-0.5' when 1 then concat('.', l_partkey, 'e-1z') else 'none' end as confidence", "' ' as after")
    return commands.redo_filters(typed).withColumn("confidence_below", F.round("confidence_below", 9)).drop("teacher", "after")


@bound("""select c_custkey, row_number() over (partition by c_nationkey order by c_name, c_custkey) - 1 as by_name, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) - 1 as by_size from customer""")
def q_display_order(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer")
    named = summaries.display_order(rows, "c_nationkey", "c_name", "c_name", "c_custkey").withColumnRenamed("place", "by_name")
    return summaries.display_order(named, "c_nationkey", "c_acctbal", "c_name", "c_custkey").select("c_custkey", "by_name", F.col("place").alias("by_size"))


@bound("""with v as (select * from (values ('discount', 0, 0.02), ('discount', 1, 0.05), ('discount', 2, 0.0), ('tax', 0, 0.04), ('tax', 1, 0.07)) t(knob, place, value)),
m as (select v.*, case knob when 'discount' then l_discount else l_tax end < value as low, l_quantity::bigint as q from lineitem, v),
s as (select knob, place, value, count(*) filter (low) as n_flagged, avg(q) filter (low) - avg(q) filter (not low) as separation from m group by 1, 2, 3)
select knob, value::double as value, n_flagged, round(separation, 9) as separation from s where separation is not null qualify row_number() over (partition by knob order by separation desc, place) = 1""")
def q_recommended_knobs(spark, sf_dir):
    knobs = {"discount": ("l_discount", (0.02, 0.05, 0.0)), "tax": ("l_tax", (0.04, 0.07))}
    rows = _t(spark, sf_dir, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("long"))
    return calibration.recommended(calibration.swept(rows, "l_quantity", knobs)).select("knob", "value", "n_flagged", F.round("separation", 9).alias("separation"))
