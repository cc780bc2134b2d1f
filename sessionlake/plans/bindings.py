"""Queries over the driver's tables, one for each operator, with the same query as SQL.

Files and persons are the users of ``events``, spans run from ``ts`` for ``value`` minutes, speakers are event types,
voice vectors are ``embeddings`` and sessions are ``orders``. Times are integer microseconds; sums are of decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.functions import text
from sessionlake.operators import corpus, intervals, matching, measures, registry, summaries
from sessionlake.streaming import commands, fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def bound(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    rows = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value", start.alias("start"))
    return rows.withColumn("end", F.col("start") + F.floor(F.col("value") * 60_000_000))


_S = "s as (select user_id, event_id as id, event_type as kind, value, epoch_us(ts) as st, epoch_us(ts) + cast(floor(value * 60000000) as bigint) as en from events)"


@bound(f"""with {_S},
a as (select *, row_number() over w as rn, case when st - lag(en) over w < 21600000000 then 0 else 1 end as brk from s window w as (partition by user_id order by st, id)),
b as (select *, sum(brk) over (partition by user_id order by rn) - 1 as g from a)
select user_id, cast(g as bigint) as span_no, min(st) as start_us, arg_max(en, rn) as end_us, count(*) as n_spans from b group by user_id, g""")
def q_gap_merge(spark, sf_dir):
    out = intervals.gap_merge(_spans(spark, sf_dir), "user_id", 6 * intervals.HOUR)
    return out.withColumnsRenamed({"start": "start_us", "end": "end_us"})


@bound(f"""with {_S},
a as (select *, row_number() over w as rn, case when lag(kind) over w = kind and st <= lag(en) over w then 0 else 1 end as brk from s window w as (partition by user_id order by st, id)),
b as (select *, sum(brk) over (partition by user_id order by rn) - 1 as g from a)
select user_id, cast(g as bigint) as span_no, kind, min(st) as start_us, max(en) as end_us, count(*) as n_spans from b group by user_id, g, kind""")
def q_label_runs(spark, sf_dir):
    out = intervals.collapse_runs(_spans(spark, sf_dir), "user_id", "kind")
    return out.withColumnsRenamed({"start": "start_us", "end": "end_us"})


@bound(f"""with {_S},
p as (select a.user_id, cast(sum(least(a.en, b.en) - greatest(a.st, b.st)) as bigint) as o from s a join s b on a.user_id = b.user_id and a.kind < b.kind and a.st < b.en and b.st < a.en group by 1),
l as (select user_id, max(en) - min(st) as n from s group by 1)
select user_id, coalesce(o, 0) as overlap, case when n > 0 then least(1.0::double, coalesce(o, 0)::double / n) else 0.0::double end as ratio from l left join p using (user_id)""")
def q_overlap_ratio(spark, sf_dir):
    return intervals.overlap_ratio(_spans(spark, sf_dir), "user_id", "kind")


@bound(f"""with {_S}, v as (select * from s where kind = 'view'), p as (select * from s where kind = 'purchase'),
c as (select v.id, sum(least(v.en, p.en) - greatest(v.st, p.st)) as o from v join p on v.user_id = p.user_id and v.st < p.en and p.st < v.en group by 1)
select user_id, id, case when user_id not in (select user_id from p) then 1.0::double else least(1.0::double, coalesce(o, 0)::double / greatest(en - st, 1)) end as coverage from v left join c using (id)""")
def q_span_coverage(spark, sf_dir):
    rows = _spans(spark, sf_dir)
    return intervals.coverage(rows.where("kind = 'view'"), rows.where("kind = 'purchase'"), "user_id")


@bound(f"""with {_S}
select v.id, count(*) as n_points, string_agg(cast(c.id as varchar), ' ' order by c.id) as points from s v join s c on v.kind = 'view' and c.kind = 'click'
and v.user_id = c.user_id and (c.st + c.en) // 2 between v.st and v.en group by v.id""")
def q_point_in_span(spark, sf_dir):
    rows = _spans(spark, sf_dir)
    return intervals.centres_in(rows.where("kind = 'click'"), rows.where("kind = 'view'"), "user_id")


@bound(f"""with {_S}, c as (select * from s where kind = 'click'),
o as (select c.id, t.kind, cast(sum(least(c.en, t.en) - greatest(c.st, t.st)) as bigint) as shared from c join s t on t.kind <> 'click' and c.user_id = t.user_id and c.st < t.en and t.st < c.en group by 1, 2),
b as (select *, row_number() over (partition by id order by shared desc, kind) as rn from o)
select c.user_id, c.id, b.kind as label, b.shared from c left join b on c.id = b.id and b.rn = 1""")
def q_overlap_argmax(spark, sf_dir):
    rows = _spans(spark, sf_dir)
    return intervals.dominant_label(rows.where("kind = 'click'"), rows.where("kind <> 'click'"), "user_id", "kind")


@bound(f"""with {_S},
u as (select user_id, id, en - st as length, least(108000000000, coalesce(sum(en - st) over (partition by user_id order by en - st desc, st, id rows between unbounded preceding and 1 preceding), 0)) as used from s)
select user_id, id, cast(least(length, 108000000000 - used) as bigint) as take from u where least(length, 108000000000 - used) >= 1800000000""")
def q_budget_prefix(spark, sf_dir):
    return intervals.budget_prefix(_spans(spark, sf_dir), "user_id", 30 * intervals.HOUR, intervals.HOUR // 2)


_C = """v as (select vec_id, label, embedding::double[] as e from embeddings),
m as (select label, pos, avg(x) as x from (select label, unnest(e) as x, generate_subscripts(e, 1) as pos from v) group by 1, 2),
c as (select label as name, list(x order by pos) as c from m group by 1),
k as (select vec_id, label, name, list_dot_product(e, c) / ((sqrt(list_dot_product(e, e)) + 1e-9) * (sqrt(list_dot_product(c, c)) + 1e-9)) as score from v, c)"""


def _library(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings")
    return rows, matching.mean_vectors(rows, "label", "embedding").withColumnRenamed("label", "name")


@bound(f"""with {_C}, r as (select *, row_number() over (partition by vec_id order by score desc, name) as rn from k)
select vec_id, label, name as best, round(score, 6) as best_score from r where rn = 1""")
def q_nearest_centroid(spark, sf_dir):
    rows, library = _library(spark, sf_dir)
    return matching.nearest_centroid(rows, library, "name", "embedding").select("vec_id", "label", "best", F.round("best_score", 6).alias("best_score"))


@bound(f"""with {_C}, r as (select *, row_number() over (partition by vec_id order by score desc, name) as rn from k where name <> label),
o as (select vec_id, score as mine from k where name = label)
select r.vec_id, label, name as other, score - mine > 0.15 as flip from r join o using (vec_id) where rn = 1""")
def q_flip_margin(spark, sf_dir):
    rows, library = _library(spark, sf_dir)
    return matching.flips(rows, library, "label", "name", "embedding", 0.15).select("vec_id", "label", "other", "flip")


@bound(f"""with {_C}, g as (select vec_id // 2 as pair,
  sum(case when (vec_id % 2 = 0) = (name = 0) then score end) as a, sum(case when (vec_id % 2 = 0) <> (name = 0) then score end) as b, count(distinct vec_id) as n from k where name in (0, 1) group by 1)
select pair, a >= b as is_straight from g where n = 2""")
def q_assign_2x2(spark, sf_dir):
    rows, library = _library(spark, sf_dir)
    two = rows.withColumns({"pair": F.expr("vec_id div 2"), "slot": F.expr("vec_id % 2")})
    return matching.assign_two(two, library, "pair", "slot", 0, 1, "name", "embedding")


@bound("""with v as (select vec_id, embedding::double[] as e from embeddings),
p as (select a.vec_id as a, b.vec_id as b, list_dot_product(a.e, b.e) / ((sqrt(list_dot_product(a.e, a.e)) + 1e-9) * (sqrt(list_dot_product(b.e, b.e)) + 1e-9)) as c from v a join v b on a.vec_id < b.vec_id)
select a, b, round(c, 6) as cosine from p where c > 0.3""")
def q_collisions(spark, sf_dir):
    return matching.similar_pairs(_t(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.3).select("a", "b", F.round("cosine", 6).alias("cosine"))


@bound("""select vec_id, label, place from (select vec_id, label, cast(row_number() over (partition by label order by vec_id desc) - 1 as int) as place from embeddings) where place < 10""")
def q_recent_ring(spark, sf_dir):
    return matching.recent(_t(spark, sf_dir, "embeddings"), "label", "vec_id").select("vec_id", "label", "place")


@bound("""with m as (select label, pos, avg(x) as x from (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as pos from embeddings) group by 1, 2)
select label, cast(pos - 1 as int) as pos, round(x, 6) as x from m""")
def q_universal_mean(spark, sf_dir):
    means = matching.mean_vectors(_t(spark, sf_dir, "embeddings"), "label", "embedding")
    return means.select("label", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@bound()
def q_running_centroid(spark, sf_dir):
    return matching.running_centroids(_t(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


_STEM = """strftime(o_orderdate, '%Y-%m-%d') || '_c' || o_custkey || case when o_orderkey % 3 = 0 then '' else '__s' || o_orderkey || case when o_orderkey % 5 = 0 then '__x' else '' end end || case o_orderkey % 4 when 0 then '_en' when 1 then '_ro' when 2 then '_fr' else '_EN' end"""


@bound(f"""with o as (select o_orderkey, lower({_STEM}) as s from orders),
p as (select o_orderkey, s, regexp_matches(s, '{text.CANONICAL}') as f, regexp_matches(s, '{text.LEGACY}') as g, right(s, 2) in ('en', 'ro') as l from o)
select o_orderkey, case when l and (f or g) then left(s, 10) end as date,
case when l and f then regexp_extract(s, '{text.CANONICAL}', 2) when l and g then 'anna' end as teacher,
case when l and f then regexp_extract(s, '{text.CANONICAL}', 3) when l and g then regexp_extract(s, '{text.LEGACY}', 2) end as student,
case when l and (f or g) then right(s, 2) end as language from p""")
def q_filename_parse(spark, sf_dir):
    stem = F.expr("""concat(date_format(o_orderdate, 'yyyy-MM-dd'), '_c', o_custkey, case when o_orderkey % 3 = 0 then '' else concat('__s', o_orderkey, case when o_orderkey % 5 = 0 then '__x' else '' end) end,
      case o_orderkey % 4 when 0 then '_en' when 1 then '_ro' when 2 then '_fr' else '_EN' end)""")
    return _t(spark, sf_dir, "orders").select("o_orderkey", text.parse_name(stem, "anna").alias("m")).select("o_orderkey", "m.*")


@bound("select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def q_needs_processing(spark, sf_dir):
    return corpus.missing_from(_t(spark, sf_dir, "documents").select("doc_id", "lang"), _t(spark, sf_dir, "labels"), "doc_id")


@bound("select doc_id, true as indexed from labels union all select doc_id, false from documents where doc_id not in (select doc_id from labels)")
def q_reconcile(spark, sf_dir):
    index = _t(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("indexed"))
    return corpus.reconcile(index, _t(spark, sf_dir, "documents").select("doc_id", F.lit(False).alias("indexed")), "doc_id")


@bound("select o_orderkey, case when o_orderkey % 10 = 0 then 'redone' else o_orderstatus end as status from orders")
def q_upsert(spark, sf_dir):
    index = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return corpus.upsert(index, index.where("o_orderkey % 10 = 0").withColumn("status", F.lit("redone")), "o_orderkey")


@bound("""with n as (select o_custkey, count(*) as n_now from orders group by 1), t as (select o_custkey, count(*) as n_then from orders where o_orderdate < timestamp '2000-01-01' group by 1)
select o_custkey, n_now, n_then from n join t using (o_custkey) where n_now - n_then >= 3""")
def q_stale(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders")
    count = lambda df: df.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return corpus.stale(count(rows), count(rows.where("o_orderdate < timestamp_ntz'2000-01-01 00:00:00'")), "o_custkey")


@bound("""select o_orderkey, o_custkey from orders o where o_orderstatus = 'F' and o_orderdate < timestamp '1999-01-01'
and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_discount < 0.01)""")
def q_redo_filter(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_discount")
    return corpus.redo_candidates(_t(spark, sf_dir, "orders"), lines, "o_orderkey", F.col("o_orderstatus") == "F", F.expr("o_orderdate < timestamp_ntz'1999-01-01 00:00:00'"), F.col("l_discount") < 0.01).select("o_orderkey", "o_custkey")


@bound("select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_discount < 0.01)")
def q_semi_low_conf(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_discount")
    return corpus.redo_candidates(_t(spark, sf_dir, "orders"), lines, "o_orderkey", low=F.col("l_discount") < 0.01).select("o_orderkey")


@bound("""select o_custkey, count(*) as n_sessions, cast(sum(cast(o_totalprice as decimal(18,2))) as varchar) as total from orders group by 1""")
def q_corpus_summary(spark, sf_dir):
    return summaries.sessions_by_person(_t(spark, sf_dir, "orders"), "o_custkey", "o_totalprice")


@bound("""select c_nationkey, count(*) as n_sessions, string_agg(distinct c_mktsegment, ',' order by c_mktsegment) as regions from customer group by 1""")
def q_person_merge(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select("c_nationkey", F.lit(1).alias("n_sessions"), F.col("c_mktsegment").alias("regions"))
    return corpus.merge_persons(rows, "c_nationkey", ["n_sessions"], ["regions"])


@bound("""with c as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn) - 1 as i, count(*) over (partition by conv_id) as n from conversations),
k as (select conv_id, unnest(range(0, greatest(0, n - 1 - 1) // 2 + 1)) as chunk from (select distinct conv_id, n from c))
select conv_id, turn, cast(chunk as bigint) as chunk, chunk = min(chunk) over (partition by conv_id, turn) as keep from c join k using (conv_id) where i >= chunk * 2 and i < chunk * 2 + 3""")
def q_chunk_overlap(spark, sf_dir):
    return corpus.chunks(_t(spark, sf_dir, "conversations"), "conv_id", "turn", 3, 1).select("conv_id", "turn", F.col("chunk").cast("long").alias("chunk"), "keep")


@bound("select conv_id, bool_and(not (turn = 3 and conv_id % 2 = 0)) as is_valid from conversations group by 1")
def q_validate_chunk(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("at"), F.col("role").alias("speaker"))
    return corpus.chunk_valid(rows, rows.withColumn("at", F.expr("case when turn = 3 and conv_id % 2 = 0 then at + 5 else at end")), "conv_id", "turn", 1)


def _turn_words() -> Column:
    return F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), F.lit(0))


def _turn_wer(spark: SparkSession, sf_dir: str, words: Column) -> DataFrame:
    """Each turn's words against those of the turn before it."""
    order = intervals.Window.partitionBy("conv_id").orderBy("turn")
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("h")).withColumn("r", F.lag("h").over(order)).where("r is not null")
    return rows.select("conv_id", "turn", text.word_error_rate(F.col("r"), F.col("h")).alias("wer"))


@bound("""with recursive w as (select conv_id, turn, regexp_extract_all(text, '[^ \\t\\n\\r]+') as h, lag(regexp_extract_all(text, '[^ \\t\\n\\r]+')) over (partition by conv_id order by turn) as r from conversations),
b as (select conv_id, turn, r, h, len(r) as n, len(h) as m from w where r is not null),
d(conv_id, turn, i, j, c) as (
  select conv_id, turn, 0::bigint, unnest(range(0, m + 1)), unnest(range(0, m + 1)) from b
  union all
  select conv_id, turn, i, j, j + min(k - j) over (partition by conv_id, turn order by j) from (
    select d.conv_id, d.turn, d.i + 1 as i, d.j, least(d.c + 1, coalesce(lag(d.c) over (partition by d.conv_id, d.turn order by d.j) + (case when b.r[d.i + 1] = b.h[d.j] then 0 else 1 end), d.c + 1)) as k
    from d join b on d.conv_id = b.conv_id and d.turn = b.turn where d.i < b.n))
select b.conv_id, b.turn, case when n = 0 then (case when m = 0 then 0.0::double else 1.0::double end) else c::double / n end as wer from b join d on d.conv_id = b.conv_id and d.turn = b.turn and d.i = n and d.j = m""")
def q_wer(spark, sf_dir):
    return _turn_wer(spark, sf_dir, _turn_words())


@bound()
def q_wer_whole(spark, sf_dir):
    """The same by its older name; it is tested against a loop."""
    return q_wer(spark, sf_dir)


@bound(f"select doc_id, sha256(translate(text, '{text.MARKED}', '{text.PLAIN}')) as folded from documents")
def q_ro_fold(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(text.fold_marks(F.col("text")).cast("binary"), 256).alias("folded"))


@bound("""select count(*) filter (quality = 1 and toxic = 1) as tp, count(*) filter (quality = 0 and toxic = 0) as tn, count(*) filter (quality = 0 and toxic = 1) as fp,
count(*) filter (quality = 1 and toxic = 0) as fn, case when tp > 0 then round(tp * 2 / (tp * 2 + fp + fn), 4) else 0 end::double as f1, case when tp > 0 then round(tp / (tp + fn), 4) else 0 end::double as recall from labels""")
def q_confusion(spark, sf_dir):
    return measures.confusion(_t(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1)


@bound("""select t::double as threshold, count(*) filter (value < t) as n_flagged, count(*) filter (value >= t) as n_unflagged from events, (values (50), (100), (150), (200), (300), (400)) x(t) group by t""")
def q_sweep(spark, sf_dir):
    swept = measures.sweep(_t(spark, sf_dir, "events"), "value", "value", [50, 100, 150, 200, 300, 400])
    return swept.select("threshold", "n_flagged", "n_unflagged")


@bound("select event_id, '[SUNG: ~' || cast(cast(round_even(value, 0) as bigint) as varchar) || 's]' as marker from events")
def q_sung_marker(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", text.sung_marker(F.col("value")).alias("marker"))


@bound("""select user_id, round(quantile_cont(value, 0.05), 6) as p5, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(stddev_pop(value), 6) as spread from events group by 1""")
def q_percentiles(spark, sf_dir):
    return summaries.percentiles(_t(spark, sf_dir, "events"), "user_id", "value")


@bound("""with v as (select vec_id, embedding::double[] as e from embeddings),
z as (select vec_id, round(20 * log10(sqrt(list_dot_product(e, e) / len(e))), 6) as rms, len(list_filter(range(1, len(e)), lambda i: (e[i] < 0) <> (e[i + 1] < 0))) / (len(e) - 1) as zcr from v)
select vec_id, rms, zcr, case when rms < -30 and zcr > 0.3 then 'sung' else 'spoken' end as kind from z""")
def q_zcr_rms(spark, sf_dir):
    e = F.col("embedding")
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.round(measures.rms_dbfs(e), 6).alias("rms"), measures.zero_crossings(e).alias("zcr"), measures.sounds_sung(e).alias("kind"))


@bound()
def q_sustained(spark, sf_dir):
    contour = F.transform("embedding", lambda x: F.when(x > 0, x.cast("double") * 1000).otherwise(0.0))
    return _t(spark, sf_dir, "embeddings").select("vec_id", measures.sustained(contour, 2).alias("is_sustained"), measures.voice_region(contour, 3).alias("region"))


@bound("""with e as (select user_id, event_id, event_type as k, value from events),
f as (select user_id, max(event_id) filter (k = 'signup') as started, min(event_id) filter (k <> 'error') as known from e group by 1 having known is not null),
s as (select e.* from e join f using (user_id) where event_id >= coalesce(started, known)),
m as (select *, case k when 'view' then 0.0 when 'click' then value when 'purchase' then 1.0 end::double as moved from s)
select user_id, case when bool_or(k = 'error') then 'failed' when bool_or(k = 'purchase') then 'success' else 'running' end as state,
coalesce(arg_max(moved, event_id) filter (moved is not null), 0.0::double) as progress, count(*) as n_events from m group by 1""")
def q_event_fold(spark, sf_dir):
    kinds = {"signup": "start", "view": "phase", "click": "progress", "purchase": "done", "error": "error"}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    rows = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), kind.alias("kind"), F.col("value").alias("amount"))
    return fold.fold_events(rows, "user_id")


@bound(f"""with {_S}, w as (select user_id, id, kind, st, lead(kind) over o as nk, lead(st) over o as ns from s where kind in ('view', 'purchase') window o as (partition by user_id order by st, id))
select user_id, id, ns - st as elapsed_us from w where kind = 'view' and nk = 'purchase'""")
def q_phase_pairs(spark, sf_dir):
    pairs = summaries.phase_pairs(_spans(spark, sf_dir), "user_id", "kind", "start", "view", "purchase", "id")
    return pairs.select("user_id", "id", F.col("elapsed").alias("elapsed_us"))


@bound("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def q_json_props(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@bound("""select event_type, event_id, rank from (select event_type, event_id, cast(row_number() over (partition by event_type order by value desc, event_id) as int) as rank from events) where rank <= 5""")
def q_top_sort(spark, sf_dir):
    return summaries.top_of_each(_t(spark, sf_dir, "events"), "event_type", "value", "event_id", 5).select("event_type", "event_id", "rank")


@bound("""with r as (select user_id, event_type, sum(value) filter (value >= 5) as audio, sum(value / 500) as s, count(*) as n from events group by 1, 2),
p as (select user_id, max(audio) as audio, sum(s) / sum(n) as m, user_id % 4 as remaining from r group by 1 having max(audio) is not null),
d as (select *, case when m < 0.1 then 'rejected' when remaining in (1, 2) and m < 0.11 then 'held' when audio < 300 then 'short' else 'updated' end as decision from p)
select user_id, decision, case when decision = 'updated' and remaining > 0 then remaining - 1 else remaining end as remaining from d""")
def q_trust_gate(spark, sf_dir):
    rows = _t(spark, sf_dir, "events")
    kinds = ["signup", "purchase", "error", "view", "click"]
    segments = rows.select("user_id", F.col("event_type").alias("region"), F.col("value").alias("length"), (F.col("value") / 500).alias("confidence"))
    persons = rows.select("user_id", (F.col("user_id") % 4).alias("remaining")).distinct()
    return registry.update_gate(segments, persons, "user_id", kinds, "view", floor=0.1, new_floor=0.11, min_clip=5.0, min_region=300.0)


@bound("""with w as (select conv_id, turn, regexp_extract_all(text, '[^ \\t\\n\\r]+') as w, -length(text) / 1000.0 as l from conversations)
select conv_id, turn, case when len(w) > 0 then len(list_filter(w, lambda x: length(x) / 10.0 < 0.2)) = 0 else coalesce(l > -0.3, false) end as skip from w""")
def q_polish_skip(spark, sf_dir):
    sure = F.transform(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), F.lit(0)), lambda w: F.length(w) / 10.0)
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", text.polish_skip(sure, -F.length("text") / 1000.0, 0.2).alias("skip"))


_TERMS = {"license": ["license", "licensed", "licence"], "right": ["right", "rights"], "public": ["public"], "author": ["author", "authors"]}


@bound(f"""with t(term, variant) as (values {", ".join(f"('{t}', '{v}')" for t, vs in _TERMS.items() for v in vs)}),
w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as variant from documents)
select doc_id, term, count(*) as n from w join t using (variant) group by 1, 2""")
def q_glossary(spark, sf_dir):
    terms = spark.createDataFrame([(t, v) for t, vs in _TERMS.items() for v in vs], "term string, variant string")
    return registry.glossary_hits(_t(spark, sf_dir, "documents"), terms, "doc_id")


_ALLOWED = {"view": ["k"], "click": ["k", "z"], "purchase": []}
_LINE = """case event_id % 6 when 0 then '{"cmd":' when 1 then '[1]' when 2 then '{"k":1,"cmd":7}' when 3 then concat('{"cmd":"', event_type, '","k":1}')
  when 4 then concat('{"cmd":"', event_type, '","k":1,"z":2}') else ' ' end"""


@bound(f"""with l as (select event_id, {_LINE} as line from events),
o as (select event_id, line, case when json_valid(line) then line else 'null' end as j from l),
c as (select *, case when json_type(j, '$.cmd') = 'VARCHAR' then json_extract_string(j, '$.cmd') end as cmd, json_type(j) as t, case when json_type(j) = 'OBJECT' then json_keys(j) end as k from o)
select event_id, cmd, case when trim(line) = '' then 'empty_line' when not json_valid(line) then 'invalid_json' when t <> 'OBJECT' then 'not_an_object' when cmd is null then 'no_command'
  when cmd not in ('view', 'click', 'purchase') then 'unknown_command'
  when (cmd = 'purchase' and len(k) > 1) or (cmd = 'view' and list_contains(k, 'z')) then 'unknown_fields' end as refused from c""")
def q_command_check(spark, sf_dir):
    lines = _t(spark, sf_dir, "events").select("event_id", F.expr(_LINE).alias("value"))
    return commands.check_commands(lines, _ALLOWED).select("event_id", "cmd", "refused")


@bound("""with n as (select c_custkey as id, c_name, case when c_custkey % 11 = 0 then 'Bad Id' else 'c' || (c_custkey // 2) end as nid, case when c_custkey % 7 = 0 then 'guest' else 'student' end as r,
  c_mktsegment || (c_custkey % 40) as d, case when c_custkey % 3 = 0 then 'x' end as m from customer),
p as (select distinct 'c' || s_suppkey as pid from supplier),
i as (select *, case when nid = 'Bad Id' then 'bad_id' when r = 'guest' then 'bad_role' end as ill from n),
k as (select *, row_number() over (partition by nid, ill is null order by id) as a, row_number() over (partition by d, ill is null order by id) as b from i)
select id as c_custkey, coalesce(ill, case when nid in (select pid from p) or a > 1 then 'id_taken' when b > 1 and m is null then 'name_taken' end) as refused from k""")
def q_register(spark, sf_dir):
    new = _t(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "case when c_custkey % 11 = 0 then 'Bad Id' else concat('c', c_custkey div 2) end as id", "case when c_custkey % 7 = 0 then 'guest' else 'student' end as default_role",
        "concat(c_mktsegment, c_custkey % 40) as display_name", "case when c_custkey % 3 = 0 then 'x' end as disambiguator",
    )
    persons = _t(spark, sf_dir, "supplier").selectExpr("concat('c', s_suppkey) as id", "s_name as display_name")
    return registry.register(persons, new, "c_custkey").select("c_custkey", "refused")
