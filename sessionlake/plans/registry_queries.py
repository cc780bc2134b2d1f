"""Queries over the driver's tables: edits of the registry, records as text and back, sung segments and their voices."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake.functions import text
from sessionlake.operators import attribution, corpus, measures, regions, registry

from .bindings import _t, bound


@bound("""with r as (select 's' || s_suppkey as old_id, case s_suppkey % 3 when 0 then 'n_' || s_suppkey when 1 then 'Not Valid' end as new_id from supplier)
select l_orderkey, l_linenumber, coalesce(case when regexp_full_match(new_id, '[a-z0-9_]+') then new_id end, 's' || l_suppkey) as person_id from lineitem left join r on old_id = 's' || l_suppkey""")
def q_rename(spark, sf_dir):
    renames = _t(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey) as old_id", "case s_suppkey % 3 when 0 then concat('n_', s_suppkey) when 1 then 'Not Valid' end as new_id")
    rows = _t(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "concat('s', l_suppkey) as person_id")
    return registry.rename(rows, "person_id", renames)


_CHANGES = "select o_custkey + case when o_orderkey % 9 = 0 then 100000000 else 0 end as id, case o_orderkey % 3 when 0 then 'c_mktsegment' when 1 then 'c_nationkey' else 'c_name' end as field, case when o_orderkey % 5 = 0 then null when o_orderkey % 3 = 1 then cast(o_orderkey % 25 as varchar(10)) else o_orderpriority end as value, o_orderkey as seq from orders"


def _changes(spark, sf_dir):
    """Orders as changes of customers: a ninth to persons who do not exist, a third to a field that may not be edited."""
    return registry.edit(_t(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id"), _t(spark, sf_dir, "orders").selectExpr(
        "o_custkey + case when o_orderkey % 9 = 0 then 100000000 else 0 end as id", "case o_orderkey % 3 when 0 then 'c_mktsegment' when 1 then 'c_nationkey' else 'c_name' end as field",
        "case when o_orderkey % 5 = 0 then null when o_orderkey % 3 = 1 then cast(o_orderkey % 25 as string) else o_orderpriority end as value", "o_orderkey as seq"), ["c_mktsegment", "c_nationkey"])


@bound(f"""with c as ({_CHANGES}), l as (select id, field, value from c qualify row_number() over (partition by id, field order by seq desc) = 1)
select c_custkey as id, c_name, case when a.id is null then c_nationkey else cast(a.value as int) end as c_nationkey, case when b.id is null then c_mktsegment else b.value end as c_mktsegment
from customer left join l a on a.id = c_custkey and a.field = 'c_nationkey' left join l b on b.id = c_custkey and b.field = 'c_mktsegment'""")
def q_edit_persons(spark, sf_dir):
    return _changes(spark, sf_dir)[0].select("id", "c_name", "c_nationkey", "c_mktsegment")


@bound(f"""select id, field, value, seq from ({_CHANGES}) where field = 'c_name' or id not in (select c_custkey from customer)""")
def q_edit_refused(spark, sf_dir):
    return _changes(spark, sf_dir)[1]


@bound("""with p as (select l_suppkey % 90 as a, l_partkey % 90 as b from lineitem where l_suppkey % 90 <> l_partkey % 90) select a as id, b as other from p union select b, a from p""")
def q_collision_edges(spark, sf_dir):
    return registry.collision_edges(_t(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 90 as a", "l_partkey % 90 as b"))


@bound("""select c_custkey as id, c_name || case c_custkey % 3 when 0 then ' (' || c_mktsegment || ')' else '' end as shown, coalesce(voices, '') as voices
from customer left join (select o_custkey, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as voices from orders group by 1) on o_custkey = c_custkey""")
def q_inspect_persons(spark, sf_dir):
    persons = _t(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_name", "case c_custkey % 3 when 0 then c_mktsegment when 1 then '' end as mark")
    vectors = _t(spark, sf_dir, "orders").selectExpr("o_custkey as id", "o_orderpriority as name")
    return registry.inspect(persons, vectors).select("id", registry.display(F.col("c_name"), F.col("mark")).alias("shown"), F.array_join("voices", ",").alias("voices"))


@bound("""with n as (select o_custkey, count(*) as n, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as seen from orders group by 1)
select c_custkey as id, case when c_custkey % 4 <> 0 then c_name end as display_name, c_acctbal as total_hours, seen, n as n_sessions, null::bigint as not_kept from customer left join n on o_custkey = c_custkey""")
def q_records_as_text(spark, sf_dir):
    """Persons written as text and read back: lists, maps and nulls return as they were, a field of the schema that was
    never written is null, one that is not in the schema goes."""
    orders = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("regions"), F.count(F.lit(1)).alias("n"))
    persons = _t(spark, sf_dir, "customer").selectExpr("c_custkey as id", "case when c_custkey % 4 <> 0 then c_name end as display_name", "c_acctbal as total_hours", "c_mktsegment as unknown_field").join(orders, "id", "left")
    told = corpus.to_json_records(persons.withColumn("counts", F.when(F.col("n").isNotNull(), F.create_map(F.lit("all"), "n"))).drop("n"), "line")
    back = corpus.from_json_records(told, "line", "id long, display_name string, total_hours double, regions array<string>, counts map<string, long>, not_kept long")
    return back.select("id", "display_name", "total_hours", F.array_join("regions", ",").alias("seen"), F.try_element_at("counts", F.lit("all")).alias("n_sessions"), "not_kept")


@bound("""with s as (select event_id, event_type, value, case event_type when 'click' then 'sung_high' when 'view' then 'spoken_mid' when 'error' then 'sung' end as region from events)
select event_id, case when region like 'sung%' then '[SUNG: ~' || cast(round_even(value, 0) as bigint) || 's]' else event_type end as text, coalesce(region like 'sung%', false) as sung,
coalesce(region like 'sung%', false) or event_id % 5 = 0 as polished, case when coalesce(region like 'sung%', false) then -1 else 2 end as n_words from s""")
def q_sung_segments(spark, sf_dir):
    """Events as segments of ``value`` seconds, two words each; clicks and errors are sung."""
    rows = _t(spark, sf_dir, "events").selectExpr(
        "event_id", "event_type as text", "0D as start", "value as end", "case event_type when 'click' then 'sung_high' when 'view' then 'spoken_mid' when 'error' then 'sung' end as region",
        "case when event_id % 5 = 0 then true when event_id % 5 = 1 then false end as polished", "array('a', 'b') as words")
    return attribution.marked(rows).select("event_id", "text", "sung", "polished", F.coalesce(F.when(F.col("words").isNotNull(), F.size("words")), F.lit(-1)).alias("n_words"))


@bound("""with v as (select vec_id, vec_id % 23 as file_id, label, embedding::double[] as e from embeddings), c as (select distinct file_id, label as person_id from v where vec_id % 2 = 0),
l as (select label as person_id, 'r' || vec_id % 3 as name, e from v where vec_id % 3 = 1),
s as (select v.file_id, v.vec_id as seg_idx, person_id, name, list_dot_product(v.e, l.e) / ((sqrt(list_dot_product(v.e, v.e)) + 1e-9) * (sqrt(list_dot_product(l.e, l.e)) + 1e-9)) as x from v join c using (file_id) join l using (person_id))
select file_id, seg_idx, person_id as best, name as best_region, round(x, 6) as best_score from s qualify row_number() over (partition by file_id, seg_idx order by x desc, person_id, name) = 1""")
def q_best_persons(spark, sf_dir):
    """Vectors as voices of 23 files, against the vectors of the persons (labels) that each file's even vectors name."""
    rows = _t(spark, sf_dir, "embeddings").selectExpr("vec_id % 23 as file_id", "vec_id as seg_idx", "label as person_id", "embedding as vec", "concat('r', vec_id % 3) as name")
    library = rows.where("seg_idx % 3 = 1").select("person_id", "name", "vec")
    best = attribution.best_persons(rows.select("file_id", "seg_idx", "vec"), ["file_id", "seg_idx"], rows.where("seg_idx % 2 = 0"), library)
    return best.withColumn("best_score", F.round("best_score", 6))


@bound("""with w as (select user_id as file_id, event_id as seg_idx, value / 10 as s, value / 10 + (event_id % 7) / 8.0 as e, 40000 + user_id % 3 * 10000 as n from events),
p as (select *, e - s >= 0.5 as whole, greatest(0.25 - (e - s) / 2, 0) as pad from w),
b as (select file_id, seg_idx, n, case when whole then s else greatest(0, s - pad) end as s, case when whole then e else least(n / 1000, e + pad) end as e from p),
c as (select file_id, seg_idx, cast(floor(s * 1000) as bigint) as first, least(n, cast(floor(e * 1000) as bigint)) as after from b) select * from c where after - first >= 500""")
def q_word_spans(spark, sf_dir):
    """Events as words of up to 0.75 seconds in files of 40 to 60 seconds."""
    rows = _t(spark, sf_dir, "events").selectExpr("user_id as file_id", "event_id as seg_idx", "value / 10 as start", "value / 10 + (event_id % 7) / 8D as end", "cast(40000 + user_id % 3 * 10000 as bigint) as n")
    return attribution.word_spans(rows, 1000).select("file_id", "seg_idx", "first", "after")


@bound("""select vec_id, label, round(len(list_filter(embedding, lambda x: abs(x::double) >= 0.2)) / len(embedding), 9) as clipped, label % 2 = 0 as sung from embeddings""")
def q_clipping(spark, sf_dir):
    label = F.when(F.col("label") % 2 == 0, F.lit("sung_low")).otherwise(F.lit("spoken_low"))
    return _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.round(measures.clipping_ratio(F.col("embedding"), 0.2), 9).alias("clipped"), regions.is_sung(label).alias("sung"))


@bound("""select conv_id, turn, case (conv_id + turn) % 4 when 0 then '["' || turn || '", "b"]' when 1 then '[' || turn || ']' end as found from conversations""")
def q_json_in_reply(spark, sf_dir):
    """Replies with an array in a fence, one without a fence, a broken one and none."""
    rows = _t(spark, sf_dir, "conversations")
    reply = F.expr("""case (conv_id + turn) % 4 when 0 then concat('Here: ```json\n["', turn, '", "b"]\n``` and [1, 2] after') when 1 then concat('so [', turn, '] it is') when 2 then concat('[', turn, ' and no end') else 'none' end""")
    return rows.select("conv_id", "turn", text.first_json_array(reply).alias("found"))
