"""Operators on spans of time: merging, collapsing, overlap and point-in-span joins, budgeted prefixes.

A span is a row with a key (the file), integer ``start`` and ``end`` in microseconds and an ``id`` that breaks ties.
Range joins are equi-joins on (key, time bucket): every span is listed under each bucket that it touches, and a pair is
taken only in the later of both first buckets, so no pair appears twice and one long file spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOUR = 3_600_000_000


def _islands(spans: DataFrame, key: str, breaks: Column) -> DataFrame:
    order = Window.partitionBy(key).orderBy("start", "id")
    return spans.withColumn("_new", breaks.cast("int")).withColumn("span_no", F.sum("_new").over(order) - 1).drop("_new")


def gap_merge(spans: DataFrame, key: str, gap: int) -> DataFrame:
    """Glues a span to the one before it where less than ``gap`` lies between; the end is that of the last span glued."""
    order = Window.partitionBy(key).orderBy("start", "id")
    before = F.lag("end").over(order)
    rows = _islands(spans, key, before.isNull() | (F.col("start") - before >= gap))
    return rows.groupBy(key, "span_no").agg(
        F.min("start").alias("start"), F.max_by("end", F.struct("start", "id")).alias("end"), F.count(F.lit(1)).alias("n_spans")
    )


def collapse_runs(spans: DataFrame, key: str, label: str) -> DataFrame:
    """One row for each run of spans with equal labels that leave no gap."""
    order = Window.partitionBy(key).orderBy("start", "id")
    same = (F.lag(label).over(order) == F.col(label)) & (F.col("start") <= F.lag("end").over(order))
    rows = _islands(spans, key, ~F.coalesce(same, F.lit(False)))
    return rows.groupBy(key, "span_no", label).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_spans"))


def overlap_join(left: DataFrame, right: DataFrame, key: str, bucket: int = 6 * HOUR, closed: bool = False) -> DataFrame:
    """Pairs of spans of one key that overlap (``closed``: or touch); columns get the suffixes ``_l`` and ``_r``."""

    def listed(df: DataFrame, end: str) -> DataFrame:
        first, last = F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket)
        out = df.withColumn("_first", first).withColumn("_b", F.explode(F.sequence(first, F.greatest(first, last))))
        return out.select(*[F.col(c).alias(c if c in (key, "_b") else c + end) for c in out.columns])

    a, b = listed(left, "_l"), listed(right, "_r")
    meets = (F.col("start_l") <= F.col("end_r")) & (F.col("start_r") <= F.col("end_l")) if closed else (F.col("start_l") < F.col("end_r")) & (F.col("start_r") < F.col("end_l"))
    return a.join(b, [key, "_b"]).where(meets & (F.col("_b") == F.greatest("_first_l", "_first_r"))).drop("_b", "_first_l", "_first_r")


def _shared() -> Column:
    return F.least("end_l", "end_r") - F.greatest("start_l", "start_r")


def overlap_ratio(spans: DataFrame, key: str, speaker: str, from_zero: bool = False) -> DataFrame:
    """Time in which two speakers talk at once, summed over pairs, over the file's length; at most 1.

    The length runs from the first start, or from zero, to the last end.
    """
    pairs = overlap_join(spans, spans, key).where(F.col(f"{speaker}_l") < F.col(f"{speaker}_r"))
    shared = pairs.groupBy(key).agg(F.sum(_shared()).alias("overlap"))
    length = spans.groupBy(key).agg((F.max("end") - (F.lit(0) if from_zero else F.min("start"))).alias("length"))
    ratio = F.when(F.col("length") > 0, F.least(F.lit(1.0), F.col("overlap") / F.col("length"))).otherwise(0.0)
    return length.join(shared, key, "left").withColumn("overlap", F.coalesce("overlap", F.lit(0).cast("long"))).select(key, "overlap", ratio.alias("ratio"))


def coverage(segments: DataFrame, speech: DataFrame, key: str) -> DataFrame:
    """The share of each segment that speech spans cover, at most 1; 1 in files without any speech span."""
    shared = overlap_join(segments, speech, key).groupBy("id_l").agg(F.sum(_shared()).alias("covered"))
    files = speech.select(key).distinct().withColumn("_any", F.lit(True))
    rows = segments.join(shared, segments["id"] == shared["id_l"], "left").join(files, key, "left")
    share = F.least(F.lit(1.0), F.coalesce("covered", F.lit(0)) / F.greatest(F.col("end") - F.col("start"), F.lit(1)))
    return rows.select(key, "id", F.when(F.col("_any").isNull(), 1.0).otherwise(share).alias("coverage"))


def _centred(points: DataFrame, spans: DataFrame, key: str, *more: str) -> DataFrame:
    centre = F.expr("(start + end) div 2")
    at = points.select(key, "id", centre.alias("start"), *more).withColumn("end", F.col("start"))
    return overlap_join(at, spans, key, closed=True)


def texts_in(points: DataFrame, spans: DataFrame, key: str, text: str) -> DataFrame:
    """For each span, the points whose centre lies in it: their number, and their trimmed texts joined in order of ids."""
    found = _centred(points.withColumnRenamed(text, "_text"), spans.drop(text), key, "_text")
    column = "_text_l" if "_text_l" in found.columns else "_text"
    pieces = F.array_sort(F.collect_list(F.struct(F.col("id_l").alias("o"), F.trim(column).alias("t"))))
    return found.groupBy(F.col("id_r").alias("id")).agg(F.count(F.lit(1)).alias("n_points"), F.array_join(F.transform(pieces, lambda p: p["t"]), " ").alias("heard"))


def centres_in(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """For each span, the points whose centre lies in it, both ends included: their number and their ids in order."""
    found = _centred(points, spans, key)
    return found.groupBy(F.col("id_r").alias("id")).agg(F.count(F.lit(1)).alias("n_points"), F.array_join(F.transform(F.array_sort(F.collect_list("id_l")), lambda x: x.cast("string")), " ").alias("points"))


def dominant_label(segments: DataFrame, turns: DataFrame, key: str, label: str) -> DataFrame:
    """The label whose turns overlap a segment longest (ties: the smaller label); null without overlap."""
    sums = overlap_join(segments, turns, key).groupBy("id_l", f"{label}_r").agg(F.sum(_shared()).alias("shared"))
    best = sums.groupBy("id_l").agg(F.min(F.struct((-F.col("shared")).alias("m"), F.col(f"{label}_r").alias("label"))).alias("best"))
    rows = segments.join(best, segments["id"] == best["id_l"], "left")
    return rows.select(key, "id", F.col("best.label").alias("label"), (-F.col("best.m")).alias("shared"))


def budget_prefix(spans: DataFrame, key: str, budget: int, least: int) -> DataFrame:
    """The longest spans of each key up to a budget of time; the last one is cut, pieces under ``least`` are left out."""
    order = Window.partitionBy(key).orderBy(F.desc("length"), "start", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.withColumn("length", F.col("end") - F.col("start"))
    rows = rows.withColumn("used", F.least(F.lit(budget), F.coalesce(F.sum("length").over(order), F.lit(0))))
    return rows.withColumn("take", F.least(F.col("length"), budget - F.col("used"))).where(F.col("take") >= least).select(key, "id", "take")
