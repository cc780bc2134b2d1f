"""The calibration run: what was recognised against ground truth, thresholds swept, the best one of each knob, a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionlake.functions.text import word_error_rate
from sessionlake.operators.measures import sweep
from sessionlake.operators.shaping import stripped
from sessionlake.sources.sinks import report

#: The knobs, what each looks at, and the thresholds tried.
KNOBS = {"avg_logprob_threshold": ("avg_logprob", (-1.0, -0.9, -0.8, -0.6, -0.4, -0.2))}
#: Seconds a bucket, in which segments and ground truth meet.
BUCKET = 60.0


def against_truth(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row a ground-truth segment: ``lesson, gt_idx, gt_start, gt_end, gt_region, gt_speaker, ref_text, hyp_text,
    matched_segments, wer, avg_logprob, no_speech_prob``.

    Predicted segments (``lesson, seg_idx, start, end, text, avg_logprob, no_speech_prob``) belong where their middle
    lies, both ends included, so one may belong twice; their texts are joined in order, their measures averaged without
    nulls. Truth has ``lesson, gt_idx, start, end, text, region, speaker``; a missing region is speaking. An empty
    reference has the rate 0 if nothing was heard, else 1.
    """
    middle = (F.col("start") + F.col("end")) / 2
    points = predicted.select("lesson", F.floor(middle / BUCKET).alias("_b"), middle.alias("_m"), F.struct("seg_idx", F.coalesce(stripped("text"), F.lit("")).alias("t")).alias("_t"), "avg_logprob", "no_speech_prob")
    spans = truth.select("lesson", "gt_idx", "start", "end").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.greatest(F.floor(F.col("start") / BUCKET), F.floor(F.col("end") / BUCKET)))))
    met = spans.join(points, ["lesson", "_b"]).where(F.col("_m").between(F.col("start"), F.col("end")))
    heard = met.groupBy("lesson", "gt_idx").agg(
        stripped(F.array_join(F.transform(F.array_sort(F.collect_list("_t")), lambda p: p["t"]), " ")).alias("hyp_text"), F.count(F.lit(1)).alias("matched_segments"),
        F.avg("avg_logprob").alias("avg_logprob"), F.avg("no_speech_prob").alias("no_speech_prob"))
    rows = truth.join(heard, ["lesson", "gt_idx"], "left").withColumns({"ref_text": F.coalesce("text", F.lit("")), "hyp_text": F.coalesce("hyp_text", F.lit(""))})
    words = lambda c: F.filter(F.split(stripped(c), r"\s+"), lambda w: w != "")
    return rows.select(
        "lesson", "gt_idx", F.col("start").alias("gt_start"), F.col("end").alias("gt_end"), F.coalesce("region", F.lit("speaking")).alias("gt_region"), F.col("speaker").alias("gt_speaker"),
        "ref_text", "hyp_text", F.coalesce("matched_segments", F.lit(0)).alias("matched_segments"), word_error_rate(words("ref_text"), words("hyp_text")).alias("wer"), "avg_logprob", "no_speech_prob")


def swept(rows: DataFrame, cost: str = "wer", knobs: dict[str, tuple[str, tuple[float, ...]]] | None = None) -> DataFrame:
    """``knob, place, value, n_flagged, n_unflagged, cost_flagged, cost_unflagged, separation`` of every threshold."""
    parts = []
    for knob, (metric, values) in (knobs or KNOBS).items():
        at = F.array_position(F.array(*map(F.lit, map(float, values))), F.col("threshold")) - 1
        parts.append(sweep(rows, metric, cost, list(values)).select(F.lit(knob).alias("knob"), at.alias("place"), F.col("threshold").alias("value"), "n_flagged", "n_unflagged", "cost_flagged", "cost_unflagged", "separation"))
    return reduce(DataFrame.unionByName, parts)


def recommended(rows: DataFrame) -> DataFrame:
    """Of each knob the threshold of the widest separation, on ties the one tried first; none where nothing separates."""
    order = Window.partitionBy("knob").orderBy(F.desc("separation"), "place")
    return rows.where("separation is not null").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def calibrate(spark: SparkSession, predicted: DataFrame, truth: DataFrame, path: str, tag: str, compare: str | None = None) -> DataFrame:
    """Writes the run's segments, sweep and recommendations under ``path/<tag>`` (CSV and JSON) and returns one row: ``tag,
    n_segments, mean_wer, prior_wer, delta``; the prior run's is null where it was not written or not asked for."""
    report(against_truth(predicted, truth), f"{path}/{tag}/segments")
    rows = _segments(spark, path, tag)
    report(swept(rows), f"{path}/{tag}/sweep")
    report(recommended(swept(rows)), f"{path}/{tag}/recommended")
    out = rows.agg(F.lit(tag).alias("tag"), F.count(F.lit(1)).alias("n_segments"), F.avg("wer").alias("mean_wer"))
    before = _segments(spark, path, compare) if compare else None
    prior = before.agg(F.avg("wer").alias("prior_wer")) if before is not None else spark.createDataFrame([(None,)], "prior_wer double")
    return out.join(F.broadcast(prior)).withColumn("delta", F.col("mean_wer") - F.col("prior_wer"))  # one row each


def _segments(spark: SparkSession, path: str, tag: str) -> DataFrame | None:
    """A run's segments as reported; None where there was no such run."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{tag}/segments/json/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    schema = "lesson string, gt_idx long, gt_start double, gt_end double, gt_region string, gt_speaker string, ref_text string, hyp_text string, matched_segments long, wer double, avg_logprob double, no_speech_prob double"
    return spark.read.schema(schema).json(f"{path}/{tag}/segments/json")
