"""Shaping of what recognition and alignment return: levels and speech coverage of segments, words, speakers of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import coverage, overlap_join
from .measures import SILENCE

WORD = "struct<start:double,end:double,word:string,probability:double>"
ALIGNED = "struct<word:string,start:double,end:double,score:double>"
SECOND = 1_000_000


def stripped(text):
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def levels(segments: DataFrame, blocks: DataFrame, size: int, rate: int = 16000) -> DataFrame:
    """``file_id, seg_idx, rms_dbfs``: the level of each segment's samples; SILENCE where there are none or all are 0.

    Sums of squares are taken block by block, so the samples of a segment are nowhere put together. Blocks are
    ``file_id, block, samples`` with ``size`` samples.
    """
    first, after = (F.greatest(F.lit(0), (F.col(c) * rate).cast("long")) for c in ("start", "end"))
    spans = segments.select("file_id", "seg_idx", first.alias("_a"), after.alias("_z"))
    each = spans.where("_z > _a").withColumn("block", F.explode(F.sequence(F.floor(F.col("_a") / size), F.floor((F.col("_z") - 1) / size))))
    begin = F.greatest(F.lit(0), F.col("_a") - F.col("block") * size)
    part = F.slice("samples", (begin + 1).cast("int"), (F.least(F.lit(size), F.col("_z") - F.col("block") * size) - begin).cast("int"))
    sums = each.join(blocks.select("file_id", "block", "samples"), ["file_id", "block"]).select(
        "file_id", "seg_idx", F.size(part).alias("n"), F.aggregate(part, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("s"))
    power = sums.groupBy("file_id", "seg_idx").agg((F.sum("s") / F.sum("n")).alias("p"))
    level = F.when(F.col("p") > 0, F.log10(F.sqrt("p")) * 20).otherwise(SILENCE)
    return spans.select("file_id", "seg_idx").join(power, ["file_id", "seg_idx"], "left").select("file_id", "seg_idx", level.alias("rms_dbfs"))


def speech_shares(segments: DataFrame, speech: DataFrame, bucket: float = 60.0) -> DataFrame:
    """``file_id, seg_idx, vad_coverage_ratio``: the share of each segment's time (seconds) under speech spans, at most 1;
    1 in files without spans. Times are compared in microseconds."""
    exact = lambda df, *more: df.select("file_id", *more, F.round(F.col("start") * SECOND).cast("long").alias("start"), F.round(F.col("end") * SECOND).cast("long").alias("end"))
    shares = coverage(exact(segments, F.struct("file_id", "seg_idx").alias("id")), exact(speech), "file_id")
    return shares.select("file_id", F.col("id.seg_idx").alias("seg_idx"), F.col("coverage").alias("vad_coverage_ratio"))


def recognised(segments: DataFrame, speech: DataFrame, blocks: DataFrame, size: int, rate: int = 16000) -> DataFrame:
    """Recognised segments (``file_id, seg_idx, start, end, text, words``) with stripped text, ``rms_dbfs`` and
    ``vad_coverage_ratio``; words are WORD structs, none where there were none. Other columns pass."""
    words = F.coalesce(F.transform("words", lambda w: F.struct(*[w[c].cast(k).alias(c) for c, k in (("start", "double"), ("end", "double"), ("word", "string"), ("probability", "double"))])), F.array().cast(f"array<{WORD}>"))
    keys = ["file_id", "seg_idx"]
    told = levels(segments, blocks, size, rate).join(speech_shares(segments, speech), keys)
    return segments.withColumns({"text": stripped("text"), "words": words}).join(told, keys, "left")


def aligned(segments: DataFrame, words: str = "words", into: str = "words_wav2vec2") -> DataFrame:
    """Aligned segments: text stripped, and of their words those with both times, stripped, with a score (0 without one).

    All other columns are carried on, so gates by words and levels still have what they ask for.
    """
    kept = F.filter(words, lambda w: w["start"].isNotNull() & w["end"].isNotNull())
    shaped = F.transform(kept, lambda w: F.struct(stripped(F.coalesce(w["word"], F.lit(""))).alias("word"), w["start"].cast("double").alias("start"), w["end"].cast("double").alias("end"), F.coalesce(w["score"].cast("double"), F.lit(0.0)).alias("score")))
    return segments.withColumns({"text": stripped("text"), into: F.coalesce(shaped, F.array().cast(f"array<{ALIGNED}>"))})


def speakers_of_words(segments: DataFrame, turns: DataFrame, key: str, words: str, speaker: str, bucket: int = 60 * SECOND) -> DataFrame:
    """Segments (``key, id, start, end``) whose words (``start, end`` and more) get ``cluster_label``: the speaker whose
    turns (``key, start, end``, speaker) overlap the word longest in all, of equal ones the smaller; null without overlap.
    An empty word within a turn overlaps it, by nothing, and so does a word an empty turn within it.

    Words stay in their arrays: a segment meets the turns that overlap it, and its words are judged against these few.
    """
    met = overlap_join(segments.select(key, "id", "start", "end"), turns.select(key, "start", "end", speaker), key, bucket)
    turn = F.struct(F.col(f"{speaker}_r").alias("speaker"), F.col("start_r").alias("start"), F.col("end_r").alias("end"))
    near = met.where(F.col(f"{speaker}_r").isNotNull()).groupBy(F.col("id_l").alias("id")).agg(F.collect_list(turn).alias("_turns"))
    rows = segments.join(near, "id", "left")
    zero = F.lit(0).cast(segments.schema["start"].dataType)

    def label(w):
        shared = lambda t: F.greatest(zero, F.least(t["end"], w["end"]) - F.greatest(t["start"], w["start"]))
        total = lambda s: F.aggregate(F.filter("_turns", lambda t: t["speaker"] == s), zero, lambda a, t: a + shared(t))
        names = F.array_distinct(F.transform(F.filter("_turns", lambda t: (t["start"] < w["end"]) & (w["start"] < t["end"])), lambda t: t["speaker"]))
        best = F.array_min(F.transform(names, lambda s: F.struct((-total(s)).alias("m"), s.alias("speaker"))))
        return w.withField("cluster_label", best["speaker"])

    return rows.withColumn(words, F.transform(words, label)).drop("_turns").select(*segments.columns)
