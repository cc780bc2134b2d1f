"""Spans of recordings that are stored as blocks of samples: cutting them out, and the voices of clusters and turns.

Blocks are ``file_id, block, samples``, all of ``size`` samples but a file's last. A span of samples meets its blocks by
their numbers, an equi-join, and its parts are put together in order: what is gathered in one row is a span, never a
recording.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .regions import sample_bounds


def lengths(blocks: DataFrame, key: str = "file_id") -> DataFrame:
    """``key, n``: the samples of each file."""
    return blocks.groupBy(key).agg(F.sum(F.size("samples")).cast("long").alias("n"))


def cut(spans: DataFrame, blocks: DataFrame, size: int, key: str = "file_id") -> DataFrame:
    """Spans (``key, first, after`` in samples, and other columns) with ``samples``; those beyond the signal are cut to
    it, and spans without samples are left out. Spans are told apart by all their columns: equal ones come out once."""
    own = spans.columns
    each = spans.where("after > first and first >= 0").distinct()
    each = each.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor((F.col("after") - 1) / size))))
    met = each.join(blocks.select(key, "block", F.col("samples").alias("_s")), [key, "block"])
    begin = F.greatest(F.lit(0), F.col("first") - F.col("block") * size)
    part = F.slice("_s", (begin + 1).cast("int"), F.greatest(F.lit(0), F.least(F.lit(size), F.col("after") - F.col("block") * size) - begin).cast("int"))
    parts = met.select(*own, "block", part.alias("_p")).where(F.size("_p") > 0)
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "_p"))), lambda p: p["_p"]))
    return parts.groupBy(*own).agg(whole.alias("samples"))


def cluster_pieces(segments: DataFrame, ends: DataFrame, budget: float = 30.0, least: float = 0.5, rate: int = 16000) -> DataFrame:
    """``file_id, cluster_label, place, first, after``: the samples that a cluster's voice is taken from.

    The longest segments first (of equal ones the earlier ``seg_idx``), until ``budget`` seconds are used; the last is cut
    to what is left. A piece is cut to the signal (``ends``: ``file_id, n``) and left out under ``least`` seconds, and
    such a piece uses nothing. Segments have ``file_id, seg_idx, cluster_label, start, end`` in seconds.
    """
    first = (F.col("start") * rate).cast("long")
    rows = segments.where("cluster_label is not null and cluster_label <> ''").join(ends, "file_id")
    # what ends too soon is left out whatever is left of the budget, so it never uses any
    rows = rows.select("file_id", "seg_idx", "cluster_label", "n", first.alias("first"), (F.col("end") - F.col("start")).alias("_l")).where(F.col("n") - F.col("first") >= int(least * rate))
    order = Window.partitionBy("file_id", "cluster_label").orderBy(F.desc("_l"), "seg_idx")
    used = F.coalesce(F.sum("_l").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumns({"_take": F.least(F.col("_l"), budget - F.least(F.lit(budget), used)), "place": F.row_number().over(order) - 1})
    rows = rows.withColumn("after", F.least("n", F.col("first") + (F.col("_take") * rate).cast("long")))
    return rows.where((F.col("_take") > 0.1) & (F.col("after") - F.col("first") >= int(least * rate))).select("file_id", "cluster_label", "place", "first", "after")


_LOADED: dict[str, Callable[[np.ndarray, int], np.ndarray | None]] = {}


def embedded(load: Callable[[], Callable[[np.ndarray, int], np.ndarray | None]], name: str, rate: int = 16000) -> Callable[[Column], Column]:
    """A function of a column of samples that gives their voices (``array<float>``), by an embedder of one's own.

    ``load`` is called once a Python worker and ``name``, however many tasks run there; it returns the embedder, which
    takes samples and their rate. What the embedder refuses (None or ValueError) and null samples have no voice: null.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def voices(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from sessionlake.operators import signals  # the worker's own module, not the copy that came with the function

        if name not in signals._LOADED:
            signals._LOADED[name] = load()
        embed = signals._LOADED[name]

        def one(samples):
            try:
                vec = None if samples is None else embed(np.asarray(samples, dtype=np.float32), rate)
            except ValueError:
                return None
            return None if vec is None else np.asarray(vec, dtype=np.float32)

        for batch in batches:
            yield batch.map(one)

    return voices


def unit_voice(vec: np.ndarray) -> np.ndarray:
    """The vector over its norm (plus 1e-9), as embedders return it."""
    return vec / (np.linalg.norm(vec) + 1e-9)


def cluster_voices(segments: DataFrame, blocks: DataFrame, size: int, embed: Callable[[Column], Column], **how) -> DataFrame:
    """``file_id, cluster_label, vec``: each cluster's pieces one after the other, embedded; clusters without usable audio
    have no row. What is gathered for a cluster is the budget's seconds."""
    pieces = cut(cluster_pieces(segments, lengths(blocks), **how), blocks, size)
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "samples"))), lambda p: p["samples"]))
    return pieces.groupBy("file_id", "cluster_label").agg(joined.alias("_s")).select("file_id", "cluster_label", embed(F.col("_s")).alias("vec")).where("vec is not null")


def turn_voices(segments: DataFrame, blocks: DataFrame, size: int, embed: Callable[[Column], Column], longest: float = 3.0, rate: int = 16000) -> DataFrame:
    """``file_id, seg_idx, vec`` of the turns shorter than ``longest`` seconds that lie within the signal."""
    short = segments.where(F.col("end") - F.col("start") < longest).join(lengths(blocks), "file_id")
    spans = short.select("file_id", "seg_idx", (F.col("start") * rate).cast("long").alias("first"), (F.col("end") * rate).cast("long").alias("after"), "n").where("after > first and after <= n").drop("n")
    return cut(spans, blocks, size).select("file_id", "seg_idx", embed(F.col("samples")).alias("vec")).where("vec is not null")


def region_voices(segments: DataFrame, blocks: DataFrame, size: int, embed: Callable[[Column], Column], min_clip: float = 0.5, rate: int = 16000) -> DataFrame:
    """``file_id, person_id, region, vec``: what ``library.session_updates`` blends: all clips of a person's region in a
    session, in order of ``seg_idx``, embedded together.

    A region's clips are gathered in one row: as long as a person's talk in one session, not longer.
    """
    from .library import DEFAULT_REGION, REGIONS

    region = F.when(F.col("matched_region").isin(*REGIONS), F.col("matched_region")).otherwise(DEFAULT_REGION)
    bounds = sample_bounds(F.col("start"), F.col("end"), F.col("n"), rate)
    rows = segments.where("speaker_id is not null and speaker_id <> ''").join(lengths(blocks), "file_id")
    clips = rows.select("file_id", "seg_idx", F.col("speaker_id").alias("person_id"), region.alias("region"), bounds["first"].alias("first"), bounds["after"].alias("after"))
    heard = cut(clips.where(F.col("after") - F.col("first") >= int(min_clip * rate)), blocks, size)
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "samples"))), lambda p: p["samples"]))
    return heard.groupBy("file_id", "person_id", "region").agg(joined.alias("_s")).select("file_id", "person_id", "region", embed(F.col("_s")).alias("vec")).where("vec is not null")
