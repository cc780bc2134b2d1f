"""Polishing transcripts: prompts, trusted merges, order, and gated patches of words.

A patch says that a word of a segment should read otherwise. The gate names the first reason against it; accepted
patches are applied one after the other, so a later one sees what an earlier one wrote.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.phonetics import same_sound
from sessionlake.functions.text import first_json_array

from .corpus import chunks

#: Fixed names of the reasons against a patch, in the order in which they are asked.
REASONS = (
    "invalid_segment_index", "invalid_word_index", "empty_text", "no_change", "missing_word_metadata", "original_mismatch",
    "no_word_confidence_and_not_glossary", "word_confidence_above_threshold", "unknown_phonetic_gate", "phonetic_keys_differ",
)
#: The one test of sounds there is; any other name refuses what the glossary does not know.
GATE = "metaphone_ro_fold"


def by_sung(rows: DataFrame, region: str = "region") -> tuple[DataFrame, DataFrame]:
    """Spoken and sung rows: sung ones have a region that starts with ``sung``."""
    sung = F.coalesce(F.col(region), F.lit("")).startswith("sung")
    return rows.where(~sung), rows.where(sung)


def in_order(spoken: DataFrame, sung: DataFrame, by: str, start: str = "start") -> DataFrame:
    """Both, with ``place``: the row's number in its file by start (missing ones count as 0) and place before."""
    both = spoken.unionByName(sung, allowMissingColumns=True)
    order = F.struct(F.coalesce(F.col(start), F.lit(0)).alias("s"), F.col("seg_idx").alias("i"))
    from pyspark.sql.window import Window

    return both.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)


def ordered_text(rows: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """``by, n_rows, text``: the trimmed texts of each group in order, joined by one blank."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("t"))))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.array_join(F.transform(pieces, lambda p: p["t"]), " ").alias("text"))


def prompts(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """One JSON array of ``start, end, speaker_id, text`` for each chunk, in order."""
    each = F.struct(F.col(order).alias("o"), F.struct("start", "end", "speaker_id", "text").alias("s"))
    return rows.groupBy(*by).agg(F.to_json(F.transform(F.array_sort(F.collect_list(each)), lambda e: e["s"])).alias("prompt"))


def merge_polished(original: DataFrame, polished: DataFrame, key: list[str]) -> DataFrame:
    """The original rows; where a polished row of the key came back, only its ``text`` is taken and ``polished`` is true."""
    back = polished.select(*key, F.col("text").alias("_new"), F.lit(True).alias("_back"))
    out = original.join(back, key, "left")
    took = F.col("_back") & F.col("_new").isNotNull()
    return out.withColumns({"text": F.when(took, F.col("_new")).otherwise(F.col("text")), "polished": F.coalesce(took, F.lit(False))}).drop("_new", "_back")


def introduced(before: Column, after: Column) -> Column:
    """Entities that only the polished text has, sorted; null lists are empty."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_except(F.coalesce(after, none), F.coalesce(before, none)))


def judge_patches(patches: DataFrame, words: DataFrame, glossary: list[str], threshold: float = 0.6, sounds: Callable[[Column, Column], Column] = same_sound, key: str = "file_id", gate: str = GATE) -> DataFrame:
    """Adds ``rejection_reason`` (null: accepted) to each patch, judged by the words as they were at first.

    ``words`` holds ``key, segment_index, word_index, word, probability``; a segment without words has one row of null
    word_index. Exact where no word has two patches; ``apply_patches`` judges in order.
    """
    segments = words.select(key, "segment_index").distinct().withColumn("_segment", F.lit(True))
    at = words.where("word_index is not null").select(key, "segment_index", "word_index", F.trim("word").alias("_word"), F.col("probability").alias("_p"), F.lit(True).alias("_there"))
    rows = patches.join(segments, [key, "segment_index"], "left").join(at, [key, "segment_index", "word_index"], "left")
    old, new = F.trim(F.coalesce("original", F.lit(""))), F.trim(F.coalesce("proposed", F.lit("")))
    known = F.lower(new).isin([g.lower() for g in glossary]) if glossary else F.lit(False)
    missing = lambda c: F.col(c).isNull()
    asked = (
        missing("segment_index") | missing("_segment") | (F.col("segment_index") < 0), missing("word_index") | (F.col("word_index") < 0), (old == "") | (new == ""), old == new,
        missing("_there"), F.coalesce("_word", F.lit("")) != old, missing("_p") & ~known, F.col("_p") >= threshold, ~known & F.lit(gate != GATE), ~known & ~sounds(old, new),
    )
    reason = F.lit(None).cast("string")
    for name, holds in reversed(list(zip(REASONS, asked))):
        reason = F.when(holds, name).otherwise(reason)
    return rows.withColumn("rejection_reason", reason).drop("_segment", "_word", "_p", "_there")


def apply_patches(patches: DataFrame, words: DataFrame, glossary: list[str], threshold: float = 0.6, key: str = "file_id", gate: str = GATE) -> DataFrame:
    """``key, segment_index, text, n_applied, rejected`` of every segment that has words or patches.

    A patch is judged by the words that those before it (by ``patch_no``) left: their order matters only within a
    segment, so segments are groups; a group is one segment's words and patches. ``rejected`` is
    ``array<struct<patch_no, reason>>``.
    """
    from sessionlake.functions.phonetics import sound_key

    terms = {g.lower() for g in glossary}
    kind = words.schema[key].dataType.simpleString()
    shape = f"{key} {kind}, segment_index int, text string, n_applied long, rejected array<struct<patch_no:int,reason:string>>"

    def reason_against(p, held) -> str | None:
        old, new = (p.original or "").strip(), (p.proposed or "").strip()
        at = None if pd.isna(p.word_index) else int(p.word_index)
        if pd.isna(p.segment_index) or held is None or p.segment_index < 0:
            return REASONS[0]
        if at is None or at < 0:
            return REASONS[1]
        if not old or not new:
            return REASONS[2]
        if old == new:
            return REASONS[3]
        if at not in held:
            return REASONS[4]
        word, sure = held[at]
        if word.strip() != old:
            return REASONS[5]
        known = new.lower() in terms
        if sure is None and not known:
            return REASONS[6]
        if sure is not None and sure >= threshold:
            return REASONS[7]
        if known:
            return None
        if gate != GATE:
            return REASONS[8]
        a = sound_key(old)
        return None if a and a == sound_key(new) else REASONS[9]

    def fold(keys: tuple, w: pd.DataFrame, p: pd.DataFrame) -> Iterator[pd.DataFrame] | pd.DataFrame:
        held = None if w.empty else {int(r.word_index): (r.word or "", None if pd.isna(r.probability) else r.probability) for r in w.itertuples() if not pd.isna(r.word_index)}
        applied, rejected = 0, []
        for patch in p.sort_values("patch_no").itertuples():
            reason = reason_against(patch, held)
            if reason:
                rejected.append({"patch_no": int(patch.patch_no), "reason": reason})
            else:
                held[int(patch.word_index)] = (patch.proposed.strip(), held[int(patch.word_index)][1])
                applied += 1
        text = " ".join(held[k][0].strip() for k in sorted(held)).strip() if held else ""
        return pd.DataFrame({key: [keys[0]], "segment_index": pd.array([keys[1]], dtype="Int32"), "text": [text], "n_applied": [applied], "rejected": [rejected]})

    one = words.select(key, F.col("segment_index").cast("int"), "word_index", "word", "probability").groupBy(key, "segment_index")
    two = patches.select(key, F.col("segment_index").cast("int"), "patch_no", "word_index", "original", "proposed").groupBy(key, "segment_index")
    return one.cogroup(two).applyInPandas(fold, shape)


SAID = "array<struct<start:double,end:double,speaker_id:string,text:string>>"


def asked(backend: Callable[[str], str | None], at_once: int = 8, seconds: float = 120.0) -> Callable[[Column], Column]:
    """A function of a column of prompts that gives the backend's replies: ``at_once`` calls in a task at a time.

    A call that fails or takes longer than ``seconds`` has no reply (null); its thread is left to itself, so it delays
    neither the other calls nor the task's end.
    """

    def together(prompts: list[str | None]) -> list[str | None]:
        replies: dict[int, str | None] = {}

        def call(k: int, prompt: str) -> None:
            try:
                replies[k] = backend(prompt)
            except Exception:  # whatever a backend raises, the chunk stays as it was
                replies[k] = None

        threads = [threading.Thread(target=call, args=(k, p), daemon=True) for k, p in enumerate(prompts) if p is not None]
        for t in threads:
            t.start()
        until = time.monotonic() + seconds
        for t in threads:
            t.join(max(0.0, until - time.monotonic()))
        told = dict(replies)
        return [told.get(k) for k in range(len(prompts))]

    @F.pandas_udf("string")
    def replies(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            prompts = batch.tolist()
            yield pd.Series([r for k in range(0, len(prompts), at_once) for r in together(prompts[k : k + at_once])], dtype=object)

    return replies.asNondeterministic()


def polished(segments: DataFrame, ask: Callable[[Column], Column], size: int = 200, overlap: int = 2, within: float = 0.001, by: str = "file_id", order: str = "seg_idx") -> DataFrame:
    """Segments whose ``text`` a backend polished, with ``polished``: chunks of ``size`` that share ``overlap`` go out.

    Of a reply the first JSON array counts. It is taken if it has the chunk's length and each segment its times (to
    ``within`` seconds) and its speaker; then only the texts are, a missing text leaving the segment as it was. Of shared
    segments the earlier chunk's version stays. Without a valid reply a chunk's segments come back unpolished: rows and
    their order never change.
    """
    own = [c for c in segments.columns if c != "polished"]
    each = chunks(segments.select(*own), by, order, size, overlap)
    row = F.struct(F.col(order).alias("_o"), "keep", F.struct(*own).alias("row"))
    held = each.groupBy(by, "chunk").agg(F.array_sort(F.collect_list(row), lambda a, b: F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).otherwise(0)).alias("_rows"))
    prompt = F.to_json(F.transform("_rows", lambda r: F.struct(*[r["row"][c].alias(c) for c in ("start", "end", "speaker_id", "text")])))
    told = held.select("_rows", F.from_json(first_json_array(ask(prompt)), SAID).alias("_said"))
    near = lambda a, b: F.abs(a - b) <= within
    pairs = F.zip_with("_rows", "_said", lambda r, s: F.coalesce(near(r["row"]["start"], s["start"]) & near(r["row"]["end"], s["end"]) & r["row"]["speaker_id"].eqNullSafe(s["speaker_id"]), F.lit(False)))
    valid = F.coalesce((F.size("_rows") == F.size("_said")) & F.forall(pairs, lambda p: p), F.lit(False))
    out = told.select(valid.alias("_valid"), "_said", F.posexplode("_rows").alias("_k", "_r")).where("_r.keep")
    new = F.when(F.col("_valid"), F.get("_said", F.col("_k"))["text"])
    return out.select("_r.row.*", new.alias("_new")).withColumns({"text": F.coalesce("_new", "text"), "polished": F.col("_new").isNotNull()}).drop("_new")
