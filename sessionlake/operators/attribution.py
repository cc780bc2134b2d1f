"""Who sings and who says each word: voices of sung segments and of single words against the voices of a file's persons.

Segments have ``file_id, seg_idx, start, end, region, text, speaker_id, speaker_confidence`` and more; ``candidates`` are
the persons of each file (``file_id, person_id``), the library has ``person_id, name, row_no, vec``. A voice meets its
file's candidates by an equi-join and passes by their vectors in parts: a person who takes part in a third of all files is
many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.text import sung_marker

from .matching import nearest_of_group
from .regions import is_sung
from .signals import cut, lengths
from .speakers import word_votes

#: Seconds that a word's window has at least; the embedder takes nothing shorter.
LEAST = 0.5


def best_persons(voices: DataFrame, key: list[str], candidates: DataFrame, library: DataFrame) -> DataFrame:
    """``key, best, best_region, best_score``: of the candidates of a voice's file (``file_id`` is in the key) the one with
    the nearest vector, of equal ones the lower id and name; voices without any candidate's vector have no row."""
    each = voices.select(*key, "vec").join(candidates.select("file_id", "person_id").distinct(), "file_id")
    found = nearest_of_group(each, library.select("person_id", "name", "vec"), "person_id", key, ["name"])
    best = found.groupBy(*key).agg(F.min(F.struct((-F.col("score")).alias("minus"), "person_id", "name")).alias("b"))
    return best.select(*key, F.col("b.person_id").alias("best"), F.col("b.name").alias("best_region"), (-F.col("b.minus")).alias("best_score"))


def _is_sung(segments: DataFrame) -> Column:
    """By the region's label, or by the column ``sung`` where there is one."""
    told = F.coalesce(is_sung(F.col("region")), F.lit(False))
    return told | F.coalesce("sung", F.lit(False)) if "sung" in segments.columns else told


def marked(segments: DataFrame) -> DataFrame:
    """Segments of sung regions with a marker for text, ``polished`` and ``sung`` set and without words; others unchanged.

    Columns ``polished`` and ``sung`` are added where they are missing (false); words are nulled where there are any.
    """
    sung = F.coalesce(is_sung(F.col("region")), F.lit(False))
    length = F.coalesce("end", F.lit(0.0)) - F.coalesce("start", F.lit(0.0))
    held = lambda c: F.coalesce(c, F.lit(False)) if c in segments.columns else F.lit(False)
    to = {"text": F.when(sung, sung_marker(length)).otherwise(F.col("text")), "polished": sung | held("polished"), "sung": sung | held("sung")}
    if "words" in segments.columns:
        to["words"] = F.when(~sung, F.col("words"))
    return segments.withColumns(to)


def sung_attributed(segments: DataFrame, blocks: DataFrame, size: int, embed: Callable[[Column], Column], candidates: DataFrame, library: DataFrame, rate: int = 16000) -> DataFrame:
    """``marked`` segments whose sung ones go to the person whose vector is nearest to their own voice.

    ``speaker_id``, ``speaker_confidence`` and ``matched_region`` are the nearest vector's. A sung segment without samples,
    one that the embedder refuses, and one of a file whose candidates have no vectors keep what they had.
    """
    rows = marked(segments)
    sung = segments.where(F.coalesce(is_sung(F.col("region")), F.lit(False)))
    spans = sung.select("file_id", "seg_idx", (F.col("start") * rate).cast("long").alias("first"), (F.col("end") * rate).cast("long").alias("after"))
    voices = cut(spans, blocks, size).select("file_id", "seg_idx", embed(F.col("samples")).alias("vec")).where("vec is not null")
    best = best_persons(voices, ["file_id", "seg_idx"], candidates, library)
    to = {"speaker_id": F.coalesce("best", "speaker_id"), "speaker_confidence": F.coalesce("best_score", "speaker_confidence")}
    old = F.col("matched_region") if "matched_region" in segments.columns else F.lit(None).cast("string")
    to["matched_region"] = F.coalesce("best_region", old)
    return rows.join(best, ["file_id", "seg_idx"], "left").withColumns(to).drop("best", "best_region", "best_score")


def word_spans(words: DataFrame, rate: int = 16000) -> DataFrame:
    """Adds ``first, after``, the samples around each word (``start, end`` in seconds; ``n`` samples in its file): a word of
    less than LEAST seconds is widened on both sides, as far as the signal goes. Windows that stay shorter are left out."""
    length = F.greatest(F.col("end") - F.col("start"), F.lit(0.0))
    pad = (LEAST - length) / 2
    begin = F.when(length >= LEAST, F.col("start")).otherwise(F.greatest(F.lit(0.0), F.col("start") - pad))
    finish = F.when(length >= LEAST, F.col("end")).otherwise(F.least(F.col("n") / rate, F.col("end") + pad))
    out = words.withColumns({"first": (begin * rate).cast("long"), "after": F.least("n", (finish * rate).cast("long"))})
    return out.where(F.col("after") - F.col("first") >= rate // 2)


def words_attributed(segments: DataFrame, blocks: DataFrame, size: int, embed: Callable[[Column], Column], candidates: DataFrame, library: DataFrame, margin: float = 0.15, rate: int = 16000) -> DataFrame:
    """Spoken segments judged word by word: adds ``reattributed_to`` to each word and ``reattributed``,
    ``reattributed_segment_flip`` to the segment, whose ``speaker_id`` may change.

    A word flips to the person nearest to its own voice where that is another one than the segment's and better than the
    segment's confidence by more than the margin. The segment goes to another person where some word flipped and more than
    half of all its words are nearest to that person. Sung segments, those without words or speaker, and files of fewer than
    two candidates stay as they are.
    """
    several = candidates.groupBy("file_id").agg(F.count_distinct("person_id").alias("_p")).where("_p > 1").select("file_id")
    spoken = segments.where(~_is_sung(segments) & F.col("speaker_id").isNotNull() & (F.size("words") > 0)).join(several, "file_id", "left_semi")
    each = spoken.select("file_id", "seg_idx", F.col("speaker_id").alias("current"), F.col("speaker_confidence").alias("confidence"), F.posexplode("words").alias("place", "w"))
    key = ["file_id", "seg_idx", "place"]
    timed = each.select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("end")).join(lengths(blocks), "file_id")
    voices = cut(word_spans(timed, rate).select(*key, "first", "after"), blocks, size).select(*key, embed(F.col("samples")).alias("vec")).where("vec is not null")
    heard = each.drop("w").join(best_persons(voices, key, candidates, library), key, "left")
    votes = word_votes(heard, ["file_id", "seg_idx"], margin).select("file_id", "seg_idx", "n_flipped", F.col("speaker_id").alias("_to"))
    flips = heard.where((F.col("best") != F.col("current")) & (F.col("best_score") - F.coalesce("confidence", F.lit(0.0)) > margin))
    flips = flips.groupBy("file_id", "seg_idx").agg(F.map_from_entries(F.collect_list(F.struct("place", "best"))).alias("_flips"))
    rows = segments.join(votes, ["file_id", "seg_idx"], "left").join(flips, ["file_id", "seg_idx"], "left")
    words = F.transform("words", lambda w, i: w.withField("reattributed_to", F.try_element_at("_flips", i)))
    to = {
        "words": words, "reattributed": F.coalesce(F.col("n_flipped") > 0, F.lit(False)),
        "reattributed_segment_flip": F.coalesce(F.col("_to") != F.col("speaker_id"), F.lit(False)), "speaker_id": F.coalesce("_to", "speaker_id"),
    }
    return rows.withColumns(to).drop("n_flipped", "_to", "_flips")
