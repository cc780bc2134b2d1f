"""Text functions: file names, word error rate, folding, markers, first JSON array in a reply."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed patterns and values of session file names.
CANONICAL = r"^(\d{4}-\d{2}-\d{2})_([a-z0-9_]+?)__([a-z0-9_]+?)_([a-z]{2})$"
LEGACY = r"^(\d{4}-\d{2}-\d{2})_([a-z0-9_]+?)_([a-z]{2})$"
LANGUAGES = ("en", "ro")
#: Letters with marks (comma and cedilla forms) and the plain ones that they fold to.
MARKED, PLAIN = "ĂăÂâÎîȘșȚțŞşŢţ", "AaAaIiSsTtSsTt"


def parse_name(stem: Column, teacher_if_short: str | None = None) -> Column:
    """``date, teacher, student, language`` of a file's stem, all null where neither form fits or the language is unknown.

    The short form names no teacher; it has the one given.
    """
    low = F.lower(stem)
    full, short = low.rlike(CANONICAL), low.rlike(LEGACY)
    part = lambda k, j: F.when(full, F.regexp_extract(low, CANONICAL, k)).when(short, F.regexp_extract(low, LEGACY, j))
    language = part(4, 3)
    teacher = F.when(full, F.regexp_extract(low, CANONICAL, 2)).when(short, F.lit(teacher_if_short))
    fields = (("date", part(1, 1)), ("teacher", teacher), ("student", part(3, 2)), ("language", language))
    return F.struct(*[F.when(language.isin(*LANGUAGES), c).alias(n) for n, c in fields])


def session_id(meta: Column) -> Column:
    return F.concat(meta["date"], F.lit("_"), meta["teacher"], F.lit("__"), meta["student"], F.lit("_"), meta["language"])


def _coded(words: Column, table: Column) -> Column:
    """A text of one code point for each word: its position in the table, past the surrogates; an ``A`` ahead, so none is taken for a byte order mark."""
    point = lambda w: F.array_position(table, w) + 0x100
    past = lambda c: F.lpad(F.hex(F.when(c < 0xD800, c).otherwise(c + 0x800)), 8, "0")
    return F.decode(F.unhex(F.concat(F.lit("00000041"), F.array_join(F.transform(words, lambda w: past(point(w))), ""))), "UTF-32")


def word_edits(reference: Column, heard: Column) -> Column:
    """Edit distance in words of two word arrays: a code point for each distinct word.

    Unicode has code points for 1.1 million distinct words of a pair; beyond them decoding fails with an error.
    """
    table = F.array(F.array_distinct(F.concat(reference, heard)))  # one element, so that the lambda's variable holds it and it is made once
    return F.element_at(F.transform(table, lambda t: F.levenshtein(_coded(reference, t), _coded(heard, t)).cast("long")), 1)


def word_error_rate(reference: Column, heard: Column) -> Column:
    """Edits over words of the reference; of an empty reference 0 or 1."""
    empty = F.when(F.size(heard) == 0, 0.0).otherwise(1.0)
    return F.when(F.size(reference) == 0, empty).otherwise(word_edits(reference, heard) / F.size(reference))


def fold_marks(text: Column) -> Column:
    return F.translate(text, MARKED, PLAIN)


def sung_marker(seconds: Column) -> Column:
    """``[SUNG: ~3s]``: seconds rounded half to even."""
    return F.concat(F.lit("[SUNG: ~"), F.bround(seconds, 0).cast("long").cast("string"), F.lit("s]"))


def first_json_array(reply: Column) -> Column:
    """The first fenced JSON array of a reply, else what stands from the first ``[`` to the last ``]``; else null."""
    fenced = F.nullif(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\[.*?\])\s*```", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(reply, r"(?s)\[.*\]", 0), F.lit(""))
    found = F.coalesce(fenced, bare)
    return F.when(F.from_json(found, "array<string>").isNotNull(), found)


def polish_skip(words: Column, logprob: Column, threshold: float | None, floor: float = -0.3) -> Column:
    """Whether a segment needs no polish: all its words are sure enough, or, without words, its log-probability is."""
    plain = F.coalesce(logprob > floor, F.lit(False))
    if threshold is None:
        return plain
    return F.when(F.size(words) > 0, F.forall(words, lambda p: F.coalesce(p, F.lit(0.0)) >= threshold)).otherwise(plain)


@F.pandas_udf(StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def ascii_id(name: Column) -> Column:
    """Lower-case letters and digits joined by ``_``; marks are taken off (NFKD). Null where nothing is left."""
    runs = F.regexp_replace(F.lower(_decomposed(name)), "[^a-z0-9]+", "_")
    return F.nullif(F.regexp_replace(runs, "^_+|_+$", ""), F.lit(""))


def parse_time(stamp: Column) -> Column:
    """A time of an ISO stamp; one without an offset is UTC by the session's zone, what does not parse is null."""
    return F.try_to_timestamp(F.nullif(F.trim(stamp), F.lit("")))


#: Fixed parts of messages of errors that are worth another try.
TRANSIENT = (
    "cuda", "cufft", "cudnn", "out of memory", "oom", "timeout", "timed out", "connection reset", "temporarily unavailable",
    "resource busy", "device or resource busy", "broken pipe",
)


def is_transient(message: Column) -> Column:
    low, out = F.lower(F.coalesce(message, F.lit(""))), F.lit(False)
    for part in TRANSIENT:
        out = out | F.contains(low, F.lit(part))
    return out


def _known(x: Column, out: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")) | (x < 0), "\u2013").otherwise(out)


def duration_text(seconds: Column) -> Column:
    """``2h 3m``, ``3m 4s`` or ``4s``; a dash for what is no duration."""
    h, m, s = (F.floor(x).cast("string") for x in (seconds / 3600, seconds % 3600 / 60, seconds % 60))
    some = F.when(seconds >= 3600, F.concat(h, F.lit("h "), m, F.lit("m"))).when(seconds >= 60, F.concat(m, F.lit("m "), s, F.lit("s")))
    return _known(seconds, some.otherwise(F.concat(s, F.lit("s"))))


def clock_text(seconds: Column) -> Column:
    """``3:04``: minutes and two digits of seconds; a dash for what is no duration."""
    return _known(seconds, F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad(F.floor(seconds % 60).cast("string"), 2, "0")))


def size_text(count: Column) -> Column:
    """Bytes in B, KB, MB (one digit) or GB (two digits)."""
    of = lambda power, digits, unit: F.concat(F.format_string(f"%.{digits}f", count / float(1024**power)), F.lit(f" {unit}"))
    return F.when(count < 1024, F.concat(count.cast("string"), F.lit(" B"))).when(count < 1024**2, of(1, 1, "KB")).when(count < 1024**3, of(2, 1, "MB")).otherwise(of(3, 2, "GB"))


def middle_cut(text: Column, most: int = 64) -> Column:
    """A text of more than ``most`` letters with its middle left out."""
    half = (most - 1) // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, half), F.lit("\u2026"), F.right(text, F.lit(half))))


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def progress(done: Column, total: Column, seconds: Column) -> Column:
    """``share, each, left``: share done, mean seconds of a file, and the seconds that the rest will take."""
    each = F.when(done > 0, seconds / done)
    return F.struct(F.when(total > 0, done / total).otherwise(0.0).alias("share"), each.alias("each"), (each * (total - done)).alias("left"))


def polish_needless(polished: Column, sung: Column, words: Column, logprob: Column, threshold: float | None, floor: float = -0.3) -> Column:
    """As ``polish_skip``; what is sung and polished already needs none either."""
    return (F.coalesce(polished, F.lit(False)) & F.coalesce(sung, F.lit(False))) | polish_skip(words, logprob, threshold, floor)
