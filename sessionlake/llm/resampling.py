"""Importance resampling towards a target distribution, with an Aho-Corasick dictionary that knows hashes.

Features are runs of one to ``longest`` consecutive words joined by one blank; a feature's bucket is its CRC-32 modulo the
number of buckets. Dictionary words stand in an automaton between delimiters (``" word "``), each with a payload: its CRC
and its length. A scan of a text with one blank for each delimiter emits the payloads in order; words that are not in the
dictionary leave a gap and get their payload on the spot, so the dictionary decides on speed alone. The CRC of a longer
run is composed of its neighbours' payloads: CRCs are linear, so the CRC of ``a + b`` is that of ``a`` moved over the
length of ``b``, xor that of ``b``. No feature is ever written out as text.

The dictionary holds the most frequent words, ``DICTIONARY`` at most, of up to ``LONGEST_WORD`` bytes; all words are
counted exactly, in tasks first, and only those of the dictionary reach the driver. Bucket counts are summed the same way; what reaches the driver is one row a bucket. Gains
go to the tasks as one array of that many numbers. Documents are drawn by rank without one sorted task: counts by score
(a score is a whole number within some ten thousand) give the least score drawn and each score's first rank, and only
documents of one score are put in order together. Noise spreads documents over scores, so no score holds a large share;
only rows that repeat one doc_id share their noise.

Null and empty texts have no features, weight 0, and are not drawn. A null doc_id counts as an empty one for the noise and
comes last among ties; of rows with equal doc_id and score either may come first. Repeated rows are scored one by one.
Very long texts are scanned whole, in memory that grows with the text. An empty table of documents gives an empty table;
an empty target gives every feature the gain of a target without counts. Only the key and ``text`` are read, so extra
columns of any name do not matter.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import zlib
from collections import Counter
from fractions import Fraction

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import FOLD, binary_text, lean, scratch, tidy, written

DICTIONARY, LONGEST_WORD = 1 << 16, 48
#: Distinct words that a task counts before it sends its counts on.
HELD_WORDS = 1 << 18
SCORED = "n_words long, n_features long, weight long, score long"


@functools.cache
def _moves() -> list[np.ndarray]:
    """Tables that move a CRC over 1, 2, 4, ... zero bytes, four lookups a move."""
    over = lambda x: zlib.crc32(b"\0", x) ^ zlib.crc32(b"\0", 0)
    one = np.array([[over(b << 8 * k) for b in range(256)] for k in range(4)], dtype=np.uint32)
    tables = [one]
    while len(tables) < 32:
        t = tables[-1]
        tables.append(np.array([_through(t, row) for row in t], dtype=np.uint32))
    return tables


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def composed(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs (uint32) of the texts ``a + b`` from the CRCs of both and the length of ``b`` in bytes."""
    out, length, k = a, length.astype(np.int64), 0
    while (length >> k).any():
        out = np.where(length >> k & 1, _through(_moves()[k], out), out)
        k += 1
    return out ^ b


class Dictionary:
    """The automaton of delimiter-bounded words with their payloads."""

    def __init__(self, words: list[bytes]):
        self.automaton = ahocorasick.Automaton()
        for k, w in enumerate(words):
            self.automaton.add_word(f" {w.decode('latin-1')} ", k)
        self.automaton.make_automaton()
        self.crc = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
        self.length = np.array([len(w) for w in words], dtype=np.int64)

    def scan(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """CRC and length of every word of the text, in order."""
        padded = b" " + text.translate(FOLD) + b" "
        blank = np.frombuffer(padded, dtype=np.uint8) == 32
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        starts, stops = edge[::2] + 1, edge[1::2] + 1
        n = len(starts)
        length = stops - starts
        crc = np.zeros(n, dtype=np.uint32)
        found = list(self.automaton.iter(padded.decode("latin-1"))) if n and len(self.crc) else []
        if found:
            ends, which = np.fromiter(itertools.chain.from_iterable(found), dtype=np.int64, count=2 * len(found)).reshape(-1, 2).T
            if len(ends) == n:
                return self.crc[which], length
            at = np.searchsorted(stops, ends)  # a match ends at the blank after its word
            crc[at] = self.crc[which]
        gap = np.ones(n, dtype=bool)
        if found:
            gap[at] = False
        for k, a, b in zip(np.flatnonzero(gap).tolist(), starts[gap].tolist(), stops[gap].tolist()):
            crc[k] = zlib.crc32(padded[a:b])
        return crc, length

    def buckets(self, text: bytes, buckets: int, longest: int) -> tuple[int, np.ndarray]:
        """The count of words, and the bucket of every feature."""
        crc, length = self.scan(text)
        run, out = crc, [crc]
        blank = np.uint32(zlib.crc32(b" "))
        for k in range(1, min(longest, len(crc))):
            run = run[:-1]
            run = composed(composed(run, np.full(len(run), blank), np.ones(len(run))), crc[k:], length[k:])
            out.append(run)
        return len(crc), np.concatenate(out).astype(np.int64) % buckets


@functools.lru_cache(2)
def _dictionary(words: tuple[bytes, ...]) -> Dictionary:
    return Dictionary(list(words))


def frequent_words(texts: DataFrame, most: int = DICTIONARY) -> tuple[bytes, ...]:
    """The words of up to LONGEST_WORD bytes that occur most often, ``most`` of them or fewer: counts fall into steps of an
    eighth of a power of two, and steps are taken whole from the highest down. All words are counted; those that occur
    once are left out."""

    def count(batches):
        held: Counter[bytes] = Counter()

        def told():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    held.update(text.as_py().translate(FOLD).split())
                if len(held) > HELD_WORDS:
                    yield told()
                    held.clear()
        if held:
            yield told()

    counts = texts.select(binary_text()).mapInArrow(tidy(count), "word binary, n long").where(F.length("word") <= LONGEST_WORD)
    with scratch(texts.sparkSession):
        often = written(counts.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").withColumn("step", F.floor(F.log2("n") * 8).cast("int")))
        room, least = most, None
        for r in often.groupBy("step").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():  # a few hundred rows
            room, least = room - r["n"], r["step"] if room >= r["n"] else least
            if room < 0:
                break
        words = [] if least is None else often.where(F.col("step") >= least).select("word").toArrow().column(0).to_pylist()
    return tuple(sorted(words))


def bucket_counts(texts: DataFrame, words: tuple[bytes, ...], buckets: int, longest: int) -> np.ndarray:
    """How many features of all texts fall in each bucket."""
    sent = texts.sparkSession.sparkContext.broadcast(words)

    def count(batches):
        known, total = _dictionary(sent.value), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    total += np.bincount(known.buckets(text.as_py(), buckets, longest)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in texts.select(binary_text()).mapInArrow(tidy(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The floored thousandfold logarithm of each bucket's share in the target over that in the source, both plus one."""
    k, n, m = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (n + k) / ((s + 1) * (m + k)))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def noise(seed: int, key) -> int:
    """The floored thousandfold Gumbel noise of a key."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame, key: str = "doc_id", buckets: int = 10_000, longest: int = 1, seed: int = 2024, most: int = DICTIONARY) -> DataFrame:
    """The key and SCORED of every document: its weight is the floored mean of its features' gains, its score the weight
    plus the key's noise."""
    docs = lean(docs)
    words = frequent_words(docs, most)
    gain = gains(bucket_counts(docs, words, buckets, longest), bucket_counts(target, words, buckets, longest))
    sent = docs.sparkSession.sparkContext.broadcast((words, gain))

    def score(batches):
        words, gain = sent.value
        known = _dictionary(words)
        for batch in batches:
            rows = []
            for who, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, found = known.buckets(text.as_py(), buckets, longest) if text.is_valid else (0, ())
                weight = int(gain[found].sum()) // len(found) if len(found) else 0
                rows.append((n, len(found), weight, weight + noise(seed, who)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4))], names)

    fields = T.StructType([docs.schema[key], *T._parse_datatype_string(SCORED).fields])
    names = fields.names
    return docs.select(key, binary_text()).mapInArrow(tidy(score), fields)


def draw(rows: DataFrame, share: Fraction | float, least_words: int = 20, key: str = "doc_id") -> DataFrame:
    """Adds ``rank`` to scored rows: 1, 2, ... by falling score, ties by key, for the drawn share (rounded down) of those
    with enough words; null for all others. The rows are read three times: pass a written table."""
    fit = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    before = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)  # one row a score
    by_score = rows.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n")).select("score", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")).collect()
    drawn = math.floor(Fraction(share).limit_denominator(10**6) * sum(r["n"] for r in by_score))
    first = rows.sparkSession.createDataFrame([(r["score"], r["_before"]) for r in by_score if r["_before"] < drawn] or [], "score long, _before long")
    low = min((r["score"] for r in by_score if r["_before"] < drawn), default=None)
    if low is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    top = fit & (F.col("score") >= low)
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last(key)))
    ranked = rows.where(top).join(F.broadcast(first), "score").withColumn("rank", F.col("_before") + place)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return rows.where(~top).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked.select(*rows.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, share: Fraction | float = Fraction(1, 10), key: str = "doc_id", **how) -> DataFrame:
    """The key, SCORED and ``rank`` of every document. Scores are written once to the shared folder, as ranks need them."""
    with scratch(docs.sparkSession):
        rows = written(scored(docs, target, key, **how), keep=True)
        return draw(rows, share, key=key)
