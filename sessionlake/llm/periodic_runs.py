"""Periodic runs of words, found through longest common extensions over a difference cover.

A run is a stretch of consecutive words with smallest period ``q`` that repeats at least four times, is at least six words
long, and that neither neighbour extends. Any stretch with period ``q`` that is long enough holds a place ``i`` on the grid
``0, 3q, 6q, ...`` with ``i + q`` in it too, so for every period the grid's places are tried: the common extension of the
suffixes at ``i`` and ``i + q`` to the right and of the prefixes to the left are the run's ends. Over all periods these
are about ``n ln(n) / 3`` places (the harmonic sum), most of which fail at their first word.

Common extensions: of all suffixes only those at places whose remainder is in a difference cover modulo ``MODULUS`` are
sorted, by doubling from windows of ``MODULUS`` words. Two places reach sampled places together within a few words, which
are compared one by one; from there the extension is the least of the common prefixes between the two in sorted order, a
range minimum by a sparse table. The sorted samples are made when the first pair of a document gets that far, so texts
that do not repeat never pay for them.

Null and empty texts have no words and no runs: counts 0, null places, digests of empty strings. Repeated rows are judged
one by one; null keys stay null; an empty table gives an empty table. Very long texts are judged whole: memory is some 150
bytes a word in one task for texts that repeat, beside the words themselves, and less for others. Only the key and ``text`` are read, so
extra columns of any name do not matter.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_text, hex_sha256, lean, tidy

#: Every difference modulo MODULUS is one of two elements of COVER.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: Words compared before samples are used, and places tried at once.
LEAST, BLOCK = 4, 1 << 19
TIMES, SHORTEST = 4, 6
RUN = "struct<start:long,length:long,period:long>"
SPACE = bytes(32 if 9 <= c <= 13 else c for c in range(256))


def _sync_table() -> np.ndarray:
    """For places i and j by their remainders: the words to compare, LEAST or more, until both are sampled."""
    out = np.zeros((MODULUS, MODULUS), dtype=np.int64)
    for a in range(MODULUS):
        for b in range(MODULUS):
            out[a, b] = next(k for k in range(LEAST, LEAST + MODULUS) if (a + k) % MODULUS in COVER and (b + k) % MODULUS in COVER)
    return out


SYNC = _sync_table()


def _dense(columns: list[np.ndarray]) -> np.ndarray:
    """Ranks from 0 of rows in the lexicographic order of the columns; equal rows share one."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    out = np.empty(len(order), dtype=np.int32)
    out[order] = np.cumsum(new, dtype=np.int32)
    return out


class Extensions:
    """Longest common extensions to the right of pairs of places in a text of word numbers."""

    def __init__(self, words: np.ndarray):
        self.words, self.n = words, len(words)
        self.sampled = False

    def sort_samples(self) -> None:
        """Ranks of the sampled suffixes, and the sparse table over their neighbours' common prefixes."""
        self.sampled = True
        n, v = self.n, MODULUS
        rows = -(-(n + 1) // v)
        self.index = np.full(rows * v, -1, dtype=np.int32)
        places = (np.arange(rows)[:, None] * v + np.array(COVER)[None, :]).ravel()
        self.index[places] = np.arange(len(places), dtype=np.int32)
        padded = np.full(rows * v + 2 * v, -1, dtype=np.int32)  # beyond the end: less than any word
        padded[:n] = self.words
        levels = [_dense([padded[places + k] for k in range(v)])]
        step = 1  # in rows: a sample's next one of the same remainder is len(COVER) further on
        while step < rows and levels[-1].max() + 1 < len(places):
            now, late = levels[-1], step * len(COVER)
            after = np.full(len(now), -1, dtype=np.int32)
            after[:-late] = now[late:]
            levels.append(_dense([now, after]))
            step *= 2
        order = np.lexsort((places, levels[-1]))  # places beyond the end tie
        self.rank = np.empty(len(order), dtype=np.int32)
        self.rank[order] = np.arange(len(order), dtype=np.int32)
        a, b = places[order[:-1]].copy(), places[order[1:]].copy()
        for k in range(len(levels) - 1, -1, -1):
            inside = np.maximum(a, b) < n
            same = inside.copy()
            same[inside] = levels[k][self.index[a[inside]]] == levels[k][self.index[b[inside]]]
            a[same] += v << k
            b[same] += v << k
        going = np.maximum(a, b) < n
        for _ in range(v):
            going[going] = padded[a[going]] == padded[b[going]]
            a[going] += 1
            b[going] += 1
            going &= np.maximum(a, b) < n
        table = [(a - places[order[:-1]]).astype(np.int32)]
        while 2 << (len(table) - 1) <= len(table[0]):
            last, half = table[-1], 1 << (len(table) - 1)
            table.append(np.minimum(last[:-half], last[half:]))
        self.table = table

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` and from ``j`` on are the same, for arrays of places with ``i < j``."""
        out = np.zeros(len(i), dtype=np.int64)
        sync = SYNC[i % MODULUS, j % MODULUS]
        alive = np.arange(len(i))
        for k in range(LEAST + MODULUS):
            alive = alive[(k < sync[alive]) & (j[alive] + k < self.n)] if k else alive
            if not len(alive):
                break
            alive = alive[self.words[i[alive] + k] == self.words[j[alive] + k]]
            out[alive] = k + 1
        far = np.flatnonzero((out == sync) & (j + sync < self.n))
        if len(far):
            if not self.sampled:
                self.sort_samples()
            a, b = (self.rank[self.index[x[far] + sync[far]]].astype(np.int64) for x in (i, j))
            first, last = np.minimum(a, b), np.maximum(a, b)
            level = np.log2(last - first).astype(np.int64)
            least = np.empty(len(far), dtype=np.int64)
            for k in np.unique(level):
                at = level == k
                least[at] = np.minimum(self.table[k][first[at]], self.table[k][last[at] - (1 << int(k))])
            out[far] += least
        return out


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """``start, length, period`` of every run, by start and period; words are numbers."""
    n = len(words)
    right, left = Extensions(words), Extensions(words[::-1])
    found: dict[tuple[int, int], int] = {}
    q, most = 1, n // TIMES
    while q <= most and n >= SHORTEST:
        count = np.maximum(0, -(-(n - np.arange(q, most + 1)) // ((TIMES - 1) * np.arange(q, most + 1))))
        upto = max(1, int(np.searchsorted(np.cumsum(count), BLOCK, side="right")))
        count = count[:upto]
        period = np.repeat(np.arange(q, q + upto), count)
        i = (np.arange(len(period)) - np.repeat(np.cumsum(count) - count, count)) * (TIMES - 1) * period
        hit = words[i] == words[i + period]
        i, period = i[hit], period[hit]
        q += upto
        if len(i):
            ahead = right.of(i, i + period)
            # the mirror image of place p is n - 1 - p; the places before i and i + q
            back = np.zeros(len(i), dtype=np.int64)
            some = i > 0
            back[some] = left.of(n - (i + period)[some], n - i[some])
            start, length = i - back, back + ahead + period
            keep = length >= np.maximum(SHORTEST, TIMES * period)
            for s, m, p in sorted(set(zip(start[keep].tolist(), length[keep].tolist(), period[keep].tolist())), key=lambda r: r[2]):
                found.setdefault((s, m), p)  # periods rise: the first is the smallest
    return sorted((s, m, p) for (s, m), p in found.items())


def split(text: bytes | None) -> list[bytes]:
    """Words between blanks, tabs and line ends of any kind."""
    return [w for w in text.translate(SPACE).split(b" ") if w] if text else []


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    return np.array(list(map({}.setdefault, words, range(len(words)))), dtype=np.int32)


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stand in a run after its first period."""
    depth = np.zeros(n + 1, dtype=np.int64)
    for s, m, p in runs:
        depth[s + p] += 1
        depth[s + m] -= 1
    return np.cumsum(depth[:-1]) > 0


def detect(docs: DataFrame, key: str = "doc_id", with_runs: bool = True, with_text: bool = True) -> DataFrame:
    """The key, ``n_words, n_runs, start, length, period, exponent_milli`` of the run with the greatest exponent (ties: least
    start, then period), ``runs_sha256, collapsed_sha256`` and, where asked for, ``runs`` (array of RUN) and ``collapsed``,
    the text without the words that a run repeats."""
    fields = [docs.schema[key], *T._parse_datatype_string("n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string").fields]
    if with_runs:
        fields.append(T.StructField("runs", T.ArrayType(T._parse_datatype_string(RUN))))
    if with_text:
        fields.append(T.StructField("collapsed", T.StringType()))
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    run_kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def judge(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                rows, runs, texts = [], [], []
                for text in batch.column(1):
                    words = split(text.as_py())
                    found = runs_of(numbered(words))
                    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                    kept = b" ".join(words if not found else [w for w, gone in zip(words, dropped(len(words), found).tolist()) if not gone])
                    told = "".join(f"{s},{m},{p}\n" for s, m, p in found)
                    rows.append((len(words), len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hex_sha256(told.encode()), hex_sha256(kept)))
                    runs.append([dict(zip(("start", "length", "period"), r)) for r in found] if with_runs else None)
                    texts.append(kept.decode("utf-8", "replace") if with_text else None)
                columns = [batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(runs, run_kind)] * with_runs + [pa.array(texts, pa.string())] * with_text, [f.name for f in fields])

    return lean(docs).select(key, binary_text()).mapInArrow(tidy(judge), T.StructType(fields))


def collapsed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents with each run cut to its first period: words joined by one blank. Texts without runs and null texts
    stay as they are, and all other columns pass."""

    def rewrite(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for k, text in enumerate(texts):
                words = split(None if text is None else text.encode())
                if found := runs_of(numbered(words)):
                    texts[k] = b" ".join([w for w, gone in zip(words, dropped(len(words), found).tolist()) if not gone]).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)], names)

    names = docs.columns
    at = names.index("text")
    return lean(docs).mapInArrow(tidy(rewrite), docs.schema)


def planted(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The key and ``text`` with repeats planted in about a tenth of the rows, by a rule on the key's CRC ``h``.

    Where ``h % 10 = 0`` and the text has ``n > 0`` words, each word from ``a = h/10 % n`` on is the one at
    ``a + (i - a) % p`` with ``p = 1 + (n - a) / (3 + h/10 % 8)``, quotients rounded down. Null keys plant nothing.
    """
    h = F.crc32(F.col(f"`{key}`").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select(key, "text", g.alias("_g"), F.when(h % 10 == 0, words).alias("_w"))
    rows = rows.withColumn("_a", F.col("_g") % F.nullif(F.size("_w"), F.lit(0)))
    rows = rows.withColumn("_p", 1 + F.floor((F.size("_w") - F.col("_a")) / (3 + F.col("_g") % 8)))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    repeated = F.array_join(F.transform(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: F.get("_w", place(i).cast("int"))), " ")
    return rows.select(key, F.when(F.size("_w") > 0, repeated).otherwise(F.col("text")).alias("text"))
