"""Substring dedup with suffix automata of reference shards.

A window of ``window`` words is removed where its words also start in a document with a smaller doc_id. A shard holds the
stretches of text around one anchor: every window picks as its anchor the smallest hash among its runs of ``GRAM`` words,
so equal windows of any two documents meet in the same shard. Within a shard the documents are read in ascending doc_id:
each stretch is streamed through the suffix automaton of the stretches before it, whose matching statistics give the
maximal spans above the threshold; then it joins the reference itself. Equal stretches are recognised whole and do not
grow the automaton, so copies cost one lookup each.

Which anchors occur in more than one document is counted first with partial aggregates, and a Bloom filter of fixed size
tells the second pass which stretches to send; what it lets through in error finds no match. An automaton holds one
shard only, so none is broadcast whole: the reference grows with the corpus and has no bound, a shard has. Anchors met
more than ``HOT`` times would make one long task; their windows are told apart one by one instead: each is its own
shard, found with partial aggregates over its hash, for which the longest match is the window itself.

``against`` judges documents by a given reference instead: its texts are cut into shards of bounded size, tasks build one
automaton of each, and these are broadcast a few at a time while every document is streamed through them. It reads all
documents once for each pass, so it is for references that do not grow with the documents.

Words are runs without white space, unchanged. Null and empty texts have none. A row without doc_id keeps its words and
takes none from others. Rows of equal doc_id are one document:
none removes the other's words. Windows are judged on the input. An empty table gives an empty table.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, binary_text, bloom, hex_sha256, in_bloom, lean, tidy, written

GRAM, HOT, SALTS = 10, 4096, 16
#: Words of one reference shard, and shards broadcast in one pass.
SHARD_WORDS, PASS_SHARDS = 50_000, 4
_P = np.uint64(0x9E3779B97F4A7C15)


def window_anchors(words: list[bytes], window: int, hashes: WordHashes) -> np.ndarray:
    """The anchor of each window of the text."""
    n = len(words)
    if n < window:
        return np.array([], dtype=np.uint64)
    row = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    gram = min(GRAM, window)
    h = np.zeros(n - gram + 1, dtype=np.uint64)
    for j in range(gram):
        h = (h ^ (h >> np.uint64(29))) * _P + row[j : n - gram + 1 + j]
    h = (h ^ (h >> np.uint64(32))) * _P
    h ^= h >> np.uint64(29)
    width, done = window - gram + 1, 1
    while done < width:  # running minimum over `width` grams, by doubling
        step = min(done, width - done)
        h = np.minimum(h[:-step], h[step:])
        done += step
    return h


def runs_of(anchors: np.ndarray) -> list[tuple[int, int, int]]:
    """Anchor, first window and window after the last of each run of windows with the same anchor."""
    if not len(anchors):
        return []
    cuts = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1], [True]]))
    return list(zip(anchors[cuts[:-1]].view(np.int64).tolist(), cuts[:-1].tolist(), cuts[1:].tolist()))


class SuffixAutomaton:
    """Of several word sequences; every state remembers nothing but its longest length, link and transitions."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]

    def add(self, words: list[bytes]) -> None:
        nexts, link, size, last = self.next, self.link, self.size, 0
        for w in words:
            held = nexts[last].get(w)
            if held is not None and size[held] == size[last] + 1:
                last = held
                continue
            if held is None:
                new = len(size)
                nexts.append({})
                size.append(size[last] + 1)
                link.append(0)
                p = last
                while p >= 0 and w not in nexts[p]:
                    nexts[p][w] = new
                    p = link[p]
                if p >= 0:
                    q = nexts[p][w]
                    link[new] = q if size[q] == size[p] + 1 else self._split(p, q, w)
                last = new
            else:
                last = self._split(last, held, w)

    def _split(self, p: int, q: int, w: bytes) -> int:
        nexts, link, size = self.next, self.link, self.size
        copy = len(size)
        nexts.append(dict(nexts[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nexts[p].get(w) == q:
            nexts[p][w] = copy
            p = link[p]
        return copy

    def spans(self, words: list[bytes], least: int) -> list[tuple[int, int]]:
        """Maximal stretches of the words covered by matches of at least that many words."""
        nexts, link, size = self.next, self.link, self.size
        state = length = 0
        out: list[list[int]] = []
        for i, w in enumerate(words):
            while state and w not in nexts[state]:
                state = link[state]
                length = size[state]
            to = nexts[state].get(w)
            if to is not None:
                state, length = to, length + 1
            if length >= least:
                a = i + 1 - least
                if out and a <= out[-1][1]:
                    out[-1][1] = i + 1
                else:
                    out.append([a, i + 1])
        return [(a, b) for a, b in out]


class KeyedAutomaton(SuffixAutomaton):
    """Of texts with keys; every state also knows the smallest key under which its word sequences occur."""

    def __init__(self, texts: list[tuple[int, list[bytes]]]):
        super().__init__()
        for _, words in texts:
            self.add(words)
        nexts, link, size = self.next, self.link, self.size
        none = max((k for k, _ in texts), default=0)
        self.least = least = [none] * len(size)
        for k, words in texts:
            state = 0
            for w in words:
                state = nexts[state][w]
                least[state] = min(least[state], k)
        for state in sorted(range(1, len(size)), key=size.__getitem__, reverse=True):
            least[link[state]] = min(least[link[state]], least[state])

    def covered(self, words: list[bytes], window: int, below: int | None = None) -> Iterator[tuple[int, int]]:
        """Maximal stretches covered by windows that occur here, if asked for under a key below the given one.

        Matching statistics are kept at a window's length at most, so the state is always that of the window itself.
        """
        nexts, link, size, least = self.next, self.link, self.size, self.least
        state = length = 0
        begin = after = -1
        for i, w in enumerate(words, 1):
            while state and w not in nexts[state]:
                state = link[state]
                length = size[state]
            to = nexts[state].get(w)
            if to is not None:
                state, length = to, length + 1
            if length < window:
                continue
            length = window
            while size[link[state]] >= window:
                state = link[state]
            if below is not None and least[state] >= below:
                continue
            if begin >= 0 and i - window <= after:
                after = i
            else:
                if begin >= 0:
                    yield begin, after
                begin, after = i - window, i
        if begin >= 0:
            yield begin, after


def shared_anchors(docs: DataFrame, key: str, window: int) -> DataFrame:
    """``anchor`` and ``n`` (documents, at least) of the anchors that occur under two keys or more."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            keys, anchors = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.unique(window_anchors(text.split() if text else [], window, hashes))
                keys += [k] * len(found)
                anchors.append(found)
            flat = np.concatenate(anchors) if anchors else np.array([], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(keys, pa.int64())], ["anchor", "k"])

    found = lean(docs).where(F.col(key).isNotNull()).select(F.col(key).cast("long"), binary_text()).mapInArrow(tidy(run), "anchor long, k long")
    return found.groupBy("anchor").agg(F.min("k").alias("x"), F.max("k").alias("y"), F.count(F.lit(1)).alias("n")).where("x < y").select("anchor", "n")


STRETCH = "anchor long, k long, row long, first long, words binary"


def stretches(docs: DataFrame, key: str, window: int, filter_bits: np.ndarray) -> DataFrame:
    """The text around every anchor that passes the filter: ``anchor, k, row, first, words``."""
    sent = docs.sparkSession.sparkContext.broadcast(filter_bits)

    def run(batches):
        hashes, bits = WordHashes(), sent.value
        for batch in batches:
            out: list[tuple] = []
            for k, row, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.split() if text else []
                anchors = window_anchors(words, window, hashes)
                if not len(anchors):
                    continue
                passed = in_bloom(bits, anchors)
                if not passed.any():
                    continue
                for anchor, first, after in runs_of(anchors):
                    if passed[first]:
                        out.append((anchor, k, row, first, b" ".join(words[first : after + window - 1])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["anchor", "k", "row", "first", "words"]
            )

    return lean(docs).where(F.col(key).isNotNull()).select(F.col(key).cast("long"), _row(), binary_text()).mapInArrow(tidy(run), STRETCH)


def _row():
    """Tells rows of equal key apart by their text."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row")


def match_shard(rows: list[tuple] | object, window: int):
    """Rows ``(k, row, first, words)`` of one shard in ascending k; yields ``(k, row, begin, after)`` to remove."""
    automaton, waiting = SuffixAutomaton(), []
    known: dict[bytes, list[tuple[int, int]] | None] = {}  # stretch: what to remove of it; None once it stands in a smaller key
    for k, same in groupby(rows, key=lambda r: r[0]):
        new: dict[bytes, list[tuple[int, int]]] = {}
        for _, row, first, text in same:
            if text in known:
                spans = [(0, text.count(b" ") + 1)]
            elif text in new:
                spans = new[text]
            else:
                if waiting:
                    for words in waiting:
                        automaton.add(words)
                    waiting = []
                words = text.split()
                spans = new[text] = automaton.spans(words, window)
            for a, b in spans:
                yield k, row, first + a, first + b
        for text, spans in new.items():
            known[text] = None
            if spans != [(0, text.count(b" ") + 1)]:
                waiting.append(text.split())


SPANS = "k long, row long, begin long, after long"


def _shard_spans(rows: DataFrame, window: int) -> DataFrame:
    dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "k")

    def each(batches):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def run(batches):
        out: list[tuple] = []
        told = lambda: pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], ["k", "row", "begin", "after"])
        for _, shard in groupby(each(batches), key=lambda r: r[0]):
            for span in match_shard((r[1:] for r in shard), window):
                out.append(span)
                if len(out) >= 20_000:
                    yield told()
                    out = []
        yield told()

    return dealt.mapInArrow(tidy(run), SPANS)


def _hot_spans(rows: DataFrame, window: int) -> DataFrame:
    """The same for anchors met very often: every window is a shard of its own, by its 128-bit hash."""

    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 2000):
                out: list[tuple] = []
                for _, k, row, first, text in zip(*(c.to_pylist() for c in batch.slice(part, 2000).columns)):
                    words = text.split(b" ")
                    for i in range(len(words) - window + 1):
                        h = xxhash.xxh3_128_intdigest(b" ".join(words[i : i + window]))
                        out.append((h >> 65, h & (1 << 63) - 1, k, row, first + i))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(5)], ["h", "g", "k", "row", "at"])

    # a window of very many documents is dealt to SALTS tasks, each of which gets the smallest key of all
    windows = written(rows.mapInArrow(run, "h long, g long, k long, row long, at long").withColumn("salt", F.pmod(F.xxhash64("k", "at"), F.lit(SALTS)).cast("int")))
    least = windows.groupBy("h", "g").agg(F.min("k").alias("m"), F.max("k").alias("x")).where("m < x").select("h", "g", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return windows.join(least, ["h", "g", "salt"]).where("m < k").select("k", "row", F.col("at").alias("begin"), (F.col("at") + window).alias("after"))


def removed_spans(docs: DataFrame, key: str = "doc_id", window: int = 50) -> DataFrame:
    """``k, row, begin, after``: word ranges to remove (they may overlap); ``row`` is the hash of the document's text."""
    anchors = written(shared_anchors(docs, key, window))
    rows = stretches(docs, key, window, bloom(anchors))
    hot = anchors.where(F.col("n") > HOT).select("anchor")
    if hot.isEmpty():
        return _shard_spans(rows, window)
    rows = written(rows)
    return _shard_spans(rows.join(hot, "anchor", "left_anti"), window).unionByName(_hot_spans(rows.join(hot, "anchor", "left_semi"), window))


def shared_stretches(docs: DataFrame, key: str = "doc_id", window: int = 50) -> DataFrame:
    """The corpus' own reference: different stretches around anchors of two documents or more, with their smallest key."""
    rows = stretches(docs, key, window, bloom(written(shared_anchors(docs, key, window))))
    return rows.groupBy("words").agg(F.min("k").alias(key)).select(key, F.col("words").cast("string").alias("text"))


def reference_shards(reference: DataFrame, key: str, window: int, shard_words: int | None = None) -> DataFrame:
    """``automaton``: one of every ``shard_words`` words of a task's texts. Longer texts are cut, with a window's overlap."""
    most = shard_words or SHARD_WORDS

    def run(batches):
        held, n = [], 0
        told = lambda: pa.RecordBatch.from_arrays([pa.array([pickle.dumps(KeyedAutomaton(held), 5)], pa.binary())], ["automaton"])
        for batch in batches:
            for k, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.split() if text else []
                for at in range(0, len(words) - window + 1, most):
                    piece = words[at : at + most + window - 1]
                    if held and n + len(piece) > most:
                        yield told()
                        held, n = [], 0
                    held.append((k, piece))
                    n += len(piece)
        if held:
            yield told()

    return lean(reference).select(F.coalesce(F.col(key).cast("long"), F.lit(0)), binary_text()).mapInArrow(tidy(run), "automaton binary")


def _key_or_zero(key: str):
    return F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("k")


def spans_in(docs: DataFrame, shards: DataFrame, key: str, window: int, earlier: bool = False) -> DataFrame:
    """``k, row, begin, after`` of the documents' stretches that occur in the shards; ``earlier``: under a smaller key only.

    Every pass broadcasts PASS_SHARDS automata and writes what it finds, so neither the driver nor a worker holds more.
    """
    context = docs.sparkSession.sparkContext
    found: list[DataFrame] = []

    def one_pass(blobs: list[bytes]) -> DataFrame:
        sent = context.broadcast(blobs)

        def run(batches):
            automata = [pickle.loads(b) for b in sent.value]
            for batch in batches:
                out = [
                    (k, row, a, b)
                    for k, row, words in ((k, row, text.split() if text else []) for k, row, text in zip(*(c.to_pylist() for c in batch.columns)))
                    for automaton in automata
                    for a, b in automaton.covered(words, window, k if earlier else None)
                ]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], ["k", "row", "begin", "after"])

        rows = lean(docs).where(F.col(key).isNotNull() if earlier else F.lit(True)).select(_key_or_zero(key), _row(), binary_text())
        done = written(rows.mapInArrow(tidy(run), SPANS))
        sent.destroy()
        return done

    waiting: list[bytes] = []
    for blob in shards.toLocalIterator():
        waiting.append(bytes(blob[0]))
        if len(waiting) == PASS_SHARDS:
            found.append(one_pass(waiting))
            waiting = []
    if waiting or not found:
        found.append(one_pass(waiting))
    return reduce(DataFrame.unionByName, found)


def against(docs: DataFrame, reference: DataFrame, key: str = "doc_id", window: int = 50, earlier: bool = False, with_text: bool = True) -> DataFrame:
    """As ``deduplicate``, of windows that occur in the reference (columns ``key`` and ``text``); a reference that is empty
    or only of shorter texts removes nothing. ``earlier``: only of reference texts with a smaller key, so rows without one
    are left alone; else keys do not matter and every row is judged."""
    if earlier:
        reference = reference.where(F.col(key).isNotNull())
    spans = spans_in(docs, written(reference_shards(reference, key, window)), key, window, earlier)
    return _without(docs, spans, key, with_text, F.col(key).cast("long").alias("k") if earlier else _key_or_zero(key))


def deduplicate(docs: DataFrame, key: str = "doc_id", window: int = 50, with_text: bool = True) -> DataFrame:
    """The key, ``n_words, n_removed, kept_sha256`` and, where asked for, ``kept_text``: kept words joined by one blank."""
    return _without(docs, removed_spans(docs, key, window), key, with_text, F.col(key).cast("long").alias("k"))


def _without(docs: DataFrame, spans: DataFrame, key: str, with_text: bool, k) -> DataFrame:
    """The documents without the words of the spans."""
    spans = spans.groupBy("k", "row").agg(F.collect_set(F.struct("begin", "after")).alias("spans"))
    texts = docs.select(F.col(key), k, _row(), binary_text().alias("_t"))
    joined = texts.join(spans, ["k", "row"], "left").select(F.col(key), "_t", F.transform("spans", lambda s: s["begin"]).alias("b"), F.transform("spans", lambda s: s["after"]).alias("a"))
    fields = [docs.schema[key], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    if with_text:
        fields.append(T.StructField("kept_text", T.StringType()))

    def run(batches):
        for batch in batches:
            n, gone, sha, kept_text = [], [], [], []
            for text, begin, after in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                words = text.split() if text else []
                kept = words
                if begin:
                    turns = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(turns, begin, 1)
                    np.add.at(turns, after, -1)
                    inside = np.cumsum(turns[:-1]) > 0
                    kept = [w for w, x in zip(words, inside.tolist()) if not x]
                n.append(len(words))
                gone.append(len(words) - len(kept))
                joined = b" ".join(kept)
                sha.append(hex_sha256(joined))
                if with_text:
                    kept_text.append(joined.decode())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept_text, pa.string())] * with_text, [f.name for f in fields])

    return joined.mapInArrow(run, T.StructType(fields))
