"""Benchmark decontamination with suffix arrays over shards of training text.

Each task turns its documents into shards of words and builds a suffix array of each: the suffixes that can start a match
(the next words are all in the benchmark, pair by pair) in the order of all words that follow, as far as an item is long,
with the length of the common prefix of each and the one before. Every test suffix is binary-searched in that array; the
common prefixes around the place found give every exact occurrence with its place and its length. Documents that hold
one are removed. Documents never shuffle: the benchmark is cut in blocks of bounded size, of which as many as
``pass_bytes`` allows are broadcast and searched in one pass; with more, one pass follows the other, and only row numbers
and places of hits are grouped.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Null and empty
texts have no words and no hits, null or empty items no windows; an item of null item_id is an item of its own. Repeated
documents are judged one by one and repeated items count by their item_id. An empty table of documents gives an empty
table, an empty benchmark no hits. Very long texts are shards of their own; extra columns of any name stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import FOLD, alnum_words, binary_text, lean, tidy, written

HITS = "n_words long, hits array<struct<first:int,after:int>>, matches array<struct<item_id:string,item_word:int,doc_word:int,n_words:int>>"
BREAK = b"|"  # never a word
_B = np.arange(16)


def common_words(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each k, how many words from a[i[k]] and from b[j[k]] on agree. Both end in different numbers, len(_B) times."""
    n, open_ = np.zeros(len(i), dtype=np.int64), np.arange(len(i))
    while len(open_):
        at_a, at_b = i[open_] + n[open_], j[open_] + n[open_]
        differ = a[at_a[:, None] + _B] != b[at_b[:, None] + _B]
        some = differ.any(axis=1)
        n[open_] += np.where(some, differ.argmax(axis=1), len(_B))
        open_ = open_[~some]
    return n


class TestSuffixes:
    """A block of items as one row of word ids, -1 after each item; every place in it starts a test suffix."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window, self.names = window, [name for name, _ in items]
        self.ids: dict[bytes, int] = {}
        rows = [[self.ids.setdefault(w, len(self.ids) + 1) for w in words] for _, words in items]
        lengths = np.array([len(r) for r in rows], dtype=np.int64)
        self.longest = int(lengths.max(initial=0))
        self.first = np.cumsum(lengths + 1) - lengths - 1
        self.row = np.full(int((lengths + 1).sum()) + 2 * len(_B) + window, -1, dtype=np.int64)
        for a, r in zip(self.first.tolist(), rows):
            self.row[a : a + len(r)] = r
        inner = (self.row[:-1] > 0) & (self.row[1:] > 0)
        self.pairs = np.unique(self.row[:-1][inner] << 32 | self.row[1:][inner])
        # suffixes that start a window: so many words are left, or they are a whole shorter item
        starts = [a + np.arange(max(1, n - window + 1)) for a, n in zip(self.first.tolist(), lengths.tolist()) if n]
        self.suffixes = np.concatenate(starts) if starts else np.array([], dtype=np.int64)
        self.item = np.searchsorted(self.first, self.suffixes, "right") - 1
        self.least = np.minimum(lengths[self.item], window)
        self.shortest = int(self.least.min(initial=window))
        head = self.row[self.suffixes[:, None] + np.arange(window)]
        inside = np.arange(window) < self.least[:, None]
        self.low, self.high = (np.where(inside, head, fill).astype(">u4").view(f"S{4 * window}").ravel() for fill in (0, 0xFFFFFFFF))


class SuffixArray:
    """Places of a row of word ids in the order of the words that follow, up to ``depth`` of them."""

    def __init__(self, row: np.ndarray, places: np.ndarray, depth: int, step: int):
        self.row = np.concatenate([row, np.full(depth + step + 2 * len(_B), -2, dtype=np.int64)])
        words = np.maximum(self.row, 0).astype(">u4")
        key = lambda at: np.ascontiguousarray(words[at[:, None] + np.arange(step)]).view(f"S{4 * step}").ravel()
        _, which, counts = np.unique(key(places), return_inverse=True, return_counts=True)
        rank, many = (np.cumsum(counts) - counts)[which], counts[which] > 1
        for at in range(step, depth, step):  # only what still ties is looked at further
            tied = np.flatnonzero(many)
            if not len(tied):
                break
            _, further = np.unique(key(places[tied] + at), return_inverse=True)
            order = np.lexsort((further, rank[tied]))
            tied, further, old = tied[order], further[order], rank[tied[order]]
            group = np.concatenate([[True], old[1:] != old[:-1]])
            new = group | np.concatenate([[True], further[1:] != further[:-1]])
            index = np.arange(len(tied))
            begin = np.maximum.accumulate(np.where(new, index, 0))
            rank[tied] = old + begin - np.maximum.accumulate(np.where(group, index, 0))
            many[tied] = np.diff(np.append(np.flatnonzero(new), len(tied)))[np.cumsum(new) - 1] > 1
        self.places = places[np.argsort(rank, kind="stable")]
        self.heads = key(self.places)
        self.shared = np.concatenate([[0], self.shared_with(self.places[1:], self.places[:-1], depth)])  # with the one before

    def shared_with(self, i: np.ndarray, j: np.ndarray, depth: int) -> np.ndarray:
        """Common words of suffixes of the row, as far as they have been ordered."""
        n, open_ = np.zeros(len(i), dtype=np.int64), np.arange(len(i))
        while len(open_):
            at_a, at_b = i[open_] + n[open_], j[open_] + n[open_]
            differ = self.row[at_a[:, None] + _B] != self.row[at_b[:, None] + _B]
            some = differ.any(axis=1)
            n[open_] += np.where(some, differ.argmax(axis=1), len(_B))
            open_ = open_[~some & (n[open_] < depth)]
        return np.minimum(n, depth)

    def search(self, tests: np.ndarray, suffixes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each test suffix stands between ``low`` and ``high``; its common words with the places before and after."""
        low, end = low.copy(), high.copy()
        open_ = np.flatnonzero(low < end)
        while len(open_):
            middle = (low[open_] + end[open_]) // 2
            n = common_words(tests, suffixes[open_], self.row, self.places[middle])
            above = tests[suffixes[open_] + n] > self.row[self.places[middle] + n]
            low[open_] = np.where(above, middle + 1, low[open_])
            end[open_] = np.where(above, end[open_], middle)
            open_ = open_[low[open_] < end[open_]]
        last = len(self.places) - 1
        before = common_words(tests, suffixes, self.row, self.places[np.maximum(low - 1, 0)])
        after = common_words(tests, suffixes, self.row, self.places[np.minimum(low, last)])
        return low, before, after


def starting_places(row: np.ndarray, tests: TestSuffixes) -> np.ndarray:
    """Places whose next words, as many as the shortest window has, follow each other in the benchmark, pair by pair."""
    if tests.shortest < 2:
        return np.flatnonzero(row > 0)
    if not len(tests.pairs):
        return np.array([], dtype=np.int64)
    codes = row[:-1] << 32 | row[1:]
    near = np.minimum(np.searchsorted(tests.pairs, codes), len(tests.pairs) - 1)
    good = np.concatenate([[0], np.cumsum((tests.pairs[near] == codes) & (row[:-1] > 0))])
    reach = tests.shortest - 1
    return np.flatnonzero(good[reach:] - good[:-reach] == reach) if len(good) > reach else np.array([], dtype=np.int64)


def shard_matches(row: np.ndarray, tests: TestSuffixes) -> Iterator[tuple[int, int, int, int]]:
    """Item, its word, the place in the row and the words of every longest match of a window or more."""
    starting = starting_places(row, tests) if len(row) and len(tests.suffixes) else []
    if not len(starting):
        return
    array = SuffixArray(row, starting, tests.longest + 1, tests.window)
    left, right = np.searchsorted(array.heads, tests.low, "left"), np.searchsorted(array.heads, tests.high, "right")
    found = np.flatnonzero(right > left)
    if not len(found):
        return
    at, before, after = array.search(tests.row, tests.suffixes[found], left[found], right[found])
    for k, here, b, a in zip(found.tolist(), at.tolist(), before.tolist(), after.tolist()):
        least, suffix, item = int(tests.least[k]), int(tests.suffixes[k]), int(tests.item[k])
        word = suffix - int(tests.first[item])
        ahead = tests.row[suffix - 1] if word else 0
        for places, n, step in ((range(here, right[k]), a, 1), (range(here - 1, left[k] - 1, -1), b, -1)):
            for i in places:  # outwards from where the suffix stands, common words only grow fewer
                if n < least:
                    break
                place = int(array.places[i])
                if not (word and place and row[place - 1] == ahead):  # else part of a longer match
                    yield item, word, place, n
                n = min(n, int(array.shared[i + 1 if step > 0 else i])) if 0 <= i + step < len(array.places) else 0


def search_shard(texts: list[bytes | None], blocks: list[TestSuffixes]) -> tuple[np.ndarray, dict[int, tuple[list, list]]]:
    """Word counts of the texts and, for those with matches, the hit ranges and the longest matches."""
    words = (b" " + BREAK + b" ").join([t.translate(FOLD) if t else b"" for t in texts]).split()
    ends = np.append(np.flatnonzero(np.array([w == BREAK for w in words], dtype=bool)) if len(texts) > 1 else [], len(words)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    found: dict[int, tuple[list, list]] = {}
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for tests in blocks:
        known = tests.ids.get
        row = np.fromiter((known(w, 0) for w in words), dtype=np.int64, count=len(words))
        for item, word, place, n in shard_matches(row, tests):
            covered[place] += 1
            covered[place + n] -= 1
            d = int(np.searchsorted(starts, place, "right")) - 1
            found.setdefault(d, ([], []))[1].append((tests.names[item], word, place - int(starts[d]), n))
    inside = np.concatenate([[False], np.cumsum(covered[:-1]) > 0, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    for b, a in zip(turns[::2].tolist(), turns[1::2].tolist()):
        d = int(np.searchsorted(starts, b, "right")) - 1
        found[d][0].append((b - int(starts[d]), a - int(starts[d])))
    for _, matches in found.values():
        matches.sort(key=lambda m: (m[2], m[3], m[0] or "", m[1]))
    return ends - starts, found


def _shards(batches, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, held = 0, 0
        for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist()):
            held += n
            if held >= size:
                yield batch.slice(first, k + 1 - first)
                first, held = k + 1, 0
        if first < batch.num_rows:
            yield batch.slice(first)


def passes_of(bench: DataFrame, item: str, window: int, block_bytes: int, pass_bytes: int) -> Iterator[list[TestSuffixes]]:
    """The benchmark in passes of blocks. It comes to the driver one pass at a time, never whole."""
    blocks, held, size, total = [], [], 0, 0
    rows = bench.select(F.col(item).cast("string").alias("i"), binary_text().alias("t")).where("t is not null").orderBy("i", "t")
    for r in rows.toLocalIterator():
        n = len(r["t"])
        if held and size + n > block_bytes:
            blocks.append(TestSuffixes(held, window))
            held, size = [], 0
            if total + n > pass_bytes:
                yield blocks
                blocks, total = [], 0
        held.append((r["i"], alnum_words(bytes(r["t"]))))
        size, total = size + n, total + n
    yield [*blocks, TestSuffixes(held, window)]


def _searched(rows: DataFrame, blocks: list[TestSuffixes], shard_bytes: int) -> DataFrame:
    """The rows, whose last column is the text, without it and with the columns of HITS."""
    sent = rows.sparkSession.sparkContext.broadcast(blocks)
    schema = T.StructType(rows.schema.fields[:-1] + T._parse_datatype_string(HITS).fields)
    names = tuple(f.name for f in schema["matches"].dataType.elementType)
    kinds = [to_arrow_type(schema[c].dataType) for c in ("n_words", "hits", "matches")]

    def search(batches):
        for shard in _shards(batches, shard_bytes):
            counts, found = search_shard(shard.column(shard.num_columns - 1).to_pylist(), sent.value)
            hits = [[{"first": b, "after": a} for b, a in found.get(k, ((), ()))[0]] for k in range(shard.num_rows)]
            matches = [[dict(zip(names, m)) for m in found.get(k, ((), ()))[1]] for k in range(shard.num_rows)]
            yield pa.RecordBatch.from_arrays([*shard.columns[:-1], *map(pa.array, (counts, hits, matches), kinds)], schema.names)

    return rows.mapInArrow(tidy(search), schema)


def _united(done, x):
    last = F.try_element_at(done, F.lit(-1))
    grown = F.struct(last["first"].alias("first"), F.greatest(last["after"], x["after"]).alias("after"))
    touching = last.isNotNull() & (last["after"] >= x["first"])
    return F.when(touching, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(x)))


def find_matches(docs: DataFrame, bench: DataFrame, key: str = "doc_id", item: str = "item_id", window: int = 10, block_bytes: int = 4 << 20, pass_bytes: int = 32 << 20, shard_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: the key, ``n_words``, ``hits`` (word ranges, disjoint) and ``matches`` (longest ones)."""
    rows, passes = lean(docs).select(F.col(key), binary_text().alias("_t")), passes_of(bench, item, window, block_bytes, pass_bytes)
    first, second = next(passes), next(passes, None)
    if second is None:
        return _searched(rows, first, shard_bytes)
    rows = written(rows.select(key, F.monotonically_increasing_id().alias("_row"), "_t"))
    out = written(_searched(rows, first, shard_bytes))
    some = out.where("size(hits) > 0").select("_row", "hits", "matches")
    while second is not None:
        more = _searched(rows.select("_row", "_t"), second, shard_bytes)
        some = some.unionByName(written(more.where("size(hits) > 0").select("_row", "hits", "matches")))
        second = next(passes, None)
    hits = F.aggregate(F.array_sort(F.flatten(F.collect_list("hits"))), F.array().cast("array<struct<first:int,after:int>>"), _united)
    found = some.groupBy("_row").agg(hits.alias("hits"), F.flatten(F.collect_list("matches")).alias("matches"))
    return out.select(key, "_row", "n_words", *[out[c].alias(f"_{c}") for c in ("hits", "matches")]).join(found, "_row", "left").select(
        key, "n_words", F.coalesce("hits", "_hits").alias("hits"), F.coalesce("matches", "_matches").alias("matches")
    )


def contamination(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The digest of find_matches: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and ``longest``."""
    found = find_matches(docs, bench, **options)
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + h["after"] - h["first"])
    return found.select(
        options.get("key", "doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0)).cast("long").alias("longest"),
    )


def decontaminated(docs: DataFrame, bench: DataFrame, item: str = "item_id", window: int = 10, block_bytes: int = 4 << 20, pass_bytes: int = 32 << 20, shard_bytes: int = 4 << 20) -> DataFrame:
    """The documents without a hit, all columns kept; each pass reads what the one before kept, and nothing shuffles."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    for k, blocks in enumerate(passes_of(bench, item, window, block_bytes, pass_bytes)):
        docs = written(docs) if k else docs
        found = _searched(lean(docs).select(F.struct(*names).alias("_doc"), binary_text().alias("_t")), blocks, shard_bytes)
        docs = found.where(F.size("hits") == 0).select("_doc.*")
    return docs
