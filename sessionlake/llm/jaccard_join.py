"""N-gram Jaccard self join by set relations: exact links between documents whose shingle sets are nearly equal.

1. Equal sets become one (their smallest doc_id stands for them), so copies are never expanded.
2. Every set is ordered by one global order, frequent shingles last, and its prefix goes into the index: a list of
   (position, size, set) for each shingle. Two linked sets share a shingle of both prefixes.
3. Index lists are skipped by position: the set at the smallest position leads its list, and only pairs of leader and
   member are compared first; then, in lists that still hold several components, the set at the largest position leads.
   Sets that link to the same leader are in one component, and their pairs with each other are skipped.
4. Lists that still hold several components are cut in blocks by size and position. Block pairs that are too unlike in
   size, or whose positions leave less room than the overlap needed, are skipped whole; what remains are pairs of sets
   of different components that have not been compared.
5. Their answers are derived from those of the highly similar set that both rounds computed: of a set S with leader L and
   any set Z, the overlap lies between that of L and Z less what S lacks of L, and that plus what S has beyond L
   (``derived``). Where these bounds decide, nothing more is read; the rest is verified.
6. Before texts are sent for a pair, the counts of both sets by part of the hash range must leave room for the overlap
   needed, which is exact too. No list is cut short, so no link between components is lost.
7. Components are found by passing the smallest label along links and jumping from label to label.

All lists are shuffled joins and partial aggregations; texts are sent to candidate pairs only, a leader's once for every
few hundred of its members, so a leader of a third of all documents is many tasks. The order's table of frequent shingles
has a fixed bound; the order does not change results, only how long lists get.

A set holds the distinct ``shingle``-word shingles of the whole text (words: runs without white space, A-Z lower-cased);
of fewer words, the whole sequence is one. Null texts and texts without words have no shingles and link with nothing,
not even each other. Every row is a node of its own, whatever its key: rows of one key are judged by their own texts and
each has its row in the result; a component bears the smallest key of its rows (null where all are null). Keys may be of
any type that can be ordered. Shingles are compared by 64-bit hashes. An empty table gives an empty table; extra columns
of any name do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, WordHashes, binary_text, bloom, in_bloom, lean, let_go, scratch, tidy, written

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bound of the order's table of frequent shingles, and the count in one stretch of words that makes one frequent there.
FREQUENT, OFTEN, STRETCH = 1 << 19, 3, 2_000_000
#: Parts of the hash range whose counts bound the overlap of two sets from above.
PART_BITS = 8
PARTS = 1 << PART_BITS
#: Ids are broadcast up to so many (8 bytes each), else joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingle_set(text: bytes | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.array([], dtype=np.uint64)
    row = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(k, len(words))
    out = np.full(len(row) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        out = (out ^ (out >> np.uint64(31))) * _M1 + row[j : len(row) - k + 1 + j]
    out = (out ^ (out >> np.uint64(29))) * _M2
    out ^= out >> np.uint64(32)
    return np.unique(out)


def frequent_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in some stretch of the corpus, sorted, with their counts: at most FREQUENT of them."""

    def count(batches):
        hashes, held, n = WordHashes(), [], 0

        def told():
            every = np.concatenate(held) if held else np.array([], dtype=np.uint64)
            held.clear()
            every.sort()
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.array([], dtype=np.int64)
            counts = np.diff(np.append(first, len(every)))
            often = counts >= OFTEN
            return pa.RecordBatch.from_arrays([pa.array(every[first][often].view(np.int64)), pa.array(counts[often])], ["token", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(shingle_set(text, k, hashes))
                n += len(held[-1])
                if n > STRETCH:
                    yield told()
                    n = 0
        yield told()

    counted = lean(docs).select(binary_text()).mapInArrow(tidy(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    tokens = top.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], top.column("n").to_numpy()[order]


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1 if n else 0


def sets_of(docs: DataFrame, key: str, k: int, percent: int) -> DataFrame:
    """``id, n, sig, prefix, parts``: the size of each document's set, its digest, its prefix in the global order, and
    how many of its hashes fall into each of PARTS parts (a byte each; null where one has more than 255)."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, k))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("parts", T.BinaryType())])

    def run(batches):
        hashes, (tokens, counts) = WordHashes(), sent.value
        for batch in batches:
            sizes, digests, prefixes, parts = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, k, hashes)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                fall = np.bincount((s >> np.uint64(64 - PART_BITS)).astype(np.int64), minlength=PARTS)
                parts.append(fall.astype(np.uint8).tobytes() if len(s) and fall.max() <= 255 else None)
                if len(s) and len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    s = s[np.argsort(np.where(tokens[at] == s, counts[at], 0), kind="stable")]
                prefixes.append(s[: prefix_length(len(s), percent)].view(np.int64))
            offsets = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes) if prefixes else np.array([], dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists, pa.array(parts, pa.binary())], schema.names)

    return lean(docs).select(key, binary_text()).mapInArrow(tidy(run), schema)


def shared_entries(own: DataFrame) -> DataFrame:
    """The index entries ``token, id, n, pos`` of shingles that several prefixes hold, and a few others.

    Tokens are counted alone first; a Bloom filter of fixed size then keeps most entries that nothing shares off the
    shuffles that follow.
    """
    twice = own.select(F.explode("prefix").alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    sent = own.sparkSession.sparkContext.broadcast(bloom(twice))

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            lengths = np.diff(lists.offsets.to_numpy())
            tokens = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
            pos = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            passed = in_bloom(sent.value, tokens.view(np.uint64))
            ids, n = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), lengths)[passed] for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(tokens[passed]), pa.array(ids), pa.array(n), pa.array(pos[passed].astype(np.int32))], ["token", "id", "n", "pos"])

    return own.select("id", "n", "prefix").mapInArrow(run, "token long, id long, n long, pos int")


def _salted(pairs: DataFrame, together: int) -> tuple[DataFrame, DataFrame]:
    """The pairs ``a, b`` with a number ``s`` for every ``together`` pairs of one ``a``, and each ``a, s`` once."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / together).alias("_of"))
    salted = written(pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("_of")).cast("int").alias("s")))
    return salted, salted.select("a", "s").distinct()


def _led(salted: DataFrame, heads: DataFrame, held: DataFrame, columns: list[str]) -> DataFrame:
    """Rows ``a, s, role, b`` and columns of ``held`` (by ``id``): each leader (role 0) before its members."""
    members = salted.join(held, salted["b"] == held["id"]).select("a", "s", F.lit(1).alias("role"), "b", *columns)
    leaders = heads.join(held, heads["a"] == held["id"]).select("a", "s", F.lit(0).alias("role"), F.col("a").alias("b"), *columns)
    return leaders.unionByName(members).repartition("a", "s").sortWithinPartitions("a", "s", "role")


def _few(ids: DataFrame) -> DataFrame:
    """A written table of ids (8 bytes each), marked for broadcast up to BROADCAST_IDS of them."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _ids(salted: DataFrame) -> DataFrame:
    return _few(written(salted.select(F.col("a").alias("id")).union(salted.select("b")).distinct()))


def bounded(pairs: DataFrame, own: DataFrame, percent: int, together: int = 4096) -> DataFrame:
    """The pairs ``a, b`` with ``n_a, n_b, most``: an upper bound of the overlap, the sum of the smaller counts by part."""
    salted, heads = _salted(pairs, together)

    def run(batches):
        lead = of = size = None
        for batch in batches:
            out: list[tuple] = []
            for a, role, b, n, parts in zip(*(batch.column(c).to_pylist() for c in ("a", "role", "b", "n", "parts"))):
                counts = None if parts is None else np.frombuffer(parts, np.uint8)
                if role == 0:
                    lead, of, size = counts, a, n
                elif of == a:
                    out.append((a, b, size, n, min(size, n) if lead is None or counts is None else int(np.minimum(lead, counts).sum(dtype=np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(5)], ["a", "b", "n_a", "n_b", "most"])

    counts = own.select("id", "n", "parts").join(_ids(salted), "id", "left_semi")
    return _led(salted, heads, counts, ["n", "parts"]).mapInArrow(run, "a long, b long, n_a long, n_b long, most long")


def _enough(overlap, percent: int):
    return overlap * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent


def verify(docs: DataFrame, key: str, pairs: DataFrame, k: int, together: int = 256) -> DataFrame:
    """The pairs ``a, b`` with their exact ``overlap, n_a, n_b``.

    The text of ``a`` goes once to every ``together`` of its pairs, so a leader of many members is no single task.
    """
    salted, heads = _salted(pairs, together)
    texts = docs.select(F.col(key).alias("id"), binary_text().alias("t")).join(_ids(salted), "id", "left_semi")

    def run(batches):
        hashes, lead, of = WordHashes(), np.array([], dtype=np.uint64), None
        for batch in batches:
            out: list[tuple] = []
            for a, role, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "role", "b", "t"))):
                s = shingle_set(text, k, hashes)
                if role == 0:
                    lead, of = s, a
                elif of == a:
                    at = np.minimum(np.searchsorted(lead, s), max(len(lead) - 1, 0))
                    both = int((lead[at] == s).sum()) if len(lead) else 0
                    out.append((a, b, both, len(lead), len(s)))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(5)], ["a", "b", "overlap", "n_a", "n_b"])

    return _led(salted, heads, texts, ["t"]).mapInArrow(tidy(run), "a long, b long, overlap long, n_a long, n_b long")


ANSWER = ["a", "b", "n_a", "n_b", "low", "high"]


def answers_of(docs: DataFrame, key: str, pairs: DataFrame, own: DataFrame, k: int, percent: int) -> DataFrame:
    """``a, b, n_a, n_b, low, high``: the overlap of every pair lies between the last two; exact where it could link."""
    told = written(bounded(pairs, own, percent))
    open_ = told.where(_enough(F.col("most"), percent))
    exact = verify(docs, key, open_.select("a", "b"), k).select("a", "b", "n_a", "n_b", F.col("overlap").alias("low"), F.col("overlap").alias("high"))
    return written(told.where(~_enough(F.col("most"), percent)).select("a", "b", "n_a", "n_b", F.lit(0).cast("long").alias("low"), F.col("most").alias("high")).unionByName(exact))


def derived(pairs: DataFrame, answers: DataFrame, percent: int) -> DataFrame:
    """Answers for pairs of sets from those of their leaders (``answers``, and the pairs ``a, b`` with ``n_a, n_b``).

    A set's leader is the one that it overlaps most of those that it links with. A pair without an answer of either
    leader is bounded by 0 and the smaller size.
    """
    leads = answers.where(_enough(F.col("low"), percent)).groupBy(F.col("b").alias("x")).agg(F.max(F.struct("low", "a", "n_a", "n_b")).alias("lead"))
    known = answers.select(F.col("a").alias("lead_id"), F.col("b").alias("z"), F.col("low").alias("known_low"), F.col("high").alias("known_high"))
    known = known.unionByName(known.select(F.col("z").alias("lead_id"), F.col("lead_id").alias("z"), "known_low", "known_high"))
    out = pairs.select("a", "b", "n_a", "n_b", F.lit(0).cast("long").alias("low"), F.least("n_a", "n_b").alias("high"))
    for x, z in (("a", "b"), ("b", "a")):
        out = out.join(leads.withColumnRenamed("x", x), x, "left")
        out = out.join(known, (F.col("lead.a") == F.col("lead_id")) & (F.col(z) == F.col("z")), "left")
        lacks, beyond = F.col("lead.n_a") - F.col("lead.low"), F.col("lead.n_b") - F.col("lead.low")
        low = F.greatest("low", F.col("known_low") - lacks)
        high = F.least("high", F.col("known_high") + beyond)
        out = out.select("a", "b", "n_a", "n_b", low.alias("low"), high.alias("high"))  # greatest and least pass over nulls
    return out


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every linked id: the smallest id that links reach."""
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")  # not a union, whose plan holds all of the links' twice
    edges = written(links.select(ways).select("e.a", "e.b").distinct())
    labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("m"))
        seen = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("was"), F.least("component", "m").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("component").alias("far"))
        moved = written(seen.join(jump, "c", "left").select("id", "was", F.least("c", F.coalesce("far", "c")).alias("component")))
        labels = moved.select("id", "component")
        if moved.where("component <> was").isEmpty():
            return labels


def _fits(n1, n2, room, percent: int):
    """Sizes near enough, and room for the overlap that they need."""
    like = F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent
    return like & (room * (100 + percent) >= (n1 + n2) * percent)


def led_pairs(rows: DataFrame, pick, percent: int) -> DataFrame:
    """Pairs of each list's leader (``pick`` of its entries) and its members of other components."""
    lead = rows.groupBy("token").agg(pick(F.struct("pos", "n", "id", "comp")).alias("lead"))
    room = F.least(F.col("n") - F.col("pos"), F.col("lead.n") - F.col("lead.pos"))
    fit = (F.col("comp") != F.col("lead.comp")) & _fits(F.col("n"), F.col("lead.n"), room, percent)
    return rows.join(lead, "token").where(fit).select(F.col("lead.id").alias("a"), F.col("id").alias("b")).distinct()


def block_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b, n_a, n_b`` of different components in the same list (``token, id, n, pos, comp``), by blocks that
    are not skipped."""
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / min(percent, 99)))
    rows = written(rows.withColumns({"band": band, "block": F.floor(F.log2(F.col("pos") + 1.0))}))
    blocks = rows.groupBy("token", "band", "block").agg(F.min("pos").alias("pos"), F.min("n").alias("low"), F.max("n").alias("high"))
    one, two = (blocks.select("token", *(F.col(c).alias(c + x) for c in ("band", "block", "pos", "low", "high"))) for x in "12")
    open_ = one.join(two, "token").where("band2 between band1 - 1 and band1 + 1")
    open_ = open_.where(F.least(F.col("high1") - F.col("pos1"), F.col("high2") - F.col("pos2")) * (100 + percent) >= (F.col("low1") + F.col("low2")) * percent)
    left, right = (rows.select("token", *(F.col(c).alias(c + x) for c in ("band", "block", "id", "n", "pos", "comp"))) for x in "12")
    pairs = left.join(open_.select("token", "band1", "block1", "band2", "block2"), ["token", "band1", "block1"]).join(right, ["token", "band2", "block2"])
    room = F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2"))
    pairs = pairs.where((F.col("id1") < F.col("id2")) & (F.col("comp1") != F.col("comp2")) & _fits(F.col("n1"), F.col("n2"), room, percent))
    return pairs.select(F.col("id1").alias("a"), F.col("id2").alias("b"), F.col("n1").alias("n_a"), F.col("n2").alias("n_b")).distinct()


def near_links(docs: DataFrame, key: str, shingle: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Members (``id, n, rep``: the smallest id of an equal set) and links ``a, b`` between representatives.

    ``key`` is a unique long. The links connect exactly the components of the full join; pairs inside a component already
    joined are skipped.
    """
    sets = written(sets_of(docs, key, shingle, percent))
    alike = sets.where("n > 0").groupBy("sig").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c"))
    equal = written(alike.where("c > 1").select("sig", "rep"))  # sets of one document alone need no join
    members = sets.select("id", "n", "sig").join(equal, "sig", "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    others = written(members.where("id <> rep").select("id"))
    own = sets.where("n > 0").join(_few(others), "id", "left_anti")
    entries = shared_entries(own)
    shared = entries.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    held = written(entries.join(shared, "token", "left_semi"))
    rows, answers = held.withColumn("comp", F.col("id")), None
    for pick in (F.min, F.max):
        let_go(docs.sparkSession)
        star = led_pairs(rows, pick, percent)
        if answers is not None:
            star = star.join(answers.select("a", "b").union(answers.select("b", "a")), ["a", "b"], "left_anti")
        found = answers_of(docs, key, star, own, shingle, percent)
        answers = found if answers is None else answers.unionByName(found)
        links = answers.where(_enough(F.col("low"), percent)).select("a", "b")
        label = components(links)
        rows = held.join(label, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
        mixed = rows.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
        rows = written(rows.join(mixed, "token", "left_semi"))
    let_go(docs.sparkSession)
    done = answers.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = written(derived(block_pairs(rows, percent).join(done, ["a", "b"], "left_anti"), answers, percent))
    links = links.union(rest.where(_enough(F.col("low"), percent)).select("a", "b"))
    rest = rest.where(_enough(F.col("high"), percent) & ~_enough(F.col("low"), percent)).select("a", "b")
    last = answers_of(docs, key, rest, own, shingle, percent)
    return members, links.union(last.where(_enough(F.col("low"), percent)).select("a", "b"))


ROW = "_row"


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """A written copy of the documents with a number for each row, and the number's name, which no column has."""
    row = ROW
    while row.lower() in {c.lower() for c in docs.columns}:
        row += "_"
    return written(docs.withColumn(row, F.monotonically_increasing_id())), row


def _components_of(numbered: DataFrame, row: str, key: str, shingle: int, percent: int) -> DataFrame:
    """``_at, _key, n, comp`` of every row: its number, its key, the size of its set, a number for its component."""
    members, links = near_links(numbered, row, shingle, percent)
    let_go(numbered.sparkSession)
    label = components(links).select(F.col("id").alias("rep"), "component")
    found = members.join(label, "rep", "left").select("id", "n", F.coalesce("component", "rep").alias("comp"))
    keys = numbered.select(F.col(f"`{row}`").alias("_at"), F.col(key).alias("_key"))
    return found.join(keys, F.col("id") == F.col("_at")).select("_at", "_key", "n", "comp")


def near_components(docs: DataFrame, key: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: the key, ``n_shingles, component_id`` (the smallest key that links or equal sets reach)."""
    with scratch(docs.sparkSession):
        numbered, row = _numbered(docs.select(key, "text"))
        found = written(_components_of(numbered, row, key, shingle, percent), keep=True)
    several = found.groupBy("comp").agg(F.min("_key").alias("_least"), F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    out = found.join(several, "comp", "left")
    return out.select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("_least", "_key").alias("component_id"))


def deduplicated(docs: DataFrame, key: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each component kept, the one of the smallest key; all columns stay.

    Of repeated rows one stays; rows of null keys come after all others in the order of keys.
    """
    numbered, row = _numbered(docs)
    with scratch(docs.sparkSession):
        found = written(_components_of(numbered, row, key, shingle, percent))
        order = F.struct(F.col("_key").isNull().alias("_none"), "_key", "_at")
        first = found.groupBy("comp").agg(F.min(order)["_at"].alias("_at"))
        gone = written(found.select("_at").join(first, "_at", "left_anti").withColumnRenamed("_at", row), keep=True)
    return numbered.join(_few(gone), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
