"""Byte-level BPE against the rank file's library, resampling and periodic runs against brute force."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from sessionlake.llm import byte_bpe, periodic_runs, queries, resampling

from test_llm import DATA, SCHEMA, WORD, given, low, none, odd, odd_rows, plain, sha, texts_of  # noqa: F401

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


# byte-level BPE

@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.model_of(byte_bpe.read_ranks(RANKS)), PATTERN, byte_bpe.exact_pattern(PATTERN))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_every_character_and_random_texts_encode_as_the_library_does(codec, library):
    rng = random.Random(1)
    every = [chr(x) for x in range(0x110000) if not 0xD800 <= x < 0xE000]
    texts = ["".join(rng.choice(rng.choice((every, every[:600], "ab '1 \n\t", "word the  "))) for _ in range(rng.randrange(200))) for _ in range(500)]
    texts += ["".join(every[k : k + 3000]) for k in range(0, len(every), 3000)] + ["a" * 5000, " " * 3000, "'s't're" * 20, "<|endoftext|>", "\x1c\x1f\x85 "]
    for t in texts:
        ids = codec.encode(t)
        assert ids == library.encode_ordinary(t) and codec.decode(ids).decode() == t


def test_long_texts_leave_in_chunks(codec, library):
    text = "abc déf 12  \n" * 12000 + "x" * 70000
    assert len(text) > byte_bpe.LONG and codec.encode(text) == library.encode_ordinary(text)
    assert all(len(c) <= byte_bpe.CHUNK * 70000 for c in codec.chunks(text)) and sum(1 for _ in codec.chunks(text)) > 5


def test_the_cache_is_bounded(codec, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    codec.known.clear()
    text = " ".join(f"w{k}" for k in range(500))
    assert codec.encode(text) == library.encode_ordinary(text) and len(codec.known) <= 50


def test_ranks_that_make_no_model():
    with pytest.raises(ValueError, match="gap"):
        byte_bpe.model_of({bytes([b]): b + 1 for b in range(256)})
    with pytest.raises(ValueError, match="bytes"):
        byte_bpe.model_of({bytes([b]): b for b in range(255)})


def test_a_token_that_no_merges_reach_is_taken_whole():
    ranks = {bytes([b]): b for b in range(256)} | {b"abcd": 256, b"ab": 257}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.Codec(byte_bpe.model_of(ranks), PATTERN, byte_bpe.exact_pattern(PATTERN))
    assert codec.whole and all(codec.encode(t) == own.encode_ordinary(t) for t in ("abcd", "abcde", "ab abcd cd", "abcd1"))


def test_byte_bpe_of_documents(spark, given, odd, none, library):  # noqa: F811
    for docs in (odd, given):
        want = []
        for d, t in texts_of(docs):
            ids = library.encode_ordinary(t)
            want.append((d, len(ids), sha(" ".join(map(str, ids))), hashlib.sha256(t.encode()).hexdigest()))
        rows = byte_bpe.encode_documents(docs, RANKS, PATTERN)
        assert sorted(tuple(r)[:4] for r in rows.collect()) == sorted(want)
    back = byte_bpe.decode_ids(byte_bpe.encode_documents(odd, RANKS, PATTERN), RANKS, PATTERN)
    assert sorted(bytes(r["decoded"]).decode() for r in back.collect()) == sorted(t for _, t in texts_of(odd))
    assert byte_bpe.encode_documents(none, RANKS, PATTERN).count() == 0
    keyless = spark.createDataFrame([(None, "one"), (None, None), ("k", "")], "doc_id string, text string")
    assert sorted((str(r[0]), r[1]) for r in byte_bpe.encode_documents(keyless, RANKS, PATTERN).collect()) == [("None", 0), ("None", 1), ("k", 0)]
    broken = spark.sql("select 1L as doc_id, cast(unhex('61FF62') as string) as text")
    assert byte_bpe.encode_documents(broken, RANKS, PATTERN).first()["n_tokens"] == len(library.encode_ordinary("a�b"))


# resampling

def drawn_by_hand(docs, target, longest=1, buckets=10_000, share=Fraction(1, 10)):
    def features(t):
        w = [x.encode() for x in WORD.findall(low(t or ""))]
        return len(w), [zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = [0] * buckets, [0] * buckets
    for counts, rows in ((s, docs), (t, target)):
        for _, text in rows:
            for b in features(text)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for d, text in docs:
        n, f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(fit[: math.floor(share * len(fit))])}
    return [(*r[:4], ranks.get(id(r))) for r in rows]


@pytest.mark.parametrize("longest,most", [(1, 1 << 16), (3, 300)])
def test_resampling(spark, given, odd, longest, most):  # noqa: F811
    target = spark.read.parquet(f"{DATA}/benchmark.parquet")
    goal = [(r["item_id"], r["text"]) for r in target.collect()]
    cells = ("doc_id", "n_features", "weight", "score", "rank")
    for docs in (given, odd.dropDuplicates(["doc_id"])):
        got = resampling.resample(docs, target, longest=longest, most=most).select(*cells).collect()
        key = lambda r: (r[0], r[1])
        assert sorted(map(tuple, got), key=key) == sorted(drawn_by_hand(texts_of(docs), goal, longest), key=key)


def test_resampling_of_odd_rows(spark, given, odd, none):  # noqa: F811
    target = spark.read.parquet(f"{DATA}/benchmark.parquet")
    half = resampling.resample(given, target, share=0.5).where("rank is not null")
    n = half.count()
    assert n == resampling.resample(given, target).where("n_words >= 20").count() // 2 and half.agg(F.max("rank"), F.countDistinct("rank")).first() == (n, n)
    assert resampling.resample(none, target).count() == 0
    assert {r["weight"] <= 2000 for r in resampling.resample(odd, target.limit(0)).collect()} == {True}
    repeats = resampling.resample(odd.union(odd).withColumn("doc_id", F.lit(None).cast("long")), target, share=1.0).collect()
    ranks = [r["rank"] for r in repeats if r["rank"]]
    assert len(repeats) == 2 * len(odd_rows()) and sorted(ranks) == [*range(1, len(ranks) + 1)]


def test_checksums_of_runs_are_composed_and_gaps_filled():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdé9") for _ in range(rng.choice([1, 3, 60, 300]))).encode() for _ in range(60)]
    known = resampling.Dictionary(words[:30])
    for _ in range(50):
        text = b" ".join(rng.choice(words) + rng.choice([b"", b",", b"  ", b"\n"]) for _ in range(rng.randrange(30)))
        w = text.translate(resampling.FOLD).split()
        n, got = known.buckets(text, 1 << 32, 4)
        assert n == len(w) and got.tolist() == [zlib.crc32(b" ".join(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1)]


# periodic runs

def runs_by_hand(w):
    n, seen = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                seen.setdefault((s, i + q - s), q)
            i += i == s
    return sorted((s, m, q) for (s, m), q in seen.items())


def test_runs_of_random_words():
    rng = random.Random(2)
    for _ in range(1500):
        k = rng.choice([1, 2, 3, 5, 30])
        w = [rng.randrange(k) for _ in range(rng.randrange(140))]
        if rng.random() < 0.5 and w:
            a, q = rng.randrange(len(w)), rng.randrange(1, 12)
            w = w[:a] + w[a : a + q] * rng.randrange(2, 30) + w[a:]
        assert periodic_runs.runs_of(np.array(w, dtype=np.int32)) == runs_by_hand(w)


def test_common_extensions():
    rng = random.Random(7)
    for k in (1, 2, 4):
        w = np.array([rng.randrange(k) for _ in range(90)] * 3, dtype=np.int32)
        lce = periodic_runs.Extensions(w)
        i, j = np.triu_indices(len(w), 1)
        want = [next((m for m in range(len(w) - b) if w[a + m] != w[b + m]), len(w) - b) for a, b in zip(i, j)]
        assert lce.of(i, j).tolist() == want and lce.sampled


def test_texts_without_repeats_sort_nothing(monkeypatch):
    monkeypatch.setattr(periodic_runs.Extensions, "sort_samples", lambda self: pytest.fail("sorted"))
    assert periodic_runs.runs_of(np.arange(5000, dtype=np.int32)) == []


def test_places_are_tried_in_blocks(monkeypatch):
    w = np.array(([1, 2, 3] * 40 + [4] * 9 + [5, 6] * 30) * 5, dtype=np.int32)
    whole = periodic_runs.runs_of(w)
    monkeypatch.setattr(periodic_runs, "BLOCK", 50)
    assert periodic_runs.runs_of(w) == whole == runs_by_hand(w.tolist())


def planted_by_hand(d, w):
    if d is not None and w and zlib.crc32(str(d).encode()) % 10 == 0:
        n, g = len(w), zlib.crc32(str(d).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def judged_by_hand(d, w):
    runs = runs_by_hand(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (d, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(kept)), kept


CELLS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_periodic_runs_of_the_query(spark, given):  # noqa: F811
    got = queries.op13_periodic_runs(spark, DATA).select(*CELLS).collect()
    want = [judged_by_hand(d, planted_by_hand(d, plain(t)))[0] for d, t in texts_of(given) if len(t) < 60000]
    left = {d for d, t in texts_of(given) if len(t) >= 60000}
    assert sorted((tuple(r) for r in got if r[0] not in left), key=str) == sorted(want, key=str) and sum(bool(r["n_runs"]) for r in got) > 10


def test_periodic_runs_of_odd_rows(spark, odd, none):  # noqa: F811
    again = spark.createDataFrame([(20, "a b c " * 4 + "tail", 1), (20, "a b c " * 4 + "tail", 1), (None, "é " * 9, 1), (21, "x y " * 50000, 1), (22, "a a a a a", 1)], "doc_id long, text string, runs int")
    docs = odd.select("doc_id", "text", F.lit(1).alias("runs")).union(again)
    rows = periodic_runs.detect(docs).collect()
    want = [judged_by_hand(d, plain(t)) for d, t in texts_of(docs) if len(t) < 60000]
    short = [r for r in rows if r["doc_id"] != 21]
    assert sorted((tuple(r[c] for c in CELLS) for r in short), key=str) == sorted((w[0] for w in want), key=str)
    assert sorted(r["collapsed"] for r in short) == sorted(w[1] for w in want)
    long = next(r for r in rows if r["doc_id"] == 21)
    assert (long["n_runs"], long["length"], long["period"], long["collapsed"], [tuple(r) for r in long["runs"]]) == (1, 100000, 2, "x y", [(0, 100000, 2)])
    assert periodic_runs.detect(none).count() == 0 and periodic_runs.planted(none).count() == 0
    cut = periodic_runs.collapsed(docs)
    assert cut.columns == docs.columns and sorted(r["text"] for r in cut.where("doc_id = 20").collect()) == ["a b c tail"] * 2
    assert cut.where("doc_id = 0").first()["text"] is None


def test_planting(spark):
    rows = [(d, " ".join(f"w{k}" for k in range(d % 50))) for d in range(300)] + [(None, "a b c")]
    got = {r["doc_id"]: r["text"] for r in periodic_runs.planted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(re.split(" ", got[d]) == (planted_by_hand(d, t.split(" "))) for d, t in rows if t)
