"""Operators against small cases, loop restatements and, for every bound query, the same query in DuckDB."""

import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sessionlake.functions import text
from sessionlake.functions import phonetics
from sessionlake.operators import corpus, intervals, matching, measures, polish
from sessionlake.plans import bindings
from sessionlake.streaming import fold

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def as_text(frame):
    told = lambda v: "~" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(told(v) for v in row) for row in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(bindings.ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = bindings.QUERIES[name](spark, DATA).toPandas(), con.execute(bindings.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    for a, b in zip(as_text(got), as_text(want)):
        for x, y in zip(a, b):
            if x != y:
                assert float(x) == pytest.approx(float(y), rel=1e-8)


def spans(spark, rows):
    return spark.createDataFrame([("f", k, a, b, w) for k, (a, b, w) in enumerate(rows)], "f string, id long, start long, end long, who string")


def test_gap_merge_is_strict_and_ends_with_the_last_span(spark):
    rows = [(0, 10, "a"), (12, 20, "a"), (30, 90, "a"), (40, 50, "a"), (59, 70, "a")]
    got = intervals.gap_merge(spans(spark, rows), "f", 10).orderBy("start").collect()
    assert [(r["start"], r["end"], r["n_spans"]) for r in got] == [(0, 20, 2), (30, 70, 3)]


def test_intervals_against_loops(spark):
    rng = random.Random(3)
    rows = [(a := rng.randrange(0, 90), a + rng.randrange(1, 30), rng.choice("xyz")) for _ in range(60)]
    df = spans(spark, rows)
    shared = sum(max(0, min(a[1], b[1]) - max(a[0], b[0])) for i, a in enumerate(rows) for b in rows[:i] if a[2] != b[2])
    assert intervals.overlap_ratio(df, "f", "who").first()["overlap"] == shared
    some = [r for r in rows if r[2] == "x"]
    got = {r["id"]: r["coverage"] for r in intervals.coverage(df, df.where("who = 'x'"), "f").collect()}
    for k, (a, b, _) in enumerate(rows):
        assert got[k] == pytest.approx(min(1, sum(max(0, min(b, d) - max(a, c)) for c, d, _ in some) / (b - a)))
    assert intervals.coverage(df, df.where("false"), "f").where("coverage <> 1").isEmpty()
    used, want = 0, {}
    for a, b, k in sorted(((a, b, k) for k, (a, b, _) in enumerate(rows)), key=lambda r: (r[0] - r[1], r[0], r[2])):
        take = min(b - a, 200 - used)
        used += max(take, 0)
        if take >= 5:
            want[k] = take
    assert {r["id"]: r["take"] for r in intervals.budget_prefix(df, "f", 200, 5).collect()} == want


def test_chunks_against_a_loop(spark):
    for n, size, overlap in ((1, 3, 1), (3, 3, 1), (4, 3, 1), (10, 4, 2), (7, 2, 5)):
        lap, starts, i = max(0, min(overlap, size - 1)), [], 0
        while True:
            starts.append(i)
            if i + size >= n:
                break
            i += size - lap
        want = sorted((c, k) for c, s in enumerate(starts) for k in range(s, min(n, s + size)))
        rows = corpus.chunks(spark.range(n).withColumn("f", F.lit(1)), "f", "id", size, overlap)
        assert sorted((r["chunk"], r["id"]) for r in rows.collect()) == want
        assert sorted(r["id"] for r in rows.where("keep").collect()) == list(range(n))
    with pytest.raises(ValueError):
        corpus.chunks(spark.range(1), "id", "id", 0, 0)


def test_vectors(spark):
    rng = np.random.default_rng(5)
    vs = rng.normal(size=(40, 6)).astype("float32")
    df = spark.createDataFrame([(k, k % 3, v.tolist()) for k, v in enumerate(vs)], "id long, g int, v array<float>")
    n = vs.astype(float) / (np.linalg.norm(vs.astype(float), axis=1) + 1e-9)[:, None]
    cos = n @ n.T
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if cos[a, b] > 0.3}
    assert {(r["a"], r["b"]) for r in matching.similar_pairs(df, "id", "v", 0.3, block=7).collect()} == want
    for r in matching.running_centroids(df, "g", "id", "v").collect():
        mine = vs[r["g"] :: 3].astype(float)
        state = mine[0] / np.linalg.norm(mine[0])
        for k, v in enumerate(mine[1:], 1):
            state = (state * k + v) / (k + 1)
            state /= np.linalg.norm(state)
        assert r["n"] == len(mine) and np.allclose(r["centroid"], state, atol=1e-6)
    empty = matching.nearest_centroid(df, df.where("false").selectExpr("g as name", "v as centroid"), "name", "v").first()
    assert (empty["best"], empty["best_score"]) == (None, -1.0)


def test_names_and_markers(spark):
    names = ["2024-05-10_anna__carol_r_ro", "2024-05-10_carol_ro", "2024-05-10_a__b__c_en", "2024-05-10_a__b_fr", "notes"]
    got = spark.createDataFrame([(n,) for n in names], "s string").select(text.parse_name(F.col("s"), "anna").alias("m")).select("m.*").collect()
    assert [tuple(r) for r in got] == [
        ("2024-05-10", "anna", "carol_r", "ro"), ("2024-05-10", "anna", "carol", "ro"), ("2024-05-10", "a", "b__c", "en"), (None,) * 4, (None,) * 4,
    ]
    one = spark.range(1)
    told = one.select(*[text.sung_marker(F.lit(x)) for x in (0.5, 1.5, 2.5)], text.fold_marks(F.lit("Ăă Ââ Îî Șș Țț ŞşŢţ")), text.first_json_array(F.lit('x ```json\n["a"]\n``` y'))).first()
    assert tuple(told) == ("[SUNG: ~0s]", "[SUNG: ~2s]", "[SUNG: ~2s]", "Aa Aa Ii Ss Tt SsTt", '["a"]')
    words = F.array(F.lit(0.9), F.lit(0.4))
    skips = one.select(text.polish_skip(words, F.lit(-0.1), 0.6), text.polish_skip(words, F.lit(-0.1), None), text.polish_skip(F.array(), F.lit(-0.2), 0.6), text.polish_skip(words, F.lit(None).cast("double"), None)).first()
    assert tuple(skips) == (False, True, True, False)


def test_word_edits_count_every_word(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(8)
    many = [f"w{k}" for k in range(400)]
    pairs = [([rng.choice(many[:n]) for _ in range(a)], [rng.choice(many[:n]) for _ in range(b)]) for n, a, b in ((5, 40, 30), (90, 120, 150), (400, 299, 250), (9, 0, 3), (9, 3, 0), (9, 0, 0))]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a array<string>, b array<string>")
    got = {r[0]: (r[1], r[2]) for r in rows.select("k", text.word_edits(F.col("a"), F.col("b")), text.word_error_rate(F.col("a"), F.col("b"))).collect()}
    for k, (a, b) in enumerate(pairs):
        assert got[k] == (edits(a, b), edits(a, b) / len(a) if a else float(bool(b)))
    # codes past the surrogates and at the byte order mark stay apart: a table of so many words, of which few are compared
    table = F.transform(F.sequence(F.lit(1), F.lit(66_000)), lambda k: F.concat(F.lit("w"), k.cast("string")))
    some = F.array(*[F.lit(f"w{k}") for k in (0xFEFF - 0x900, 0xD7FF - 0x100, 0xD800 - 0x100, 0xFFFF - 0x900, 0x10000 - 0x900)])
    assert [ord(c) for c in spark.range(1).select(text._coded(some, table)).first()[0]] == [65, 0xFEFF, 0xD7FF, 0xE000, 0xFFFF, 0x10000]
    turns = pd.read_parquet(f"{DATA}/conversations.parquet").sort_values(["conv_id", "turn"])
    turns["words"] = [[w for w in re.split("[ \t\n\r]+", t) if w] for t in turns["text"]]
    assert max(map(len, turns["words"])) > 62
    whole = {}
    for c, of in turns.groupby("conv_id"):
        for a, b, turn in zip(of["words"], of["words"][1:], of["turn"][1:]):
            whole[c, turn] = edits(a, b) / len(a) if a else float(bool(b))
    assert {(r["conv_id"], r["turn"]): r["wer"] for r in bindings.QUERIES["q_wer_whole"](spark, DATA).collect()} == pytest.approx(whole)


def test_signals(spark):
    array = lambda xs: F.lit(list(map(float, xs)))
    one = spark.range(1)
    levels = one.select(measures.rms_dbfs(array([0] * 9)), measures.rms_dbfs(array([1] * 9)), measures.rms_dbfs(array([0.25] * 9)), measures.zero_crossings(array([1, -1, 1])), measures.zero_crossings(array([1]))).first()
    assert levels[0] == -120 and levels[1] == 0 and levels[2] == pytest.approx(-12.04, abs=0.05) and levels[3:] == (1.0, 0.0)
    held = one.select(measures.sustained(array([440] * 150), 150), measures.sustained(array([440] * 48), 150), measures.sustained(array([440, 440, 0, 440]), 3), measures.voice_region(array([440] * 47), 46), measures.voice_region(array([0] * 5), 46)).first()
    assert tuple(held) == (True, False, False, "sung_full", "speaking")


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.randrange(4), k, rng.choice(["start", "phase", "progress", "done", "error"]), float(k)) for k in range(60)]
    schema = "file long, seq long, kind string, amount double"
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        seen = fold.stream_fold(stream, "file").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
        seen.foreachBatch(lambda df, k, part=part: df.write.mode("overwrite").parquet(str(tmp_path / f"out{part}"))).trigger(availableNow=True).start().awaitTermination(120)
    last = {}
    for part in range(3):
        last |= {r["file"]: (r["state"], r["progress"], r["n_events"]) for r in spark.read.parquet(str(tmp_path / f"out{part}")).collect()}
    want = fold.fold_events(spark.createDataFrame(rows, schema), "file").collect()
    assert last == {r["file"]: (r["state"], r["progress"], r["n_events"]) for r in want}


def test_sound_keys():
    keys = {"metaphone": "MTFN", "wrack": "RK", "photo": "FT", "school": "SKL", "church": "XRX", "science": "SNS", "judge": "JJ", "laugh": "LF", "bomb": "BM", "xylo": "SL", "action": "AKXN", "that": "0T", "quick": "KK", "inimă": "INM", "": "", "123": ""}
    for word, key in keys.items():
        assert phonetics.sound_key(word) == key, word
    assert phonetics.sound_key("inimă") == phonetics.sound_key("inima") and phonetics.sound_key("glas") != phonetics.sound_key("vocea")


def test_patches_in_order(spark):
    words = spark.createDataFrame([("f", 0, 0, " helo ", 0.2), ("f", 0, 1, "wrld", 0.3), ("f", 0, 2, "sure", 0.95), ("f", 1, 0, "plain", None), ("f", 2, None, None, None)], "file_id string, segment_index int, word_index int, word string, probability double")
    patches = [
        (1, 0, 0, "helo", "hello"), (2, 0, 0, "hello", "hallo"), (3, 0, 1, "wrld", "vibrato"), (4, 0, 1, "wrld", "qqq"), (5, 0, 2, "sure", "shure"), (6, 1, 0, "plain", "plane"), (7, 1, 0, "plain", "Vibrato"),
        (8, 9, 0, "a", "b"), (9, 0, -1, "a", "b"), (10, 0, 0, "", "b"), (11, 0, 0, "b", "b"), (12, 2, 0, "a", "b"), (13, 0, 1, "nope", "x"), (14, None, 0, "a", "b"),
    ]
    rows = spark.createDataFrame([("f", *p) for p in patches], "file_id string, patch_no int, segment_index int, word_index int, original string, proposed string")
    got = {r["segment_index"]: r for r in polish.apply_patches(rows, words, ["vibrato"]).collect()}
    assert (got[0]["text"], got[0]["n_applied"]) == ("hallo vibrato sure", 3) and (got[1]["text"], got[2]["text"]) == ("Vibrato", "")
    reasons = {x["patch_no"]: x["reason"] for r in got.values() for x in r["rejected"]}
    want = {4: "original_mismatch", 5: "word_confidence_above_threshold", 6: "no_word_confidence_and_not_glossary", 8: "invalid_segment_index", 9: "invalid_word_index", 10: "empty_text", 11: "no_change", 12: "missing_word_metadata", 13: "original_mismatch", 14: "invalid_segment_index"}
    assert reasons == want
    once = {r["patch_no"]: r["rejection_reason"] for r in polish.judge_patches(rows, words, ["vibrato"]).collect()}
    assert once == {**dict.fromkeys(range(1, 15)), **want, 2: "original_mismatch", 4: "phonetic_keys_differ"}


def test_vectors_in_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(k, k % 7, rng.normal(size=4).tolist() if k else None) for k in range(60)], "id long, g long, v array<double>")
    centroids = matching.mean_vectors(df, "g", "v").withColumnRenamed("g", "name")
    whole = sorted(map(tuple, matching.flips(df, centroids, "g", "name", "v", 0.1).drop("v").collect()))
    monkeypatch.setattr(matching, "BLOCK_BYTES", 64)
    assert sorted(map(tuple, matching.flips(df, centroids, "g", "name", "v", 0.1).drop("v").collect())) == whole
    plan = matching.similar_pairs(df.where("v is not null"), "id", "v", 0.9, block=8)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_session_helpers_on_small_rows(spark):
    one = spark.range(1)
    told = one.select(text.ascii_id(F.lit("  Škola  №5 – Élan ")), text.ascii_id(F.lit("漢字")), text.duration_text(F.lit(-1.0)), text.duration_text(F.lit(7384.0)), text.size_text(F.lit(1536)), text.parse_time(F.lit("not a time")).cast("string")).first()
    assert tuple(told) == ("skola_no5_elan", None, "\u2013", "2h 3m", "1.5 KB", None)
    assert measures.recommended(measures.sweep(spark.createDataFrame([(1.0, 5.0), (2.0, 1.0), (3.0, 1.0)], "m double, c double"), "m", "c", [1.5, 2.5])).first()["threshold"] == 1.5
    assert one.select(measures.clipping_ratio(F.array(F.lit(1.0), F.lit(0.5)))).first()[0] == 0.5
