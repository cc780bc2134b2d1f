"""Sung segments and single words attributed by their own voices, against loops over the whole signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.operators import attribution, signals
from sessionlake.operators.corpus import from_json_records, to_json_records

RATE, SIZE = 1000, 700
SEGMENT = "file_id string, seg_idx int, start double, end double, region string, text string, speaker_id string, speaker_confidence double, words array<struct<word: string, start: double, end: double>>"


def embedder():
    def embed(samples, rate):  # a closure, so that it goes to workers by value
        if len(samples) < rate // 2:
            raise ValueError("too short")
        vec = np.array([samples[0::2].mean(), samples[1::2].mean(), samples.std(), 0.1], dtype=np.float64)
        return vec / (np.linalg.norm(vec) + 1e-9)

    return embed


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(9)
    whole = {f: np.repeat(rng.normal(size=(30, 2)), 400, axis=0)[: 400 * 30].reshape(-1)[:11800].astype("float32") for f in ("a", "b", "c")}
    blocks = spark.createDataFrame([(f, k, s[k * SIZE : (k + 1) * SIZE].tolist()) for f, s in whole.items() for k in range(-(-len(s) // SIZE))], "file_id string, block long, samples array<float>")
    library = [(p, n, k, rng.normal(size=4).astype("float32").tolist()) for p in ("p1", "p2", "p3") for n, k in (("universal", 0), ("spoken_mid", 0), ("recent", 0), ("recent", 1))]
    candidates = [("a", "p1"), ("a", "p2"), ("a", "p2"), ("b", "p1"), ("b", "p2"), ("b", "p3"), ("c", "p3")]
    segments = []
    for f in whole:
        for i in range(24):
            start = float(rng.integers(0, 720)) / 64
            end = start + float(rng.choice([0.25, 0.5, 1.5, 2.5, 3.5]))
            words = [(f"w{k}", t, t + float(rng.choice([0.0625, 0.25, 0.75]))) for k, t in enumerate(np.arange(start, end, 0.375).tolist())]
            speaker = None if i % 11 == 10 else f"p{1 + i % 2}"
            segments.append((f, i, start, end, ("sung_high", "spoken_mid", None)[i % 3], f"text {i}", speaker, None if i % 7 == 6 else 0.1 * (i % 5), None if i % 13 == 12 else [] if i % 13 == 11 else words))
    return whole, blocks, spark.createDataFrame(library, "person_id string, name string, row_no int, vec array<float>"), library, candidates, segments


loud = embedder()


def loader():
    made = embedder()

    def load():  # a closure, as well
        return made

    return load


def nearest(vec, f, library, candidates):
    unit = lambda v: np.asarray(v, dtype=np.float64) / (np.linalg.norm(np.asarray(v, dtype=np.float64)) + 1e-9)
    persons = {p for g, p in candidates if g == f}
    return min(((-float(unit(vec) @ unit(v)), p, n) for p, n, _, v in library if p in persons), default=None)


def voice(signal, first, after):
    part = signal[first:after]
    return loud(part, RATE).astype("float32") if after > first and len(part) >= RATE // 2 else None


def test_sung_segments(spark, corpus):
    whole, blocks, known, library, candidates, segments = corpus
    df, who = spark.createDataFrame(segments, SEGMENT).repartition(3), spark.createDataFrame(candidates, "file_id string, person_id string")
    embed = signals.embedded(loader(), "sung", RATE)
    rows = {(r["file_id"], r["seg_idx"]): r for r in attribution.sung_attributed(df, blocks, SIZE, embed, who, known, rate=RATE).collect()}
    assert len(rows) == len(segments)
    moved = 0
    for f, i, start, end, region, text, speaker, confidence, words in segments:
        r = rows[f, i]
        if region != "sung_high":
            assert (r["text"], r["speaker_id"], r["speaker_confidence"], r["matched_region"], r["sung"], r["polished"]) == (text, speaker, confidence, None, False, False)
            assert (r["words"] is None) == (words is None)
            continue
        assert (r["text"], r["words"], r["sung"], r["polished"]) == (f"[SUNG: ~{round(end - start)}s]", None, True, True)
        vec = voice(whole[f], int(start * RATE), int(end * RATE))
        if vec is None:
            assert (r["speaker_id"], r["speaker_confidence"], r["matched_region"]) == (speaker, confidence, None)
        else:
            minus, person, name = nearest(vec, f, library, candidates)
            assert (r["speaker_id"], r["matched_region"]) == (person, name) and r["speaker_confidence"] == pytest.approx(-minus, abs=1e-6)
            moved += person != speaker
    assert moved > 3
    nobody = attribution.sung_attributed(df, blocks, SIZE, embed, who.where("false"), known, rate=RATE)
    assert {(r["speaker_id"], r["matched_region"]) for r in nobody.where("sung").collect()} == {(s[6], None) for s in segments if s[4] == "sung_high"}


@pytest.mark.parametrize("margin", [0.0, 0.3])
def test_words_vote(spark, corpus, margin):
    whole, blocks, known, library, candidates, segments = corpus
    df, who = spark.createDataFrame(segments, SEGMENT).repartition(3), spark.createDataFrame(candidates, "file_id string, person_id string")
    out = attribution.words_attributed(df, blocks, SIZE, signals.embedded(loader(), "words", RATE), who, known, margin, RATE)
    rows = {(r["file_id"], r["seg_idx"]): r for r in out.collect()}
    assert len(rows) == len(segments)
    flipped = switched = 0
    for f, i, start, end, region, text, speaker, confidence, words in segments:
        r, to = rows[f, i], []
        votes = {}
        judged = f != "c" and region != "sung_high" and speaker and words  # file c has one candidate
        for _, a, b in words or ():
            length, seconds = max(b - a, 0.0), len(whole[f]) / RATE
            pad = (0.5 - length) / 2
            first, after = (a, b) if length >= 0.5 else (max(0.0, a - pad), min(seconds, b + pad))
            vec = voice(whole[f], int(first * RATE), int(after * RATE)) if judged else None
            best = nearest(vec, f, library, candidates) if vec is not None else None
            flips = best is not None and best[1] != speaker and -best[0] - (confidence or 0.0) > margin
            to.append(best[1] if flips else None)
            if best is not None and best[1] != speaker:
                votes[best[1]] = votes.get(best[1], 0) + 1
        top = min(((-n, p) for p, n in votes.items()), default=None)
        wins = any(to) and top is not None and -top[0] > len(words) / 2
        assert [w["reattributed_to"] for w in r["words"] or ()] == to
        assert (r["reattributed"], r["reattributed_segment_flip"], r["speaker_id"]) == (any(to), wins, top[1] if wins else speaker)
        flipped += any(to)
        switched += wins
    assert flipped > 3 and switched > 1


def test_no_rows(spark, corpus):
    _, blocks, known, _, candidates, _ = corpus
    none, who = spark.createDataFrame([], SEGMENT), spark.createDataFrame(candidates, "file_id string, person_id string")
    embed = signals.embedded(loader(), "none", RATE)
    assert attribution.sung_attributed(none, blocks, SIZE, embed, who, known, rate=RATE).collect() == []
    assert attribution.words_attributed(none, blocks, SIZE, embed, who, known, rate=RATE).where(F.lit(True)).collect() == []


def test_records_keep_nulls_and_nesting(spark):
    rows = spark.createDataFrame([("a", None, [1.5, 2.0], {"low": 3}), ("b\n\"x", "n", [], {}), (None, "", None, None)], "id string, name string, pitch_range_hz array<double>, counts map<string, long>")
    told = to_json_records(rows, "line")
    assert '"name":null' in told.first()["line"]
    back = from_json_records(told, "line", "id string, name string, pitch_range_hz array<double>, counts map<string, long>")
    assert back.collect() == rows.collect()
