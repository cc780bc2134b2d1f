"""Signals in blocks against slices of the whole signal."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.operators import signals
from sessionlake.sources import audio

from test_audio_view import wav

RATE = 1000


@pytest.mark.parametrize("rate, size", [(16000, 1000), (44100, 777), (8000, 50000)])
def test_blocks_are_the_whole_signal(spark, tmp_path, rate, size):
    rng = np.random.default_rng(3)
    both = rng.uniform(-0.9, 0.9, (rate // 3, 2))
    (tmp_path / "a.wav").write_bytes(wav(both, rate))
    (tmp_path / "b.wav").write_bytes(b"RIFF")
    good, bad = audio.signal_blocks(spark.read.format("binaryFile").load(str(tmp_path)), size=size)
    blocks = [r["samples"] for r in good.orderBy("block").collect()]
    whole = audio.resampled(audio.wav_signal(wav(both, rate))[1], rate)
    assert [len(b) for b in blocks[:-1]] == [size] * (len(blocks) - 1) and np.allclose(np.concatenate(blocks), whole, atol=1e-6)
    assert [r["path"].rsplit("/", 1)[1] for r in bad.collect()] == ["b.wav"]


@pytest.fixture(scope="module")
def recorded(spark):
    """Two files of 61.5 and 7.25 seconds, in blocks of 1500 samples; one of two hours, whose blocks are made by Spark."""
    rng = np.random.default_rng(5)
    whole = {"a": rng.normal(size=61500), "b": rng.normal(size=7250)}
    rows = [(f, k, s[k * 1500 : (k + 1) * 1500].tolist()) for f, s in whole.items() for k in range(-(-len(s) // 1500))]
    blocks = spark.createDataFrame(rows, "file_id string, block long, samples array<double>")
    long = spark.range(4800).select(F.lit("long").alias("file_id"), F.col("id").alias("block"), F.transform(F.sequence(F.lit(0), F.lit(1499)), lambda i: (F.col("id") * 1500 + i).cast("double")).alias("samples"))
    return blocks.union(long), whole | {"long": np.arange(7200 * RATE, dtype=np.float64)}


def test_cut_spans(spark, recorded):
    blocks, whole = recorded
    rng = random.Random(2)
    spans = [(k, f, a, a + rng.choice([1, 700, 1500, 9000])) for k, f in enumerate(["a", "b", "long"] * 15) for a in [rng.choice([0, 1499, 1500, rng.randrange(len(whole[f]))])]]
    spans += [(90, "a", 61499, 70000), (91, "a", 61500, 61600), (92, "b", 5, 5), (93, "none", 0, 5)]
    got = {r["k"]: r["samples"] for r in signals.cut(spark.createDataFrame(spans, "k int, file_id string, first long, after long"), blocks, 1500).collect()}
    assert set(got) == {s[0] for s in spans} - {91, 92, 93} and all(np.allclose(got[k], whole[f][a:b]) for k, f, a, b in spans if k in got)


def embedder():
    def embed(samples, rate):  # a closure, so that it goes to workers by value
        if len(samples) < rate // 2:
            raise ValueError("too short")
        return signals.unit_voice(np.array([samples.mean(), np.abs(samples).mean(), len(samples), samples[0]], dtype=np.float64))

    return embed


loud = embedder()


def pieces_by_hand(segments, n, rate=RATE):
    """The rules in a loop: longest first, 30 seconds in all, none of 0.1 s, no piece under half a second."""
    used, out = 0.0, []
    for _, _, _, start, end in sorted(segments, key=lambda s: -(s[4] - s[3])):
        take = min(end - start, 30.0 - used)
        if take <= 0.1:
            continue
        first = int(start * rate)
        after = min(first + int(take * rate), n)
        if after - first < rate // 2:
            continue
        out.append((first, after))
        used += take
        if used >= 30.0:
            break
    return out


def test_voices_of_clusters_and_turns(spark, recorded, tmp_path):
    blocks, whole = recorded
    rng = random.Random(8)
    segments = []
    for f in ("a", "b", "long"):
        end = len(whole[f]) / RATE
        for i in range(60):
            start = rng.randrange(int(end * 64)) / 64
            segments.append((f, i, rng.choice(["S0", "S1", "S2"]) if f != "b" else None if i else "S0", start, start + rng.choice([0.0625, 0.25, 0.5, 1.0, 2.5, 4.0, 11.0])))
    df = spark.createDataFrame(segments, "file_id string, seg_idx int, cluster_label string, start double, end double").repartition(3)
    calls, made = str(tmp_path), embedder()

    def load():
        import tempfile

        tempfile.mkstemp(dir=calls)
        return made

    embed = signals.embedded(load, "loud", RATE)
    got = {(r["file_id"], r["cluster_label"]): r["vec"] for r in signals.cluster_voices(df, blocks, 1500, embed, rate=RATE).collect()}
    want = {}
    for f, label in {(s[0], s[2]) for s in segments if s[2]}:
        pieces = pieces_by_hand([s for s in segments if (s[0], s[2]) == (f, label)], len(whole[f]))
        if pieces:
            want[f, label] = loud(np.concatenate([whole[f][a:b] for a, b in pieces]).astype(np.float32), RATE)
    assert set(got) == set(want) and len(want) > 5 and all(np.allclose(got[k], want[k], atol=1e-5) for k in want)
    turns = {(r["file_id"], r["seg_idx"]): r["vec"] for r in signals.turn_voices(df, blocks, 1500, embed, rate=RATE).collect()}
    short = {(f, i): whole[f][int(a * RATE) : int(b * RATE)] for f, i, _, a, b in segments if 0.5 <= b - a < 3 and int(b * RATE) <= len(whole[f])}
    assert set(turns) == set(short) and all(np.allclose(turns[k], loud(short[k].astype(np.float32), RATE), atol=1e-5) for k in short)
    import os

    assert 0 < len(os.listdir(calls)) <= 8  # once a worker, not once a task


def test_voices_of_regions_feed_the_library(spark, recorded):
    blocks, whole = recorded
    made = embedder()
    segments = spark.createDataFrame([("a", 1, "x", "recent", 20.0, 32.0, 0.9), ("a", 0, "x", "speaking", 1.0, 3.0, 0.9), ("a", 2, "x", "speaking", 5.0, 5.25, 0.9), ("a", 3, None, "speaking", 5.0, 9.0, 0.9), ("b", 0, "x", "sung_low", 6.0, 60.0, 0.9)],
                                     "file_id string, seg_idx int, speaker_id string, matched_region string, start double, end double, speaker_confidence double")
    got = {(r["file_id"], r["region"]): r["vec"] for r in signals.region_voices(segments, blocks, 1500, signals.embedded(lambda: made, "other", RATE), rate=RATE).collect()}
    want = {("a", "speaking"): np.concatenate([whole["a"][1000:3000], whole["a"][20000:32000]]), ("b", "sung_low"): whole["b"][6000:]}
    assert set(got) == set(want) and all(np.allclose(got[k], loud(want[k].astype(np.float32), RATE), atol=1e-5) for k in want)
