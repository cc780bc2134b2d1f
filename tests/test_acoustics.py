"""Pitch and loudness of signals that are known, levels and coverage of segments against loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.operators import acoustics, measures, shaping

RATE = 16000
times = lambda s, rate=RATE: np.arange(int(s * rate)) / rate
quarter_tone = 2 ** (1 / 24)


def near(got, want):
    return (got > want / quarter_tone) & (got < want * quarter_tone)


@pytest.mark.parametrize("pitch", [70, 98, 146.8, 220, 311.1, 440, 659.3, 880, 1046.5])
def test_tones_and_voices(pitch):
    t = times(0.6)
    for signal in (np.sin(2 * np.pi * pitch * t), sum(np.sin(2 * np.pi * pitch * k * t + k) / k for k in range(1, 9) if pitch * k < 7000)):
        got = acoustics.contour(0.3 * signal.astype(np.float32))
        inside = got[8:-8]
        assert len(got) == 61 and near(inside, pitch).all()


def test_glides_and_noise():
    t = times(1.5)
    pitch = 150 * 2 ** (t / 1.5)  # an octave up
    glide = 0.3 * np.sin(2 * np.pi * np.cumsum(pitch) / RATE)
    got = acoustics.contour(glide.astype(np.float32))
    assert near(got[8:-8], pitch[::160][8 : len(got) - 8]).mean() > 0.97
    rng = np.random.default_rng(1)
    assert (acoustics.contour(rng.normal(size=RATE).astype(np.float32) * 0.1) == 0).mean() > 0.95
    noisy = acoustics.contour((glide + 0.01 * rng.normal(size=len(glide))).astype(np.float32))
    assert near(noisy[8:-8], pitch[::160][8 : len(got) - 8]).mean() > 0.95
    assert (acoustics.contour(np.zeros(3000, np.float32)) == 0).all() and len(acoustics.contour(np.zeros(0, np.float32))) == 0


def test_contours_feed_the_regions(spark):
    tone = lambda f, s: (0.3 * np.sin(2 * np.pi * f * times(s))).tolist()
    rows = spark.createDataFrame([("held", tone(600, 2.0)), ("short", tone(600, 0.4) + [0.0] * 8000 + tone(640, 0.4)), ("silent", [0.0] * 8000), ("none", None)], "k string, samples array<float>")
    contours = rows.withColumn("f0", acoustics.pitch_contours()("samples"))
    got = {r["k"]: (r["s"], r["r"]) for r in contours.select("k", measures.sustained(F.col("f0"), 150).alias("s"), measures.voice_region(F.col("f0"), 150).alias("r")).collect()}
    assert got["held"] == (True, "sung_full") and got["short"] == (False, "sung_high") and got["silent"] == (False, "speaking") and got["none"][0] is None


def in_blocks(signals, size):
    return [(f, k, s[k * size : (k + 1) * size].tolist()) for f, s in signals.items() for k in range(-(-len(s) // size))]


def test_loudness_of_known_signals(spark):
    sine = lambda s, level, f=997.0: 10 ** (level / 20) * np.sin(2 * np.pi * f * times(s))
    signals = {
        "tone": sine(20, -23), "quieter": sine(5.03, -33), "silent": np.zeros(3 * RATE), "short": sine(0.39, -20),
        # the quiet stretch falls under the relative gate, the very quiet one under the absolute one
        "gated": np.concatenate([sine(10, -36), sine(20, -23), sine(10, -36)]), "nearly silent": np.concatenate([sine(10, -80), sine(20, -23), sine(10, -80)]),
        "high": sine(10, -23, 4000.0), "low": sine(10, -23, 60.0),
    }
    size = 2 * RATE
    blocks = spark.createDataFrame(in_blocks(signals, size), "file_id string, block long, samples array<double>")
    got = {r["file_id"]: r["lufs"] for r in acoustics.loudness(blocks, size).collect()}
    # a sine of -23 dB at 997 Hz has -26.0 in one channel; windows half in the loud stretch take a little off
    assert got["tone"] == pytest.approx(-26.0, abs=0.1) and got["quieter"] == pytest.approx(-36.0, abs=0.1) and got["gated"] == pytest.approx(-26.0, abs=0.2) and got["nearly silent"] == pytest.approx(-26.0, abs=0.2)
    assert got["silent"] == float("-inf") and got["short"] is None and got["high"] == pytest.approx(-26.0 + 3.3, abs=0.4) and got["low"] < -28
    whole = acoustics.weighted(signals["gated"], RATE)
    tenths = (whole.reshape(-1, 1600) ** 2).mean(axis=1)
    windows = np.convolve(tenths, np.ones(4) / 4, "valid")
    loud = windows[-0.691 + 10 * np.log10(windows) > -70]
    kept = loud[-0.691 + 10 * np.log10(loud) > -0.691 + 10 * np.log10(loud.mean()) - 10]
    assert got["gated"] == pytest.approx(-0.691 + 10 * np.log10(kept.mean()), abs=1e-3)

    louder = acoustics.normalised(blocks, size, -20.0)
    again = {r["file_id"]: r["lufs"] for r in acoustics.loudness(louder, size).collect()}
    assert all(again[f] == pytest.approx(-20.0, abs=1e-6) for f in ("tone", "quieter", "gated", "high", "low"))
    same = {r["file_id"]: r["samples"] for r in louder.where("file_id in ('silent', 'short') and block = 0").collect()}
    assert same["short"] == signals["short"].tolist() and same["silent"] == [0.0] * size
    assert acoustics.normalised(blocks, size, None) is blocks


def test_recognised_segments(spark):
    rng = np.random.default_rng(2)
    random.seed(3)
    whole = {"a": rng.normal(size=5230) * 0.1, "b": np.concatenate([np.zeros(1000), rng.normal(size=900)])}
    blocks = spark.createDataFrame(in_blocks(whole, 300), "file_id string, block long, samples array<double>")
    segments = [("a", i, s := random.randrange(0, 500) / 100, s + random.choice([0.0, 0.13, 0.5, 2.0]), f" text {i}\n", [(s, s + 0.1, " w", 0.5)] if i % 2 else None, -0.5) for i in range(20)]
    segments += [("b", 0, 0.0, 1.0, "silent", None, None), ("b", 1, 0.5, 9.0, None, None, None), ("b", 2, 50.0, 60.0, "beyond", None, None)]
    speech = [("a", 0.1, 0.9), ("a", 1.2, 1.25), ("a", 2.0, 4.5)]
    df = spark.createDataFrame(segments, "file_id string, seg_idx int, start double, end double, text string, words array<struct<start:double,end:double,word:string,probability:double>>, avg_logprob double")
    got = {(r["file_id"], r["seg_idx"]): r for r in shaping.recognised(df, spark.createDataFrame(speech, "file_id string, start double, end double"), blocks, 300, rate=1000).collect()}
    assert len(got) == len(segments)
    for f, i, s, e, t, w, lp in segments:
        r, clip = got[f, i], whole[f][int(s * 1000) : int(e * 1000)]
        power = np.mean(clip**2) if len(clip) else 0.0
        assert r["rms_dbfs"] == pytest.approx(20 * np.log10(np.sqrt(power)) if power > 0 else -120.0)
        covered = sum(max(0.0, min(e, b) - max(s, a)) for g, a, b in speech if g == f)
        assert r["vad_coverage_ratio"] == pytest.approx(1.0 if f == "b" else min(1.0, covered / max(e - s, 1e-6)), abs=1e-5)
        assert r["text"] == (t and t.strip()) and r["avg_logprob"] == lp and [tuple(x) for x in r["words"]] == (w or [])
