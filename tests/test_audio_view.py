"""Audio files as rows, and the viewers' registry against a loop over its events."""

import json
import random
import struct
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.sources import audio
from sessionlake.streaming import view


def wav(samples: np.ndarray, rate: int, bits: int = 16, kind: int = 1) -> bytes:
    channels = 1 if samples.ndim == 1 else samples.shape[1]
    if kind == 3:
        body = samples.astype(f"<f{bits // 8}").tobytes()
    elif bits == 8:
        body = (samples * 127 + 128).round().astype(np.uint8).tobytes()
    else:
        whole = (samples.reshape(-1) * (2 ** (bits - 1) - 1)).round().astype(np.int64)
        body = b"".join(int(v).to_bytes(bits // 8, "little", signed=True) for v in whole)
    form = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    chunks = b"fmt " + struct.pack("<I", 16) + form + b"odd " + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", len(chunks) + 4) + b"WAVE" + chunks


@pytest.mark.parametrize("bits, kind, within", [(8, 1, 0.02), (16, 1, 1e-4), (24, 1, 1e-6), (32, 1, 1e-6), (32, 3, 1e-7), (64, 3, 1e-7)])
def test_wav_of_every_width(bits, kind, within):
    both = np.column_stack([np.linspace(-0.9, 0.9, 200), np.linspace(0.5, -0.5, 200)])
    rate, signal = audio.wav_signal(wav(both, 8000, bits, kind))
    assert rate == 8000 and np.abs(signal - both.mean(axis=1)).max() < within


@pytest.mark.parametrize("rate", [8000, 22050, 44100, 48000])
def test_resampled_tone_is_the_tone(rate):
    tone = lambda r: np.sin(2 * np.pi * 440 * np.arange(r) / r).astype(np.float32)
    got = audio.resampled(tone(rate), rate)
    assert len(got) == 16000 and np.abs(got - tone(16000))[400:-400].max() < 2e-3


def test_signals_keep_broken_files_apart(spark, tmp_path):
    tone = np.sin(2 * np.pi * 300 * np.arange(16000) / 16000)
    for name, content in (("a.wav", wav(tone, 16000)), ("b.wav", b"RIFF"), ("d.wav", wav(tone, 16000)[:30])):
        (tmp_path / name).write_bytes(content)
    good, bad = audio.signals(spark.read.format("binaryFile").load(str(tmp_path)))
    row = good.withColumn("w", audio.window_of(F.col("samples"), F.lit(0.25), F.lit(0.5))).withColumn("none", audio.window_of(F.col("samples"), F.lit(2.0), F.lit(3.0))).collect()[0]
    assert np.abs(np.array(row["samples"]) - tone).max() < 1e-4 and row["w"] == row["samples"][4000:8000] and row["none"] == []
    assert sorted(r["path"].rsplit("/", 1)[1] for r in bad.collect()) == ["b.wav", "d.wav"]
    good, bad = audio.signals(spark.createDataFrame([("x", None), ("y", b"")], "path string, content binary"))
    assert good.count() == 0 and sorted(r["path"] for r in bad.collect()) == ["x", "y"]


def test_probes(spark, tmp_path):
    said = {"a": {"streams": [{"codec_name": "aac", "bit_rate": "128000"}], "format": {"duration": "1.5", "bit_rate": "9"}}, "b": {"streams": [{"codec_name": "opus"}], "format": {"bit_rate": "64000"}}, "c": {"streams": [], "format": {"duration": "N/A", "bit_rate": "x"}}}
    tool = tmp_path / "tool"
    tool.write_text(f"#!{sys.executable}\nimport sys, json\nprint(json.dumps({said!r}[sys.argv[-1]]))\n")
    tool.chmod(0o755)
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("gone",), (None,)], "path string")
    got = {r["path"]: tuple(r)[1:] for r in audio.probed(rows, str(tool)).collect()}
    assert got == {"a": (1.5, "aac", 128000), "b": (None, "opus", 64000), "c": (None, None, None), "gone": (None,) * 3, None: (None,) * 3}
    assert audio.probed(rows, str(tmp_path / "no tool")).where("codec is not null").count() == 0


def test_spectral_floor(spark):
    rng = np.random.default_rng(1)
    tone = np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000).astype(np.float32)
    assert np.abs(audio.without_floor(tone, ceiling=-1000.0) - tone).max() < 1e-4  # nothing lies below: the frames add up again
    noisy = tone[:3000] + rng.normal(0, 1e-3, 3000).astype(np.float32)
    cleaned, sums, squares = audio.without_floor(noisy), np.zeros(4024), np.zeros(4024)
    hann = np.hanning(1025)[:-1]
    for at in range(0, 3001, 256):
        frame = np.concatenate([np.zeros(512), noisy, np.zeros(512)])[at : at + 1024] * hann
        bins = np.fft.fft(frame)
        half = np.abs(bins[:513])
        under = 20 * np.log10((half + 1e-9) / (half.max() + 1e-9))
        gone = np.flatnonzero(under < min(np.percentile(under, 5) + 6, -55))
        assert len(gone)
        bins[gone] = bins[-gone] = 0
        sums[at : at + 1024] += np.fft.ifft(bins).real * hann
        squares[at : at + 1024] += hann**2
    assert np.abs(cleaned - sums[512:3512] / squares[512:3512]).max() < 1e-6
    rows = spark.createDataFrame([(1, noisy.tolist()), (2, [0.5] * 10), (3, None)], "id int, s array<float>")
    got = {r["id"]: r["s"] for r in rows.select("id", audio.spectral_floor("s").alias("s")).collect()}
    assert np.allclose(got[1], cleaned) and got[2] == [0.5] * 10 and got[3] is None


def looped(events):
    persons, collisions = [], []
    for e in events:
        kind, source, target = e["kind"], e["source"], e["target"]
        if kind == "listed":
            persons = [(i, dict(f)) for i, f in e["persons"]]
        elif kind == "inspected":
            persons = [(i, f | e["person"][1]) if i == e["person"][0] else (i, f) for i, f in persons]
        elif kind == "renamed":
            persons = [(target if i == source else i, f) for i, f in persons]
        elif kind == "merged":
            persons = [(i, f) for i, f in persons if i != source]
            collisions = [c for c in collisions if source not in c[:2]]
        elif kind == "collision":
            collisions = [c for c in collisions if {c[0], c[1]} != {source, target}] + [(source, target, e["similarity"])]
    return persons, collisions


def test_registry_view_against_a_loop(spark):
    rng, events = random.Random(3), []
    for viewer in range(12):
        for seq in range(rng.randint(1, 40)):
            a, b = rng.sample("pqrst", 2)
            kind = rng.choice(["listed"] * (viewer % 3) + ["inspected", "renamed", "merged", "collision", "collision", "pong"])
            person = (a, {rng.choice("xy"): rng.choice(["1", "2", None])}) if kind == "inspected" else None
            listed = [(i, {"x": "0"}) for i in rng.sample("pqrst", 4)] if kind == "listed" else None
            events.append({"viewer": viewer, "seq": seq, "kind": kind, "persons": listed, "person": person, "source": a, "target": b, "similarity": seq / 7})
    rng.shuffle(events)
    schema = f"viewer int, seq long, kind string, persons array<{view.PERSON}>, person {view.PERSON}, source string, target string, similarity double"
    got = {r["viewer"]: ([(p["id"], p["fields"]) for p in r["persons"]], [tuple(c) for c in r["collisions"]]) for r in view.registry_view(spark.createDataFrame(events, schema), "viewer").collect()}
    want = {v: looped(sorted((e for e in events if e["viewer"] == v), key=lambda e: e["seq"])) for v in range(12)}
    assert json.dumps(got, sort_keys=True) == json.dumps(want, sort_keys=True)
