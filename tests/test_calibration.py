"""The calibration run against a loop."""

import random

import numpy as np
import pytest

from sessionlake.plans import calibration

PREDICTED = "lesson string, seg_idx int, start double, end double, text string, avg_logprob double, no_speech_prob double"
TRUTH = "lesson string, gt_idx int, start double, end double, text string, region string, speaker string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def looped(predicted, truth):
    out = {}
    for lesson, g, start, end, text, region, speaker in truth:
        some = [p for p in predicted if p[0] == lesson and start <= (p[2] + p[3]) / 2 <= end]
        hyp = " ".join((p[4] or "").strip() for p in some).strip()
        ref, got = (text or "").split(), hyp.split()
        mean = lambda k: float(np.mean([p[k] for p in some if p[k] is not None])) if any(p[k] is not None for p in some) else None
        out[lesson, g] = (len(some), hyp, (0.0 if not got else 1.0) if not ref else edits(ref, got) / len(ref), mean(5), mean(6), region or "speaking")
    return out


def test_calibration(spark, tmp_path):
    rng = random.Random(4)
    say = lambda: " ".join(rng.choice("one two three four".split()) for _ in range(rng.randrange(6)))
    truth = [(f"l{k}", g, g * 30.0, g * 30.0 + 30.0, rng.choice([say(), say(), None, " "]), rng.choice([None, "sung_low"]), "s") for k in range(3) for g in range(12)]
    predicted = [(f"l{k}", i, s := rng.randrange(0, 720) / 2, s + rng.choice([1.0, 4.0, 60.0, 0.0]), rng.choice([say(), f" {say()} ", None]), rng.choice([None, -rng.random()]), rng.choice([None, rng.random()])) for k in range(3) for i in range(40)]
    predicted += [("l0", 90, 29.0, 31.0, "edge", -0.5, 0.1), ("other", 0, 1.0, 2.0, "x", -0.1, 0.1)]
    predicted.sort(key=lambda p: (p[0], p[1]))
    p, t = spark.createDataFrame(predicted, PREDICTED).repartition(3), spark.createDataFrame(truth, TRUTH)
    want = looped(predicted, truth)
    rows = calibration.against_truth(p, t)
    for r in rows.collect():
        n, hyp, wer, logprob, silence, region = want[r["lesson"], r["gt_idx"]]
        assert (r["matched_segments"], r["hyp_text"], r["gt_region"]) == (n, hyp, region) and r["wer"] == pytest.approx(wer)
        assert (r["avg_logprob"], r["no_speech_prob"]) == (pytest.approx(logprob), pytest.approx(silence))
    values = calibration.KNOBS["avg_logprob_threshold"][1]
    best = None
    swept = {r["value"]: r for r in calibration.swept(rows).collect()}
    for v in values:
        low, high = ([w[2] for w in want.values() if w[3] is not None and (w[3] < v) == side] for side in (True, False))
        gap = np.mean(low) - np.mean(high) if low and high else None
        assert (swept[v]["n_flagged"], swept[v]["n_unflagged"], swept[v]["separation"]) == (len(low), len(high), pytest.approx(gap))
        if gap is not None and (best is None or gap > best[0]):
            best = (gap, v)
    (chosen,) = calibration.recommended(calibration.swept(rows)).collect()
    assert chosen["value"] == best[1]
    mean = float(np.mean([w[2] for w in want.values()]))
    first = calibration.calibrate(spark, p, t, str(tmp_path), "first", compare="never").first()
    assert (first["n_segments"], first["mean_wer"], first["prior_wer"], first["delta"]) == (36, pytest.approx(mean), None, None)
    again = calibration.calibrate(spark, p.where("seg_idx < 20"), t, str(tmp_path), "second", compare="first").first()
    assert again["prior_wer"] == pytest.approx(mean) and again["delta"] == pytest.approx(again["mean_wer"] - mean)
    assert spark.read.option("header", True).csv(f"{tmp_path}/second/recommended/csv").count() == 1
