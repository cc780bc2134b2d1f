"""Pitch contours and loudness of samples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# pitch


def contour(signal: np.ndarray, rate: int = 16000, hop: float = 0.01, low: float = 65.0, high: float = 1100.0, window: float = 0.05, least: float = 0.15, floor: float = 1e-4) -> np.ndarray:
    """The pitch in Hz around every ``hop`` seconds, 0 where nothing is voiced.

    The difference function of each frame with itself moved by every lag, over its own running mean: the first dip under
    ``least`` is the period, refined by a parabola. Sums of products come of one Fourier transform a frame. Frames at the
    ends reach into zeros; those quieter than ``floor`` (root mean square) have no pitch.
    """
    first, last, size, step = max(2, int(rate / high) - 1), int(rate / low) + 2, int(window * rate), int(hop * rate)
    reach = size + last
    padded = np.pad(signal.astype(np.float64), (reach // 2, reach - reach // 2))
    starts, bins = np.arange(0, len(signal) + 1 if len(signal) else 0, step), 1 << int(np.ceil(np.log2(reach + size)))
    out = np.zeros(len(starts))
    for begin in range(0, len(starts), 256):
        some = starts[begin : begin + 256]
        frames = padded[some[:, None] + np.arange(reach)]
        head = np.fft.rfft(frames[:, :size], bins, axis=1)
        cross = np.fft.irfft(np.conj(head) * np.fft.rfft(frames, bins, axis=1), bins, axis=1)[:, : last + 1]
        power = np.concatenate([np.zeros((len(some), 1)), np.cumsum(frames**2, axis=1)], axis=1)
        own, moved = power[:, size], power[:, size : size + last + 1] - power[:, : last + 1]
        differs = np.maximum(own[:, None] + moved - 2 * cross, 0.0)
        mean = np.cumsum(differs[:, 1:], axis=1) / np.arange(1, last + 1)
        share = np.concatenate([np.ones((len(some), 1)), differs[:, 1:] / np.maximum(mean, 1e-12)], axis=1)
        dips = (share[:, 1:-1] < least) & (share[:, 1:-1] <= share[:, 2:]) & (share[:, 1:-1] <= share[:, :-2])
        dips[:, : first - 1] = False
        found = dips.any(axis=1) & (own > size * floor**2)
        lag = dips.argmax(axis=1) + 1
        rows = np.arange(len(some))
        a, b, c = (share[rows, np.clip(lag + k, 0, last)] for k in (-1, 0, 1))
        bend = a - 2 * b + c
        lag = lag + np.where(np.abs(bend) > 1e-12, 0.5 * (a - c) / np.where(np.abs(bend) > 1e-12, bend, 1.0), 0.0)
        out[begin : begin + len(some)] = np.where(found, rate / lag, 0.0)
    return np.where((out >= low) & (out <= high), out, 0.0)


def pitch_contours(rate: int = 16000, **how) -> Callable[[Column], Column]:
    """``contour`` over a column of samples; null stays null."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def contours(samples: pd.Series) -> pd.Series:
        return samples.map(lambda s: None if s is None else contour(np.asarray(s, dtype=np.float32), rate, **how))

    return contours


# loudness

#: Fixed values of the loudness measure: length and step of its blocks in seconds, its two gates, its offset.
LENGTH, STEP, SILENT, BELOW, OFFSET = 0.4, 0.1, -70.0, -10.0, -0.691


def _shelf(rate: int) -> tuple[np.ndarray, np.ndarray]:
    """The high shelf: 4 dB up above 1500 Hz."""
    up, w, q = 10 ** (4.0 / 40), 2 * np.pi * 1500.0 / rate, 1 / np.sqrt(2)
    c, r = np.cos(w), 2 * np.sqrt(up) * np.sin(w) / (2 * q)
    b = up * np.array([up + 1 + (up - 1) * c + r, -2 * (up - 1 + (up + 1) * c), up + 1 + (up - 1) * c - r])
    return b, np.array([up + 1 - (up - 1) * c + r, 2 * (up - 1 - (up + 1) * c), up + 1 - (up - 1) * c - r])


def _pass(rate: int) -> tuple[np.ndarray, np.ndarray]:
    """The high pass at 38 Hz."""
    w = 2 * np.pi * 38.0 / rate
    c, a = np.cos(w), np.sin(w) / (2 * 0.5)
    return np.array([(1 + c) / 2, -(1 + c), (1 + c) / 2]), np.array([1 + a, -2 * c, 1 - a])


def weighted(signal: np.ndarray, rate: int) -> np.ndarray:
    """The signal through both filters, by their common response: their echoes are over within the second added."""
    n = len(signal)
    bins = 1 << int(np.ceil(np.log2(n + rate)))
    z = np.exp(-2j * np.pi * np.arange(bins // 2 + 1) / bins)
    response = np.ones(len(z), dtype=complex)
    for b, a in (_shelf(rate), _pass(rate)):
        response *= (b[0] + b[1] * z + b[2] * z * z) / (a[0] + a[1] * z + a[2] * z * z)
    return np.fft.irfft(np.fft.rfft(signal.astype(np.float64), bins) * response, bins)[:n]


def loudness(blocks: DataFrame, size: int, rate: int = 16000) -> DataFrame:
    """``file_id, n, lufs``: the gated loudness of recordings in blocks (``file_id, block, samples``), null under 0.4 s.

    ``size`` is a multiple of a tenth of a second. Each block is filtered with the second before it, from the block
    before, and gives the power of its tenths; four in a row are one window, windows above the first gate give the second.
    Silent recordings are at minus infinity.
    """
    step = int(STEP * rate)
    if size % step or size < rate:
        raise ValueError("blocks must be whole tenths of a second, and a second at least")
    tail = blocks.select("file_id", (F.col("block") + 1).alias("block"), F.slice("samples", size - rate + 1, rate).alias("_before"))
    rows = blocks.join(tail, ["file_id", "block"], "left")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def powers(before: pd.Series, samples: pd.Series) -> pd.Series:
        def one(b, s):
            s = np.asarray(s, dtype=np.float64)
            b = np.zeros(0) if b is None else np.asarray(b, dtype=np.float64)
            heard = weighted(np.concatenate([b, s]), rate)[len(b) :]
            return (heard[: len(heard) // step * step].reshape(-1, step) ** 2).sum(axis=1) / step
        return pd.Series([one(b, s) for b, s in zip(before, samples)])

    length = blocks.groupBy("file_id").agg(F.sum(F.size("samples")).cast("long").alias("n"))
    tenths = rows.select("file_id", "block", F.posexplode(powers("_before", "samples")).alias("k", "p")).select("file_id", (F.col("block") * (size // step) + F.col("k")).alias("k"), "p")
    wide = round(LENGTH / STEP)
    four = Window.partitionBy("file_id").orderBy("k").rowsBetween(0, wide - 1)
    windows = tenths.select("file_id", F.avg("p").over(four).alias("p"), F.count("p").over(four).alias("m")).where(F.col("m") == wide)
    level = OFFSET + 10 * F.log10("p")
    loud = windows.where((F.col("p") > 0) & (level > SILENT))
    gate = loud.groupBy("file_id").agg((OFFSET + 10 * F.log10(F.avg("p")) + BELOW).alias("_gate"))
    kept = loud.join(gate, "file_id").where(level > F.col("_gate")).groupBy("file_id").agg((OFFSET + 10 * F.log10(F.avg("p"))).alias("_l"))
    told = F.when(F.col("n") >= round(LENGTH * rate), F.coalesce("_l", F.lit(float("-inf"))))
    return length.join(kept, "file_id", "left").select("file_id", "n", told.alias("lufs"))


def normalised(blocks: DataFrame, size: int, target: float | None, rate: int = 16000) -> DataFrame:
    """The blocks at the target loudness. Without a target, under 0.4 s and in silence samples stay as they are."""
    if target is None:
        return blocks
    gain = F.pow(F.lit(10.0), (F.lit(float(target)) - F.col("lufs")) / 20)
    held = loudness(blocks, size, rate).select("file_id", F.when((F.col("lufs") > float("-inf")) & ~F.isnan("lufs"), gain).alias("_gain"))
    kind = blocks.schema["samples"].dataType.elementType
    louder = F.when(F.col("_gain").isNull(), F.col("samples")).otherwise(F.transform("samples", lambda x: (x * F.col("_gain")).cast(kind)))
    return blocks.join(held, "file_id", "left").withColumn("samples", louder).select(*blocks.columns)
