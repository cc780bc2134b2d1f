"""Audio files as rows: probes of their headers, WAV files as signals of one channel, windows, a floor for noise."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.regions import sample_bounds

RATE = 16000
#: Samples a block: half a minute.
BLOCK = 30 * RATE
PROBE = "streams array<struct<codec_name:string,bit_rate:string>>, format struct<duration:string,bit_rate:string>"
ENTRIES = "stream=codec_name,bit_rate:format=duration,bit_rate"


def probed(listing: DataFrame, tool: str = "ffprobe", timeout: float = 15) -> DataFrame:
    """Adds ``duration_s, codec, bitrate`` of the files at ``path``, as the tool tells them; null where it tells nothing.

    Without the tool, on unreadable files and beyond the timeout all three are null. The first audio stream's bit rate
    stands before the container's. Executors must see the paths.
    """
    command = [tool, "-v", "error", "-select_streams", "a:0", "-show_entries", ENTRIES, "-of", "json"]

    def tell(path: str | None) -> str | None:
        if path is None:
            return None
        try:
            return subprocess.run([*command, path.removeprefix("file:")], capture_output=True, text=True, check=True, timeout=timeout).stdout
        except (OSError, subprocess.SubprocessError, UnicodeDecodeError):
            return None

    @F.pandas_udf("string")
    def told(paths: pd.Series) -> pd.Series:
        return paths.map(tell, na_action=None)

    said = listing.withColumn("_said", F.from_json(told("path"), PROBE))
    first = F.try_element_at("_said.streams", F.lit(1))
    rate = F.coalesce(F.nullif(first["bit_rate"], F.lit("")), F.nullif(F.col("_said.format.bit_rate"), F.lit("")))
    return said.select(
        *listing.columns, F.col("_said.format.duration").try_cast("double").alias("duration_s"),
        first["codec_name"].alias("codec"), rate.try_cast("bigint").alias("bitrate"),
    )


def _form(content: bytes) -> tuple[int, int, int, int, memoryview]:
    """Rate, channels, kind, bits and the data of a WAV file."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
        body = memoryview(content)[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate = (int.from_bytes(body[a:b], "little") for a, b in ((0, 2), (2, 4), (4, 8)))
            if kind == 0xFFFE:  # the extended form names the kind at the start of its identifier
                kind = int.from_bytes(body[24:26], "little")
            form = rate, channels, kind, int.from_bytes(body[14:16], "little")
        elif name == b"data" and form:
            return *form, body
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _mixed(channels: int, kind: int, bits: int, body: memoryview) -> np.ndarray:
    samples = _numbers(kind, bits, body)
    return samples[: len(samples) // channels * channels].reshape(-1, channels).mean(axis=1, dtype=np.float32)


def wav_signal(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples (-1 to 1, the mean of the channels) of a WAV file of whole or floating numbers."""
    rate, *form, body = _form(content)
    return rate, _mixed(*form, body)


def _numbers(kind: int, bits: int, body: memoryview) -> np.ndarray:
    raw = body[: len(body) // (bits // 8) * (bits // 8)]
    if kind == 3:
        return np.frombuffer(raw, {32: "<f4", 64: "<f8"}[bits]).astype(np.float32)
    if kind != 1:
        raise ValueError(f"WAV format {kind}")
    if bits == 8:
        return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    if bits == 24:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        return (wide.view("<i4")[:, 0] / 2.0**31).astype(np.float32)
    return (np.frombuffer(raw, {16: "<i2", 32: "<i4"}[bits]) / 2.0 ** (bits - 1)).astype(np.float32)


def _resampled_part(part: Callable[[int, int], np.ndarray], rate: int, to: int, begin: int, end: int, zeros: int = 32) -> np.ndarray:
    """Samples ``begin`` to ``end`` at the new rate; ``part`` gives samples of the signal, zeros beyond it."""
    cut = min(1.0, to / rate)
    reach = int(np.ceil(zeros / cut))
    offsets, out = np.arange(-reach, reach + 1), np.empty(end - begin, np.float32)
    for first in range(begin, end, 4096):
        places = np.arange(first, min(end, first + 4096)) * (rate / to)
        centre = np.floor(places).astype(np.int64)
        near = part(int(centre[0]) - reach, int(centre[-1]) + reach + 1).astype(np.float64)
        away = places[:, None] - (centre[:, None] + offsets)
        window = np.where(np.abs(away) <= reach, 0.5 + 0.5 * np.cos(np.pi * away / reach), 0.0)
        out[first - begin : first - begin + len(places)] = (near[centre[:, None] + offsets - (centre[0] - reach)] * np.sinc(cut * away) * window).sum(axis=1) * cut
    return out


def _padded(signal: np.ndarray) -> Callable[[int, int], np.ndarray]:
    n = len(signal)
    return lambda a, b: np.pad(signal[max(0, a) : max(0, min(n, b))], (max(0, -a), max(0, b - max(n, a))))


def resampled(signal: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """The signal at another rate, by a windowed sinc, a block at a time."""
    if rate == to or not len(signal):
        return signal
    return _resampled_part(_padded(signal), rate, to, 0, int(np.ceil(len(signal) * to / rate)))


def wav_blocks(content: bytes, to: int = RATE, size: int = BLOCK) -> Iterator[np.ndarray]:
    """A WAV file's samples at the rate, ``size`` at a time: no more of the signal is decoded at once than a block needs."""
    rate, channels, kind, bits, body = _form(content)
    wide = channels * bits // 8
    n = len(body) // wide if wide else 0

    def part(a: int, b: int) -> np.ndarray:
        held = _mixed(channels, kind, bits, body[max(0, a) * wide : max(0, min(n, b)) * wide])
        return np.pad(held, (max(0, -a), max(0, b - max(n, a))))

    total = n if rate == to else int(np.ceil(n * to / rate))
    for begin in range(0, total, size):
        end = min(total, begin + size)
        yield part(begin, end) if rate == to else _resampled_part(part, rate, to, begin, end)


def signal_blocks(files: DataFrame, rate: int = RATE, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Of ``path, content``: ``path, block, samples`` with ``size`` samples a block but the last, and ``path, error``.

    A recording is many rows, so that no row, task or group holds a whole one; the files' own bytes are one row each, as
    the source reads them. A file that breaks off has no blocks. Both results read the files.
    """
    schema = T.StructType.fromDDL("path string, block long, samples array<float>, error string")

    def decode(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    for k, block in enumerate(wav_blocks(content or b"", rate, size)):
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k], pa.int64()), pa.array([block], pa.list_(pa.float32())), pa.array([None], pa.string())], schema.names)
                except (ValueError, KeyError, ArithmeticError) as error:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([None], pa.int64()), pa.array([None], pa.list_(pa.float32())), pa.array([f"{type(error).__name__}: {error}"])], schema.names)

    rows = files.select("path", "content").mapInArrow(decode, schema)
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("path", "error")


def signals(files: DataFrame, rate: int = RATE) -> tuple[DataFrame, DataFrame]:
    """Of ``path, content`` (as the binaryFile source reads them): ``path, samples`` at the rate, and ``path, error``.

    That source has no rows for files of no bytes.
    """
    schema = T.StructType.fromDDL("path string, samples array<float>, error string")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    had, signal = wav_signal(bytes(content or b""))
                    row = (path, resampled(signal, had, rate), None)
                except (ValueError, KeyError, ArithmeticError) as error:
                    row = (path, None, f"{type(error).__name__}: {error}")
                yield pd.DataFrame([row], columns=["path", "samples", "error"])

    rows = files.select("path", "content").mapInPandas(decode, schema)
    return rows.where("error is null").select("path", "samples"), rows.where("error is not null").select("path", "error")


def window_of(samples: Column, start: Column, end: Column, rate: int = RATE) -> Column:
    """The samples between two times in seconds, cut to the signal; empty where nothing lies between."""
    bounds = sample_bounds(start, end, F.size(samples).cast("long"), rate)
    return F.slice(samples, (bounds["first"] + 1).cast("int"), F.greatest(F.lit(0), bounds["after"] - bounds["first"]).cast("int"))


def without_floor(signal: np.ndarray, percentile: float = 5.0, above: float = 6.0, ceiling: float = -55.0, size: int = 1024, hop: int = 256) -> np.ndarray:
    """Frequencies below each frame's own floor of noise are silenced.

    The floor is a percentile of the frame's levels (dB under its peak) and some dB, at most the ceiling. Signals shorter
    than a frame stay as they are.
    """
    if len(signal) < size:
        return signal.astype(np.float32)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    padded = np.pad(signal.astype(np.float64), size // 2)
    starts = np.arange(0, len(padded) - size + 1, hop)
    out, weight = np.zeros(len(padded)), np.zeros(len(padded))
    for begin in range(0, len(starts), 1024):
        some = starts[begin : begin + 1024]
        bins = np.fft.rfft(padded[some[:, None] + np.arange(size)] * window, axis=1)
        level = np.abs(bins)
        level = 20 * np.log10((level + 1e-9) / (level.max(axis=1, keepdims=True) + 1e-9))
        floor = np.minimum(np.percentile(level, percentile, axis=1, keepdims=True) + above, ceiling)
        frames = np.fft.irfft(bins * (level >= floor), size, axis=1) * window
        for at, frame in zip(some.tolist(), frames):
            out[at : at + size] += frame
            weight[at : at + size] += window**2
    kept = slice(size // 2, size // 2 + len(signal))
    return (out[kept] / np.where(weight[kept] > 1e-8, weight[kept], 1.0)).astype(np.float32)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def spectral_floor(samples: pd.Series) -> pd.Series:
    """``without_floor`` over a column of signals; null stays null."""
    return samples.map(lambda s: None if s is None else without_floor(np.asarray(s, np.float32)))
