"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import gc
import hashlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word of the letter-and-digit kind become blanks and A-Z become a-z; UTF-8 bytes stay.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
#: Only A-Z become a-z.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; null has none."""
    return text.translate(FOLD).split() if text else []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where it is unset a temporary folder serves, on ``local`` masters only: on a cluster, executors would not share it.
    """
    context = spark.sparkContext
    set_dir = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not set_dir:
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(set_dir)
    return set_dir


_SCRATCH: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables ``written`` inside are deleted at the end, but for those to be kept: what is left over must not read them."""
    paths: list[str] = []
    before = _SCRATCH.set(paths)
    try:
        yield
    finally:
        _SCRATCH.reset(before)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, keep: bool = False) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: cuts lineage, survives lost executors.

    Inside ``scratch`` the files go at its end unless they are to be kept; others are left in
    ``<shared folder>/sessionlake/<application>`` for the application's life. Shuffle files of the rows' computation go as
    soon as they are written, and not only when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sessionlake/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    held = _SCRATCH.get()
    if held is not None and not keep:
        held.append(path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """The driver collects its garbage: tables broadcast by earlier plans, and the plans, are dropped by Spark only then.

    For loops of many small plans, once a round: each broadcast table takes some MB of the driver however few its rows,
    and a heap that has grown by them stays large.
    """
    gc.collect()  # Python's names of the JVM's objects first
    spark._jvm.System.gc()


def tidy(run):
    """A task's function over batches, after which the worker gives back what it held: idle Python workers stay small."""

    @functools.wraps(run)
    def held(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return held


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def hex_sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


class WordHashes(dict):
    """64-bit hashes of words; those of up to 64 bytes are remembered, up to a bound in number and so in bytes."""

    def __init__(self, bound: int = 100_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[word] = value
        return value


BATCH_ROWS, ARROW_ROWS = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def lean(docs: DataFrame) -> DataFrame:
    """The documents, with the session set to hand at most BATCH_ROWS rows at a time to Python: texts are long, and the
    buffers of a batch stand both in the JVM and in its worker."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(ARROW_ROWS)) <= BATCH_ROWS:
        conf.set(ARROW_ROWS, str(BATCH_ROWS))
    return docs


def binary_text(column: str = "text"):
    """The text as UTF-8 bytes; null stays null."""
    return F.col(column).cast("string").cast("binary")


#: Bits of a Bloom filter (8 MB), as a power of two.
BITS = 26
_P = np.uint64(0x9E3779B97F4A7C15)


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each hash."""
    mixed = (hashes ^ (hashes >> np.uint64(33))) * _P
    shift = np.uint64(64 - BITS)
    return (mixed >> shift).astype(np.int64), ((mixed * _P) >> shift).astype(np.int64)


def bloom(hashes: DataFrame) -> np.ndarray:
    """The filter's bits. Tasks turn hashes (column ``anchor``) into set words of the filter, a shuffle unites them: at most 2^20 rows."""

    def run(batches):
        for batch in batches:
            a, b = _slots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            both = np.unique(np.concatenate([a, b]))
            bits = np.left_shift(np.int64(1), (both & 63).astype(np.int64))
            at = both >> 6
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.array([], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at[first]), pa.array(np.bitwise_or.reduceat(bits, first) if len(first) else np.array([], dtype=np.int64))], ["at", "bits"])

    rows = hashes.select("anchor").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # as rows of Python they would fill the driver
    out = np.zeros(1 << (BITS - 6), dtype=np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out


def in_bloom(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets through: all that it was made of, and some others."""
    a, b = _slots(hashes)
    return ((bits[a >> 6] >> (a & 63)) & (bits[b >> 6] >> (b & 63)) & 1).astype(bool)
