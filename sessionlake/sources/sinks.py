"""Sinks: tables replaced whole by versions, event lines, reports."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The files of a folder that are named by numbers."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n) for n in names if n.isdigit())


def version(spark: SparkSession, path: str) -> int | None:
    """The number of the version last pointed to, by ``replace`` or by ``update``."""
    done = _numbers(spark, f"{path}/done")
    try:
        pointed = spark.read.schema("v long").parquet(f"{path}/pointer").agg(F.max("v")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        pointed = None
    return max([*done, *([pointed] if pointed is not None else [])], default=None)


def replace(rows: DataFrame, path: str) -> int:
    """Writes the rows as the table's next version, then points to it: readers see the old table or the new one.

    The rows may be computed from the current version. A write that was cut off is written over by the next. One writer
    at a time.
    """
    spark = rows.sparkSession
    v = (version(spark, path) or 0) + 1
    rows.write.mode("overwrite").parquet(f"{path}/data/v={v}")
    spark.range(v, v + 1, 1, 1).toDF("v").write.mode("append").parquet(f"{path}/pointer")
    return v


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The version last pointed to; None where nothing was ever written."""
    v = version(spark, path)
    return None if v is None else spark.read.parquet(f"{path}/data/v={v}")


def _created(spark: SparkSession, path: str, content: str) -> bool:
    """Makes a small file with its content unless it is there: of several that try at once, one succeeds."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at.getParent())
    if fs.getScheme() == "file":  # whose own create looks first and makes the file after
        final = unquote(urlparse(str(fs.makeQualified(at).toString())).path)
        with open(f"{final}.{content}", "w") as f:
            f.write(content)
        try:
            os.link(f"{final}.{content}", final)
        except FileExistsError:
            return False
        finally:
            os.unlink(f"{final}.{content}")
        return True
    try:
        out = fs.create(at, False)
    except Exception as error:
        if fs.exists(at):
            return False
        raise error
    out.write(content.encode())
    out.close()
    return True


def _settle(spark: SparkSession, path: str) -> None:
    """Moves the data of commits to their place and points to them, also of those that were cut off in between."""
    to = spark._jvm.org.apache.hadoop.fs.Path
    fs = to(path).getFileSystem(spark._jsc.hadoopConfiguration())
    held = version(spark, path) or 0
    for n in (n for n in _numbers(spark, f"{path}/commits") if n > held):
        stage = spark.read.text(f"{path}/commits/{n}").first()
        if stage is None:
            return  # just being written
        data = to(f"{path}/data/v={n}")
        fs.mkdirs(data.getParent())
        if not fs.exists(data):
            try:
                fs.rename(to(f"{path}/staged/{stage[0]}"), data)
            except Exception:
                if not fs.exists(data):  # else another writer was faster
                    raise
        _created(spark, f"{path}/done/{n}", stage[0])


def update(spark: SparkSession, path: str, make: Callable[[DataFrame | None], DataFrame], tries: int = 20) -> int:
    """The table's next version, made of the current one (None at first) by ``make``; any number of writers at once.

    A version is committed by making a file with its number, which one writer can do; a writer that finds it there begins
    again from the version that was committed, so no writer's change is lost (``replace`` does not look). Data are staged before and moved after: what
    a crash leaves is a stage that nothing points to, or a commit that the next writer carries out.
    """
    for _ in range(tries):
        _settle(spark, path)
        base, stage = version(spark, path) or 0, uuid.uuid4().hex
        make(current(spark, path)).write.parquet(f"{path}/staged/{stage}")
        won = _created(spark, f"{path}/commits/{base + 1}", stage)
        _settle(spark, path)
        if won:
            return base + 1
        left = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/staged/{stage}")
        left.getFileSystem(spark._jsc.hadoopConfiguration()).delete(left, True)
    raise RuntimeError(f"{path}: other writers were faster {tries} times")


def event_lines(rows: DataFrame) -> DataFrame:
    """``value``: one JSON object a row. A null ``timestamp`` is now (UTC), a null ``id`` is left out, other nulls stay."""
    if "timestamp" in rows.columns:
        now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        rows = rows.withColumn("timestamp", F.coalesce(F.col("timestamp").cast("string"), now))
    told = lambda names: F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"})
    line = told(rows.columns)
    if "id" in rows.columns and len(rows.columns) > 1:
        line = F.when(F.col("id").isNull(), told([c for c in rows.columns if c != "id"])).otherwise(line)
    return rows.select(line.alias("value"))


def report(rows: DataFrame, path: str) -> None:
    """A report as CSV with a header in each file, and as JSON lines beside it."""
    rows.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/json")


def append(rows: DataFrame, path: str) -> None:
    """Rows added to a plain table; a retried task adds none twice, a retried call does."""
    rows.write.mode("append").parquet(path)


def finalize(transcript: DataFrame, index: DataFrame, transcripts_path: str, index_path: str, key: str) -> None:
    """The transcript first, then the index: what a crash leaves between them is a transcript that the index lacks,
    which ``corpus.reconcile`` adds. Rows of the index are replaced by key."""
    from sessionlake.operators.corpus import upsert

    append(transcript, transcripts_path)
    held = current(index.sparkSession, index_path)
    replace(index if held is None else upsert(held, index, key), index_path)


def write_library(library: DataFrame, path: str, ring: int = 10) -> int:
    """The voice library ``person_id, name, row_no, vec`` as the table's next version; rings keep their first rows, the newest."""
    return replace(library.where((F.col("name") != "recent") | (F.col("row_no") < ring)), path)
