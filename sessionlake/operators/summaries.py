"""Summaries of the corpus, of scans and of batches; means and choices of calibration runs; pitch ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def corpus_summary(sessions: DataFrame, persons: DataFrame, hours: str = "total_hours") -> DataFrame:
    """One row: ``n_sessions, n_persons, total_hours``; no sum is null for an empty corpus."""
    of = sessions.agg(F.count(F.lit(1)).alias("n_sessions"))
    return of.join(persons.agg(F.count(F.lit(1)).alias("n_persons"), F.coalesce(F.sum(hours), F.lit(0).cast(persons.schema[hours].dataType)).alias("total_hours")))  # one row beside one


def sessions_by_person(sessions: DataFrame, person: str, amount: str) -> DataFrame:
    """``n_sessions`` and ``total`` (an exact decimal, as text) of every person."""
    return sessions.groupBy(person).agg(F.count(F.lit(1)).alias("n_sessions"), F.sum(F.col(amount).cast("decimal(18,2)")).cast("string").alias("total"))


def snapshot(persons: DataFrame) -> DataFrame:
    """``id, entry``: how many sessions each person had and in which regions, sorted; what a run is stamped with.

    A table, not one map: the stamp of a run grows with the registry.
    """
    regions = F.array_sort(F.coalesce("observed_regions", F.array().cast("array<string>")))
    return persons.select("id", F.struct("n_sessions", regions.alias("regions")).alias("entry"))


def scan_summary(files: DataFrame, processed: Column) -> DataFrame:
    """One row: ``total, processed, fresh``."""
    done = F.count_if(processed)
    return files.agg(F.count(F.lit(1)).alias("total"), done.alias("processed"), (F.count(F.lit(1)) - done).alias("fresh"))


def batch_result(files: DataFrame, ok: Column) -> DataFrame:
    """One row a batch: ``n_ok, n_failed``. The failures are ``batch_failures``, rows of their own."""
    return files.groupBy("batch").agg(F.count_if(ok).alias("n_ok"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_failed"))


def batch_failures(files: DataFrame, ok: Column) -> DataFrame:
    return files.where(~F.coalesce(ok, F.lit(False)))


def mean_change(runs: DataFrame, run: str, measure: str, old, new) -> DataFrame:
    """One row: the means of two runs, nulls left out, and the change; null where a run has none."""
    mean = lambda r: F.avg(F.when(F.col(run) == r, F.col(measure)))
    return runs.agg(mean(old).alias("mean_old"), mean(new).alias("mean_new")).withColumn("change", F.col("mean_new") - F.col("mean_old"))


def best_by(rows: DataFrame, measure: str, order: str) -> DataFrame:
    """The row of the largest measure, the first in order on ties; nulls never win."""
    return rows.where(F.col(measure).isNotNull()).orderBy(F.desc(measure), order).limit(1)


def percentiles(rows: DataFrame, by: str, value: str, places: int = 6) -> DataFrame:
    """``p5, p50, p95`` (linear) and ``spread`` (of the population) of each group."""
    p = lambda x: F.round(F.percentile(value, F.lit(x)), places)
    return rows.groupBy(by).agg(p(0.05).alias("p5"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.round(F.stddev_pop(value), places).alias("spread"))


def pitch_ranges(frames: DataFrame, persons: DataFrame, key: str, pitch: str, least: int = 100) -> DataFrame:
    """``key, low, high``: the range a person is known by, widened by the 5th and 95th percentile of voiced frames.

    Persons with fewer than ``least`` voiced frames keep their range; a range never narrows.
    """
    seen = frames.where(F.col(pitch) > 0).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.percentile(pitch, F.lit(0.05)).alias("l"), F.percentile(pitch, F.lit(0.95)).alias("h")).where(F.col("n") >= least)
    return persons.select(key, "low", "high").join(seen, key, "left").select(key, F.least("low", "l").alias("low"), F.greatest("high", "h").alias("high"))


def top_of_each(rows: DataFrame, by: str, value: str, tie: str, size: int) -> DataFrame:
    """The rows of the largest values of each group, with ``rank`` from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value), tie))).where(F.col("rank") <= size)


def phase_pairs(rows: DataFrame, by: str, kind: str, start: str, begins: str, ends: str, order: str) -> DataFrame:
    """Rows of a begin whose next row of either kind is an end, with ``elapsed``; a begin without one has no row."""
    w = Window.partitionBy(by).orderBy(start, order)
    both = rows.where(F.col(kind).isin(begins, ends)).withColumns({"_k": F.lead(kind).over(w), "_s": F.lead(start).over(w)})
    return both.where((F.col(kind) == begins) & (F.col("_k") == ends)).withColumn("elapsed", F.col("_s") - F.col(start)).drop("_k", "_s")


def display_order(files: DataFrame, by: str, sort: str, name: str = "name", key: str = "id") -> DataFrame:
    """Adds ``place``: the row's number, from 0, in the order in which its group (``by``) is shown.

    ``sort`` is the name column, in which marks and case come after letters (a, A, á, b), or a number, the largest first.
    Ties come in order of ``key``; missing values last.
    """
    order = F.asc_nulls_last(F.collate(name, "UNICODE")) if sort == name else F.desc_nulls_last(sort)
    return files.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order, key)) - 1)
