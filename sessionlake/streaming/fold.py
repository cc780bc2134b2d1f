"""The fold of an event log into a state per file, over a table and as a stream.

Kinds of events: ``start`` resets a file and makes it running, ``phase`` and ``progress`` set its progress, ``done`` ends
it well, ``error`` ends it badly (a later ``done`` does not heal it, a new ``start`` does). Errors of files that no other
event has made known are ignored; any other event makes a file known.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "state string, progress double, n_events long"


def fold_events(events: DataFrame, key: str) -> DataFrame:
    """``key, state, progress, n_events`` (since the last start) from columns ``seq, kind, amount``: two aggregations."""
    first = events.groupBy(key).agg(
        F.max(F.when(F.col("kind") == "start", F.col("seq"))).alias("_started"), F.min(F.when(F.col("kind") != "error", F.col("seq"))).alias("_known")
    )
    since = events.join(first.where("_known is not null"), key).where(F.col("seq") >= F.coalesce("_started", "_known"))
    moved = F.when(F.col("kind") == "phase", 0.0).when(F.col("kind") == "progress", F.col("amount")).when(F.col("kind") == "done", 1.0)
    sums = since.groupBy(key).agg(
        F.bool_or(F.col("kind") == "error").alias("_failed"), F.bool_or(F.col("kind") == "done").alias("_done"),
        F.max_by(moved, F.when(moved.isNotNull(), F.col("seq"))).alias("progress"), F.count(F.lit(1)).alias("n_events"),
    )
    state = F.when(F.col("_failed"), "failed").when(F.col("_done"), "success").otherwise("running")
    return sums.select(key, state.alias("state"), F.coalesce("progress", F.lit(0.0)).alias("progress"), "n_events")


def stream_fold(events: DataFrame, key: str) -> DataFrame:
    """The same as a stream (update mode): the state after each micro-batch of the files it touched.

    Within a micro-batch events are put in order of ``seq``; batches are taken in the order in which they come.
    """

    def step(keys: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, progress, n = held.get if held.exists else (None, 0.0, 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        for kind, amount in zip(rows["kind"], rows["amount"]):
            if kind == "start":
                state, progress, n = "running", 0.0, 0
            elif state is None:
                if kind == "error":
                    continue
                state = "running"
            n += 1
            if kind == "error":
                state = "failed"
            elif kind == "done":
                state, progress = ("failed" if state == "failed" else "success"), 1.0
            elif kind == "phase":
                progress = 0.0
            elif kind == "progress":
                progress = float(amount)
        if state is not None:
            held.update((state, progress, n))
            yield pd.DataFrame({key: [keys[0]], "state": [state], "progress": [progress], "n_events": [n]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


#: Fixed names of the phases of a file, in the order in which they are shown.
PHASES = ("isolation", "vad", "decode", "asr", "alignment", "diarization", "identification", "verification", "polish", "corpus_update")


def phase_number(phase: Column, wire: Column) -> Column:
    """The phase's place from 0: by its name where that is known, else the number on the wire, else 0."""
    at = F.array_position(F.array(*map(F.lit, PHASES)), phase)
    return F.when(at > 0, at - 1).otherwise(F.coalesce(wire.cast("long"), F.lit(0)))


def resolve_paths(events: DataFrame, run: str = "run") -> DataFrame:
    """Adds ``resolved`` to events ``run, seq, kind, file_index, path``: the path that the file's index stood for then.

    An event's own path sets it (``queued`` and ``start`` have one), ``batch_done`` and ``cancelled`` of a run clear all.
    """
    clears = F.col("kind").isin("batch_done", "cancelled")
    batch = F.sum(F.when(clears, 1).otherwise(0)).over(Window.partitionBy(run).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = events.withColumn("_batch", F.coalesce(batch, F.lit(0)))
    up_to = Window.partitionBy(run, "_batch", "file_index").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.when(F.col("file_index").isNotNull(), F.last("path", ignorenulls=True).over(up_to))
    return rows.withColumn("resolved", F.coalesce("path", known)).drop("_batch")


def completed_phases(events: DataFrame, key: str) -> DataFrame:
    """``completed`` (phases in the order of their ends, since the file's last start) and ``message`` (its last warning).

    Events ``seq, kind, phase, message``; files that nothing but warnings, errors and ends made known have no row.
    """
    first = events.groupBy(key).agg(F.max(F.when(F.col("kind") == "start", F.col("seq"))).alias("_started"), F.min(F.when(~F.col("kind").isin("warning", "error", "phase_done"), F.col("seq"))).alias("_known"))
    since = events.join(first.where("_known is not null"), key).where(F.col("seq") >= F.coalesce("_started", "_known"))
    ended = F.collect_list(F.when(F.col("kind") == "phase_done", F.struct("seq", "phase")))
    warned = F.when(F.col("kind") == "warning", F.col("seq"))
    return since.groupBy(key).agg(F.transform(F.array_sort(ended), lambda e: e["phase"]).alias("completed"), F.max_by("message", warned).alias("message"))
