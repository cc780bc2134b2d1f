"""A sink of event lines that takes each micro-batch once, and error events for lines that are no events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionlake.sources.sinks import event_lines


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the batch's event lines as text under ``path/batch=<number>``.

    A batch that is played again is written over by itself, so it adds nothing, whether it was cut off or whole.
    """

    def write(rows: DataFrame, number: int) -> None:
        event_lines(rows).write.mode("overwrite").text(f"{path}/batch={number}")

    return write


def write_events(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a stream of events into the sink; the checkpoint names the batches, so it belongs to the path for good."""
    return rows.writeStream.foreachBatch(batch_writer(path)).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What the sink holds, with the number of each row's ``batch``."""
    return spark.read.text(path).select("batch", F.from_json("value", schema).alias("e")).select("batch", "e.*")


def dispatched(checked: DataFrame, column: str = "value", told: int = 200) -> DataFrame:
    """Events for checked command lines (``commands.check_commands``): ``accepted`` with the command's name, and one
    ``error`` a refused line with its reason and the first ``told`` characters of the line."""
    bad = F.col("refused").isNotNull()
    return checked.select(
        F.when(bad, "error").otherwise("accepted").alias("type"), F.when(~bad, F.col("cmd")).alias("cmd"), F.col("refused").alias("error_type"),
        F.when(bad, F.substring(column, 1, told)).alias("raw"), F.lit(None).cast("string").alias("timestamp"),
    )
