"""Sharding by proportional stratified interleaving.

Rows are ranked in a seeded order within their source, sorted by fractional rank ``(rank + 1/2) / rows of the source``
and cut into shards of near equal counts, so every shard has the mixture of the whole. All ranks are exact and global:
rows fall into many small buckets of the sort key, whose counts are summed; only the order within a bucket is a window,
so a hot source is spread over all tasks. No text is shuffled.

Null sources are a source of their own; null texts have no bytes (size 16, CRC 0); rows that agree in doc_id and text
are placed in any order among themselves. Fewer rows than shards leave shards empty. Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OVERHEAD = 16


def _ranked(rows: DataFrame, group: list[str], bucket: str, order: list, name: str) -> DataFrame:
    """Adds the rank from 0 within the group by (bucket, order); counts of buckets give each bucket's first rank."""
    counts = rows.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order)
    ranked = rows.withColumn("_in", F.row_number().over(inside) - 1).join(starts, [*group, bucket])
    return ranked.withColumn(name, F.col("_first") + F.col("_in")).drop("_first", "_in")


def interleave(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_rows: int = 20_000) -> DataFrame:
    """Returns ``doc_id, source, size, text_crc32, law, shard, slot``; the law is ``rows``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        "source",
        (F.length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_s"),
        F.xxhash64(F.lit(seed), F.col("doc_id")).alias("_h"),
    )
    sizes = docs.groupBy(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_s")).agg(F.count(F.lit(1)).alias("_of"))
    total = docs.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    buckets = max(1, -(-total // bucket_rows))
    even = F.shiftrightunsigned("_h", 1) / float(1 << 63)  # in [0, 1)
    rows = rows.withColumn("_b", F.floor(even * buckets))
    rows = _ranked(rows, ["_s"], "_b", [F.shiftrightunsigned("_h", 1), F.col("doc_id"), F.col("text_crc32")], "_rank").drop("_b")
    rows = rows.join(sizes, "_s").withColumn("_f", (F.col("_rank") * 2 + 1) / (F.col("_of") * 2))
    rows = rows.withColumn("_b", F.floor(F.col("_f") * buckets)).withColumn("_all", F.lit(0))
    order = [F.col("_f"), F.col("_s"), F.col("_rank")]
    rows = _ranked(rows, ["_all"], "_b", order, "_at")
    rows = rows.withColumn("shard", F.expr(f"cast(_at * {shards} div {max(total, 1)} as int)"))
    first = F.expr(f"(shard * {max(total, 1)} + {shards} - 1) div {shards}")
    return rows.select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_at") - first).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Writes the documents as one folder a shard, in slot order within a file."""
    by_id = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    by_id.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
