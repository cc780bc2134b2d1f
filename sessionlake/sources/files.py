"""Sources: listings of media files, JSON and CSV tables whose unreadable rows are routed aside, glossaries, overrides.

A folder that does not exist gives an empty table. What cannot be read never fails a query: it is data (``bad``) or, for
tables where nothing else makes sense, left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.functions import text

#: File name extensions of media.
MEDIA = (".mp4", ".m4a", ".mp3", ".wav", ".webm", ".ogg", ".flac")
LISTING = "path string, name string, size_bytes long, modified timestamp"
CORRUPT = "_corrupt_record"


def _or_empty(read: Callable[[], DataFrame], spark: SparkSession, schema) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def media_listing(spark: SparkSession, folder: str) -> DataFrame:
    """``path, name, size_bytes, modified`` of the media files below a folder; their content is not read."""

    def read():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        name = F.regexp_extract("path", r"[^\\/]+$", 0)
        rows = files.select("path", name.alias("name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
        return rows.where(F.lower(F.regexp_extract("name", r"\.[^.]*$", 0)).isin(*MEDIA))

    return _or_empty(read, spark, LISTING)


def scan(listing: DataFrame, transcripts: DataFrame, overrides: DataFrame | None = None, teacher_if_short: str | None = None) -> DataFrame:
    """The listing with ``meta`` (from the name, or an override by name), ``file_id``, ``parse_ok, needs_processing``.

    A name that does not parse needs processing; the others do where ``transcripts`` lacks their ``file_id``.
    """
    meta = text.parse_name(F.regexp_replace("name", r"\.[^.]*$", ""), teacher_if_short)
    rows = listing
    if overrides is not None:
        rows = rows.join(overrides.select("name", F.col("meta").alias("_own")), "name", "left")
        meta = F.coalesce("_own", meta)
    rows = rows.withColumn("meta", meta).drop("_own")
    rows = rows.withColumns({"file_id": text.session_id(F.col("meta")), "parse_ok": F.col("meta.date").isNotNull()})
    done = transcripts.select("file_id", F.lit(True).alias("_done")).dropDuplicates(["file_id"])
    return rows.join(done, "file_id", "left").withColumn("needs_processing", ~F.col("parse_ok") | F.col("_done").isNull()).drop("_done")


def json_rows(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of files that hold one JSON object or an array of objects each, and ``path, raw`` of what does not parse."""
    def read():
        whole = spark.read.option("wholetext", "true").text(path)
        return whole.select(F.input_file_name().alias("path"), "value", F.from_json("value", T.ArrayType(schema)).alias("rows"))

    good = _or_empty(lambda: read().select(F.explode("rows").alias("r")).where("r is not null").select("r.*"), spark, schema)
    bad = _or_empty(lambda: read().where("rows is null").select("path", F.col("value").alias("raw")), spark, "path string, raw string")
    return good, bad


def csv_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return _or_empty(lambda: spark.read.schema(schema).option("header", "true").csv(path), spark, schema)


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """``language, term, variant`` of glossary files; a term is a variant of itself, repeated variants count once."""
    schema = T.StructType.fromDDL("language string, notes string, terms map<string, array<string>>")
    good, _ = json_rows(spark, path, schema)
    each = good.select("language", F.explode("terms").alias("term", "variants"))
    variants = F.array_union(F.array("term"), F.coalesce("variants", F.array().cast("array<string>")))
    return each.select("language", "term", F.explode(variants).alias("variant")).withColumn("variant", F.lower("variant")).distinct()


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """``name, meta`` of a file that maps file names to their data; a file that holds no such map has none."""
    meta = "struct<date:string,teacher:string,student:string,language:string>"

    def read():
        whole = spark.read.option("wholetext", "true").text(path)
        return whole.select(F.explode(F.from_json("value", f"map<string,{meta}>")).alias("name", "meta"))

    return _or_empty(read, spark, f"name string, meta {meta}")


def events(lines: DataFrame, schema: str, shown: int = 200) -> DataFrame:
    """``event`` of each line (column ``value``); a line that does not parse becomes ``error``, its first characters."""
    parsed = F.from_json("value", f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})
    rows = lines.select("value", parsed.alias("event"))
    fails = F.col("event").isNull() | F.col(f"event.{CORRUPT}").isNotNull()
    return rows.select(F.when(~fails, F.col("event").dropFields(CORRUPT)).alias("event"), F.when(fails, F.substring("value", 1, shown)).alias("error"))


def folders_with(listing: DataFrame, names: list[str]) -> DataFrame:
    """``folder`` and the path of each name (a struct by name) of the folders that hold files of all these names."""
    folder = F.regexp_extract("path", r"^(.*)[\\/][^\\/]+$", 1)
    rows = listing.where(F.col("name").isin(names)).select(folder.alias("folder"), "name", "path")
    found = rows.groupBy("folder").agg(*[F.min(F.when(F.col("name") == n, F.col("path"))).alias(n) for n in names])
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(f"`{n}`").isNotNull()
    return found.where(whole).select("folder", F.struct(*[F.col(f"`{n}`") for n in names]).alias("paths"))


def lessons(spark: SparkSession, folder: str, audio: str = "audio.wav", truth: str = "ground_truth.json") -> DataFrame:
    """``folder, paths`` of the lessons below a folder: those that hold both the audio and its ground truth."""

    def read():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        return folders_with(files.select("path", F.regexp_extract("path", r"[^\\/]+$", 0).alias("name")), [audio, truth])

    return _or_empty(read, spark, f"folder string, paths struct<`{audio}`:string,`{truth}`:string>")


def region_labels(whole: DataFrame, by_lesson: DataFrame) -> DataFrame:
    """``file, start, end, label``: the aggregate's rows; of files that it lacks, those of the lessons.

    A lesson's rows may name no file; they belong to the lesson's folder (``folder``).
    """
    own = by_lesson.select(F.coalesce("file", F.regexp_extract("folder", r"[^\\/]+$", 0)).alias("file"), "start", "end", "label")
    return whole.select("file", "start", "end", "label").unionByName(own.join(whole.select("file").distinct(), "file", "left_anti"))


def checked(listing: DataFrame, seen: DataFrame) -> DataFrame:
    """The listing with ``is_fresh``: size and time are those seen (``path, size_bytes, modified, sha256``) and, where a
    digest was seen, the content's is the same (``content``, read only for these)."""
    before = seen.select("path", *[F.col(c).alias(f"_{c}") for c in ("size_bytes", "modified", "sha256")])
    same = (F.col("size_bytes") == F.col("_size_bytes")) & (F.col("modified") == F.col("_modified"))
    digest = F.when(F.col("_sha256").isNull(), True).otherwise(F.sha2("content", 256) == F.col("_sha256"))
    return listing.join(before, "path", "left").withColumn("is_fresh", F.coalesce(same & digest, F.lit(False))).drop("_size_bytes", "_modified", "_sha256", "content")
