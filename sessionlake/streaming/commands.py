"""Command lines: checked as a table or as a stream; every refused line becomes data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def check_commands(lines: DataFrame, allowed: dict[str, list[str]], column: str = "value") -> DataFrame:
    """The lines with ``cmd, fields`` (other names, sorted) and ``refused``, the first that holds: ``empty_line,
    invalid_json, not_an_object, no_command, unknown_command, unknown_fields``; null for a valid command."""
    known = F.create_map(*[x for name, fields in allowed.items() for x in (F.lit(name), F.array(*map(F.lit, fields)).cast("array<string>"))])
    rows = lines.withColumn("_v", F.try_parse_json(column)).withColumn("_c", F.try_variant_get("_v", "$.cmd", "variant"))
    rows = rows.withColumns({
        "cmd": F.when(F.schema_of_variant("_c") == "STRING", F.try_variant_get("_v", "$.cmd", "string")),
        "fields": F.array_sort(F.array_remove(F.map_keys(F.try_variant_get("_v", "$", "map<string,variant>")), "cmd")),
    })
    refused = (
        F.when(F.trim(F.coalesce(F.col(column), F.lit(""))) == "", "empty_line").when(F.col("_v").isNull(), "invalid_json")
        .when(~F.schema_of_variant("_v").startswith("OBJECT"), "not_an_object").when(F.col("cmd").isNull(), "no_command")
        .when(~F.map_contains_key(known, F.col("cmd")), "unknown_command").when(F.size(F.array_except("fields", known[F.col("cmd")])) > 0, "unknown_fields")
    )
    return rows.withColumn("refused", refused).drop("_v", "_c")


def command_stream(spark: SparkSession, folder: str, allowed: dict[str, list[str]]) -> DataFrame:
    """The lines of files that arrive in a folder, checked, as a stream."""
    return check_commands(spark.readStream.text(folder), allowed)


def rewritten(lines: DataFrame, column: str = "value") -> DataFrame:
    """A viewer's command lines as the engine takes them: ``command`` (JSON) and ``refused``, the first that holds of
    ``not_an_object, no_command, bad_files``; other columns pass.

    The name is ``cmd``, else ``type``, which goes. Files of ``process_batch`` become paths (strings, or objects with a
    ``path``; without a list there are none). ``scan_files`` takes ``inputDir`` as ``input_dir`` unless that is a string,
    and asks for durations unless it says itself whether to.
    """
    kind = lambda c: F.schema_of_variant(c)
    at = lambda path, of="string": F.try_variant_get("_v", path, of)
    said = lambda name: F.when(kind(at(f"$.{name}", "variant")) == "STRING", at(f"$.{name}"))
    rows = lines.withColumn("_v", F.try_parse_json(column)).withColumn("_cmd", F.nullif(F.coalesce(said("cmd"), said("type")), F.lit("")))
    path = lambda f: F.when(kind(f) == "STRING", F.try_variant_get(f, "$", "string")).when(kind(F.try_variant_get(f, "$.path", "variant")) == "STRING", F.nullif(F.try_variant_get(f, "$.path", "string"), F.lit("")))
    rows = rows.withColumn("_files", F.coalesce(F.transform(at("$.files", "array<variant>"), path), F.array().cast("array<string>")))
    batch, scan = F.col("_cmd") == "process_batch", F.col("_cmd") == "scan_files"
    entry = lambda name, value: F.map_from_entries(F.array(F.struct(F.lit(name).alias("key"), value.alias("value"))))
    none = F.create_map().cast("map<string,variant>")
    given = F.map_filter(at("$", "map<string,variant>"), lambda k, v: ~k.isin("type", "cmd"))
    dropped = F.map_filter(given, lambda k, v: ~((batch & (k == "files")) | (scan & ((k == "inputDir") | ((k == "input_dir") & (kind(v) != "STRING") & said("inputDir").isNotNull()) | ((k == "probe_duration") & (kind(v) != "BOOLEAN"))))))
    dropped = F.coalesce(dropped, none)
    more = F.map_concat(
        entry("cmd", F.col("_cmd").cast("variant")), F.when(batch, entry("files", F.to_variant_object("_files"))).otherwise(none),
        F.when(scan & said("inputDir").isNotNull() & said("input_dir").isNull(), entry("input_dir", said("inputDir").cast("variant"))).otherwise(none),
        F.when(scan & F.coalesce(kind(at("$.probe_duration", "variant")) != "BOOLEAN", F.lit(True)), entry("probe_duration", F.lit(True).cast("variant"))).otherwise(none),
    )
    refused = (
        F.when(~F.coalesce(kind(F.col("_v")).startswith("OBJECT"), F.lit(False)), "not_an_object").when(F.col("_cmd").isNull(), "no_command")
        .when(batch & F.exists("_files", lambda f: f.isNull()), "bad_files")
    )
    rows = rows.withColumn("refused", refused)
    return rows.withColumn("command", F.when(F.col("refused").isNull(), F.to_json(F.map_concat(dropped, more), {"ignoreNullFields": "false"}))).drop("_v", "_cmd", "_files")


def redo_filters(inputs: DataFrame) -> DataFrame:
    """What a redo asks for, from what was typed: ``everything`` (boolean), ``threshold, student, teacher, confidence,
    after`` (strings) give ``all, threshold, student, teacher, confidence_below, after``, null where left out.

    Numbers are read as far as they go (``12 h`` is 12), others count as left out, and so do blanks and confidences of 0
    or less. With ``everything`` all other terms are left out. Other columns pass.
    """
    everything = F.coalesce("everything", F.lit(False))
    number = lambda c, pattern, to: F.regexp_extract(c, r"^\s*(" + pattern + ")", 1).try_cast(to)
    blank = lambda c: F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))
    sure = number("confidence", r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", "double")
    terms = {"threshold": number("threshold", "[+-]?[0-9]+", "long"), "student": blank("student"), "teacher": blank("teacher"), "confidence_below": F.when(sure > 0, sure), "after": blank("after")}
    own = [F.col(f"`{c}`") for c in inputs.columns if c not in ("everything", "threshold", "student", "teacher", "confidence", "after")]
    return inputs.select(*own, F.when(everything, True).alias("all"), *[F.when(~everything, c).alias(n) for n, c in terms.items()])
