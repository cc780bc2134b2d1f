"""Edits of the person registry as tables: registration, renames, edits, collision edges, and the gate of updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VALID_ID = "^[a-z0-9_]+$"
ROLES = ("teacher", "student")
#: Mean confidence below which a person's library is never updated, and the one that a new person needs.
FLOOR, NEW_FLOOR, TRUSTED_AFTER = 0.65, 0.75, 3


def register(persons: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """The new rows with ``refused``: null, or the first of ``bad_id, bad_role, id_taken, name_taken`` that holds.

    A display name may be shared only by a row with a ``disambiguator``. Of well-formed rows of one request that share
    an id or a name, those after the first in ``order`` count as taken.
    """
    ill = F.when(~F.coalesce(F.col("id").rlike(VALID_ID), F.lit(False)), "bad_id").when(~F.coalesce(F.col("default_role").isin(*ROLES), F.lit(False)), "bad_role")
    rows = new.withColumn("_ill", ill)
    taken = lambda key: persons.select(key, F.lit(True).alias(f"_{key}")).dropDuplicates([key])
    rows = rows.join(taken("id"), "id", "left").join(taken("display_name"), "display_name", "left")
    nth = lambda key: F.row_number().over(Window.partitionBy(key, F.col("_ill").isNull()).orderBy(order)) > 1
    rows = rows.withColumns({"_again": nth("id"), "_named": nth("display_name")})
    refused = F.coalesce("_ill", F.when(F.col("_id").isNotNull() | F.col("_again"), "id_taken").when((F.col("_display_name").isNotNull() | F.col("_named")) & F.col("disambiguator").isNull(), "name_taken"))
    return rows.withColumn("refused", refused).select(*[F.col(f"`{c}`") for c in new.columns], "refused")


def rename(rows: DataFrame, key: str, renames: DataFrame) -> DataFrame:
    """Rows whose key is an ``old_id`` of the renames take its ``new_id``; ids that are not valid change nothing."""
    valid = renames.where(F.col("new_id").rlike(VALID_ID)).select(F.col("old_id").alias(key), F.col("new_id").alias("_new")).dropDuplicates([key])
    moved = rows.join(valid, key, "left").withColumn(key, F.coalesce("_new", key))
    return moved.select(*[F.col(f"`{c}`") for c in rows.columns])


def edit(persons: DataFrame, changes: DataFrame, editable: list[str]) -> tuple[DataFrame, DataFrame]:
    """Persons after ``changes`` (``id, field, value, seq``; the last of a field wins, null clears it), and the changes
    refused: of fields that may not be edited, or of persons that do not exist."""
    fits = changes.where(F.col("field").isin(*editable))
    last = [F.max_by(F.struct(F.col("value")), F.when(F.col("field") == f, F.col("seq"))).alias(f"_{f}") for f in editable]
    rows = persons.join(fits.groupBy("id").agg(*last), "id", "left")
    for f in editable:
        rows = rows.withColumn(f, F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.value").cast(persons.schema[f].dataType)).otherwise(F.col(f)))
    refused = changes.where(~F.coalesce(F.col("field").isin(*editable), F.lit(False))).unionByName(fits.join(persons.select("id"), "id", "left_anti"))
    return rows.select(*[F.col(f"`{c}`") for c in persons.columns]), refused


def collision_edges(pairs: DataFrame) -> DataFrame:
    """``id, other`` both ways for pairs ``a, b``; a person never collides with itself."""
    pairs = pairs.where("a <> b")
    return pairs.selectExpr("a as id", "b as other").union(pairs.selectExpr("b", "a")).distinct()


def inspect(persons: DataFrame, vectors: DataFrame) -> DataFrame:
    """Persons with ``voices``, the sorted names of their vectors (``id, name``); without any, an empty list."""
    names = vectors.groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("voices"))
    return persons.join(names, "id", "left").withColumn("voices", F.coalesce("voices", F.array().cast("array<string>")))


def display(name, mark):
    """``Name`` or ``Name (mark)``."""
    return F.when(F.length(mark) > 0, F.concat(name, F.lit(" ("), mark, F.lit(")"))).otherwise(name)


def update_gate(
    segments: DataFrame, persons: DataFrame, key: str, regions: list[str], default: str,
    floor: float = FLOOR, new_floor: float = NEW_FLOOR, min_clip: float = 0.5, min_region: float = 10.0, redo: bool = False,
) -> DataFrame:
    """``key, decision, remaining``: whether the segments (``region, length, confidence``) may update a person's library.

    ``rejected`` below the floor, ``held`` below the floor of new persons (``remaining`` 1 or 2), ``short`` where no
    region has enough audio in clips that are long enough, else ``updated``, which counts ``remaining`` down unless it
    is a redo. Null confidences are 0; unknown regions are the default; persons without a clip do not appear.
    """
    region = F.when(F.col("region").isin(*regions), F.col("region")).otherwise(default)
    clip = F.when(F.col("length") >= min_clip, F.col("length"))
    parts = segments.withColumn("region", region).groupBy(key, "region").agg(
        F.sum(clip).alias("_audio"), F.sum(F.coalesce("confidence", F.lit(0.0))).alias("_sum"), F.count(F.lit(1)).alias("_n")
    )
    each = parts.groupBy(key).agg(F.max("_audio").alias("_audio"), (F.sum("_sum") / F.sum("_n")).alias("_mean")).where("_audio is not null")
    left = F.col("remaining")
    decision = (
        F.when(F.col("_mean") < floor, "rejected").when((left > 0) & (left < TRUSTED_AFTER) & (F.col("_mean") < new_floor), "held")
        .when(F.col("_audio") < min_region, "short").otherwise("updated")
    )
    judged = each.join(persons.select(key, "remaining"), key).withColumn("decision", decision)
    down = F.lit(False) if redo else (F.col("decision") == "updated") & (left > 0)
    return judged.select(key, "decision", F.when(down, left - 1).otherwise(left).alias("remaining"))


#: Glossaries of up to so many variants are looked up inside a text's array of words.
FEW_VARIANTS = 10_000


def glossary_hits(docs: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """``key, term, n``: how often the words (letters a-z) of a text are variants (``term, variant``) of a term.

    Words that are no variants go before the texts are taken apart, unless the glossary has too many to be sent along:
    then every word meets it in a join. The hits are the same.
    """
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    few = terms.select("variant").where("variant is not null").distinct().limit(FEW_VARIANTS + 1).collect()
    if len(few) <= FEW_VARIANTS:
        found = F.filter(found, lambda w: w.isin([r["variant"] for r in few]))
    words = docs.select(key, F.explode(found).alias("variant"))
    return words.join(terms, "variant").groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def fix_terms(column, variants: dict[str, str]):
    """The text with variants, as whole words, replaced by their terms."""
    return reduce(lambda c, v: F.regexp_replace(c, rf"\b{v[0]}\b", v[1]), variants.items(), column)
