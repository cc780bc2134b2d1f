"""The registry as its viewers see it, folded from their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERSON = "struct<id:string,fields:map<string,string>>"
COLLISION = "struct<a:string,b:string,similarity:double>"
STATE = f"struct<persons:array<{PERSON}>,collisions:array<{COLLISION}>>"


def _persons(held: Column, e: Column) -> Column:
    overlaid = lambda old, new: F.map_zip_with(old, new, lambda k, o, n: F.when(F.map_contains_key(new, k), n).otherwise(o))
    inspected = lambda p: F.when(p["id"] == e["person"]["id"], F.struct(p["id"].alias("id"), overlaid(p["fields"], e["person"]["fields"]).alias("fields"))).otherwise(p)
    renamed = lambda p: F.when(p["id"] == e["source"], F.struct(e["target"].alias("id"), p["fields"].alias("fields"))).otherwise(p)
    return (
        F.when(e["kind"] == "listed", e["persons"]).when(e["kind"] == "inspected", F.transform(held, inspected))
        .when(e["kind"] == "renamed", F.transform(held, renamed)).when(e["kind"] == "merged", F.filter(held, lambda p: p["id"] != e["source"])).otherwise(held)
    )


def _collisions(held: Column, e: Column) -> Column:
    pair = lambda c, a, b: F.struct(F.least(c[a], c[b]), F.greatest(c[a], c[b]))
    others = F.filter(held, lambda c: pair(c, "a", "b") != pair(e, "source", "target"))
    met = F.struct(e["source"].alias("a"), e["target"].alias("b"), e["similarity"].alias("similarity"))
    apart = F.filter(held, lambda c: (c["a"] != e["source"]) & (c["b"] != e["source"]))
    return F.when(e["kind"] == "collision", F.array_append(others, met)).when(e["kind"] == "merged", apart).otherwise(held)


def registry_view(events: DataFrame, viewer: str) -> DataFrame:
    """``persons`` and ``collisions`` of each viewer after its events, in the order of ``seq``.

    Events have ``kind, persons, person, source, target, similarity`` (persons as ``id, fields``): ``listed`` replaces all
    persons, ``inspected`` lays its fields over the person's, ``renamed`` gives source the id target, ``merged`` drops
    source and its collisions, ``collision`` replaces that of the same two persons, whichever stands first. Other kinds
    change nothing. What came before a viewer's last list is not folded, but for its collisions.
    """
    last = F.max(F.when(F.col("kind") == "listed", F.col("seq"))).over(Window.partitionBy(viewer))
    of_use = (F.col("seq") >= F.coalesce("_last", "seq")) | F.col("kind").isin("merged", "collision")
    fields = ["seq", "kind", "persons", "person", "source", "target", "similarity"]
    rows = events.withColumn("_last", last).where(of_use).groupBy(viewer).agg(F.array_sort(F.collect_list(F.struct(*fields)), lambda x, y: F.when(x["seq"] < y["seq"], -1).when(x["seq"] > y["seq"], 1).otherwise(0)).alias("_events"))
    start = F.from_json(F.lit('{"persons": [], "collisions": []}'), STATE)
    step = lambda s, e: F.struct(_persons(s["persons"], e).alias("persons"), _collisions(s["collisions"], e).alias("collisions"))
    return rows.select(viewer, F.aggregate("_events", start, step).alias("_view")).select(viewer, "_view.persons", "_view.collisions")
