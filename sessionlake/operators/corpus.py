"""Operators on the corpus of sessions: missing and stale sessions, upserts, summaries, merges of persons, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def missing_from(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Rows whose key the index lacks."""
    return rows.join(index.select(key).distinct(), key, "left_anti")


def reconcile(index: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The index and what was found but not indexed; running it twice adds nothing."""
    return index.unionByName(missing_from(found, index, key))


def upsert(index: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Updates replace the rows of their keys."""
    return index.join(updates.select(key).distinct(), key, "left_anti").unionByName(updates)


def stale(now: DataFrame, stamped: DataFrame, key: str, gain: int = 3) -> DataFrame:
    """Keys in both counts (column ``n``) that gained at least ``gain``; those that are gone are never stale."""
    both = now.select(key, F.col("n").alias("n_now")).join(stamped.select(key, F.col("n").alias("n_then")), key)
    return both.where(F.col("n_now") - F.col("n_then") >= gain)


def redo_candidates(sessions: DataFrame, segments: DataFrame, key: str, where=None, before=None, low=None, participants: DataFrame | None = None, takes_part: dict | None = None, only: DataFrame | None = None) -> DataFrame:
    """Sessions that fit every condition given: an own predicate, processed before a time, any weak segment, persons in
    roles (``takes_part`` by role, of rows ``key, id, role``), and being among ``only`` (the stale ones)."""
    for role, person in (takes_part or {}).items():
        sessions = sessions.join(participants.where((F.col("id") == person) & (F.col("role") == role)).select(key), key, "left_semi")
    if only is not None:
        sessions = sessions.join(only.select(key), key, "left_semi")
    for condition in (where, before):
        if condition is not None:
            sessions = sessions.where(condition)
    return sessions if low is None else sessions.join(segments.where(low).select(key), key, "left_semi")


def merge_persons(persons: DataFrame, into: str, counters: list[str], sets: list[str]) -> DataFrame:
    """Persons that share ``into`` become one: counters are summed, sets united in order."""
    return persons.groupBy(into).agg(*[F.sum(c).alias(c) for c in counters], *[F.array_join(F.array_sort(F.collect_set(s)), ",").alias(s) for s in sets])


def merge_into(persons: DataFrame, merges: DataFrame) -> DataFrame:
    """Persons after merges (``id, into``): counters and hours are summed, regions united in the order in which they
    stand (the kept person's first), counts by region summed by key. Names and roles are the kept person's.

    Columns ``id, display_name, n_sessions, hours, regions: array, counts: map``. One step: ``into`` is not merged itself.
    """
    rows = persons.join(merges, "id", "left").withColumns({"_to": F.coalesce("into", "id"), "_own": F.col("into").isNull()})
    each = rows.select("_to", F.explode(F.map_entries("counts")).alias("e")).groupBy("_to", "e.key").agg(F.sum("e.value").alias("n"))
    counts = each.groupBy("_to").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias("counts"))
    order = F.array_sort(F.collect_list(F.struct((~F.col("_own")).alias("other"), "id", "regions")))
    out = rows.groupBy("_to").agg(
        F.max(F.when(F.col("_own"), F.col("display_name"))).alias("display_name"), F.sum("n_sessions").alias("n_sessions"), F.sum("hours").alias("hours"),
        F.array_distinct(F.flatten(F.transform(order, lambda o: F.coalesce(o["regions"], F.array().cast("array<string>"))))).alias("regions"),
    )
    none = F.create_map().cast(persons.schema["counts"].dataType)
    return out.join(counts, "_to", "left").select(F.col("_to").alias("id"), "display_name", "n_sessions", "hours", "regions", F.coalesce("counts", none).alias("counts"))


def merge_edges(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Collision edges ``a, b`` after merges (``id, into``): ends are rewritten, edges to oneself go, each stays once."""
    for x in "ab":
        to = merges.select(F.col("id").alias(x), F.col("into").alias("_to"))
        edges = edges.join(to, x, "left").withColumn(x, F.coalesce("_to", x)).drop("_to")
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def drop_merged(library: DataFrame, merges: DataFrame, person: str = "person_id") -> DataFrame:
    """The voice library without the centroids of persons that were merged away."""
    return library.join(merges.select(F.col("id").alias(person)), person, "left_anti")


def stamped(runs: DataFrame, snapshot: DataFrame, **metadata) -> DataFrame:
    """Rows ``run, id, entry`` and the metadata: the snapshot of the registry that each run is stamped with."""
    return runs.join(F.broadcast(snapshot) if snapshot.limit(10_001).count() <= 10_000 else snapshot).withColumns({k: F.lit(v) for k, v in metadata.items()})


def last_of_pairs(rows: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """Unordered pairs, of repeated ones the last in order; the pair's smaller end comes first."""
    rows = rows.withColumns({a: F.least(a, b), b: F.greatest(a, b)})
    last = Window.partitionBy(a, b).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def to_json_records(rows: DataFrame, value: str) -> DataFrame:
    """One JSON text a row, with every column, nulls too; ``from_json_records`` with the rows' schema gives them back."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias(value))


def from_json_records(lines: DataFrame, value: str, schema: str) -> DataFrame:
    """Records of a fixed schema from JSON text: unknown keys go, missing ones are null, broken text gives nulls."""
    return lines.withColumn("_r", F.from_json(value, schema)).select(*[c for c in lines.columns if c != value], "_r.*")


def aliased(rows: DataFrame, value: str, fields: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Typed columns from JSON text: of each field (kind, names) the first name whose value can be read as that kind."""
    pick = lambda kind, names: F.coalesce(*[F.get_json_object(value, f"$.{n}").try_cast(kind) for n in names])
    return rows.withColumns({name: pick(kind, names) for name, (kind, names) in fields.items()}).drop(value)


def unassigned(clusters: DataFrame, assigned: DataFrame, key: list[str]) -> DataFrame:
    """Clusters that no person was assigned to."""
    return clusters.join(assigned.where("person_id is not null").select(*key), key, "left_anti")


def chunks(rows: DataFrame, by: str, order: str, size: int, overlap: int) -> DataFrame:
    """Adds ``chunk`` and ``keep``: chunks of ``size`` rows that share ``overlap`` rows with the one before.

    ``keep`` marks the copy that a merge takes: of a shared row, the earlier chunk's.
    """
    if size <= 0:
        raise ValueError("size must be positive")
    overlap = max(0, min(overlap, size - 1))
    step = size - overlap
    at = Window.partitionBy(by)
    numbered = rows.withColumn("_i", F.row_number().over(at.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(at))
    last = F.floor(F.greatest(F.lit(0), F.col("_n") - overlap - 1) / step)
    low = F.greatest(F.lit(0), F.floor((F.col("_i") - size) / step) + 1)
    each = numbered.withColumn("chunk", F.explode(F.sequence(low, F.least(last, F.floor(F.col("_i") / step)))))
    return each.withColumn("keep", F.col("chunk") == low).drop("_i", "_n")


def chunk_valid(original: DataFrame, polished: DataFrame, by: str, order: str, within: int) -> DataFrame:
    """Whether a polished chunk kept its rows: as many, each within ``within`` in time, and the same speakers."""
    o, p = (df.select(by, order, F.col("at").alias(f"at_{x}"), F.col("speaker").alias(f"speaker_{x}"), F.lit(True).alias(f"in_{x}")) for df, x in ((original, "o"), (polished, "p")))
    same = F.coalesce(F.col("in_o") & F.col("in_p") & (F.abs(F.col("at_o") - F.col("at_p")) <= within) & F.col("speaker_o").eqNullSafe(F.col("speaker_p")), F.lit(False))
    return o.join(p, [by, order], "full").groupBy(by).agg(F.bool_and(same).alias("is_valid"))
