"""The library of voices: bootstrap of persons, and updates folded in session order onto what is stored.

Stored are two tables: the library (``person_id, name, row_no, vec``: a centroid a region, ``universal``, and the ring
``recent`` with the newest at row_no 0) and the persons with their counters (PERSON). ``state_of`` makes one row a person
of them, ``fold_library`` takes that state and new updates to the next state, ``library_rows`` and ``person_rows`` give the
tables back. A person's state is small: a vector a region and RING more.
"""

from __future__ import annotations

from collections import deque
from math import sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .matching import dot

RING = 10


def unit(vec: Column) -> Column:
    """The vector over its norm (plus 1e-9), in double."""
    norm = F.sqrt(dot(vec, vec)) + 1e-9
    return F.transform(vec, lambda x: x.cast("double") / norm)


def bootstrap(clusters: DataFrame, person: str, vec: str) -> DataFrame:
    """Library rows ``person_id, name, row_no, vec`` of new persons: the universal centroid and a ring of one."""
    rows = clusters.select(F.col(person).alias("person_id"), unit(F.col(vec)).alias("vec"))
    return rows.select("person_id", F.explode(F.array(F.lit("universal"), F.lit("recent"))).alias("name"), F.lit(0).alias("row_no"), "vec")


def universal(vectors: DataFrame, by: str, vec: str) -> DataFrame:
    """The unweighted mean of each group's vectors, normalised."""
    from .matching import mean_vectors

    return mean_vectors(vectors, by, vec).select(by, unit(F.col("centroid")).alias("centroid"))


#: Fixed names of the regions that a library holds, the one that all others count as, and the shares that gate updates.
REGIONS, DEFAULT_REGION = ("speaking", "sung_low", "sung_mid", "sung_high", "sung_full"), "speaking"
PERSON = (
    "id string, n_sessions_as_teacher long, n_sessions_as_student long, total_hours double, first_seen string, last_updated string, "
    "observed_regions array<string>, region_session_counts map<string,long>, bootstrap_sessions_remaining int"
)
STATE = "person_id string, person struct<%s>, centroids map<string,array<double>>, universal array<double>, ring array<array<double>>" % PERSON.replace(" ", ":").replace(",:", ",")
#: What a fold did: updates by outcome and the largest drift of a centroid.
OUTCOME = "n_updated long, n_held long, n_rejected long, n_short long, drift double"


def session_updates(segments: DataFrame, sessions: DataFrame, voices: DataFrame, min_clip: float = 0.5) -> DataFrame:
    """One update a person and session: ``person_id, file_id, date, role, confidence, seconds, regions``.

    Segments have ``file_id, speaker_id, matched_region, start, end, speaker_confidence``, sessions ``file_id, date,
    teacher_id, student_id``, voices one vector for each ``file_id, person_id, region``. Confidence (null: 0) and seconds
    are over all segments; ``regions`` (region, seconds, vec) has those with clips of ``min_clip`` seconds, names that no
    library holds counting as DEFAULT_REGION. Persons without such a clip have no update.
    """
    region = F.when(F.col("matched_region").isin(*REGIONS), F.col("matched_region")).otherwise(DEFAULT_REGION)
    length = F.col("end") - F.col("start")
    rows = segments.where("speaker_id is not null and speaker_id <> ''").select("file_id", F.col("speaker_id").alias("person_id"), region.alias("region"), length.alias("l"), F.coalesce("speaker_confidence", F.lit(0.0)).alias("c"))
    parts = rows.groupBy("file_id", "person_id", "region").agg(
        F.sum("c").alias("c"), F.count(F.lit(1)).alias("n"), F.sum("l").alias("l"), F.sum(F.when(F.col("l") >= min_clip, F.col("l"))).alias("audio")
    )
    heard = F.when(F.col("audio").isNotNull(), F.struct("region", F.col("audio").alias("seconds"), "vec"))
    each = parts.join(voices.select("file_id", "person_id", "region", "vec"), ["file_id", "person_id", "region"], "left").groupBy("file_id", "person_id").agg(
        (F.sum("c") / F.sum("n")).alias("confidence"), F.sum("l").alias("seconds"), F.array_sort(F.collect_list(heard), lambda x, y: F.when(x["region"] < y["region"], -1).otherwise(1)).alias("regions")
    )
    role = F.when(F.col("teacher_id") == F.col("person_id"), "teacher").when(F.col("student_id") == F.col("person_id"), "student")
    told = each.where(F.size("regions") > 0).join(sessions.select("file_id", "date", "teacher_id", "student_id"), "file_id")
    return told.select("person_id", "file_id", F.col("date").cast("string").alias("date"), role.alias("role"), "confidence", "seconds", "regions")


def new_persons(ids: DataFrame, first_seen: str = "first_seen", trust: int = 3) -> DataFrame:
    """PERSON rows of ids that are registered for the first time."""
    none = {"n_sessions_as_teacher": "0L", "n_sessions_as_student": "0L", "total_hours": "0D", "last_updated": "cast(null as string)", "observed_regions": "cast(array() as array<string>)",
            "region_session_counts": "cast(map() as map<string,long>)", "bootstrap_sessions_remaining": str(trust)}
    return ids.select("id", F.col(first_seen).alias("first_seen"), *[F.expr(e).alias(c) for c, e in none.items()]).select(*T._parse_datatype_string(PERSON).names)


def state_of(persons: DataFrame, library: DataFrame) -> DataFrame:
    """STATE of every person; vectors of persons that are not registered are left out."""
    own = F.struct(*[F.col(c).cast(k.dataType).alias(c) for c, k in zip(T._parse_datatype_string(PERSON).names, T._parse_datatype_string(PERSON))])
    vec = F.col("vec").cast("array<double>")
    named = ~F.col("name").isin("universal", "recent")
    sides = library.groupBy("person_id").agg(
        F.map_from_entries(F.collect_list(F.when(named, F.struct("name", vec.alias("vec"))))).alias("centroids"),
        F.max_by(vec, F.when(F.col("name") == "universal", 0)).alias("universal"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("name") == "recent", F.struct("row_no", vec.alias("vec"))))), lambda r: r["vec"]).alias("ring"),
    )
    held = persons.select(F.col("id").cast("string").alias("person_id"), own.alias("person")).join(sides.withColumn("person_id", F.col("person_id").cast("string")), "person_id", "left")
    empty = {"centroids": F.create_map().cast("map<string,array<double>>"), "ring": F.array().cast("array<array<double>>")}
    return held.withColumns({c: F.coalesce(c, e) for c, e in empty.items()})


def library_rows(state: DataFrame) -> DataFrame:
    """``person_id, name, row_no, vec`` of states."""
    row = lambda name, no, vec: F.struct(name.alias("name"), no.cast("int").alias("row_no"), vec.alias("vec"))
    regions = F.transform(F.map_entries("centroids"), lambda e: row(e["key"], F.lit(0), e["value"]))
    ring = F.transform("ring", lambda v, k: row(F.lit("recent"), k, v))
    whole = F.filter(F.array(row(F.lit("universal"), F.lit(0), F.col("universal"))), lambda r: r["vec"].isNotNull())
    return state.select("person_id", F.explode(F.concat(regions, whole, ring)).alias("r")).select("person_id", "r.*")


def person_rows(state: DataFrame) -> DataFrame:
    return state.select("person.*")


class _Voice:
    """One person's state while its updates pass."""

    def __init__(self, row: dict):
        self.row, self.person = row, row["person"]
        self.at = {r: np.asarray(v, dtype=np.float64) for r, v in row["centroids"] or []}
        self.counts = dict(self.person["region_session_counts"] or [])
        self.seen = list(self.person["observed_regions"] or [])
        self.left = self.person["bootstrap_sessions_remaining"] or 0
        self.universal = row["universal"]
        self.ring = deque(row["ring"] or [], RING)
        self.did, self.drift = dict.fromkeys(("n_updated", "n_held", "n_rejected", "n_short"), 0), 0.0

    def take(self, confidence: float, regions: list, rule: dict, told: tuple) -> None:
        """``regions``: name, seconds and vector of each region heard; ``told``: role, seconds and date of the session."""
        if confidence < rule["floor"]:
            self.did["n_rejected"] += 1
        elif 0 < self.left < rule["trust"] and confidence < rule["new_floor"]:
            self.did["n_held"] += 1
        else:
            least, redo = rule["min_seconds"], rule["redo"]
            touched = self.touch([r for r in regions if (r[1] or 0.0) >= least and (redo or r[2] is not None)], redo)
            if touched:
                mean = touched[0]
                for v in touched[1:]:
                    mean = mean + v
                mean = mean / len(touched)
                self.universal = mean / (sqrt(mean.dot(mean)) + 1e-9)
            self.did["n_updated" if touched else "n_short"] += 1
            if touched and not redo:
                self.count(*told)

    def touch(self, regions: list, redo: bool) -> list[np.ndarray]:
        """The centroids of the regions heard, blended with the new vectors unless these are in them already."""
        out = []
        for name, _, v in regions:
            prior = self.at.get(name)
            if redo and prior is None:
                continue
            if not redo:
                k = self.counts.get(name, 0)
                if prior is not None:
                    v = (prior * k + v) / (k + 1)
                    v /= sqrt(v.dot(v)) + 1e-9
                    self.drift = max(self.drift, 1.0 - float(prior.dot(v)) / (sqrt(prior.dot(prior) * v.dot(v)) + 1e-9))
                else:
                    v = v.copy()  # a view would keep its batch
                self.at[name], self.counts[name] = v, k + 1
                if k == 0 and name not in self.seen:
                    self.seen.append(name)
            if name in REGIONS:
                out.append(self.at[name])
        return out

    def count(self, role: str | None, seconds: float | None, date: str | None) -> None:
        p = self.person
        self.ring.appendleft(self.universal)
        if role in ("teacher", "student"):
            p[f"n_sessions_as_{role}"] = (p[f"n_sessions_as_{role}"] or 0) + 1
        p["total_hours"] = (p["total_hours"] or 0.0) + (seconds or 0.0) / 3600.0
        p["last_updated"], p["first_seen"] = date, p["first_seen"] if p["first_seen"] is not None else date
        self.left = max(0, self.left - 1)

    def told(self) -> dict:
        person = self.person | {"observed_regions": self.seen, "region_session_counts": list(self.counts.items()), "bootstrap_sessions_remaining": self.left}
        held = {"centroids": list(self.at.items()), "universal": self.universal, "ring": list(self.ring)}
        return self.row | {"person": person} | held | {"drift": self.drift} | self.did


def _each_update(batch: pa.RecordBatch):
    """Person, state, confidence, regions and the rest of each row, column by column; a region's vector is a view of all."""
    update = batch.column("update")
    col = dict(zip((f.name for f in update.type), update.flatten()))
    regions = col["regions"]
    flat = regions.flatten()
    name, seconds, vec = flat.flatten()
    starts, numbers = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(vec), 0).to_numpy())]).tolist(), vec.flatten().to_numpy(zero_copy_only=False)
    vecs = [numbers[a:b] if there else None for a, b, there in zip(starts, starts[1:], vec.is_valid().to_pylist())]
    heard, at = list(zip(name.to_pylist(), seconds.to_pylist(), vecs)), 0
    held = batch.column("held")
    known = held.is_valid().to_pylist()
    rows = zip(batch.column("person_id").to_pylist(), known, col["confidence"].to_pylist(), pc.fill_null(pc.list_value_length(regions), 0).to_pylist(), col["role"].to_pylist(), col["seconds"].to_pylist(), col["date"].to_pylist())
    for k, (person, state, confidence, n, *told) in enumerate(rows):
        yield person, held[k].as_py() if state else None, confidence or 0.0, heard[at : at + n], told
        at += n


def fold_library(updates: DataFrame, state: DataFrame, floor: float = 0.65, new_floor: float = 0.75, trust: int = 3, min_seconds: float = 10.0, redo: bool = False) -> DataFrame:
    """STATE and OUTCOME of every person after the updates (as ``session_updates`` makes them), in order of date and file.

    An update is rejected where its confidence is below ``floor``, held while the person is new (fewer than ``trust``
    updates to go, but some) and it is below ``new_floor``, short where no region has ``min_seconds``. Otherwise each long
    enough region is blended into its centroid by the sessions so far and normalised; the universal centroid is the
    normalised mean of the regions touched and goes to the front of the ring; counters, hours and dates move on and one
    update of trust is used up. In a ``redo`` the sessions are in the centroids already: only the universal centroid is
    made anew, of the regions that have a centroid. Persons without a state are not registered: their updates are left out.

    The steps do not commute: each person's state and then its updates stream in order through one task, which holds one
    state at a time. Folding in two goes with the state stored between equals folding at once.
    """
    fields = T._parse_datatype_string(STATE).fields
    shape = T.StructType([*fields, *T._parse_datatype_string(OUTCOME).fields])
    up = F.struct("file_id", F.col("date").cast("string").alias("date"), "role", F.col("confidence").cast("double").alias("confidence"), F.col("seconds").cast("double").alias("seconds"), F.transform("regions", lambda r: F.struct(r["region"].alias("region"), r["seconds"].cast("double").alias("seconds"), r["vec"].cast("array<double>").alias("vec"))).alias("regions"))
    one = state.select("person_id", F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]).alias("held"))
    two = updates.select(F.col("person_id").cast("string").alias("person_id"), up.alias("update"))
    tasks = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that small rows do not end in one task
    rows = one.unionByName(two, allowMissingColumns=True).repartition(tasks, "person_id").sortWithinPartitions("person_id", F.col("held").isNull(), "update.date", "update.file_id")
    arrow = to_arrow_schema(shape)
    rule = {"floor": floor, "new_floor": new_floor, "trust": trust, "min_seconds": min_seconds, "redo": redo}

    def run(batches):
        voice, out = None, []
        for batch in batches:
            for person, state, confidence, regions, told in _each_update(batch):
                if state is not None:
                    if voice is not None:
                        out.append(voice.told())
                    voice = _Voice(state)
                elif voice is not None and voice.row["person_id"] == person:
                    voice.take(confidence, regions, rule, told)
                if len(out) >= 200:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if voice is not None:
            yield pa.RecordBatch.from_pylist([*out, voice.told()], schema=arrow)

    return rows.mapInArrow(run, shape)
