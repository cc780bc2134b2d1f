"""Sessions taken into a corpus, and redone: recomputed from what is stored, with the library as it stands now.

A corpus is a folder: ``voices`` (versioned STATE of the library), ``clusters`` (``file_id, cluster_label, vec``), and
``sessions`` and ``segments``, both partitioned by one column of theirs (``part``), a date or the file itself. ``redo``
identifies the speakers of the chosen files anew, lets given steps verify and polish the segments, makes the library's
universal centroids anew and stamps the sessions with the library's version. Counters, hours, rings and region centroids
stay, so a redo counts nothing twice. ``ingest`` does the same for new files and folds their voices into the library.

Results are staged first and laid over the corpus after: only the partitions that hold a chosen file are written, with the
other files of such a partition carried along; all other partitions keep their files. Laying over can be repeated: after a
crash, ``finish`` does so with what was staged last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionlake.functions.text import sung_marker
from sessionlake.sources.sinks import current, replace, version

from .library import bootstrap, fold_library, library_rows, new_persons, person_rows, session_updates, state_of
from .matching import cosine, nearest_of_group
from .speakers import STUDENT, TEACHER, last_of_role, speaker_columns

STORED = ("sessions", "segments")


def meta(sessions: DataFrame) -> DataFrame:
    """Sessions with ``teacher_id`` and ``student_id`` from their participants: the last of a role, empty without one."""
    who = F.col("participants")
    return sessions.withColumns({f"{r}_id": F.coalesce(last_of_role(who, r), F.lit("")) for r in (TEACHER, STUDENT)})


def identify(clusters: DataFrame, sessions: DataFrame, library: DataFrame, persons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Who speaks in which cluster: ``file_id, cluster_label, person_id, confidence, region, is_new``, and files refused.

    Each of a file's two clusters is scored against all vectors of the session's teacher and student (the best cosine, of
    equal ones the first name and place; -1 without vectors); the pairing with the larger sum holds, on ties the one that
    gives the first label to the teacher. Roles whose person is not registered leave their cluster: its voice is the new
    person's (``is_new``, confidence 1), the teacher's the first label's; a role without an id leaves its cluster without a person.
    Files without exactly two clusters are refused: ``file_id, n_clusters``.
    """
    n = clusters.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_clusters"), F.min("cluster_label").alias("_first"))
    rows = clusters.join(n, "file_id").join(sessions.select("file_id", "teacher_id", "student_id"), "file_id")
    refused = sessions.select("file_id").join(n, "file_id", "left").select("file_id", F.coalesce("n_clusters", F.lit(0)).alias("n_clusters")).where("n_clusters <> 2")
    each = rows.where("n_clusters = 2").select(
        "file_id", "cluster_label", "vec", (F.col("cluster_label") == F.col("_first")).alias("_one"),
        F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_id").alias("person_id")) for r in (TEACHER, STUDENT)])).alias("p"),
    ).select("file_id", "cluster_label", "vec", "_one", "p.*")
    known = persons.select(F.col("id").alias("person_id"), F.lit(True).alias("_known")).distinct()
    vectors = library.join(known, "person_id", "left_semi").select("person_id", "name", "row_no", "vec")
    key = ["file_id", "cluster_label", "_one", "role"]
    found = nearest_of_group(each, vectors, "person_id", key, ["name", "row_no"]).select(*key, "person_id", F.struct((-F.col("score")).alias("minus"), "name", "row_no").alias("b"))
    scored = each.select(*key, "person_id").unionByName(found, allowMissingColumns=True)  # those without vectors stay
    best = F.min("b")
    top = scored.groupBy("file_id", "cluster_label", "_one", "role", "person_id").agg(best.alias("b")).select(
        "file_id", "cluster_label", "_one", "role", "person_id", F.coalesce(-F.col("b.minus"), F.lit(-1.0)).alias("score"), F.coalesce("b.name", F.lit("")).alias("region"))
    known = top.join(known, "person_id", "left")
    sums = lambda straight: F.sum(F.when((F.col("_one") == (F.col("role") == TEACHER)) == straight, F.col("score")))
    file = Window.partitionBy("file_id")
    known = known.withColumn("_straight", F.coalesce(sums(True).over(file) >= sums(False).over(file), F.lit(True)))
    held = known.where((F.col("_one") == (F.col("role") == TEACHER)) == F.col("_straight"))
    new = F.col("_known").isNull()
    return held.where(~new | (F.col("person_id") != "")).select(
        "file_id", "cluster_label", "person_id", F.when(new, 1.0).otherwise(F.col("score")).alias("confidence"), F.when(new, "universal").otherwise(F.col("region")).alias("region"), new.alias("is_new")), refused


def attributed(segments: DataFrame, assigned: DataFrame, sessions: DataFrame, persons: DataFrame) -> DataFrame:
    """Segments with the columns of their speakers; an empty or missing ``region`` is speaking, and sung segments have their
    marker as text, are polished, and lose their words."""
    rows = speaker_columns(segments, assigned, sessions, persons, "file_id")
    rows = rows.withColumn("region", F.coalesce(F.nullif("region", F.lit("")), F.lit("speaking")))
    sung = F.col("region").startswith("sung")
    made = {"text": F.when(sung, sung_marker(F.col("end") - F.col("start"))).otherwise(F.col("text")), "polished": F.when(sung, True).otherwise(F.col("polished")), "sung": sung}
    if "words" in rows.columns:
        made["words"] = F.when(~sung, F.col("words"))
    return rows.withColumns(made)


def verified(segments: DataFrame, turns: DataFrame, clusters: DataFrame, assigned: DataFrame, persons: DataFrame, longest: float = 3.0, margin: float = 0.15) -> DataFrame:
    """Spoken segments under ``longest`` seconds whose own voice (``turns``: ``file_id, seg_idx, vec``) fits the file's other
    cluster better by more than the margin go to that cluster, with its person's id and name; roles and confidences stay."""
    two = clusters.join(clusters.groupBy("file_id").agg(F.count(F.lit(1)).alias("_n")).where("_n = 2").select("file_id"), "file_id", "left_semi")
    own = two.select("file_id", "cluster_label", F.col("vec").alias("_own"))
    other = two.select("file_id", F.col("cluster_label").alias("_label"), F.col("vec").alias("_other"))
    names = assigned.join(persons.select(F.col("id").alias("person_id"), "display_name"), "person_id").select("file_id", F.col("cluster_label").alias("_label"), F.col("person_id").alias("_id"), F.col("display_name").alias("_name"))
    short = segments.where((F.col("end") - F.col("start") < longest) & (F.col("end") > F.col("start")) & ~F.col("sung")).select("file_id", "seg_idx", "cluster_label")
    judged = short.join(turns.select("file_id", "seg_idx", "vec"), ["file_id", "seg_idx"]).join(own, ["file_id", "cluster_label"]).join(other, "file_id").where("_label <> cluster_label")
    moved = judged.where(cosine(F.col("vec"), F.col("_other")) - cosine(F.col("vec"), F.col("_own")) > margin).join(names, ["file_id", "_label"], "left").select("file_id", "seg_idx", "_label", "_id", "_name")
    rows = segments.join(moved, ["file_id", "seg_idx"], "left")
    to = {"cluster_label": F.coalesce("_label", "cluster_label"), "speaker_id": F.coalesce("_id", "speaker_id"), "speaker_name": F.coalesce("_name", "speaker_name"), "reattributed": F.col("_label").isNotNull()}
    return rows.withColumns(to).drop("_label", "_id", "_name")


def participants(assigned: DataFrame, sessions: DataFrame, persons: DataFrame) -> DataFrame:
    """``file_id, participants``: id, name and role of the persons of each file's clusters, in the clusters' order."""
    named = assigned.join(persons.select(F.col("id").alias("person_id"), "display_name", "default_role"), "person_id", "left").join(sessions.select("file_id", "teacher_id", "student_id"), "file_id")
    role = F.when(F.col("person_id") == F.col("teacher_id"), TEACHER).when(F.col("person_id") == F.col("student_id"), STUDENT).otherwise(F.col("default_role"))
    one = F.struct(F.col("cluster_label").alias("l"), F.col("person_id").alias("id"), F.coalesce("display_name", "person_id").alias("name"), role.alias("role"))
    return named.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda p: F.struct(p["id"].alias("id"), p["name"].alias("name"), p["role"].alias("role"))).alias("participants"))


def registered(persons: DataFrame, assigned: DataFrame, sessions: DataFrame) -> DataFrame:
    """``id, display_name, default_role`` of those known and of the new ones, who are called by their id."""
    new = assigned.where("is_new").join(sessions.select("file_id", "teacher_id"), "file_id").select(
        F.col("person_id").alias("id"), F.col("person_id").alias("display_name"), F.when(F.col("person_id") == F.col("teacher_id"), TEACHER).otherwise(STUDENT).alias("default_role"))
    return persons.select("id", "display_name", "default_role").unionByName(new.groupBy("id").agg(F.first("display_name").alias("display_name"), F.max("default_role").alias("default_role")))


def _processed(state: DataFrame, sessions: DataFrame, segments: DataFrame, clusters: DataFrame, names: DataFrame, processed_at: str, number: int | None, turns: DataFrame | None, polish: Callable[[DataFrame], DataFrame] | None):
    """Segments, sessions (with ``teacher_id, student_id``) and the state before any update, with new persons in it."""
    assigned, refused = identify(clusters, sessions, library_rows(state), person_rows(state))
    sessions = sessions.join(refused.select("file_id"), "file_id", "left_anti")
    known = registered(names, assigned, sessions)

    first = Window.partitionBy("person_id").orderBy("date", "file_id")
    fresh = assigned.where("is_new").join(clusters, ["file_id", "cluster_label"]).join(sessions.select("file_id", "date"), "file_id")
    fresh = fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    new = new_persons(fresh.select(F.col("person_id").alias("id"), F.col("date").cast("string").alias("first_seen")))
    state = state.unionByName(state_of(new, bootstrap(fresh, "person_id", "vec")), allowMissingColumns=True)

    rows = attributed(segments.join(sessions.select("file_id"), "file_id", "left_semi"), assigned, sessions, known)
    if turns is not None:
        rows = verified(rows, turns, clusters, assigned, known)
    if polish is not None:
        open_ones = ~F.col("sung") & ~F.coalesce("polished", F.lit(False))
        rows = rows.where(~open_ones).unionByName(polish(rows.where(open_ones)), allowMissingColumns=True)
    order = Window.partitionBy("file_id").orderBy(F.coalesce("start", F.lit(0.0)), F.col("sung"), "seg_idx")
    rows = rows.withColumn("seg_idx", (F.row_number().over(order) - 1).cast(segments.schema["seg_idx"].dataType))
    stamp = {"processed_at": F.lit(processed_at), "voices_version": F.lit(number).cast("long")}
    made = sessions.drop("participants").join(participants(assigned, sessions, known), "file_id", "left").withColumns(stamp)
    return rows, made, state


def _next_stage(spark: SparkSession, base: str) -> tuple[int, str]:
    number = max((int(n) for n, _ in _staged(spark, base)), default=0) + 1
    return number, f"{base}/redo/n={number}"


def _write_stage(stage: str, held: dict[str, DataFrame | None], made: dict[str, DataFrame], part: str) -> None:
    """The made rows, with what else their partitions hold."""
    touched, files = made["sessions"].select(part).distinct(), made["sessions"].select("file_id")
    for name, rows in made.items():
        old = held[name]
        if old is not None:
            rows = rows.select(*[c for c in old.columns if c in rows.columns])
            rows = old.join(touched, part, "left_semi").join(files, "file_id", "left_anti").unionByName(rows, allowMissingColumns=True)
        rows.write.mode("overwrite").parquet(f"{stage}/{name}")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def redo(spark: SparkSession, base: str, chosen: DataFrame, names: DataFrame, processed_at: str, part: str = "date", turns: DataFrame | None = None, polish: Callable[[DataFrame], DataFrame] | None = None, **gates) -> int:
    """Redoes the chosen files (``file_id``) of the corpus at ``base``; returns the number of the staged redo.

    ``names`` are the persons' ``id, display_name, default_role``; ``turns`` are voices of short segments for
    ``verified``; ``polish`` takes the spoken segments that are not polished yet and returns them. ``processed_at`` goes
    into the sessions, and the version of ``voices`` into their ``voices_version``, where they have that column. Files
    without two clusters stay as they are. Persons that a chosen file names and that are not registered are bootstrapped
    from their cluster; of several such files the first one's.
    """
    held = {t: spark.read.parquet(f"{base}/{t}") for t in STORED}
    clusters = spark.read.parquet(f"{base}/clusters").join(chosen.select("file_id"), "file_id", "left_semi")
    sessions = meta(held["sessions"].join(chosen.select("file_id"), "file_id", "left_semi"))
    rows, made, state = _processed(current(spark, f"{base}/voices"), sessions, held["segments"], clusters, names, processed_at, version(spark, f"{base}/voices"), turns, polish)
    number, stage = _next_stage(spark, base)
    _write_stage(stage, held, {"segments": rows, "sessions": made}, part)
    updates = session_updates(spark.read.parquet(f"{stage}/segments").join(made.select("file_id"), "file_id", "left_semi"), made, _no_voices(spark))
    return _laid_over(spark, base, number, stage, part, fold_library(updates, state, redo=True, **gates), state.columns)


def ingest(
    spark: SparkSession, base: str, sessions: DataFrame, segments: DataFrame, clusters: DataFrame, names: DataFrame, voices: Callable[[DataFrame], DataFrame],
    processed_at: str, part: str = "date", turns: DataFrame | None = None, polish: Callable[[DataFrame], DataFrame] | None = None, **gates,
) -> int | None:
    """Takes new sessions into the corpus at ``base``, which may be empty; returns the number of the stage, None where
    nothing was new.

    ``sessions`` hold ``file_id, date, language, teacher_id, student_id`` and more, ``segments`` what recognition and
    diarization gave (``file_id, date, seg_idx, start, end, text, cluster_label`` and more), ``clusters`` the voices of the
    files' clusters. Files that the corpus has are passed over, so a run that was cut off is simply run again. ``voices``
    takes the attributed segments and returns what their regions sound like (``signals.region_voices``); they are folded
    into the library in order of date. All files of one call are identified by the library as it was before it: where one
    day's voices should serve the next day's identification, call once a day. Other parameters are those of ``redo``.
    """
    held = {t: _stored(spark, f"{base}/{t}") for t in STORED}
    if held["sessions"] is not None:
        sessions = sessions.join(held["sessions"].select("file_id"), "file_id", "left_anti")
    if sessions.isEmpty():
        return None
    fresh = lambda df: df.join(sessions.select("file_id"), "file_id", "left_semi")
    segments, clusters = fresh(segments), fresh(clusters)
    for name, kind in (("region", "string"), ("polished", "boolean")):
        if name not in segments.columns:
            segments = segments.withColumn(name, F.lit(None).cast(kind))
    number, stage = _next_stage(spark, base)
    clusters.write.mode("overwrite").parquet(f"{stage}/clusters")
    clusters = spark.read.parquet(f"{stage}/clusters")
    state = current(spark, f"{base}/voices")
    if state is None:
        nobody = new_persons(spark.createDataFrame([], "id string, first_seen string"))
        state = state_of(nobody, spark.createDataFrame([], "person_id string, name string, row_no int, vec array<double>"))
    rows, made, state = _processed(state, sessions, segments, clusters, names, processed_at, (version(spark, f"{base}/voices") or 0) + 1, turns, polish)
    _write_stage(stage, held, {"segments": rows, "sessions": made.drop("teacher_id", "student_id") if held["sessions"] is None else made}, part)
    new = fresh(spark.read.parquet(f"{stage}/segments"))
    return _laid_over(spark, base, number, stage, part, fold_library(session_updates(new, made, voices(new)), state, **gates), state.columns)


def _laid_over(spark: SparkSession, base: str, number: int, stage: str, part: str, folded: DataFrame, columns: list[str]) -> int:
    folded.select(*columns).write.mode("overwrite").parquet(f"{stage}/voices")
    spark.createDataFrame([(part,)], "part string").coalesce(1).write.mode("overwrite").parquet(f"{stage}/ready")
    finish(spark, base)
    return number


def _no_voices(spark: SparkSession) -> DataFrame:
    """A redo blends nothing, so it needs no vectors of what was heard."""
    return spark.createDataFrame([], "file_id string, person_id string, region string, vec array<double>")


def _staged(spark: SparkSession, base: str) -> list[tuple[str, bool]]:
    """Numbers of staged redos, and whether each is whole."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/redo")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [str(s.getPath().getName()) for s in fs.listStatus(root)]
    ready = lambda name: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/redo/{name}/ready/_SUCCESS"))
    return sorted((n.split("=")[1], ready(n)) for n in found if n.startswith("n="))


def finish(spark: SparkSession, base: str) -> None:
    """Lays the last whole staged redo over the corpus; doing so again changes nothing."""
    staged = _staged(spark, base)
    whole = [int(n) for n, ready in staged if ready]
    if not whole:
        return
    stage = f"{base}/redo/n={max(whole)}"
    part = spark.read.parquet(f"{stage}/ready").first()["part"]
    for name in ("segments", "sessions"):  # the sessions last: they say what was redone
        rows = spark.read.parquet(f"{stage}/{name}").hint("rebalance", part)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(f"{base}/{name}")
    if (clusters := _stored(spark, f"{stage}/clusters")) is not None:
        stored = _stored(spark, f"{base}/clusters")
        added = clusters if stored is None else clusters.join(stored.select("file_id").distinct(), "file_id", "left_anti")
        added.write.mode("append").parquet(f"{base}/clusters")
    told = lambda state: state.select(F.to_json(F.struct(*sorted(state.columns))).alias("j"))
    new, old = spark.read.parquet(f"{stage}/voices"), current(spark, f"{base}/voices")
    if old is None or not (told(old).exceptAll(told(new)).isEmpty() and told(new).exceptAll(told(old)).isEmpty()):
        replace(new, f"{base}/voices")
    for n, _ in staged:
        if int(n) < max(whole):
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/redo/n={n}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stale_sessions(spark: SparkSession, base: str, gain: int = 3) -> DataFrame:
    """Sessions stamped with a version of ``voices`` since which some person of it gained ``gain`` sessions.

    A stamp is the version's number, so no session holds a copy of the registry; versions are compared, not sessions.
    Sessions without a stamp are never stale, and persons that are gone make none so.
    """
    n = (F.coalesce("person.n_sessions_as_teacher", F.lit(0)) + F.coalesce("person.n_sessions_as_student", F.lit(0))).alias("n")
    then = spark.read.parquet(f"{base}/voices/data").select("person_id", F.col("v").cast("long").alias("voices_version"), n)
    now = current(spark, f"{base}/voices").select("person_id", n).withColumnRenamed("n", "now")
    old = then.join(now, "person_id").where(F.col("now") - F.col("n") >= gain).select("voices_version").distinct()
    return spark.read.parquet(f"{base}/sessions").join(old, "voices_version", "left_semi")
