"""Speakers of sessions: roles, participants, columns of assigned clusters, statistics of each person.

A transcript has ``participants: array<struct<id, name, role>>``; clusters of voices are assigned to persons by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEACHER, STUDENT = "teacher", "student"
#: Columns that segments get from their cluster's person.
SPEAKER = ("speaker_id", "speaker_name", "speaker_role", "speaker_confidence", "matched_region")


def role_of(person: Column, teacher: Column, student: Column, default: Column) -> Column:
    """The person's role in a session: by the session's own ids, else the person's usual one."""
    return F.when(person == teacher, TEACHER).when(person == student, STUDENT).when(person.isNotNull(), default)


def last_of_role(participants: Column, role: str) -> Column:
    """The id of the last participant of the role; null if there is none."""
    return F.try_element_at(F.filter(participants, lambda p: p["role"] == role), F.lit(-1))["id"]


def index_entry(transcripts: DataFrame, columns: list[str], participants: str = "participants") -> DataFrame:
    """The columns asked for, as far as they are there, with ``teacher_id`` and ``student_id`` from the participants."""
    kept = [F.col(f"`{c}`") for c in columns if c in transcripts.columns]
    who = F.col(participants)
    return transcripts.select(*kept, last_of_role(who, TEACHER).alias("teacher_id"), last_of_role(who, STUDENT).alias("student_id"))


def has_participant(participants: Column, person, role: str) -> Column:
    """Whether the person takes part in that role; null participants have nobody."""
    return F.coalesce(F.exists(participants, lambda p: (p["id"] == person) & (p["role"] == role)), F.lit(False))


def of_participant(sessions: DataFrame, participants: DataFrame, key: str, person, role: str) -> DataFrame:
    """Sessions in whose rows of participants (``key, id, role``) the person has the role."""
    return sessions.join(participants.where((F.col("id") == person) & (F.col("role") == role)).select(key), key, "left_semi")


def speaker_columns(segments: DataFrame, assigned: DataFrame, sessions: DataFrame, persons: DataFrame, key: str) -> DataFrame:
    """Segments with the SPEAKER columns of their cluster (``key, cluster_label``).

    ``assigned`` holds ``person_id, confidence, region`` of clusters, ``sessions`` holds ``teacher_id, student_id``,
    ``persons`` holds ``id, display_name, default_role``. Clusters without a person give nulls; an empty region is null.
    """
    told = assigned.join(sessions.select(key, "teacher_id", "student_id"), key, "left")
    told = told.join(persons.select(F.col("id").alias("person_id"), "display_name", "default_role"), "person_id", "left")
    told = told.select(
        key, "cluster_label", F.col("person_id").alias("speaker_id"), F.col("display_name").alias("speaker_name"),
        role_of(F.col("person_id"), F.col("teacher_id"), F.col("student_id"), F.col("default_role")).alias("speaker_role"),
        F.col("confidence").alias("speaker_confidence"), F.nullif(F.col("region"), F.lit("")).alias("matched_region"),
    )
    return segments.drop(*SPEAKER).join(told, [key, "cluster_label"], "left")


def speaker_statistics(segments: DataFrame, person: str, min_clip: float = 0.5) -> DataFrame:
    """``mean_confidence`` (null counts as 0) and ``seconds`` over all segments of a person; ``clips`` counts those of
    ``min_clip`` seconds or more by region. Columns ``region, length, confidence``."""
    each = segments.groupBy(person, "region").agg(
        F.sum(F.coalesce("confidence", F.lit(0.0))).alias("c"), F.count(F.lit(1)).alias("n"), F.sum("length").alias("s"), F.count_if(F.col("length") >= min_clip).alias("clips")
    )
    clips = F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.struct("region", "clips")), lambda e: (e["clips"] > 0) & e["region"].isNotNull())))
    return each.groupBy(person).agg((F.sum("c") / F.sum("n")).alias("mean_confidence"), F.sum("s").alias("seconds"), clips.alias("clips"))


def total_sessions(persons: DataFrame) -> DataFrame:
    """Adds ``n_sessions``, those as teacher and as student."""
    return persons.withColumn("n_sessions", F.coalesce("n_sessions_as_teacher", F.lit(0)) + F.coalesce("n_sessions_as_student", F.lit(0)))


def other_clusters(clusters: DataFrame, key: str, label: str) -> DataFrame:
    """Each cluster beside every other one of its file: ``key, label, other``."""
    two = clusters.select(key, F.col(label).alias("other")).distinct()
    return clusters.select(key, label).distinct().join(two, key).where(F.col(label) != F.col("other"))


def named_pairs(pairs: DataFrame, persons: DataFrame) -> DataFrame:
    """Pairs ``a, b`` with ``name_a, name_b``; persons without a name are called by their id."""
    for x in "ab":
        names = persons.select(F.col("id").alias(x), F.col("display_name").alias(f"name_{x}"))
        pairs = pairs.join(names, x, "left").withColumn(f"name_{x}", F.coalesce(f"name_{x}", F.col(x).cast("string")))
    return pairs


def word_votes(words: DataFrame, key: list[str], margin: float) -> DataFrame:
    """Whom the words of a segment vote for: ``key, n_words, n_flipped, speaker_id``.

    Rows are words with the segment's ``current`` person and ``confidence`` and the word's ``best`` person and
    ``best_score`` (null where a word has no voice). A word flips where another person is better by more than the margin.
    The segment goes to another person if some word flipped and that person has more than half of all words; of equal
    votes the lower id wins.
    """
    flipped = (F.col("best") != F.col("current")) & (F.col("best_score") - F.coalesce("confidence", F.lit(0.0)) > margin)
    votes = words.groupBy(*key, "current", "best").agg(F.count(F.lit(1)).alias("n"), F.count_if(flipped).alias("f"))
    others = F.when(F.col("best") != F.col("current"), F.struct((-F.col("n")).alias("m"), "best"))
    sums = votes.groupBy(*key, "current").agg(F.sum("n").alias("n_words"), F.sum("f").alias("n_flipped"), F.min(others).alias("top"))
    wins = (F.col("n_flipped") > 0) & (-F.col("top.m") * 2 > F.col("n_words"))
    return sums.select(*key, "n_words", "n_flipped", F.when(wins, F.col("top.best")).otherwise(F.col("current")).alias("speaker_id"))
