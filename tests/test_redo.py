"""The library folded onto stored state, and redo as an idempotent recompute, against loops."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.operators import library, redo
from sessionlake.sources import sinks

UPDATE = "person_id string, file_id string, date string, role string, confidence double, seconds double, regions array<struct<region:string,seconds:double,vec:array<double>>>"
unit = lambda v: np.asarray(v) / (np.linalg.norm(v) + 1e-9)


def looped(updates, trust=3, redone=()):
    """What each person's files say after the updates, one after the other."""
    out = {}
    for u, again in [*((u, False) for u in updates), *((u, True) for u in redone)]:
        p = out.setdefault(u[0], {"at": {}, "n": {}, "seen": [], "universal": None, "ring": [], "left": trust, "teacher": 0, "student": 0, "hours": 0.0, "last": None, "first": None, "did": [0, 0, 0, 0]})
        if u[4] < 0.65 or 0 < p["left"] < 3 and u[4] < 0.75:
            p["did"][2 if u[4] < 0.65 else 1] += 1
            continue
        active = []
        for region, seconds, vec in u[6]:
            if seconds < 10 or again and region not in p["at"]:
                continue
            if not again:
                v = np.array(vec)
                if region in p["at"]:
                    v = unit((p["at"][region] * p["n"][region] + v) / (p["n"][region] + 1))
                p["at"][region], p["n"][region] = v, p["n"].get(region, 0) + 1
                p["seen"] += [region] * (region not in p["seen"])
            active.append(p["at"][region])
        if active:
            p["universal"] = unit(np.mean(active, axis=0))
        p["did"][0 if active else 3] += 1
        if active and not again:
            p["ring"] = [p["universal"], *p["ring"]][:10]
            p[u[3]] += 1
            p["hours"] += u[5] / 3600
            p["last"], p["first"], p["left"] = u[2], p["first"] or u[2], max(0, p["left"] - 1)
    return out


def some_updates():
    rng = np.random.default_rng(4)
    out = []
    for p in ("a", "b", "c"):
        for s in range(40):
            regions = [(r, float(rng.integers(2, 30)), rng.normal(size=3).tolist()) for r in ("speaking", "sung_low", "sung_mid") if rng.random() < 0.7]
            if regions:
                out.append((p, f"f{s:02d}", f"2024-01-{s // 2 + 1:02d}", "teacher" if p == "a" else "student", float(0.55 + rng.random() * 0.4), float(rng.integers(5, 90)), regions))
    return out


def same(row, want):
    assert [row[c] for c in ("n_updated", "n_held", "n_rejected", "n_short")] == want["did"]
    holds(row, want)


def holds(row, want):
    p = row["person"]
    assert [p["n_sessions_as_teacher"], p["n_sessions_as_student"], p["bootstrap_sessions_remaining"], p["last_updated"], p["first_seen"]] == [want["teacher"], want["student"], want["left"], want["last"], want["first"]]
    assert p["total_hours"] == pytest.approx(want["hours"]) and p["region_session_counts"] == want["n"] and p["observed_regions"] == want["seen"]
    assert {r: pytest.approx(v) for r, v in row["centroids"].items()} == {r: v.tolist() for r, v in want["at"].items()}
    assert np.allclose(row["ring"], want["ring"]) and np.allclose(row["universal"], want["universal"])


@pytest.fixture(scope="module")
def empty_state(spark):
    ids = spark.createDataFrame([(p, None) for p in "abcd"], "id string, first_seen string")
    return library.state_of(library.new_persons(ids), spark.createDataFrame([], "person_id string, name string, row_no int, vec array<float>"))


def test_library_fold_against_a_loop(spark, empty_state):
    rows = some_updates()
    random.Random(1).shuffle(rows)
    made = spark.createDataFrame([*rows, ("unknown", *rows[0][1:])], UPDATE).repartition(7)
    got = {r["person_id"]: r for r in library.fold_library(made, empty_state).collect()}
    want = looped(sorted(rows, key=lambda u: (u[0], u[2], u[1])))
    assert set(got) == {*"abcd"} and got["d"]["n_updated"] == 0 and got["d"]["universal"] is None and min(w["did"][0] for w in want.values()) > 10
    for p, w in want.items():
        same(got[p], w)


def test_folding_in_two_goes_through_the_tables_is_folding_at_once(spark, empty_state, tmp_path):
    rows = sorted(some_updates(), key=lambda u: (u[2], u[1]))
    early = [u for u in rows if u[1] < "f17"]
    late = [u for u in rows if u[1] >= "f17"]
    first = library.fold_library(spark.createDataFrame(early, UPDATE), empty_state)
    sinks.write_library(library.library_rows(first), str(tmp_path / "library"))
    sinks.replace(library.person_rows(first), str(tmp_path / "persons"))
    back = lambda name: sinks.current(spark, str(tmp_path / name))
    held = library.state_of(back("persons"), back("library"))
    second = {r["person_id"]: r for r in library.fold_library(spark.createDataFrame(late, UPDATE), held).collect()}
    for p, w in looped([*early, *late]).items():
        holds(second[p], w)
    ring = back("library").where("person_id = 'a' and name = 'recent'").orderBy("row_no").collect()
    assert [r["row_no"] for r in ring] == list(range(len(ring))) and np.allclose(ring[0]["vec"], looped(early)["a"]["universal"])


def test_a_redo_changes_the_universal_centroid_only(spark, empty_state):
    rows = sorted(some_updates(), key=lambda u: (u[0], u[2], u[1]))
    once = library.fold_library(spark.createDataFrame(rows, UPDATE), empty_state).select(*empty_state.columns)
    some = [(*u[:6], [*u[6], ("sung_full", 99.0, None)]) for u in rows if u[1] in ("f03", "f30")]  # a region without a centroid is left out
    again = {r["person_id"]: r for r in library.fold_library(spark.createDataFrame(some, UPDATE), once, redo=True).collect()}
    before = {r["person_id"]: r for r in once.collect()}
    want = looped(rows, redone=some)
    for p in "abc":
        holds(again[p], want[p])
        assert {c: before[p][c] for c in ("person", "centroids", "ring")} == {c: again[p][c] for c in ("person", "centroids", "ring")}


def test_session_updates(spark):
    segments = spark.createDataFrame([("f", "a", "speaking", 0.0, 12.0, 0.9), ("f", "a", "recent", 12.0, 12.4, None), ("f", "a", "sung_low", 20.0, 20.4, 0.6), ("f", "b", None, 0.0, 0.3, 0.9), ("f", None, "speaking", 0.0, 50.0, 1.0)],
                                     "file_id string, speaker_id string, matched_region string, start double, end double, speaker_confidence double")
    sessions = spark.createDataFrame([("f", "2024-01-01", "x", "a")], "file_id string, date string, teacher_id string, student_id string")
    voices = spark.createDataFrame([("f", "a", "speaking", [1.0])], "file_id string, person_id string, region string, vec array<double>")
    (row,) = library.session_updates(segments, sessions, voices).collect()
    assert (row["person_id"], row["role"], row["date"]) == ("a", "student", "2024-01-01") and row["confidence"] == pytest.approx(0.5) and row["seconds"] == pytest.approx(12.8)
    assert [tuple(r) for r in row["regions"]] == [("speaking", 12.0, [1.0])]


# redo over a stored corpus

SEGMENT = "file_id string, date string, seg_idx int, start double, end double, text string, region string, polished boolean, sung boolean, words array<string>, cluster_label string, speaker_id string, speaker_name string, speaker_role string, speaker_confidence double, matched_region string, reattributed boolean"
SESSION = "file_id string, date string, language string, participants array<struct<id:string,name:string,role:string>>, processed_at string, voices_version long"


def corpus_at(spark, base):
    """Three days, four files: two clusters each but for the last; ann, bob and cat are registered, zoe is not."""
    e = np.eye(4)
    vecs = {"ann": e[0], "bob": e[1], "cat": e[2]}
    persons = library.new_persons(spark.createDataFrame([(p, "2023-01-01") for p in vecs], "id string, first_seen string"))
    rows = [(p, n, 0, v.tolist()) for p, v in vecs.items() for n in ("speaking", "universal", "recent")]
    state = library.state_of(persons.withColumn("n_sessions_as_teacher", F.lit(2).cast("long")), spark.createDataFrame(rows, "person_id string, name string, row_no int, vec array<double>"))
    sinks.replace(state, f"{base}/voices")
    files = {"f1": ("2024-01-01", "ann", "bob", [0.1 * e[0] + e[1], e[0]]), "f2": ("2024-01-01", "ann", "cat", [e[0], e[2]]), "f3": ("2024-01-02", "ann", "zoe", [e[3], e[0]]), "f4": ("2024-01-03", "ann", "bob", [e[0]])}
    sessions, segments, clusters = [], [], []
    for f, (date, teacher, student, found) in files.items():
        sessions.append((f, date, "en", [(teacher, teacher, "teacher"), (student, student, "student")], "then", None))
        clusters += [(f, f"S{k}", v.tolist()) for k, v in enumerate(found)]
        for i in range(6):
            segments.append((f, date, i, i * 12.0, i * 12.0 + (2.0 if i == 4 else 11.0), f"text {i}", "sung_low" if i == 5 else None, False, False, ["w"], f"S{i % len(found)}", "old", "old", None, 0.1, None, False))
    write = lambda df, name: df.write.partitionBy("date").parquet(f"{base}/{name}")
    write(spark.createDataFrame(sessions, SESSION), "sessions")
    write(spark.createDataFrame(segments, SEGMENT), "segments")
    spark.createDataFrame(clusters, "file_id string, cluster_label string, vec array<double>").write.parquet(f"{base}/clusters")
    names = spark.createDataFrame([(p, p.title(), "student") for p in vecs], "id string, display_name string, default_role string")
    return names, segments


def files_of(base, name):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{base}/{name}") for f in fs if f.endswith(".parquet")}


def rows_of(spark, base):
    order = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    return order(spark.read.parquet(f"{base}/segments")), order(spark.read.parquet(f"{base}/sessions")), order(sinks.current(spark, f"{base}/voices"))


def test_redo(spark, tmp_path):
    base = str(tmp_path)
    names, before = corpus_at(spark, base)
    old_segments, old_sessions = files_of(base, "segments"), files_of(base, "sessions")
    chosen = spark.createDataFrame([("f1",), ("f3",), ("f4",), ("no such file",)], "file_id string")
    turns = spark.createDataFrame([("f1", 4, [1.0, 0.0, 0.0, 0.0]), ("f3", 4, [0.0, 0.0, 0.0, 1.0])], "file_id string, seg_idx int, vec array<double>")
    polish = lambda rows: rows.withColumns({"text": F.upper("text"), "polished": F.lit(True)})
    redone = lambda: redo.redo(spark, base, chosen, names, "now", turns=turns, polish=polish)
    redone()

    got = {(r["file_id"], r["seg_idx"]): r for r in spark.read.parquet(f"{base}/segments").collect()}
    assert len(got) == len(before)
    who = {"f1": {"S0": ("bob", "student"), "S1": ("ann", "teacher")}, "f3": {"S0": ("zoe", "student"), "S1": ("ann", "teacher")}}
    for row in before:
        f, i, label = row[0], row[2], row[10]
        now = got[f, i]
        if f not in who:  # f2 shares a partition with f1, f4 has one cluster
            assert tuple(now[c.split()[0]] for c in SEGMENT.split(", ") if c[:5] != "date ") == row[:1] + row[2:]
            continue
        person, role = who[f][label]
        if (f, i) == ("f1", 4):  # a short turn that sounds like the other cluster
            assert (now["cluster_label"], now["speaker_id"], now["speaker_name"], now["speaker_role"], now["reattributed"]) == ("S1", "ann", "Ann", "student", True)
            continue
        assert (now["cluster_label"], now["speaker_id"], now["speaker_role"]) == (label, person, role)
        assert now["speaker_name"] == {"zoe": "zoe"}.get(person, person.title()) and now["matched_region"] == ("universal" if person == "zoe" else "recent")
        assert (now["text"], now["polished"], now["sung"], now["words"]) == (("[SUNG: ~11s]", True, True, None) if i == 5 else (f"TEXT {i}", True, False, ["w"]))
    sessions = {r["file_id"]: r for r in spark.read.parquet(f"{base}/sessions").collect()}
    assert [sessions[f]["processed_at"] for f in ("f1", "f2", "f3", "f4")] == ["now", "then", "now", "then"] and sessions["f1"]["voices_version"] == 1
    assert [tuple(p) for p in sessions["f3"]["participants"]] == [("zoe", "zoe", "student"), ("ann", "Ann", "teacher")]
    voices = {r["person_id"]: r for r in sinks.current(spark, f"{base}/voices").collect()}
    assert set(voices) == {"ann", "bob", "cat", "zoe"} and voices["ann"]["person"]["n_sessions_as_teacher"] == 2 and voices["zoe"]["person"]["bootstrap_sessions_remaining"] == 3
    assert np.allclose(voices["zoe"]["ring"], [np.eye(4)[3]]) and np.allclose(voices["ann"]["universal"], np.eye(4)[0])

    kept = lambda old, name, day: {p: t for p, t in old.items() if day in p} == {p: t for p, t in files_of(base, name).items() if day in p}
    assert kept(old_segments, "segments", "date=2024-01-03") and kept(old_sessions, "sessions", "date=2024-01-03") and not kept(old_segments, "segments", "date=2024-01-02")

    settled = rows_of(spark, base)
    redo.finish(spark, base)  # as after a crash
    assert rows_of(spark, base) == settled and sinks.version(spark, f"{base}/voices") == 2
    redone()  # zoe is registered now, and her voice is known: from here on nothing changes
    third = rows_of(spark, base)
    redone()
    assert rows_of(spark, base) == third and sinks.version(spark, f"{base}/voices") == 2

    assert redo.stale_sessions(spark, base).count() == 0
    grown = sinks.current(spark, f"{base}/voices").withColumn("person", F.col("person").withField("n_sessions_as_teacher", F.col("person.n_sessions_as_teacher") + 3))
    sinks.replace(grown, f"{base}/voices")
    assert {r["file_id"] for r in redo.stale_sessions(spark, base).collect()} == {"f1", "f3"}


def test_an_unfinished_stage_is_not_laid_over(spark, tmp_path):
    base = str(tmp_path)
    corpus_at(spark, base)
    before = rows_of(spark, base)
    spark.range(1).write.parquet(f"{base}/redo/n=1/segments")
    redo.finish(spark, base)
    assert rows_of(spark, base) == before


def test_ingest_day_by_day(spark, tmp_path):
    """Ann teaches bob on three days; both are bootstrapped on the first, known on the others."""
    base, e = str(tmp_path), np.eye(4)
    days = [f"2024-02-0{d}" for d in (1, 2, 3)]
    sessions = [(f"g{k}", d, "en", "ann", "bob") for k, d in enumerate(days)]
    segments, clusters = [], []
    for k, d in enumerate(days):
        swap = k == 2  # on the third day the labels are the other way round
        clusters += [(f"g{k}", "S0", (e[1] if swap else e[0]).tolist()), (f"g{k}", "S1", (e[0] if swap else e[1]).tolist())]
        segments += [(f"g{k}", d, i, i * 20.0, i * 20.0 + 19.0, f" text {i}", f"S{i % 2}") for i in range(4)]
    ss = spark.createDataFrame(sessions, "file_id string, date string, language string, teacher_id string, student_id string")
    gs = spark.createDataFrame(segments, "file_id string, date string, seg_idx int, start double, end double, text string, cluster_label string")
    cs = spark.createDataFrame(clusters, "file_id string, cluster_label string, vec array<double>")
    names = spark.createDataFrame([], "id string, display_name string, default_role string")
    made = {"ann": e[0] + 0.2 * e[2], "bob": e[1] + 0.2 * e[3]}

    def voices(rows):
        sound = lambda p: F.array(*map(F.lit, made[p].tolist()))
        heard = rows.select("file_id", F.col("speaker_id").alias("person_id"), F.lit("speaking").alias("region")).distinct()
        return heard.withColumn("vec", F.when(F.col("person_id") == "ann", sound("ann")).otherwise(sound("bob")))

    for d in days:
        assert redo.ingest(spark, base, ss.where(F.col("date") <= d), gs, cs, names, voices, "now") is not None
    assert redo.ingest(spark, base, ss, gs, cs, names, voices, "later") is None
    who = {(r["file_id"], r["cluster_label"]): (r["speaker_id"], r["speaker_role"]) for r in spark.read.parquet(f"{base}/segments").collect()}
    want = {("g0", "S0"): "ann", ("g0", "S1"): "bob", ("g1", "S0"): "ann", ("g1", "S1"): "bob", ("g2", "S0"): "bob", ("g2", "S1"): "ann"}
    assert who == {k: (p, {"ann": "teacher", "bob": "student"}[p]) for k, p in want.items()}
    assert spark.read.parquet(f"{base}/segments").count() == 12 and spark.read.parquet(f"{base}/clusters").count() == 6
    held = {r["person_id"]: r for r in sinks.current(spark, f"{base}/voices").collect()}
    for p, role in (("ann", "teacher"), ("bob", "student")):
        person = held[p]["person"]
        assert person[f"n_sessions_as_{role}"] == 3 and person["bootstrap_sessions_remaining"] == 0 and person["region_session_counts"] == {"speaking": 3} and person["last_updated"] == days[2]
        v = made[p]
        for n in (1, 2):
            v = unit((v * n + made[p]) / (n + 1))
        assert np.allclose(held[p]["centroids"]["speaking"], v) and len(held[p]["ring"]) == 4
    assert [r["voices_version"] for r in spark.read.parquet(f"{base}/sessions").orderBy("file_id").collect()] == [1, 2, 3]
    before = rows_of(spark, base)
    redo.redo(spark, base, ss.select("file_id"), names, "now")  # what was taken in can be redone
    after = rows_of(spark, base)
    assert len(after[0]) == len(before[0]) and {k: v for k, v in who.items()} == {(r["file_id"], r["cluster_label"]): (r["speaker_id"], r["speaker_role"]) for r in spark.read.parquet(f"{base}/segments").collect()}
    again = {r["person_id"]: r["person"] for r in sinks.current(spark, f"{base}/voices").collect()}
    assert again == {p: held[p]["person"] for p in held}


def test_updates_are_read_column_by_column(spark, empty_state):
    """Null regions' vectors, updates without regions and several batches of one person; no update becomes a Python struct."""
    import pyarrow as pa

    heard = [("speaking", 20.0, [1.0, 0.0]), ("sung_low", 5.0, None)]
    update = pa.array([None, {"file_id": "f", "date": "d", "role": "teacher", "confidence": None, "seconds": 3.0, "regions": [dict(zip(("region", "seconds", "vec"), r)) for r in heard]}, {"file_id": "g", "date": "e", "role": None, "confidence": 0.9, "seconds": None, "regions": []}],
                      pa.struct([("file_id", pa.string()), ("date", pa.string()), ("role", pa.string()), ("confidence", pa.float64()), ("seconds", pa.float64()), ("regions", pa.list_(pa.struct([("region", pa.string()), ("seconds", pa.float64()), ("vec", pa.list_(pa.float64()))])))]))
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 3), pa.array([{"person_id": "a"}, None, None]), update], ["person_id", "held", "update"])
    got = list(library._each_update(batch))
    assert got[0][1] == {"person_id": "a"} and got[1][1] is None and got[1][4] == ["teacher", 3.0, "d"] and got[2][2:] == (0.9, [], [None, None, "e"])
    (r1, s1, v1), (r2, s2, v2) = got[1][3]
    assert (r1, s1, v1.tolist(), r2, s2, v2) == ("speaking", 20.0, [1.0, 0.0], "sung_low", 5.0, None) and got[1][2] == 0.0
