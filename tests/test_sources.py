"""Sources, sinks, registry edits and the command stream on small cases."""

import json

from pyspark.sql import types as T

from sessionlake.operators import registry
from sessionlake.sources import files, sinks
from sessionlake.streaming import commands


def test_listing_and_scan(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("2025-08-07_dora__emil_en.MP4", "deep/odd.wav", "notes.txt", "deep/2025-08-08_ana__bob_ro.mp3"):
        (tmp_path / name).write_bytes(b"xyz")
    done = spark.createDataFrame([("2025-08-08_ana__bob_ro",)] * 2, "file_id string")
    own = spark.createDataFrame([("odd.wav", ("2025-01-01", "a", "b", "en"))], "name string, meta struct<date:string,teacher:string,student:string,language:string>")
    listing = files.media_listing(spark, str(tmp_path))
    got = {r["name"]: (r["parse_ok"], r["needs_processing"], r["size_bytes"]) for r in files.scan(listing, done).collect()}
    assert got == {"2025-08-07_dora__emil_en.MP4": (True, True, 3), "odd.wav": (False, True, 3), "2025-08-08_ana__bob_ro.mp3": (True, False, 3)}
    assert {r["name"]: r["file_id"] for r in files.scan(listing, done, own).collect()}["odd.wav"] == "2025-01-01_a__b_en"
    assert files.media_listing(spark, str(tmp_path / "none")).count() == 0


def test_json_rows_route_what_is_broken(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1}, {"id": 2}]))
    (tmp_path / "b.json").write_text("this is not valid json {{{")
    (tmp_path / "c.json").write_text('{"id": 3}')
    schema = T.StructType.fromDDL("id long")
    good, bad = files.json_rows(spark, str(tmp_path), schema)
    assert sorted(r["id"] for r in good.collect()) == [1, 2, 3]
    assert [r["path"].rsplit("/", 1)[1] for r in bad.collect()] == ["b.json"]
    assert [d.count() for d in files.json_rows(spark, str(tmp_path / "none"), schema)] == [0, 0]


def test_glossary_overrides_events(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"language": "en", "terms": {"fach": ["fach", "fahk", "fahk"], "vibrato": []}}))
    assert sorted(tuple(r) for r in files.glossary(spark, str(tmp_path / "g.json")).collect()) == [("en", "fach", "fach"), ("en", "fach", "fahk"), ("en", "vibrato", "vibrato")]
    (tmp_path / "o.json").write_text(json.dumps({"x.mp4": {"date": "2025-01-01", "teacher": "a"}}))
    assert [(r["name"], r["meta"]["teacher"]) for r in files.overrides(spark, str(tmp_path / "o.json")).collect()] == [("x.mp4", "a")]
    (tmp_path / "o2.json").write_text("[1")
    assert files.overrides(spark, str(tmp_path / "o2.json")).count() == 0
    lines = spark.createDataFrame([('{"type":"ok","n":1}',), ("oops" * 100,)], "value string")
    got = files.events(lines, "type string, n long").collect()
    assert {(r["event"] and r["event"]["n"], r["error"]) for r in got} == {(1, None), (None, "oops" * 50)}


def test_versions_replace_whole_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.current(spark, path) is None
    sinks.replace(spark.range(3), path)
    sinks.replace(sinks.current(spark, path).where("id > 0"), path)
    assert sorted(r["id"] for r in sinks.current(spark, path).collect()) == [1, 2]


def test_event_lines_and_report(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, 1), (None, "t", None)], "id string, timestamp string, n int")
    first, second = (json.loads(r["value"]) for r in sinks.event_lines(rows).collect())
    assert first["id"] == "a" and first["timestamp"].endswith("Z") and second == {"timestamp": "t", "n": None}
    sinks.report(rows, str(tmp_path / "r"))
    assert files.csv_rows(spark, str(tmp_path / "r/csv"), rows.schema).count() == 2


def test_registry_edits(spark):
    persons = spark.createDataFrame([("a", "Ana", "alto"), ("b", "Bob", None)], "id string, display_name string, fach string")
    changes = spark.createDataFrame([("a", "fach", "x", 1), ("a", "fach", None, 2), ("b", "display_name", "Rob", 1), ("b", "id", "z", 1), ("c", "fach", "y", 1)], "id string, field string, value string, seq int")
    done, refused = registry.edit(persons, changes, ["display_name", "fach"])
    assert sorted(map(tuple, done.collect())) == [("a", "Ana", None), ("b", "Rob", None)]
    assert sorted((r["id"], r["field"]) for r in refused.collect()) == [("b", "id"), ("c", "fach")]
    moved = registry.rename(persons, "id", spark.createDataFrame([("a", "ana"), ("b", "B!")], "old_id string, new_id string"))
    assert sorted(r["id"] for r in moved.collect()) == ["ana", "b"]
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a")], "a string, b string")
    assert sorted(map(tuple, registry.collision_edges(pairs).collect())) == [("a", "b"), ("b", "a")]
    voices = spark.createDataFrame([("a", "speaking"), ("a", "recent")], "id string, name string")
    assert {r["id"]: r["voices"] for r in registry.inspect(persons, voices).collect()} == {"a": ["recent", "speaking"], "b": []}


def test_update_gate(spark):
    segments = spark.createDataFrame([("new", None, 20.0, 0.7), ("old", "speaking", 20.0, 0.7), ("low", "speaking", 20.0, None), ("short", "odd", 5.0, 0.9), ("tiny", "speaking", 0.1, 1.0)], "person string, region string, length double, confidence double")
    persons = spark.createDataFrame([(p, n) for p, n in (("new", 2), ("old", 3), ("low", 0), ("short", 2), ("tiny", 1))], "person string, remaining int")
    got = {r["person"]: (r["decision"], r["remaining"]) for r in registry.update_gate(segments, persons, "person", ["speaking"], "speaking").collect()}
    assert got == {"new": ("held", 2), "old": ("updated", 2), "low": ("rejected", 0), "short": ("short", 2)}
    redo = registry.update_gate(segments.where("person = 'old'"), persons, "person", ["speaking"], "speaking", redo=True)
    assert [tuple(r) for r in redo.collect()] == [("old", "updated", 3)]


def test_command_stream_equals_table(spark, tmp_path):
    lines = ['{"cmd":"ping"}', '{"cmd":"ping","x":1}', "[]", "{", '{"cmd":"no"}', '{"cmd":3}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines))
    allowed = {"ping": ["id"]}
    stream = commands.command_stream(spark, str(tmp_path / "in"), allowed).select("value", "refused")
    query = stream.writeStream.format("memory").queryName("checked").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    table = commands.check_commands(spark.createDataFrame([(x,) for x in lines], "value string"), allowed).select("value", "refused")
    want = sorted((r[0], str(r[1])) for r in table.collect())
    assert sorted((r[0], str(r[1])) for r in spark.table("checked").collect()) == want
    assert [r for _, r in sorted(want)] == [dict(zip(lines, ("None", "unknown_fields", "not_an_object", "invalid_json", "unknown_command", "no_command")))[v] for v, _ in sorted(want)]


def test_lessons_labels_and_fresh_files(spark, tmp_path):
    for name in ("a/audio.wav", "a/ground_truth.json", "b/audio.wav", "c/ground_truth.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert [r["folder"].rsplit("/", 1)[1] for r in files.lessons(spark, str(tmp_path)).collect()] == ["a"]
    assert files.lessons(spark, str(tmp_path / "none")).count() == 0
    whole = spark.createDataFrame([("a", 0.0, 1.0, "low")], "file string, start double, end double, label string")
    own = spark.createDataFrame([("/x/a", None, 0.0, 1.0, "mid"), ("/x/b", None, 0.0, 2.0, "high"), ("/x/b", "c", 0.0, 3.0, "low")], "folder string, file string, start double, end double, label string")
    assert sorted((r["file"], r["label"]) for r in files.region_labels(whole, own).collect()) == [("a", "low"), ("b", "high"), ("c", "low")]
    digest = "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    listing = spark.createDataFrame([(p, 1, 5, b"x") for p in "abcde"], "path string, size_bytes long, modified long, content binary")
    seen = spark.createDataFrame([("a", 1, 5, None), ("b", 2, 5, None), ("c", 1, 5, digest), ("d", 1, 5, "0")], "path string, size_bytes long, modified long, sha256 string")
    assert {r["path"]: r["is_fresh"] for r in files.checked(listing, seen).collect()} == {"a": True, "b": False, "c": True, "d": False, "e": False}


def test_finalize_and_library(spark, tmp_path):
    entry = lambda k, s: spark.createDataFrame([(k, s)], "id string, state string")
    for k, s in (("x", "one"), ("y", "one"), ("x", "two")):
        sinks.finalize(entry(k, s).select("id"), entry(k, s), str(tmp_path / "t"), str(tmp_path / "i"), "id")
    assert sorted(map(tuple, sinks.current(spark, str(tmp_path / "i")).collect())) == [("x", "two"), ("y", "one")] and spark.read.parquet(str(tmp_path / "t")).count() == 3
    rows = [("p", "recent", k, [float(k)]) for k in range(14)] + [("p", "universal", 0, [1.0])]
    sinks.write_library(spark.createDataFrame(rows, "person_id string, name string, row_no int, vec array<double>"), str(tmp_path / "l"))
    kept = sinks.current(spark, str(tmp_path / "l")).collect()
    assert sorted(r["row_no"] for r in kept if r["name"] == "recent") == list(range(10)) and len(kept) == 11
