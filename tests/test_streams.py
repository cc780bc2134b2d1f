"""Streams whose events come late and out of order, against the folds of tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sessionlake.streaming import commands, fold, ordered, sink, view

KINDS = ["start", "phase", "progress", "phase_done", "warning", "error", "done"]


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    before = {k: spark.conf.get(k, None) for k in (*ordered.STORE, "spark.sql.shuffle.partitions")}
    for k, v in {**ordered.STORE, "spark.sql.shuffle.partitions": "2"}.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def late(rows, rng, batches=3, by=4):
    """The rows in files, each up to ``by`` places from where it belongs."""
    moved = [r for _, r in sorted(enumerate(rows), key=lambda e: e[0] + rng.uniform(0, by))]
    size = -(-len(moved) // batches)
    return [moved[k : k + size] for k in range(0, len(moved), size)]


def streamed(spark, folder, schema, files, make, last):
    """What a stream over the files puts out, one file a batch, and a last row that lets the watermark pass all others."""
    out, name = [], "s" + folder.name.replace("-", "_")
    query = None
    for k, rows in enumerate([*files, [last]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = spark.readStream.schema(schema).parquet(str(folder / "in"))
        query = make(stream).writeStream.outputMode("update" if name.endswith("u") else "append").foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    return out


def test_paths_and_file_states(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"r{i % 2}", i, rng.choice(["queued", "start", "phase", "phase", "done"] + ["batch_done", "cancelled"] * (i % 5 == 0)), rng.choice([0, 1, 2, None])) for i in range(60)]
    rows = [(r, i, k, at, f"p{rng.randrange(9)}" if k in ("queued", "start") else None) for r, i, k, at in rows]
    schema = "run string, seq long, kind string, file_index long, path string, ts timestamp"
    stamp = lambda r: (*r, spark_time(r[1]))
    table = spark.createDataFrame([stamp(r) for r in rows], schema)
    folder = tmp_path / "paths"
    got = streamed(spark, folder, schema, late([stamp(r) for r in rows], rng), lambda s: ordered.resolved_paths(s, delay="10 seconds"), ("end", 0, "end", None, None, spark_time(10_000)))
    want = {(r["run"], r["seq"]): r["resolved"] for r in fold.resolve_paths(table).collect()}
    assert len(got) == len(rows) and {(r["run"], r["seq"]): r["resolved"] for r in got} == want and sum(v is not None for v in want.values()) > 20


def spark_time(second):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)


def test_file_states(spark, tmp_path):
    rng = random.Random(9)
    rows = [(f"f{rng.randrange(4)}", i, rng.choice(KINDS), i / 100, f"ph{i}", f"m{i}", spark_time(i)) for i in range(80)] + [("orphan", 81, "error", None, None, "m", spark_time(81))]
    schema = "file string, seq long, kind string, amount double, phase string, message string, ts timestamp"
    got = streamed(spark, tmp_path / "states_u", schema, late(rows, rng), lambda s: ordered.file_states(s, "file", delay="10 seconds"), ("end", 0, "end", None, None, None, spark_time(10_000)))
    last = {}
    for r in got:
        last[r["file"]] = max(last.get(r["file"], r), r, key=lambda x: x["last_seq"])
    table = spark.createDataFrame(rows, schema)
    done = {r["file"]: r for r in fold.completed_phases(table, "file").collect()}
    state = {r["file"]: r["state"] for r in fold.fold_events(table.where("kind not in ('phase_done', 'warning')"), "file").collect()}
    assert set(last) == set(done) == set(state) and "orphan" not in last
    for f, r in last.items():
        assert (r["completed"], r["message"], r["state"]) == (done[f]["completed"], done[f]["message"], state[f])
        since = [x for x in rows if x[0] == f and x[1] >= max([y[1] for y in rows if y[0] == f and y[2] == "start"], default=0)]
        moved = [x for x in since if x[2] in ("start", "phase", "progress", "done", "phase_done")]
        assert r["progress"] == {"progress": moved[-1][3], "done": 1.0, "phase_done": 1.0}.get(moved[-1][2], 0.0)


def test_registry_view(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(90):
        a, b = rng.sample("pqrst", 2)
        kind = "listed" if i in (0, 1, 40) else rng.choice(["inspected", "renamed", "merged", "collision", "collision", "pong"])
        person = (a, {rng.choice("xy"): rng.choice(["1", "2", None])}) if kind == "inspected" else None
        listed = [(p, {"x": "0"}) for p in rng.sample("pqrst", 4)] if kind == "listed" else None
        rows.append((i % 2, i, kind, listed, person, a, b, i / 7, spark_time(i)))
    schema = f"viewer int, seq long, kind string, persons array<{view.PERSON}>, person {view.PERSON}, source string, target string, similarity double, ts timestamp"
    got = streamed(spark, tmp_path / "view", schema, late(rows, rng), lambda s: ordered.view_changes(s, "viewer", delay="10 seconds"), (9, 0, "end", None, None, None, None, None, spark_time(10_000)))
    held = {}
    for r in sorted(got, key=lambda r: r["seq"]):  # changes of one event come in their order
        at = held.setdefault(r["viewer"], {})
        at.pop((r["part"], r["key"]), None)
        if r["value"] is not None:
            at[r["part"], r["key"]] = json.loads(r["value"])
    want = {r["viewer"]: r for r in view.registry_view(spark.createDataFrame(rows, schema), "viewer").collect()}
    for v in (0, 1):
        persons = [p for (part, _), p in sorted(((k, x) for k, x in held[v].items() if k[0] == "person"), key=lambda e: int(e[0][1]))]
        assert [(p["id"], p["fields"]) for p in persons] == [(p["id"], p["fields"]) for p in want[v]["persons"]]
        assert [(c["a"], c["b"], c["similarity"]) for (part, _), c in held[v].items() if part == "collision"] == [tuple(c) for c in want[v]["collisions"]]


def test_phase_pairs(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for f in range(12):
        rows.append((f"f{f}", "vad", "s", spark_time(f * 10)))
        if f % 3:
            rows.append((f"f{f}", "vad", "e", spark_time(f * 10 + rng.randrange(1, 40))))
    rows.sort(key=lambda r: r[3])
    schema = "file string, phase string, side string, ts timestamp"
    make = lambda s: ordered.phase_pairs(s.where("side = 's'"), s.where("side = 'e'"), ["file", "phase"], "1 minute", "30 seconds")
    ends = [("end", "vad", "s", spark_time(90_000)), ("end", "vad", "e", spark_time(90_000))]
    got = streamed(spark, tmp_path / "pairs", schema, [*late(rows, rng), ends], make, ("end2", "vad", "e", spark_time(100_000)))
    begun, over = ({r[0]: r[3] for r in rows if r[2] == side} for side in "se")
    assert sorted((r["file"], r["elapsed_s"]) for r in got if not r["file"].startswith("end")) == sorted(((f, (over[f] - t).total_seconds() if f in over else None) for f, t in begun.items()), key=lambda x: x[0])


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    lines = ['{"cmd": "ping"}', "oops", '{"cmd": "nope"}', "", '{"cmd": "ping", "x": 1}', "[1]"]
    allowed = {"ping": [], "scan": ["dir"]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines[:3]) + "\n")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda: sink.write_events(sink.dispatched(commands.command_stream(spark, str(tmp_path / "in"), allowed)), out, state).awaitTermination(120)
    assert run()
    (tmp_path / "in" / "b.txt").write_text("\n".join(lines[3:]) + "\n")
    assert run()
    schema = "type string, cmd string, error_type string, raw string, timestamp string"
    held = lambda: sorted((r["batch"], r["type"], r["cmd"], r["error_type"], r["raw"]) for r in sink.read_events(spark, out, schema).na.fill("-").collect())
    once = held()
    assert [r[1:4] for r in once if r[0] == 0] == [("accepted", "ping", "-"), ("error", "-", "invalid_json"), ("error", "-", "unknown_command")] and len(once) == 6
    table = sink.dispatched(commands.check_commands(spark.createDataFrame([(x,) for x in lines[3:]], "value string"), allowed))
    sink.batch_writer(out)(table, 1)
    assert held() == once
    assert all(r["timestamp"].endswith("Z") for r in sink.read_events(spark, out, schema).collect())
