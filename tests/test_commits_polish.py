"""Writers that commit at once, and polishing with backends that fail, dawdle and lie."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from sessionlake.operators import polish
from sessionlake.sources import sinks


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    errors, wins = [], []

    def add(who):
        try:
            for k in range(3):
                row = spark.createDataFrame([(f"{who}{k}",)], "name string")
                wins.append(sinks.update(spark, path, lambda now, row=row: row if now is None else now.union(row)))
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=add, args=(w,)) for w in "abc"]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert not errors and sorted(wins) == list(range(1, 10))
    assert sorted(r["name"] for r in sinks.current(spark, path).collect()) == sorted(f"{w}{k}" for w in "abc" for k in range(3))


def test_a_commit_that_was_cut_off_is_carried_out(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.update(spark, path, lambda now: spark.range(2)) == 1
    spark.range(5).write.parquet(f"{path}/staged/x")
    assert sinks._created(spark, f"{path}/commits/2", "x") and not sinks._created(spark, f"{path}/commits/2", "y")
    assert sinks.current(spark, path).count() == 2
    assert sinks.update(spark, path, lambda now: now.union(spark.range(1))) == 3 and sinks.current(spark, path).count() == 6
    assert sinks.update(spark, path, lambda now: now.where("false")) == 4 and sinks.current(spark, path).count() == 0


SEGMENT = "file_id string, seg_idx int, start double, end double, speaker_id string, text string, extra int"


def segments(n=23):
    return [(f, i, i * 1.0, i + 0.5, None if i == 4 else "s", f"{f} text {i}", i) for f in ("a", "b", "c", "d", "e", "f") for i in range(n)]


def replies(prompt):
    """By file: a good backend, one that fails, one that dawdles, liars of three kinds."""
    import json as j
    import time

    rows = j.loads(prompt)
    kind = rows[0]["text"][0]
    for r in rows:
        r["text"] = r["text"].upper()
        r["start"] += 0.0005
    if kind == "b":
        raise RuntimeError("no")
    if kind == "c":
        time.sleep(4)
    if kind == "d":
        rows[-1]["start"] += 1
    if kind == "e":
        rows.pop()
    if kind == "f":
        rows[0]["speaker_id"] = "other"
    return f"Here it is:\n```json\n{j.dumps(rows)}\n```"


def test_backends(spark):
    rows = segments()
    made = replies

    def backend(prompt):
        return made(prompt)

    import types

    made = types.FunctionType(replies.__code__, {"__builtins__": __builtins__})  # goes to workers by value
    out = polish.polished(spark.createDataFrame(rows, SEGMENT).repartition(3), polish.asked(backend, at_once=4, seconds=1.5), size=10, overlap=2)
    got = sorted(map(tuple, out.select(*[c.split()[0] for c in SEGMENT.split(", ")], "polished").collect()))
    assert [r[:2] for r in got] == [r[:2] for r in rows]
    for r, old in zip(got, rows):
        assert r == (*old[:5], old[5].upper(), old[6], True) if old[0] == "a" else r == (*old, False)


def test_the_earlier_chunk_stays_and_missing_texts_change_nothing(spark):
    rows = [r for r in segments(12) if r[0] == "a"]

    def backend(prompt):
        import json

        said = json.loads(prompt)
        for k, r in enumerate(said):
            r["text"] = None if k == 1 else f"{said[0]['text']} {k}" if k else r["text"]
        return json.dumps(said)

    out = polish.polished(spark.createDataFrame(rows, SEGMENT), polish.asked(backend), size=5, overlap=2).orderBy("seg_idx").collect()
    assert [r["text"] for r in out[:8]] == ["a text 0", "a text 1", "a text 0 2", "a text 0 3", "a text 0 4", "a text 3 2", "a text 3 3", "a text 3 4"] and not out[1]["polished"]
    none = polish.polished(spark.createDataFrame([], SEGMENT), polish.asked(backend))
    assert none.count() == 0 and polish.polished(spark.createDataFrame(rows, SEGMENT).withColumn("polished", F.lit(True)), polish.asked(lambda p: "no json")).where("polished").count() == 0
