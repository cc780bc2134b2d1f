"""Command lines rewritten, filters from what was typed, orders of display, and vectors in passes."""

import json

import numpy as np
from pyspark.sql import functions as F

from sessionlake.operators import matching, polish, registry, regions, summaries
from sessionlake.streaming import commands

GIVEN = [
    ('{"type": "scan_files", "inputDir": "/in", "id": null}', {"cmd": "scan_files", "input_dir": "/in", "id": None, "probe_duration": True}),
    ('{"cmd": "scan_files", "type": "other", "inputDir": "/in", "input_dir": "/own", "probe_duration": false}', {"cmd": "scan_files", "input_dir": "/own", "probe_duration": False}),
    ('{"cmd": "scan_files", "inputDir": 7, "input_dir": 8, "probe_duration": "yes"}', {"cmd": "scan_files", "input_dir": 8, "probe_duration": True}),
    ('{"cmd": "scan_files", "inputDir": "/in", "input_dir": 8}', {"cmd": "scan_files", "input_dir": "/in", "probe_duration": True}),
    ('{"type": "process_batch", "files": ["a", {"path": "b", "size": 1}], "options": {"x": [1, {"y": null}]}}', {"cmd": "process_batch", "files": ["a", "b"], "options": {"x": [1, {"y": None}]}}),
    ('{"type": "process_batch"}', {"cmd": "process_batch", "files": []}),
    ('{"type": "process_batch", "files": "a"}', {"cmd": "process_batch", "files": []}),
    ('{"type": "process_batch", "files": [{"path": ""}]}', "bad_files"),
    ('{"type": "process_batch", "files": [3]}', "bad_files"),
    ('{"type": "ping", "probe_duration": 3, "inputDir": "x"}', {"cmd": "ping", "probe_duration": 3, "inputDir": "x"}),
    ('{"cmd": 5, "type": "ping"}', {"cmd": "ping"}), ('{"cmd": ""}', "no_command"), ("{}", "no_command"), ("[1]", "not_an_object"), ("oops", "not_an_object"), (None, "not_an_object"),
]


def test_commands_rewritten(spark):
    rows = spark.createDataFrame([(k, line) for k, (line, _) in enumerate(GIVEN)], "k int, value string")
    got = {r["k"]: r for r in commands.rewritten(rows).collect()}
    for k, (_, want) in enumerate(GIVEN):
        r = got[k]
        assert (r["refused"] if isinstance(want, str) else json.loads(r["command"])) == want, (k, r)


def test_filters(spark):
    typed = [(False, " 3x", " ann ", "", "0.70", "2024-01-01 "), (True, "3", "ann", "bob", "0.7", "x"), (None, "x", None, " ", "0", None), (False, "-2.9", "", None, "1e-1", ""), (False, None, None, None, "abc", None)]
    got = [tuple(r) for r in commands.redo_filters(spark.createDataFrame(typed, "everything boolean, threshold string, student string, teacher string, confidence string, after string")).collect()]
    none = (None,) * 5
    assert got == [(None, 3, "ann", None, 0.7, "2024-01-01"), (True, *none), (None, *none), (None, -2, None, None, 0.1, None), (None, *none)]


def test_display_order(spark):
    names = ["b", "a", "A", "á", "Z", "z", "ab", "e", "é", "f", None]
    rows = spark.createDataFrame([(k, 1, n) for k, n in enumerate(names)], "id int, g int, name string")
    assert [r["name"] for r in summaries.display_order(rows, "g", "name").orderBy("place").collect()] == ["a", "A", "á", "ab", "b", "e", "é", "f", "z", "Z", None]
    assert [r["id"] for r in summaries.display_order(rows, "g", "id").orderBy("place").collect()] == list(range(10, -1, -1))


def test_one_worker_a_pass_and_keys_of_any_type(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(f"p{k}", f"g{k % 7}", rng.normal(size=4).tolist() if k else None) for k in range(60)], "id string, g string, v array<double>")
    centroids = matching.mean_vectors(df, "g", "v").withColumnRenamed("g", "name")
    whole = sorted(map(tuple, matching.flips(df, centroids, "g", "name", "v", 0.1).drop("v").collect()))
    monkeypatch.setattr(matching, "BLOCK_BYTES", 64)
    monkeypatch.setattr(matching, "PASS_BLOCKS", 2)
    again = matching.flips(df, centroids, "g", "name", "v", 0.1)
    assert again._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, again.drop("v").collect())) == whole
    v = {r["id"]: np.array(r["v"]) for r in df.where("v is not null").collect()}
    cos = lambda a, b: float(v[a] @ v[b] / (np.linalg.norm(v[a]) * np.linalg.norm(v[b])))
    want = sorted((a, b) for a in v for b in v if a < b and cos(a, b) > 0.8)
    assert sorted((r["a"], r["b"]) for r in matching.similar_pairs(df.where("v is not null"), "id", "v", 0.8, block=8).collect()) == want and len(want) > 20


def test_display_names_and_sung_labels(spark):
    rows = spark.createDataFrame([("Ann", None), ("Ann", ""), ("Ann", "II")], "n string, m string")
    assert [r[0] for r in rows.select(registry.display(F.col("n"), F.col("m"))).collect()] == ["Ann", "Ann", "Ann (II)"]
    labels = spark.createDataFrame([("sung_low",), ("speaking",), ("unsung",), (None,)], "l string")
    assert [bool(r[0]) for r in labels.select(regions.is_sung(F.col("l"))).collect()] == [True, False, False, False]


def test_glossaries_of_any_size(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Right rights, LEFT wrong right"), (2, None), (3, "")], "doc_id int, text string")
    terms = spark.createDataFrame([("right", "right"), ("right", "rights"), ("left", "left"), ("both", "right"), ("none", None)], "term string, variant string")
    few = sorted(map(tuple, registry.glossary_hits(docs, terms, "doc_id").collect()))
    monkeypatch.setattr(registry, "FEW_VARIANTS", 1)
    assert few == sorted(map(tuple, registry.glossary_hits(docs, terms, "doc_id").collect())) == [(1, "both", 2), (1, "left", 1), (1, "right", 3)]
    assert registry.glossary_hits(docs, terms.limit(0), "doc_id").count() == 0


def test_an_unknown_gate_refuses_what_the_glossary_does_not_know(spark):
    words = spark.createDataFrame([("f", 0, k, "word", 0.1) for k in range(3)], "file_id string, segment_index int, word_index int, word string, probability double")
    patches = spark.createDataFrame([("f", 1, 0, 0, "word", "ward"), ("f", 2, 0, 1, "word", "term"), ("f", 3, 0, 2, "word", "zzz")], "file_id string, patch_no int, segment_index int, word_index int, original string, proposed string")
    said = lambda gate: [r[0] for r in polish.judge_patches(patches, words, ["term"], gate=gate).orderBy("patch_no").select("rejection_reason").collect()]
    assert said("other") == ["unknown_phonetic_gate", None, "unknown_phonetic_gate"] and said(polish.GATE) == [None, None, "phonetic_keys_differ"]
    (row,) = polish.apply_patches(patches, words, ["term"], gate="other").collect()
    assert row["text"] == "word term word" and {r["reason"] for r in row["rejected"]} == {"unknown_phonetic_gate"}
