"""Similar pairs with cells that never meet, against all pairs."""

import functools
import math

import numpy as np
import pytest

from sessionlake.operators import matching

SCHEMA = "id string, v array<double>"


def _brute(rows, above):
    keys, v = [k for k, x in rows if x is not None], np.array([x for _, x in rows if x is not None])
    with np.errstate(invalid="ignore"):
        u = v / (np.sqrt((v * v).sum(axis=1)) + 1e-9)[:, None]
        met = np.argwhere(u @ u.T > above)
    return {(keys[a], keys[b]) for a, b in met if keys[a] < keys[b]}


@pytest.mark.parametrize("above", [-0.4, 0.0, 0.7, 0.97, 1.5])
def test_pairs_equal_all_pairs(spark, above):
    """A third of the rows around one centre, the others around 24, with copies, lengths far apart, zeros, NaN and nulls."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(25, 8))
    rows = [(f"p{k:03}", (10.0 ** rng.integers(-3, 4) * (centres[0 if k % 3 == 0 else k % 25] + rng.normal(size=8) * 0.15)).tolist()) for k in range(300)]
    rows += [("z1", [0.0] * 8), ("z2", [0.0] * 8), ("nan", [float("nan")] + [1.0] * 7), ("none", None), ("copy", rows[5][1])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [(r["a"], r["b"]) for r in matching.similar_pairs(df, "id", "v", above, block=6).collect()]
    want = _brute(rows, above)
    assert len(got) == len(set(got)) and set(got) == want
    assert bool(want) == (above < 1)


def test_far_cells_never_meet(spark):
    """Of ten tight bundles of directions at right angles, only a small part of all pairs of cells meets."""
    rng = np.random.default_rng(3)
    rows = [(str(k), (np.eye(10)[k % 10] + rng.normal(size=10) * 0.01).tolist()) for k in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    _, cells = matching._cells(df, "id", "v", 0.95, 4)
    one, two = cells["c1"].to_numpy(), cells["c2"].to_numpy()
    n = len(set(one[one == two]))
    assert n > 10 and len(one) < n * (n + 1) / 2 / 3
    assert {(r["a"], r["b"]) for r in matching.similar_pairs(df, "id", "v", 0.95, block=4).collect()} == _brute(rows, 0.95)


def test_no_rows_and_one_row(spark):
    assert matching.similar_pairs(spark.createDataFrame([], SCHEMA), "id", "v", 0.5).collect() == []
    assert matching.similar_pairs(spark.createDataFrame([("a", [1.0, 2.0])], SCHEMA), "id", "v", 0.5).collect() == []


def test_nearest_of_group_in_cuts_and_parts(spark, monkeypatch):
    """Groups of several parts and cuts, copies in the library, zero vectors, groups without vectors, and no join of pairs."""
    rng = np.random.default_rng(4)
    rows = [(k, f"g{k % 5 if k % 2 else 0}", rng.normal(size=6).round(1).tolist() if k else None) for k in range(300)] + [(300, None, [1.0] * 6), (301, "g1", [0.0] * 6)]
    library = [(f"g{k % 4}", f"n{(k * 7) % 50:02}", rng.normal(size=6).round(1).astype("float32").tolist()) for k in range(40)]
    library += [(g, "m" + n, v) for g, n, v in library] + [("g0", "z", None), ("g0", "y", [0.0] * 6)]
    a, b = spark.createDataFrame(rows, "id long, g string, vec array<double>"), spark.createDataFrame(library, "g string, name string, vec array<float>")
    dot = lambda x, y: functools.reduce(lambda s, pq: s + pq[0] * pq[1], zip(x, y), 0.0)
    cos = lambda x, y: dot(x, y) / ((math.sqrt(dot(x, x)) + 1e-9) * (math.sqrt(dot(y, y)) + 1e-9))
    held = [(r["g"], r["name"], r["vec"]) for r in b.where("vec is not null").collect()]
    want = {k: min((-cos(v, w), n) for h, n, w in held if h == g) for k, g, v in rows if v is not None and any(h == g for h, _, _ in held)}
    for cut, least in ((32768, 4096), (7, 3)):
        monkeypatch.setattr(matching, "HELD", cut)
        monkeypatch.setattr(matching, "PASSING", least)
        found = matching.nearest_of_group(a, b, "g", ["id"], ["name"])
        assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()  # no product pair by pair
        got = {}
        for r in found.collect():
            got[r["id"]] = min(got.get(r["id"], (9, "")), (-r["score"], r["name"]))
        assert got == want and len(want) > 200


def test_a_task_holds_one_block(spark, monkeypatch):
    """Pairs go out in small batches, each vector passes by half of the blocks, and every pair comes once."""
    rng = np.random.default_rng(6)
    rows = [(f"p{k:03}", v) for k, v in enumerate(rng.normal(size=(200, 4)).round(1).tolist())]
    monkeypatch.setattr(matching, "SCORES", 64)
    monkeypatch.setattr(matching, "PAIRS", 10)
    for block in (20, 21, 23, 400):  # an even and an odd number of blocks, and one
        found = matching.similar_pairs(spark.createDataFrame(rows, SCHEMA), "id", "v", 0.2, block=block)
        got = [(r["a"], r["b"]) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == _brute(rows, 0.2)
        assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()  # no block is a row, so no batch holds many
