"""Bound queries on few rows that the small tables lack, against the same query in DuckDB."""

import datetime

import duckdb
import pandas as pd
import pytest

from sessionlake.plans import bindings
from sessionlake.plans import session_queries  # noqa: F401


@pytest.fixture
def told(spark, tmp_path):
    """Rows of a query and of its SQL, both in order, over tables made of given columns."""

    def both(name, **tables):
        con = duckdb.connect()
        for table, columns in tables.items():
            frame = pd.DataFrame(columns)
            if "ts" in frame:
                frame["ts"] = frame["ts"].astype("datetime64[us]")
            frame.to_parquet(tmp_path / f"{table}.parquet")
            con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
        want = con.execute(bindings.ORACLE_SQL[name])
        columns = [c[0] for c in want.description]
        return sorted(tuple(r) for r in bindings.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()), sorted(want.fetchall())

    return both


def test_bands_end_where_the_decimals_do(told):
    # 100 + 0.35 * n in doubles is not the nearest double of its decimal for these n: the pitch on the band's end is speech
    keys = [k for k in range(3, 6000, 3) if k % 7 and k % 9 and k % 20 <= 8 and (n := k % 500 - 40) > 0 and 100 + 0.35 * n < (1000 + 3.5 * n) / 10]
    got, want = told("q_pitch_region", customer={"c_custkey": keys, "c_nationkey": pd.Series([0] * len(keys), dtype="int32"), "c_acctbal": [1000 + 3.5 * (k % 500 - 40) for k in keys]})
    assert len(keys) > 10 and {r[3] for r in want} == {"speaking"}
    assert got == want


def test_empty_turns_are_short(told):
    got, want = told("q_sample_bounds", events={"event_id": [1, 2, 3, 4], "value": [0.0, 2.99, 3.0, 150.0]})
    assert [r[3] for r in want] == [True, True, False, False]
    assert got == want


def test_empty_words_and_turns_within_each_other(told):
    at = datetime.datetime(2024, 1, 1)
    rows = [(1, 0, 0, 60.0, "view"), (2, 0, 10, 0.0, "click"), (4, 1, 0, 60.0, "view"), (5, 1, 10, 0.0, "click"), (7, 2, 0, 0.0, "view"), (9, 2, 0, 30.0, "error"), (8, 2, 30, 0.0, "click")]
    got, want = told("q_words_speakers", events={
        "event_id": [r[0] for r in rows], "user_id": [r[1] for r in rows], "ts": [at + datetime.timedelta(minutes=r[2]) for r in rows], "value": [r[3] for r in rows], "event_type": [r[4] for r in rows]})
    assert dict(want)[2] == "view,view,view,view" and dict(want)[4] == "click,-,-,-"
    assert got == want
