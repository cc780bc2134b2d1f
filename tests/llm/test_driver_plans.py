"""What the driver holds of a query's plan: estimates are read, not recomputed, and links are read once."""

from pyspark.sql import functions as F

from sessionlake.llm import jaccard_join, quality


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan()


def test_estimates_are_read_and_not_recomputed_by_every_plan(spark, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(30) + F.col("id") % 40), lambda i: F.sha1((i * F.col("id")).cast("string")).substr(F.lit(1), (i * F.col("id")) % 9 + 1))).alias("text"))
    got, distance = [], quality._distance
    monkeypatch.setattr(quality, "_distance", lambda rows, estimate, sent=quality._same: got.append(estimate) or distance(rows, estimate, sent))
    assert quality.judge_quality(docs).count() == 400
    assert len(got) >= 4  # the half nearest to the medians, two steps at least, the verdicts
    for estimate in got:
        assert "SQRT(" not in optimized(estimate).toString()
        text = optimized(estimate.where(F.abs("_det") > 1)).toString()
        assert len(text.splitlines()) <= 4, text


def test_components_read_their_links_once(spark, monkeypatch):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 5), (9, 9)], "a long, b long").where("a > 0")
    plans, written = [], jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df, keep=False: plans.append(optimized(df)) or written(df, keep))
    found = {r["id"]: r["component"] for r in jaccard_join.components(links).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 5: 5, 7: 5, 9: 9}
    assert plans[0].collectLeaves().size() == 1
