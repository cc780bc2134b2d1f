"""Quality rules and robust multivariate outliers, in DataFrame expressions only.

Statistics of a document are taken from its whole text. For every language and source the minimum-covariance-determinant
estimate is made of the transformed statistics. Three starts (median and MAD of each statistic; mean and covariance of
all rows; those of the half nearest to the first) are each carried on by concentration steps, which keep the ``SHARE`` of
the group with the smallest Mahalanobis distances and estimate mean and covariance again, until no determinant changes;
of the three ends the one of the smallest determinant is the estimate. The rows to keep are found from exact counts of a
fine logarithmic grid of distances, so no group is sorted or gathered, however large it is, and only estimates (some
numbers for each group) are joined to rows, by broadcast while they are few. Documents beyond ``CUTOFF`` are rejected.
The same estimate is made of every language and of the whole corpus, and each is shrunk towards the one above it, which
counts as ``min_rows`` rows of a group: means and covariances within are averaged by rows, so a group of few rows has
nearly the estimate above it, a large one its own, and every document has a distance.

Null and empty texts have no words and fail the base rule. Null languages and sources are groups of their own, as is a
table without these columns. Repeated rows are judged one by one; an empty table gives an empty table. Extra columns do
not matter, whatever their names; very long texts are judged whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let_go, scratch, written

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Share of a group that the estimate rests on, and the factor that makes its covariance consistent for four normal
#: statistics: 0.75 / P(chi2 of 6 degrees <= the 0.75 quantile of chi2 of 4 degrees).
SHARE, CONSISTENT = 0.75, 1.49
#: Squared Mahalanobis distance beyond which a document is rejected: far above the 0.9999 quantile of chi2 of 4 degrees
#: (23.5), since texts have heavier tails than normal ones.
CUTOFF = 50.0
#: Least standard deviation of each statistic: groups in which nearly all values agree do not reject small deviations.
FLOOR = {"x0": 0.25, "x1": 0.04, "x2": 0.12, "x3": 0.12}
X = tuple(FLOOR)
#: Determinants that change by less, as logarithms, have settled.
SETTLED = 1e-3
#: Pairs of language and source up to which their tables (at most nine rows of some numbers for each) are broadcast.
MOST_SENT = 10_000


def text_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and ``n_lines`` to the columns to keep."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("_t"))
    rows = rows.withColumns({
        "_w": F.filter(F.split("_t", SPACE), lambda w: w != ""),
        "_l": F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
        "n_symbols": (F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))).cast("long"),
    })
    windows = F.transform(F.sequence(F.lit(1), F.size("_w") - 4), lambda i: F.xxhash64(*[F.element_at("_w", i + k) for k in range(5)]))
    rows = rows.select(
        *[F.col(f"`{c}`") for c in keep],
        F.size("_w").cast("long").alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.when(F.size("_w") >= 6, windows).alias("_h"),
    )
    # windows found twice: sorted by hash, each equal to a neighbour; most texts have none and are not sorted
    doubled = F.size(F.array_distinct("_h")) < F.size("_h")
    rows = rows.withColumn("_s", F.when(doubled, F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    twice = lambda e, k: F.coalesce(F.get("_s", k - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get("_s", k + 1)["x"] == e["x"], F.lit(False))
    rows = rows.withColumn("_p", F.array_sort(F.transform(F.filter("_s", twice), lambda e: e["i"])))
    steps = F.zip_with("_p", F.slice("_p", 2, F.size("_p")), lambda a, b: F.coalesce(F.least(F.lit(5), b - a), F.lit(5)))
    repeated = F.when(F.col("_p").isNotNull(), F.aggregate(steps, F.lit(0).cast("long"), lambda n, s: n + s)).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("n_repeat_words", repeated).drop("_h", "_s", "_p")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def _transformed(rows: DataFrame) -> DataFrame:
    part = lambda a, b: F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return rows.withColumns({
        "x0": F.log(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)) + 1),
        "x1": F.sqrt(part("n_symbols", "word_chars")),
        "x2": F.asin(F.sqrt(part("n_repeat_words", "n_words"))),
        "x3": F.asin(F.sqrt(part("n_dup_lines", "n_lines"))),
    })


def _estimate(moments: DataFrame, *keep: str) -> DataFrame:
    """``_g``, columns to keep, mean, the Cholesky factor of the covariance and ``_det``, the logarithm of its determinant,
    from ``m_i`` and ``m_i_j``; floors are added to the diagonal."""
    d = range(len(X))
    out = moments
    for i in d:
        for j in range(i + 1):
            cov = (F.col(f"m{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * CONSISTENT
            if i == j:
                cov = F.greatest(cov, F.lit(0.0)) + FLOOR[X[i]] ** 2
            for k in range(j):
                cov = cov - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(cov, F.lit(FLOOR[X[i]] ** 2 / 4))) if i == j else cov / F.col(f"l{j}{j}"))
    det = sum((F.log(F.col(f"l{i}{i}")) * 2 for i in d), F.lit(0.0))
    return out.select("_g", *keep, *[f"m{i}" for i in d], *[f"l{i}{j}" for i in d for j in range(i + 1)], det.alias("_det"))


def _same(table: DataFrame) -> DataFrame:
    return table


def _distance(rows: DataFrame, estimate: DataFrame, sent=_same) -> DataFrame:
    """Adds ``_d2``, the squared distance from the estimate of the row's group ``_g``. ``sent`` marks tables of a row for
    each group, for broadcast where the groups are few."""
    out = rows.join(sent(estimate.drop("_det")), "_g", "left")
    total = F.lit(0.0)
    for i in range(len(X)):
        y = F.col(X[i]) - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l{i}{k}") * F.col(f"_y{k}")
        out = out.withColumn(f"_y{i}", y / F.col(f"l{i}{i}"))
        total = total + F.col(f"_y{i}") * F.col(f"_y{i}")
    return out.withColumn("_d2", total).select(*rows.columns, "_d2")


#: What ``_under`` needs of the moments besides the means.
SECOND = ("_n", *[f"m{i}_{j}" for i in range(len(X)) for j in range(i + 1)])


def _moments(rows: DataFrame) -> DataFrame:
    d = range(len(X))
    means = [F.avg(X[i]).alias(f"m{i}") for i in d]
    return rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), *means, *[F.avg(F.col(X[i]) * F.col(X[j])).alias(f"m{i}_{j}") for i in d for j in range(i + 1)])


def _medians(rows: DataFrame, sent) -> DataFrame:
    """An estimate of each group from medians and MADs alone."""
    d = range(len(X))
    middle = written(rows.groupBy("_g").agg(*[F.percentile_approx(X[i], 0.5, 1000).alias(f"m{i}") for i in d]))
    off = rows.join(sent(middle), "_g").groupBy("_g").agg(*[F.first(f"m{i}").alias(f"m{i}") for i in d], *[F.percentile_approx(F.abs(F.col(X[i]) - F.col(f"m{i}")), 0.5, 1000).alias(f"a{i}") for i in d])
    factor = {f"l{i}{j}": F.sqrt((F.col(f"a{i}") * 1.4826) ** 2 + FLOOR[X[i]] ** 2) if i == j else F.lit(0.0) for i in d for j in range(i + 1)}
    return off.withColumns(factor | {"_det": sum((F.log(factor[f"l{i}{i}"]) * 2 for i in d), F.lit(0.0))}).select("_g", *[f"m{i}" for i in d], *factor, "_det")


def _closest(scored: DataFrame, share: float, sent) -> DataFrame:
    """The share of each group with the smallest distances, up to a cell of the grid."""
    scored = scored.withColumn("_c", F.floor(F.log2(F.col("_d2") + 1e-6) * 32))
    counts = scored.groupBy("_g", "_c").agg(F.count(F.lit(1)).alias("_n"))
    up_to = Window.partitionBy("_g").orderBy("_c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of = Window.partitionBy("_g")
    sums = counts.select("_g", "_c", F.sum("_n").over(up_to).alias("_sum"), F.sum("_n").over(of).alias("_of"))
    last = sums.where(F.col("_sum") >= F.col("_of") * share).groupBy("_g").agg(F.min("_c").alias("_last"))
    return scored.join(sent(last), "_g").where(F.col("_c") <= F.col("_last"))


def _statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    docs = docs.withColumns({c: F.lit(None).cast("string") for c in ("lang", "source") if c not in docs.columns})
    rows = text_statistics(docs, [*keep, "lang", "source"])
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    rows = rows.withColumns({"_lang": named("lang"), "_pair": F.concat_ws("\x1f", named("lang"), named("source")), "base_failed": base_failed()})
    return _transformed(rows).drop("lang", "source")


def _under(own: DataFrame, above: DataFrame, rows_above: int) -> DataFrame:
    """The moments of groups (``_g, _up``) shrunk towards those of the groups above, which weigh as so many rows.

    Means and covariances are averaged apart: how far a group lies from the one above does not widen its covariance, so
    a lone outlier is as far off as it is for the group above.
    """
    d = range(len(X))
    moments = [*[f"m{i}" for i in d], *[f"m{i}_{j}" for i in d for j in range(i + 1)]]
    both = own.join(above.select(F.col("_g").alias("_up"), *[F.col(m).alias(f"_{m}") for m in moments]), "_up")
    share = F.col("_n") / (F.col("_n") + rows_above)
    mixed = lambda a, b: b + share * (a - b)
    cov = lambda i, j, x: F.col(f"{x}m{i}_{j}") - F.col(f"{x}m{i}") * F.col(f"{x}m{j}")
    mean = {i: mixed(F.col(f"m{i}"), F.col(f"_m{i}")) for i in d}
    products = [(mixed(cov(i, j, ""), cov(i, j, "_")) + mean[i] * mean[j]).alias(f"m{i}_{j}") for i in d for j in range(i + 1)]
    return both.select("_g", "_n", *[mean[i].alias(f"m{i}") for i in d], *products)


def _fit(rows: DataFrame, steps: int, min_rows: int) -> DataFrame:
    """The estimate of every pair of language and source: a small written table."""
    with scratch(rows.sparkSession):
        return written(_fitted(rows, steps, min_rows), keep=True)


def _fitted(rows: DataFrame, steps: int, min_rows: int) -> DataFrame:
    pairs = written(rows.select("_lang", "_pair").distinct())
    sent = F.broadcast if pairs.limit(MOST_SENT + 1).count() <= MOST_SENT else _same
    levels = F.array("_pair", "_lang", F.lit(""))
    in_group = rows.select(F.explode(levels).alias("_g"), *X)
    medians = written(_medians(in_group, sent))
    half = _estimate(_moments(_closest(_distance(in_group, medians, sent), 0.5, sent)))
    whole = _estimate(_moments(in_group))
    starts = [start.withColumn("_g", F.concat(F.lit(f"{k}\x1e"), "_g")) for k, start in enumerate((medians, whole, half))]
    estimate = written(starts[0].unionByName(starts[1]).unionByName(starts[2]))
    names = F.flatten(F.transform(levels, lambda g: F.array(*[F.concat(F.lit(f"{k}\x1e"), g) for k in range(len(starts))])))
    started = rows.select(F.explode(names).alias("_g"), *X)
    let_go(rows.sparkSession)
    for _ in range(max(steps, 1)):
        # written with its factors: a plan that holds their expressions, and a filter that repeats them, fill the driver
        before, estimate = estimate, written(_estimate(_moments(_closest(_distance(started, estimate, sent), SHARE, sent)), *SECOND))
        moved = estimate.join(before.select("_g", F.col("_det").alias("_was")), "_g")
        if moved.where(F.abs(F.col("_det") - F.col("_was")) > SETTLED).isEmpty():
            break
        let_go(rows.sparkSession)
    told = estimate.select("_g", *SECOND, *[f"m{i}" for i in range(len(X))], "_det").withColumn("_in", F.substring_index("_g", "\x1e", -1))
    least = told.groupBy("_in").agg(F.min(F.struct("_det", "_g"))["_g"].alias("_g"))
    moments = written(told.join(least.select("_g"), "_g", "left_semi").drop("_g", "_det").withColumnRenamed("_in", "_g"))
    languages = moments.join(pairs.select(F.col("_lang").alias("_g"), F.lit("").alias("_up")).distinct(), "_g")
    languages = _under(languages, moments.where("_g = ''"), min_rows)
    own = moments.join(pairs.select(F.col("_pair").alias("_g"), F.col("_lang").alias("_up")), "_g")
    return _estimate(_under(own, languages, min_rows))


def _judged(rows: DataFrame, estimate: DataFrame, cutoff: float) -> DataFrame:
    few = estimate.limit(MOST_SENT + 1).count() <= MOST_SENT
    rows = _distance(rows.withColumn("_g", F.col("_pair")), estimate, F.broadcast if few else _same)
    return rows.withColumn("_kept", ~F.col("base_failed") & (F.col("_d2") <= cutoff))


def judge_quality(docs: DataFrame, key: str = "doc_id", steps: int = 12, min_rows: int = 60, cutoff: float = CUTOFF) -> DataFrame:
    """One row per document: the key, the statistics, ``base_failed, distance2, kept``."""
    rows = written(_statistics(docs, [key]))
    return _judged(rows, _fit(rows, steps, min_rows), cutoff).select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("_d2").alias("distance2"), F.col("_kept").alias("kept")
    )


def filtered(docs: DataFrame, steps: int = 12, min_rows: int = 60, cutoff: float = CUTOFF) -> DataFrame:
    """The documents that are kept, all columns as they were.

    The statistics are taken once and written beside each document; the estimates read only their columns.
    """
    either = [c if c in docs.columns else None for c in ("lang", "source", "text")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *[c for c in either if c])
    rows = written(_statistics(packed, ["_doc"]))
    fitted = _fit(rows.drop("_doc"), steps, min_rows)
    return _judged(rows, fitted, cutoff).where("_kept").select("_doc.*")
