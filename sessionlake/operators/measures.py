"""Measures: confusion matrices, threshold sweeps, signal levels, sustained pitch, voice regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed pitch bands (Hz) where the voice type is unknown.
SPEAKING, LOW, MID = (100, 280), (90, 280), (280, 500)
SILENCE = -120.0


def confusion(rows: DataFrame, truth: Column, said: Column) -> DataFrame:
    """One row: ``tp, tn, fp, fn, f1, recall`` (to four places; 0 where undefined)."""
    n = lambda c: F.count_if(c)
    counts = rows.agg(n(truth & said).alias("tp"), n(~truth & ~said).alias("tn"), n(~truth & said).alias("fp"), n(truth & ~said).alias("fn"))
    f1 = F.when(F.col("tp") > 0, F.round(F.col("tp") * 2 / (F.col("tp") * 2 + F.col("fp") + F.col("fn")), 4)).otherwise(0.0)
    recall = F.when(F.col("tp") > 0, F.round(F.col("tp") / (F.col("tp") + F.col("fn")), 4)).otherwise(0.0)
    return counts.withColumns({"f1": f1, "recall": recall})


def sweep(rows: DataFrame, metric: str, cost: str, thresholds: list[float]) -> DataFrame:
    """For each threshold, counts and mean costs of rows below it and of the others, in one pass over the rows.

    Null metrics are on neither side; a side without rows has a null mean and the threshold no separation.
    """
    sums = []
    for k, t in enumerate(thresholds):
        for side, fits in (("flagged", F.col(metric) < t), ("unflagged", F.col(metric) >= t)):
            sums += [F.count_if(fits).alias(f"n_{side}_{k}"), F.avg(F.when(fits, F.col(cost))).cast("double").alias(f"cost_{side}_{k}")]
    once = rows.agg(*sums)
    parts = ("n_flagged", "n_unflagged", "cost_flagged", "cost_unflagged")
    each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{p}_{k}").alias(p) for p in parts]) for k, t in enumerate(thresholds)])
    return once.select(F.explode(each).alias("r")).select("r.*").withColumn("separation", F.col("cost_flagged") - F.col("cost_unflagged"))


def recommended(swept: DataFrame) -> DataFrame:
    """The threshold of the largest separation, the first on ties."""
    return swept.where("separation is not null").agg(F.min(F.struct((-F.col("separation")).alias("m"), "threshold")).alias("b")).select(F.col("b.threshold").alias("threshold"))


def rms_dbfs(samples: Column) -> Column:
    """Level of the samples; silence and empty signals are at -120."""
    power = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size(samples)
    return F.when((F.size(samples) > 0) & (power > 0), F.log10(F.sqrt(power)) * 20).otherwise(SILENCE)


def zero_crossings(samples: Column) -> Column:
    """Changes of sign over neighbours; 0 for fewer than two samples."""
    pairs = F.zip_with(F.slice(samples, 1, F.greatest(F.size(samples) - 1, F.lit(0))), F.slice(samples, 2, F.greatest(F.size(samples) - 1, F.lit(0))), lambda a, b: (a < 0) != (b < 0))
    return F.when(F.size(samples) >= 2, F.size(F.filter(pairs, lambda p: p)) / (F.size(samples) - 1)).otherwise(0.0)


def clipping_ratio(samples: Column, at: float = 0.995) -> Column:
    return F.when(F.size(samples) > 0, F.size(F.filter(samples, lambda x: F.abs(x) >= at)) / F.size(samples)).otherwise(0.0)


def sounds_sung(samples: Column) -> Column:
    return F.when((rms_dbfs(samples) < -30) & (zero_crossings(samples) > 0.3), "sung").otherwise("spoken")


def sustained(contour: Column, frames: int, semitones: float = 0.5) -> Column:
    """Whether so many voiced frames in a row stay near the first of their run; 0 is unvoiced."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("base"), F.lit(False).alias("hit"))

    def step(s, f):
        f = f.cast("double")
        near = (s["n"] > 0) & (F.abs(F.log2(f / s["base"])) * 12 <= semitones)
        n = F.when(f <= 0, 0).when(near, s["n"] + 1).otherwise(1)
        return F.struct(n.alias("n"), F.when(near, s["base"]).otherwise(f).alias("base"), (s["hit"] | (n >= frames)).alias("hit"))

    return F.aggregate(contour, start, step, lambda s: s["hit"])


def voice_region(contour: Column, frames: int, steady: float = 0.08) -> Column:
    """The region of a pitch contour by its voiced frames, with the bands for an unknown voice type."""
    voiced = F.array_sort(F.filter(F.transform(contour, lambda f: f.cast("double")), lambda f: f > 0))
    n = F.size(voiced)
    middle = (F.get(voiced, F.expr("0") + F.floor((n - 1) / 2).cast("int")) + F.get(voiced, F.floor(n / 2).cast("int"))) / 2
    mean = F.aggregate(voiced, F.lit(0.0), lambda s, x: s + x) / n
    spread = F.sqrt(F.aggregate(voiced, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n) / mean
    within = lambda band: (middle >= band[0]) & (middle < band[1])
    return (
        F.when(n == 0, "speaking").when(middle.between(*SPEAKING) & (spread <= steady), "speaking").when(sustained(contour, frames), "sung_full")
        .when(within(LOW), "sung_low").when(within(MID), "sung_mid").otherwise("sung_high")
    )
