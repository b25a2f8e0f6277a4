"""Classification metrics and calibration as aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: bands and alarm
#: bands of the reliability table; the last is closed by a little more than 1
BANDS = (0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0001)
#: accuracy beyond which a leak is likelier than skill
ALARM = 0.92
#: share of resamples that a challenger must win
SWITCH = 0.90


def accuracy(truth: str, pred: str) -> Column:
    return F.avg((F.col(truth) == F.col(pred)).cast("double"))


def label_counts(rows: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """(by..., label, tp, fp, fn) of every label in truth or prediction, in one pass."""
    by = by or []
    right = F.col(truth) == F.col(pred)
    parts = F.when(right, F.array(F.struct(F.col(truth).alias("label"), F.lit("tp").alias("kind")))).otherwise(
        F.array(F.struct(F.col(pred).alias("label"), F.lit("fp").alias("kind")), F.struct(F.col(truth).alias("label"), F.lit("fn").alias("kind")))
    )
    long = rows.select(*by, F.explode(parts).alias("x")).select(*by, "x.label", "x.kind")
    return long.groupBy(*by, "label").agg(*[F.sum((F.col("kind") == k).cast("long")).alias(k) for k in ("tp", "fp", "fn")])


def f1() -> Column:
    """From tp, fp and fn; 0 where nothing was there to find."""
    d = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return F.when(d > 0, 2 * F.col("tp") / d).otherwise(0.0)


def per_class_f1(rows: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    return label_counts(rows, truth, pred, by).withColumn("f1", f1())


def macro_f1(rows: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return per_class_f1(rows, truth, pred, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def binary_f1(truth: str, pred: str, label: str) -> Column:
    t, p = F.col(truth) == label, F.col(pred) == label
    tp, d = F.sum((t & p).cast("long")), F.sum(t.cast("long") + p.cast("long"))
    return F.coalesce(F.try_divide(2.0 * tp, d), F.lit(0.0))


def confusion(rows: DataFrame, truth: str, pred: str, labels: list[str]) -> DataFrame:
    """A row for each label, a column pred_<label> for each label; square and complete."""
    every = rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    counted = rows.groupBy(F.col(truth).alias("label")).pivot(pred, labels).count()
    return every.join(counted, "label", "left").fillna(0).select("label", *[F.col(f"`{x}`").alias(f"pred_{x}") for x in labels])


def mean_std(c: str) -> list[Column]:
    """Mean and population deviation; NaN where there are no rows."""
    nan = F.lit(float("nan"))
    return [F.coalesce(F.avg(c), nan).alias(f"{c}_mean"), F.coalesce(F.stddev_pop(c), nan).alias(f"{c}_std")]


def band(conf: Column, edges: tuple[float, ...] = BANDS) -> Column:
    """Lower edge of the band, left-closed; null outside."""
    out = F.lit(None).cast("double")
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        out = F.when((conf >= lo) & (conf < hi), F.lit(lo)).otherwise(out)
    return out


def reliability(rows: DataFrame, conf: str, right: Column) -> DataFrame:
    """band, n, share, mean confidence, accuracy, gap; empty bands are absent."""
    g = rows.withColumn("band", band(F.col(conf))).where("band is not null").groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.avg(conf).alias("mean_conf"), F.avg(right.cast("double")).alias("accuracy")
    )
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))
    return g.withColumn("share", share).withColumn("gap", F.col("mean_conf") - F.col("accuracy"))


def calibration_error(rows: DataFrame, conf: str, right: Column, bins: int = 10) -> DataFrame:
    """One row: ece over equal bins whose last edge lies a little above 1."""
    edges = tuple(i / bins for i in range(bins)) + (1 + 1e-9,)
    g = rows.withColumn("bin", band(F.col(conf), edges)).where("bin is not null").groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(conf).alias("c"), F.avg(right.cast("double")).alias("a")
    )
    return g.agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))


def threshold_sweep(rows: DataFrame, conf: str, right: Column, high: Column, thresholds: list[float]) -> DataFrame:
    """For each threshold: shares of low confidence and of escalation, accuracy on both sides, errors caught.

    One row of partial sums per threshold: rows are not multiplied.
    """
    aggs = [F.count(F.lit(1)).alias("n"), F.sum((~right).cast("long")).alias("n_err")]
    for i, t in enumerate(thresholds):
        low = F.col(conf) < t
        aggs += [
            F.sum(low.cast("long")).alias(f"low_{i}"),
            F.sum((low | high).cast("long")).alias(f"esc_{i}"),
            F.sum((low & right).cast("long")).alias(f"lr_{i}"),
            F.sum((~low & right).cast("long")).alias(f"hr_{i}"),
        ]
    one = rows.agg(*aggs)
    lines = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.try_divide(F.col(f"low_{i}"), F.col("n")).alias("low_share"),
            F.try_divide(F.col(f"esc_{i}"), F.col("n")).alias("escalated_share"),
            F.try_divide(F.col(f"hr_{i}"), F.col("n") - F.col(f"low_{i}")).alias("acc_confident"),
            F.try_divide(F.col(f"lr_{i}"), F.col(f"low_{i}")).alias("acc_uncertain"),
            ((F.col(f"low_{i}") - F.col(f"lr_{i}")) / F.greatest(F.col("n_err"), F.lit(1))).alias("errors_caught"),
        )
        for i, t in enumerate(thresholds)
    ]
    return one.select(F.inline(F.array(*lines)))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a proportion; (0, 1) where there are no trials."""
    p = F.try_divide(k.cast("double"), n)
    d = 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / d
    return F.when(n > 0, F.greatest(mid - half, F.lit(0.0))).otherwise(0.0), F.when(n > 0, F.least(mid + half, F.lit(1.0))).otherwise(1.0)


def review_estimates(reviewed: DataFrame, unflagged: int) -> DataFrame:
    """One row from a reviewed sample (bucket, yes, flagged): how right a rule is and how much it misses.

    Precision is over every reviewed row that the rule flags. The share of
    hits among the random bucket, times the ``unflagged`` rows of the corpus,
    estimates what the rule misses; both come with Wilson bounds. Recall is
    what it found over that and what it misses; null where both are 0.
    """
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    random = F.col("bucket") == "random"
    one = reviewed.agg(count(F.col("flagged")).alias("n"), count(F.col("flagged") & F.col("yes")).alias("k"), count(random).alias("rn"), count(random & F.col("yes")).alias("rk"))
    low, high = wilson(F.col("k"), F.col("n"))
    rlow, rhigh = wilson(F.col("rk"), F.col("rn"))
    rate = F.coalesce(F.try_divide("rk", "rn"), F.lit(0.0))
    return one.select(
        F.col("n").alias("n_flagged"), F.col("k").alias("n_right"), F.coalesce(F.try_divide("k", "n"), F.lit(0.0)).alias("precision"), low.alias("precision_low"), high.alias("precision_high"),
        (rate * unflagged).alias("missed"), (rlow * unflagged).alias("missed_low"), (rhigh * unflagged).alias("missed_high"), F.try_divide(F.col("k").cast("double"), F.col("k") + rate * unflagged).alias("recall"),
    )


def class_weights(rows: DataFrame, label: str, cap: float | None = None) -> DataFrame:
    """n / (k * n_c) over the classes present; a lone class weighs 1."""
    g = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))
    n, k = F.sum("n").over(whole), F.count(F.lit(1)).over(whole)
    w = F.when(k > 1, n / (k * F.col("n"))).otherwise(1.0)
    return g.withColumn("weight", F.least(w, F.lit(cap)) if cap else w)


def majority(c: str) -> Column:
    """Most frequent label, the smallest of equals."""
    return F.mode(c, True)


def _resampled(different: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(b, drawn, total) of (d, n): what each resample draws and its sum, all resamples in one pass.

    A row comes into a resample as often as a Poisson number of mean one says,
    so ``n`` rows of one difference as often as one of mean ``n``; the draws
    hang on the seed and the difference alone. A task adds up arrays of one
    number a resample, whatever it reads.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn, total = np.zeros(resamples), np.zeros(resamples)
        for f in frames:
            for d, n in zip(f["d"].to_numpy(dtype=float), f["n"].to_numpy(), strict=True):
                often = np.random.default_rng([seed, int(np.float64(d + 0.0).view(np.uint64))]).poisson(n, resamples)
                drawn += often
                total += often * d
        yield pd.DataFrame({"b": np.arange(resamples), "drawn": drawn, "total": total})

    each = different.mapInPandas(run, "b bigint, drawn double, total double")
    return each.groupBy("b").agg(F.sum("drawn").alias("drawn"), F.sum("total").alias("total"))


def paired_bootstrap(rows: DataFrame, better: Column, resamples: int = 4000, seed: int = 11) -> DataFrame:
    """One row: mean difference, 2.5 and 97.5 percentiles over resamples, share above 0.

    ``better`` is each row's difference. Equal differences are counted first,
    and each is drawn in all resamples at once, so the cost grows with the
    different values and not with rows times resamples. Null differences are
    left out; without any others there are no resamples. A run repeats but for
    the order in which numbers are added.
    """
    different = rows.select(better.cast("double").alias("d")).where("d is not null").groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    # a resample that draws nothing has no mean
    means = _resampled(different, resamples, seed).where("drawn > 0").select((F.col("total") / F.col("drawn")).alias("m"))
    return means.agg(
        F.percentile("m", 0.5).alias("median"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.avg((F.col("m") > 0).cast("double")).alias("p_better"), F.count(F.lit(1)).alias("resamples")
    )
