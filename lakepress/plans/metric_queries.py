"""Queries of the evaluation stack."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakepress.operators import metrics as M
from lakepress.plans.registry import SCORED, Registry
from lakepress.sources import mapped as S

R = Registry()


def _right():
    return F.col("true_narrative") == F.col("pred_narrative")


def _f1_sql(where: str, t: str = "true_narrative", p: str = "pred_narrative", by: str = "") -> str:
    b = f"{by}, " if by else ""
    return (
        f"lab AS (SELECT DISTINCT {b}{t} AS label FROM {where} UNION SELECT DISTINCT {b}{p} FROM {where}), "
        f"cnt AS (SELECT {'l.' + by + ', ' if by else ''}l.label, sum(CASE WHEN o.{t} = l.label AND o.{p} = l.label THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN o.{t} <> l.label AND o.{p} = l.label THEN 1 ELSE 0 END)::BIGINT AS fp, "
        f"sum(CASE WHEN o.{t} = l.label AND o.{p} <> l.label THEN 1 ELSE 0 END)::BIGINT AS fn FROM lab l JOIN {where} o ON {'o.' + by + ' = l.' + by if by else 'true'} GROUP BY ALL), "
        f"f AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM cnt)"
    )


@R.add(f"{SCORED}, {_f1_sql('oof')} SELECT label, tp, fp, fn, round(f1, 9)::DOUBLE AS f1 FROM f")
def per_class_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and F1 of each label in truth or prediction."""
    return M.per_class_f1(S.scored(spark, sf_dir), "true_narrative", "pred_narrative").withColumn("f1", F.round("f1", 9))


@R.add(f"{SCORED}, {_f1_sql('oof', by='fold')}, a AS (SELECT fold, avg(CASE WHEN true_narrative = pred_narrative THEN 1.0 ELSE 0 END) AS acc, count(*) AS n FROM oof GROUP BY fold) SELECT a.fold, a.n, round(avg(f1), 9)::DOUBLE AS macro_f1, round(any_value(acc), 9)::DOUBLE AS accuracy FROM f JOIN a ON a.fold = f.fold GROUP BY a.fold, a.n")
def macro_f1_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A5: accuracy and macro-F1 of each fold."""
    s = S.scored(spark, sf_dir)
    acc = s.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(M.accuracy("true_narrative", "pred_narrative"), 9).alias("accuracy"))
    return M.macro_f1(s, "true_narrative", "pred_narrative", ["fold"]).withColumn("macro_f1", F.round("macro_f1", 9)).join(acc, "fold")


_MAP = "CASE {0} WHEN 'Alpha' THEN 'Main' WHEN 'Beta' THEN 'Main' WHEN 'Gamma' THEN 'Side' WHEN 'Delta' THEN 'Side' ELSE 'Other' END"


@R.add(f"{SCORED}, c AS (SELECT {_MAP.format('true_narrative')} AS t3, {_MAP.format('pred_narrative')} AS p3 FROM oof), {_f1_sql('c', 't3', 'p3')} SELECT round(avg(f1), 9)::DOUBLE AS macro_f1_3 FROM f")
def macro_f1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five classes collapsed to three, then macro-F1."""
    fold = F.create_map(*[F.lit(x) for x in chain(*S.COLLAPSE.items())])
    s = S.scored(spark, sf_dir).select(fold[F.col("true_narrative")].alias("t3"), fold[F.col("pred_narrative")].alias("p3"))
    return M.macro_f1(s, "t3", "p3").select(F.round("macro_f1", 9).alias("macro_f1_3"))


@R.add(f"{SCORED} SELECT has_body, count(*) AS n, round(avg(CASE WHEN true_severity = pred_severity THEN 1.0 ELSE 0 END), 9)::DOUBLE AS accuracy, round(coalesce(2.0 * sum(CASE WHEN true_severity = 'High' AND pred_severity = 'High' THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN true_severity = 'High' THEN 1 ELSE 0 END) + sum(CASE WHEN pred_severity = 'High' THEN 1 ELSE 0 END), 0), 0), 9)::DOUBLE AS f1_high FROM oof GROUP BY has_body")
def severity_by_has_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity metrics of each body regime."""
    return S.scored(spark, sf_dir).groupBy("has_body").agg(
        F.count(F.lit(1)).alias("n"), F.round(M.accuracy("true_severity", "pred_severity"), 9).alias("accuracy"), F.round(M.binary_f1("true_severity", "pred_severity", "High"), 9).alias("f1_high")
    )


@R.add(f"{SCORED}, l AS (SELECT unnest({list(S.NARRATIVES)}) AS label) SELECT l.label, " + ", ".join(f"count(CASE WHEN o.pred_narrative = '{x}' THEN 1 END) AS pred_{x}" for x in S.NARRATIVES) + " FROM l LEFT JOIN oof o ON o.true_narrative = l.label GROUP BY l.label")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square confusion matrix."""
    return M.confusion(S.scored(spark, sf_dir), "true_narrative", "pred_narrative", sorted(S.NARRATIVES))


@R.add(f"{SCORED} SELECT count(*) AS n, round(avg(CASE WHEN true_narrative = pred_narrative THEN 1.0 ELSE 0 END), 9)::DOUBLE AS narrative_accuracy, round(avg(CASE WHEN true_severity = pred_severity THEN 1.0 ELSE 0 END), 9)::DOUBLE AS severity_accuracy, avg(CASE WHEN true_narrative = pred_narrative THEN 1.0 ELSE 0 END) > 0.92 OR avg(CASE WHEN true_severity = pred_severity THEN 1.0 ELSE 0 END) > 0.92 AS leak_alarm, round(avg(conf), 9)::DOUBLE AS conf_mean, round(stddev_pop(conf), 9)::DOUBLE AS conf_std FROM oof")
def score_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, population deviation and leakage alarm in one pass."""
    a, b = M.accuracy("true_narrative", "pred_narrative"), M.accuracy("true_severity", "pred_severity")
    mean, std = M.mean_std("conf")
    return S.scored(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"), F.round(a, 9).alias("narrative_accuracy"), F.round(b, 9).alias("severity_accuracy"), ((a > M.ALARM) | (b > M.ALARM)).alias("leak_alarm"), F.round(mean, 9).alias("conf_mean"), F.round(std, 9).alias("conf_std")
    )


_BAND = "CASE WHEN conf < 0.5 THEN 0.0 WHEN conf < 0.6 THEN 0.5 WHEN conf < 0.7 THEN 0.6 WHEN conf < 0.8 THEN 0.7 WHEN conf < 0.9 THEN 0.8 ELSE 0.9 END"


@R.add(f"{SCORED}, g AS (SELECT ({_BAND})::DOUBLE AS band, count(*) AS n, avg(conf) AS c, avg(CASE WHEN true_narrative = pred_narrative THEN 1.0 ELSE 0 END) AS a FROM oof GROUP BY 1) SELECT band, n, round(n / sum(n) OVER (), 9)::DOUBLE AS share, round(c, 9)::DOUBLE AS mean_conf, round(a, 9)::DOUBLE AS accuracy, round(c - a, 9)::DOUBLE AS gap FROM g")
def reliability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence bands with share, accuracy and gap."""
    r = M.reliability(S.scored(spark, sf_dir), "conf", _right())
    return r.select("band", "n", *[F.round(c, 9).alias(c) for c in ("share", "mean_conf", "accuracy", "gap")])


@R.add(f"{SCORED}, e AS (SELECT i / 10.0 AS lo, CASE WHEN i = 9 THEN 1 + 1e-9 ELSE (i + 1) / 10.0 END AS hi FROM range(10) t(i)), g AS (SELECT lo, count(*) AS n, avg(conf) AS c, avg(CASE WHEN true_narrative = pred_narrative THEN 1.0 ELSE 0 END) AS a FROM oof JOIN e ON conf >= lo::DOUBLE AND conf < hi::DOUBLE GROUP BY lo) SELECT round(sum(n * abs(c - a)) / sum(n), 9)::DOUBLE AS ece FROM g")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected calibration error over ten bins."""
    return M.calibration_error(S.scored(spark, sf_dir), "conf", _right()).select(F.round("ece", 9).alias("ece"))


_T = [0.0, 0.5, 0.6, 0.7, 0.8, 0.9]


@R.add(f"{SCORED}, t AS (SELECT unnest({_T})::DOUBLE AS threshold), x AS (SELECT t.threshold, conf < t.threshold AS low, conf < t.threshold OR pred_severity = 'High' AS esc, true_narrative = pred_narrative AS ok FROM oof, t) SELECT threshold, round(avg(low::INT), 9)::DOUBLE AS low_share, round(avg(esc::INT), 9)::DOUBLE AS escalated_share, round(avg(CASE WHEN NOT low THEN ok::INT END), 9)::DOUBLE AS acc_confident, round(avg(CASE WHEN low THEN ok::INT END), 9)::DOUBLE AS acc_uncertain, round(sum((low AND NOT ok)::INT) / greatest(sum((NOT ok)::INT), 1), 9)::DOUBLE AS errors_caught FROM x GROUP BY threshold")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each confidence threshold escalates and catches."""
    r = M.threshold_sweep(S.scored(spark, sf_dir), "conf", _right(), F.col("pred_severity") == "High", _T)
    return r.select("threshold", *[F.round(c, 9).alias(c) for c in r.columns[1:]])


_Z = 1.96


@R.add(f"{SCORED}, g AS (SELECT source AS bucket, sum(CASE WHEN true_severity = 'High' THEN 1 ELSE 0 END)::BIGINT AS k, count(*) AS n FROM oof GROUP BY source), p AS (SELECT *, k * 1.0::DOUBLE / n AS p FROM g) SELECT bucket, k, n, round(greatest((p + {_Z*_Z} / (2 * n) - {_Z} * sqrt(p * (1 - p) / n + {_Z*_Z} / (4.0 * n * n))) / (1 + {_Z*_Z} / n), 0), 9)::DOUBLE AS low, round(least((p + {_Z*_Z} / (2 * n) + {_Z} * sqrt(p * (1 - p) / n + {_Z*_Z} / (4.0 * n * n))) / (1 + {_Z*_Z} / n), 1), 9)::DOUBLE AS high FROM p")
def wilson_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by bucket with Wilson intervals."""
    g = S.scored(spark, sf_dir).groupBy(F.col("source").alias("bucket")).agg(F.sum((F.col("true_severity") == "High").cast("long")).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = M.wilson(F.col("k"), F.col("n"))
    return g.select("bucket", "k", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@R.add(f"{SCORED}, g AS (SELECT true_narrative AS label, count(*) AS n FROM oof GROUP BY 1) SELECT label, n, round(least(sum(n) OVER () * 1.0::DOUBLE / (count(*) OVER () * n), 1.05), 9)::DOUBLE AS weight FROM g")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced class weights with a cap."""
    w = M.class_weights(S.scored(spark, sf_dir).select(F.col("true_narrative").alias("label")), "label", 1.05)
    return w.withColumn("weight", F.round("weight", 9))


@R.add(f"{SCORED}, k AS (SELECT fold, avg(length(source) * doc_id % 17) AS m, stddev_pop(length(source) * doc_id % 17) AS s FROM (SELECT f.fold, o.* EXCLUDE fold FROM (SELECT DISTINCT fold FROM oof) f JOIN oof o ON o.fold <> f.fold) GROUP BY fold) SELECT fold, round(m, 9)::DOUBLE AS mean, round(CASE WHEN s <= 1e-6 THEN 1 ELSE s END, 9)::DOUBLE AS std FROM k")
def feature_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature's mean and deviation over each fold's training rows.

    Sums of all rows less the fold's own give the training rows' moments in one pass.
    """
    x = F.pmod(F.length("source") * F.col("doc_id"), F.lit(17)).cast("double")
    per = S.scored(spark, sf_dir).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    whole = Window.partitionBy(F.lit(0))
    n, s, q = [F.sum(c).over(whole) - F.col(c) for c in ("n", "s", "q")]
    std = F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0)))
    return per.select("fold", F.round(s / n, 9).alias("mean"), F.round(F.when(std <= 1e-6, 1.0).otherwise(std), 9).alias("std"))


@R.add(f"{SCORED}, c AS (SELECT f.fold, o.true_narrative AS y, count(*) AS n FROM (SELECT DISTINCT fold FROM oof) f JOIN oof o ON o.fold <> f.fold GROUP BY 1, 2), b AS (SELECT fold, y, row_number() OVER (PARTITION BY fold ORDER BY n DESC, y) AS rn FROM c) SELECT o.doc_id, o.fold, b.y AS predicted FROM oof o JOIN b ON b.fold = o.fold AND b.rn = 1")
def majority_baseline_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row predicted by the majority of the other folds.

    Label counts of all folds less the own fold's; no self-join of rows.
    """
    s = S.scored(spark, sf_dir)
    per = s.groupBy("fold", "true_narrative").agg(F.count(F.lit(1)).alias("n"))
    folds, labels = per.select("fold").distinct(), per.groupBy("true_narrative").agg(F.sum("n").alias("total"), F.collect_set("fold").alias("__folds"))
    every = folds.withColumn("one", F.lit(1)).join(labels.withColumn("one", F.lit(1)), "one")
    train = every.join(per, ["fold", "true_narrative"], "left").select("fold", "true_narrative", (F.col("total") - F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")
    best = train.groupBy("fold").agg(F.min_by("true_narrative", F.struct(-F.col("n"), F.col("true_narrative"))).alias("predicted"))
    return s.join(best, "fold").select("doc_id", "fold", "predicted")


@R.add(f"{SCORED}, r AS (SELECT seed, fold, avg(CASE WHEN true_narrative = pred_narrative THEN 1.0 ELSE 0 END)::DOUBLE AS a, avg(CASE WHEN true_severity = pred_severity THEN 1.0 ELSE 0 END)::DOUBLE AS b FROM oof GROUP BY seed, fold) SELECT count(*) AS runs, round(avg(a - b), 9)::DOUBLE AS mean_delta, round(stddev_pop(a - b), 9)::DOUBLE AS std_delta, sum(CASE WHEN a > b THEN 1 ELSE 0 END)::BIGINT AS wins FROM r")
def paired_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two settings paired on seed and fold."""
    s = S.scored(spark, sf_dir)
    x = s.groupBy("seed", "fold").agg(M.accuracy("true_narrative", "pred_narrative").alias("a"))
    y = s.groupBy("seed", "fold").agg(M.accuracy("true_severity", "pred_severity").alias("b"))
    d = F.col("a") - F.col("b")
    return x.join(y, ["seed", "fold"]).agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg(d), 9).alias("mean_delta"), F.round(F.stddev_pop(d), 9).alias("std_delta"), F.sum((d > 0).cast("long")).alias("wins"))


@R.add(f"{SCORED}, r AS (SELECT seed, fold, avg(CASE WHEN true_narrative = pred_narrative THEN 1.0 ELSE 0 END)::DOUBLE AS a FROM oof GROUP BY seed, fold), s AS (SELECT seed, avg(a) AS m FROM r GROUP BY seed), f AS (SELECT fold, avg(a) AS m FROM r GROUP BY fold) SELECT (SELECT round(avg(a), 9)::DOUBLE FROM r) AS mean, (SELECT round(stddev_pop(a), 9)::DOUBLE FROM r) AS std, (SELECT round(stddev_pop(m), 9)::DOUBLE FROM s) AS std_seed_means, (SELECT round(stddev_pop(m), 9)::DOUBLE FROM f) AS std_fold_means, (SELECT round(quantile_cont(a, 0.5), 9)::DOUBLE FROM r) AS median, (SELECT round(max(a), 9)::DOUBLE FROM r) AS best")
def cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of runs over seeds and folds."""
    runs = S.scored(spark, sf_dir).groupBy("seed", "fold").agg(M.accuracy("true_narrative", "pred_narrative").alias("a"))
    per = lambda c: runs.groupBy(c).agg(F.avg("a").alias("m")).agg(F.round(F.stddev_pop("m"), 9).alias(f"std_{c}_means"), F.lit(1).alias("one"))
    whole = runs.agg(F.round(F.avg("a"), 9).alias("mean"), F.round(F.stddev_pop("a"), 9).alias("std"), F.round(F.percentile("a", 0.5), 9).alias("median"), F.round(F.max("a"), 9).alias("best"), F.lit(1).alias("one"))
    return whole.join(per("seed"), "one").join(per("fold"), "one").drop("one")


@R.add("WITH h AS (SELECT conv_id, turn, length(text) AS score, max(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations) SELECT conv_id, turn, CAST(score AS INT) AS score, before IS NULL OR score > before + 10 AS improved FROM h")
def early_stopping_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best score so far along each history, strict improvement by a margin."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    h = S.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("score")).withColumn("before", F.max("score").over(w))
    return h.select("conv_id", "turn", "score", (F.col("before").isNull() | (F.col("score") > F.col("before") + 10)).alias("improved"))


@R.add("WITH h AS (SELECT conv_id, arg_max(turn, length(text) * 1000 - turn) AS best_turn, max(turn) AS last_turn, max(length(text)) AS best, arg_max(length(text), turn) AS final FROM conversations GROUP BY conv_id) SELECT conv_id, best_turn, last_turn, CAST(best AS INT) AS best, CAST(final AS INT) AS final, best_turn = last_turn AS at_ceiling FROM h")
def selection_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected against final point of each history."""
    n = F.length("text")
    return S.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.max_by("turn", n * 1000 - F.col("turn")).alias("best_turn"), F.max("turn").alias("last_turn"), F.max(n).alias("best"), F.max_by(n, "turn").alias("final")
    ).withColumn("at_ceiling", F.col("best_turn") == F.col("last_turn"))


@R.add(f"{SCORED} SELECT fold, count(*) AS n, " + ", ".join(f"sum(CASE WHEN true_narrative = '{x}' THEN 1 ELSE 0 END)::BIGINT AS \"{x}\"" for x in S.NARRATIVES) + ", sum(CASE WHEN true_severity = 'High' THEN 1 ELSE 0 END)::BIGINT AS high, sum(CASE WHEN has_body THEN 1 ELSE 0 END)::BIGINT AS bodied FROM oof GROUP BY fold")
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: classes of each fold, absent ones 0."""
    s = S.scored(spark, sf_dir)
    p = s.groupBy("fold").pivot("true_narrative", list(S.NARRATIVES)).count().fillna(0)
    rest = s.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("true_severity") == "High").cast("long")).alias("high"), F.sum(F.col("has_body").cast("long")).alias("bodied"))
    return rest.join(p, "fold")


_CB = "CASE WHEN conf > 0 AND conf <= 0.699 THEN 'low' WHEN conf > 0.699 AND conf <= 0.849 THEN 'mid' WHEN conf > 0.849 AND conf <= 1 THEN 'high' END"


@R.add(f"{SCORED} SELECT {_CB} AS bin, lang, count(*) AS n, sum(CASE WHEN true_narrative <> pred_narrative THEN 1 ELSE 0 END)::BIGINT AS errors, round(avg(CASE WHEN true_narrative = pred_narrative THEN 1.0 ELSE 0 END), 9)::DOUBLE AS accuracy FROM oof GROUP BY 1, 2")
def error_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by right-closed confidence bins and language."""
    c = F.col("conf")
    b = F.when((c > 0) & (c <= 0.699), "low").when((c > 0.699) & (c <= 0.849), "mid").when((c > 0.849) & (c <= 1), "high")
    return S.scored(spark, sf_dir).groupBy(b.alias("bin"), "lang").agg(F.count(F.lit(1)).alias("n"), F.sum((~_right()).cast("long")).alias("errors"), F.round(M.accuracy("true_narrative", "pred_narrative"), 9).alias("accuracy"))


@R.add("SELECT event_type, round(quantile_cont(value, 0.5), 6)::DOUBLE AS p50, round(quantile_cont(value, 0.95), 6)::DOUBLE AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p50 and p95."""
    return S.table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@R.add("WITH t AS (SELECT unnest(string_split(p_type, ' ')) AS kind FROM part) SELECT kind, count(*) AS n FROM t WHERE kind <> '' GROUP BY kind")
def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of listed types."""
    return S.table(spark, sf_dir, "part").select(F.explode(F.filter(F.split("p_type", " "), lambda x: x != "")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"{SCORED} SELECT true_severity, sum(CASE WHEN pred_severity = 'High' THEN 1 ELSE 0 END)::BIGINT AS flagged, sum(CASE WHEN pred_severity = 'High' AND conf < 0.5 THEN 1 ELSE 0 END)::BIGINT AS unsure, count(*) AS n FROM oof GROUP BY 1")
def screen_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a screen."""
    flagged = F.col("pred_severity") == "High"
    return S.scored(spark, sf_dir).groupBy("true_severity").agg(F.sum(flagged.cast("long")).alias("flagged"), F.sum((flagged & (F.col("conf") < 0.5)).cast("long")).alias("unsure"), F.count(F.lit(1)).alias("n"))


@R.add()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired bootstrap of narrative against severity accuracy."""
    s = S.scored(spark, sf_dir)
    d = (F.col("true_narrative") == F.col("pred_narrative")).cast("int") - (F.col("true_severity") == F.col("pred_severity")).cast("int")
    return M.paired_bootstrap(s, d)
