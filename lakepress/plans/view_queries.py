"""Queries over the read model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakepress.functions import keywords as K
from lakepress.functions import text as T
from lakepress.operators import folds as X
from lakepress.operators import views as V
from lakepress.plans.registry import ART, MODEL, PRED, REV, Registry
from lakepress.sources import mapped as S

R = Registry()


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.read_model(S.articles(spark, sf_dir), S.predictions(spark, sf_dir), S.explanations(spark, sf_dir), S.reviews(spark, sf_dir))


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    m = model(spark, sf_dir).where(V.view(name, S.ANALYSIS_SOURCES, "source"))
    return m.select("doc_id", "headline", "source", "has_body", "eff_narrative", "eff_severity", "p_high", V.category(S.ANALYSIS_SOURCES, "source").alias("category"))


def _view_sql(name: str) -> str:
    return (
        MODEL + "SELECT doc_id, headline, source, has_body, eff_narrative, eff_severity, p_high, CASE WHEN dismissed THEN 'dismissed' WHEN source IN ('src3', 'src7') THEN 'analysis'"
        f" WHEN eff_severity = 'High' AND has_body THEN 'alert' WHEN eff_severity = 'High' THEN 'unconfirmed' ELSE 'normal' END AS category FROM flags WHERE v_{name}"
    )


@R.add(_view_sql("all"))
def view_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that is not dismissed."""
    return _view(spark, sf_dir, "all")


@R.add(_view_sql("alerts"))
def view_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High articles with a body from other than analysis outlets."""
    return _view(spark, sf_dir, "alerts")


@R.add(_view_sql("unconfirmed"))
def view_unconfirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High headlines without a body."""
    return _view(spark, sf_dir, "unconfirmed")


@R.add(_view_sql("analysis"))
def view_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what analysis outlets wrote."""
    return _view(spark, sf_dir, "analysis")


@R.add(_view_sql("review"))
def view_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what waits for an analyst."""
    return _view(spark, sf_dir, "review")


@R.add(_view_sql("dismissed"))
def view_dismissed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what an analyst found not relevant."""
    return _view(spark, sf_dir, "dismissed")


@R.add(MODEL + "SELECT " + ", ".join(f"CAST(coalesce(sum(CASE WHEN v_{v} THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_{v}" for v in V.VIEWS) + " FROM flags")
def view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of all views in one pass."""
    return V.view_counts(model(spark, sf_dir), S.ANALYSIS_SOURCES, "source")


@R.add(MODEL + "SELECT " + ", ".join(f"CAST(coalesce(sum(CASE WHEN v_{v} THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_{v}" for v in V.VIEWS) + " FROM flags WHERE collected_at >= TIMESTAMP '2024-01-15 00:00:00'")
def view_counts_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A27 with a start time."""
    return V.view_counts(model(spark, sf_dir).where(V.wanted(since="2024-01-15 00:00:00")), S.ANALYSIS_SOURCES, "source")


@R.add(
    MODEL + "SELECT eff_narrative, eff_severity, count(*) AS n FROM flags WHERE v_all GROUP BY GROUPING SETS ((eff_narrative, eff_severity), (eff_narrative), (eff_severity))"
)
def breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective narrative by severity with both marginals, in one pass."""
    m = model(spark, sf_dir).where(V.view("all"))
    sets = [[F.col("eff_narrative"), F.col("eff_severity")], [F.col("eff_narrative")], [F.col("eff_severity")]]
    return m.groupingSets(sets, "eff_narrative", "eff_severity").agg(F.count(F.lit(1)).alias("n"))


@R.add(
    MODEL + "SELECT strftime(collected_at, '%Y-%m-%d') AS day, count(*) AS classified, CAST(sum(CASE WHEN eff_severity = 'High' THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN v_alerts THEN 1 ELSE 0 END) AS BIGINT) AS alerts FROM flags WHERE v_all AND collected_at >= TIMESTAMP '2024-01-05 00:00:00' GROUP BY 1"
)
def daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified, High and alerts by UTC day."""
    m = model(spark, sf_dir).where(V.view("all") & V.wanted(since="2024-01-05 00:00:00"))
    alert = V.view("alerts", S.ANALYSIS_SOURCES, "source")
    return m.groupBy(F.date_format("collected_at", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("classified"), F.sum((F.col("eff_severity") == "High").cast("long")).alias("high"), F.sum(F.coalesce(alert, F.lit(False)).cast("long")).alias("alerts")
    )


@R.add(f"WITH {ART}, {PRED} SELECT a.source, a.source_kind, count(*) AS stored, count(p.article_id) AS classified FROM art a LEFT JOIN pred p ON p.article_id = a.doc_id GROUP BY 1, 2")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored and classified by source."""
    p = S.predictions(spark, sf_dir).select(F.col("article_id").alias("doc_id"), F.lit(1).alias("hit"))
    return S.articles(spark, sf_dir).join(p, "doc_id", "left").groupBy("source", "source_kind").agg(F.count(F.lit(1)).alias("stored"), F.count("hit").alias("classified"))


@R.add(f"WITH {REV[:0]}{REV.strip()} SELECT article_id, review_id, narrative, severity, not_relevant FROM latest")
def latest_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole latest review of each article."""
    return V.latest_review(S.reviews(spark, sf_dir))


@R.add(f"WITH {REV.strip()} SELECT article_id, count(*) AS n_reviews, string_agg(coalesce(narrative, '-') || '/' || coalesce(severity, '-'), ';' ORDER BY review_id) AS history FROM rev GROUP BY article_id")
def review_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article's reviews in order."""
    r = S.reviews(spark, sf_dir)
    line = F.concat_ws("/", F.coalesce("narrative", F.lit("-")), F.coalesce("severity", F.lit("-")))
    g = r.groupBy("article_id").agg(F.count(F.lit(1)).alias("n_reviews"), F.sort_array(F.collect_list(F.struct("review_id", line.alias("line")))).alias("h"))
    return g.select("article_id", "n_reviews", F.array_join("h.line", ";").alias("history"))


@R.add(MODEL + "SELECT doc_id, headline, p_high FROM flags WHERE v_all AND eff_narrative = 'Alpha' AND headline ILIKE '%the%' ORDER BY p_high DESC, doc_id LIMIT 20 OFFSET 10")
def article_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1, F16: a page by score with filters."""
    return V.page(model(spark, sf_dir), V.view("all") & V.wanted(narrative="Alpha", q="the"), by_score=True, limit=20, offset=10).select("doc_id", "headline", "p_high")


@R.add(MODEL + "SELECT doc_id, headline FROM flags WHERE v_all AND (source = 'src4' OR source_domain = 'src4') AND collected_at >= TIMESTAMP '2024-01-03 00:00:00' ORDER BY coalesce(published_at, collected_at) DESC, doc_id LIMIT 25")
def newest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of a source."""
    return V.page(model(spark, sf_dir), V.view("all") & V.wanted(source="src4", since="2024-01-03"), limit=25).select("doc_id", "headline")


@R.add(MODEL + "SELECT count(*) AS total FROM flags WHERE v_all AND eff_severity = 'High' AND (source = 'src2' OR source_domain = 'src2')")
def page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: the total that goes with a page."""
    return model(spark, sf_dir).where(V.view("all") & V.wanted(severity="High", source="src2")).agg(F.count(F.lit(1)).alias("total"))


@R.add(f"WITH {ART}, {PRED}, {REV.strip()} SELECT a.doc_id, p.p_high FROM art a JOIN pred p ON p.article_id = a.doc_id LEFT JOIN expl e ON e.article_id = a.doc_id WHERE e.article_id IS NULL ORDER BY p.p_high DESC, a.collected_at DESC, a.doc_id LIMIT 40")
def to_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to explain next."""
    e = S.explanations(spark, sf_dir).select(F.col("article_id").alias("doc_id"))
    p = S.predictions(spark, sf_dir).select(F.col("article_id").alias("doc_id"), "p_high")
    return S.articles(spark, sf_dir).join(p, "doc_id").join(e, "doc_id", "left_anti").orderBy(F.desc("p_high"), F.desc("collected_at"), "doc_id").limit(40).select("doc_id", "p_high")


@R.add(f"WITH {ART}, r AS (SELECT doc_id, source_kind, row_number() OVER (PARTITION BY source_kind ORDER BY collected_at DESC, doc_id) AS pos FROM art WHERE NOT has_body) SELECT doc_id, source_kind, pos FROM r WHERE pos <= 10")
def pending_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: newest headlines without a body, ten of each kind."""
    pos = F.row_number().over(Window.partitionBy("source_kind").orderBy(F.desc("collected_at"), "doc_id"))
    return S.articles(spark, sf_dir).where(~F.col("has_body")).select("doc_id", "source_kind", pos.cast("long").alias("pos")).where("pos <= 10")


@R.add(f"WITH {ART}, {PRED} SELECT a.doc_id FROM art a WHERE a.has_body AND a.doc_id NOT IN (SELECT article_id FROM pred) ORDER BY a.collected_at, a.doc_id LIMIT 64")
def to_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oldest articles that wait for a label."""
    p = S.predictions(spark, sf_dir).select(F.col("article_id").alias("doc_id"))
    return S.articles(spark, sf_dir).where("has_body").join(p, "doc_id", "left_anti").orderBy("collected_at", "doc_id").limit(64).select("doc_id")


@R.add(f"WITH {ART} SELECT doc_id, headline FROM art ORDER BY md5('17:' || doc_id), doc_id LIMIT 25")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample, the same at every run."""
    return S.articles(spark, sf_dir).orderBy(X.shuffled("doc_id", 17), "doc_id").limit(25).select("doc_id", "headline")


def _present(t: str) -> str:
    x = r"regexp_replace(headline, '([^\p{L}\p{N}_])', '\1\1', 'g')"
    return rf"len(regexp_extract_all({x}, '(?i)(?:^|[^\p{{L}}\p{{N}}_]){t}(?:[^\p{{L}}\p{{N}}_]|$)'))"


_SUMS = ", ".join("(" + " + ".join(_present(t) for t in ts) + f") AS {g}" for g, ts in S.GROUPS.items())
_RUBRIC = "CASE WHEN greatest(" + ", ".join(S.GROUPS) + ") = 0 THEN NULL " + " ".join(f"WHEN {g} = greatest({', '.join(S.GROUPS)}) THEN '{g}'" for g in S.GROUPS) + " END"


@R.add(
    f"WITH {ART}, {PRED}, k AS (SELECT doc_id, {_SUMS} FROM art), x AS (SELECT p.*, {_RUBRIC} AS rubric FROM pred p JOIN k ON k.doc_id = p.article_id), y AS (SELECT *, NOT has_body AND rubric IS NOT NULL AS by_rule, has_body AND narrative_conf < 0.7 AS low FROM x)"
    " SELECT article_id AS doc_id, CASE WHEN by_rule THEN rubric ELSE narrative END AS final_narrative, CASE WHEN NOT by_rule THEN narrative_conf::DOUBLE END AS final_conf, CASE WHEN by_rule THEN 'rubric' ELSE 'encoder' END AS narrative_source, severity = 'High' OR low AS escalated,"
    " concat_ws(',', CASE WHEN severity = 'High' THEN 'severity_high' END, CASE WHEN low THEN 'low_confidence' END) AS escalation_reasons, low OR NOT has_body AS needs_review, concat_ws(',', CASE WHEN low THEN 'low_confidence' END, CASE WHEN NOT has_body THEN 'headline_only' END) AS review_reasons FROM y"
)
def routing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """routed records with the hybrid narrative label."""
    a = S.articles(spark, sf_dir).select("doc_id", "headline")
    p = S.predictions(spark, sf_dir).withColumnRenamed("article_id", "doc_id").join(a, "doc_id")
    return p.select("doc_id", *V.routing(F.col("has_body"), F.col("narrative_conf"), F.col("severity"), K.top_group(F.col("headline"), S.GROUPS), F.col("narrative")))


@R.add(f"WITH {ART}, {PRED} SELECT article_id, p_high FROM pred")
def p_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    """probability of High, four places."""
    return S.predictions(spark, sf_dir).select("article_id", "p_high")


@R.add(f"WITH {REV.strip()} SELECT review_id, CASE WHEN narrative IS NULL AND severity IS NULL AND NOT not_relevant THEN 'empty' WHEN not_relevant AND (narrative IS NOT NULL OR severity IS NOT NULL) THEN 'contradiction' END AS error FROM rev")
def verdict_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """verdicts that say nothing or contradict themselves."""
    return S.reviews(spark, sf_dir).select("review_id", V.verdict_error(F.col("narrative"), F.col("severity"), F.col("not_relevant")).alias("error"))


@R.add(
    f"WITH {ART}, {PRED}, {REV.strip()} SELECT count(*) AS articles, CAST(sum(CASE WHEN a.has_body THEN 1 ELSE 0 END) AS BIGINT) AS with_body, count(p.article_id) AS classified, count(e.article_id) AS explained, CAST(sum(CASE WHEN p.severity = 'High' THEN 1 ELSE 0 END) AS BIGINT) AS high, count(DISTINCT a.source) AS sources, strftime(max(a.collected_at), '%Y-%m-%dT%H:%M:%SZ') AS newest FROM art a LEFT JOIN pred p ON p.article_id = a.doc_id LEFT JOIN expl e ON e.article_id = a.doc_id"
)
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar statistics of the store in one pass."""
    p = S.predictions(spark, sf_dir).select(F.col("article_id").alias("doc_id"), "severity")
    e = S.explanations(spark, sf_dir).select(F.col("article_id").alias("doc_id"), "ex_status")
    a = S.articles(spark, sf_dir).select("doc_id", "has_body", "source", "collected_at").join(p, "doc_id", "left").join(e, "doc_id", "left")
    return a.agg(
        F.count(F.lit(1)).alias("articles"),
        F.sum(F.col("has_body").cast("long")).alias("with_body"),
        F.count("severity").alias("classified"),
        F.count("ex_status").alias("explained"),
        F.sum(F.coalesce((F.col("severity") == "High").cast("long"), F.lit(0))).alias("high"),
        F.countDistinct("source").alias("sources"),
        F.date_format(F.max("collected_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("newest"),
    )


@R.add("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def events_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A29 over events: counts by type and day."""
    e = S.table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@R.add("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events ORDER BY event_id DESC LIMIT 10")
def recent_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last reports, parsed from JSON."""
    e = S.table(spark, sf_dir, "events").orderBy(F.desc("event_id")).limit(10)
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), F.from_json("props", "k int")["k"].alias("k"))


@R.add("SELECT conv_id, count(*) AS turns, arg_max(text, turn) AS last_text, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def conversation_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9 over conversations: the last turn as a whole."""
    c = S.table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max_by("text", "turn").alias("last_text"), F.max_by("role", "turn").alias("last_role"))


@R.add(
    "SELECT o_orderpriority, l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1, 2"
)
def revenue_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A28, J1 at volume: the same relational shapes over the star schema."""
    li = S.table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp"))
    j = li.join(S.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderpriority", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@R.add(f"WITH {ART} SELECT doc_id, CASE WHEN length(headline) < 12 THEN 'too_short' WHEN NOT has_body THEN 'no_body' WHEN length(body) < 1000 THEN 'teaser' END AS fetch_error FROM art")
def fetch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a page gave no article."""
    a = S.articles(spark, sf_dir)
    why = F.when(F.length("headline") < 12, "too_short").when(~F.col("has_body"), "no_body").when(~T.is_full_text(F.col("body")), "teaser")
    return a.select("doc_id", why.alias("fetch_error"))
