"""The read model: classified articles with their explanation and latest review, views over them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the names of the views
VIEWS = ("all", "alerts", "unconfirmed", "analysis", "review", "dismissed")


def latest_review(reviews: DataFrame, key: str = "article_id", order: str = "review_id") -> DataFrame:
    """The whole row of the largest id for each article, nulls included."""
    rest = [c for c in reviews.columns if c not in (key, order)]
    newest = F.max_by(F.struct(order, *rest), order)
    return reviews.groupBy(key).agg(newest.alias("r")).select(key, "r.*")


def read_model(articles: DataFrame, predictions: DataFrame, explanations: DataFrame, reviews: DataFrame, below: float = 0.7) -> DataFrame:
    """One row for each classified article. Every join is on the article's id."""
    r = latest_review(reviews).select(
        F.col("article_id").alias("doc_id"), "review_id", F.col("narrative").alias("r_narrative"), F.col("severity").alias("r_severity"), F.col("not_relevant").alias("r_not_relevant")
    )
    p = predictions.withColumnRenamed("article_id", "doc_id")
    a = articles.drop("has_body", "headline_body")
    e = explanations.withColumnRenamed("article_id", "doc_id")
    low = F.col("has_body") & (F.col("narrative_conf") < below)
    return (
        p.join(a, "doc_id")
        .join(e, "doc_id", "left")
        .join(r, "doc_id", "left")
        .withColumn("dismissed", F.coalesce("r_not_relevant", F.lit(False)))
        .withColumn("eff_narrative", F.coalesce("r_narrative", "narrative"))
        .withColumn("eff_severity", F.coalesce("r_severity", "severity"))
        .withColumn("needs_review", low | ~F.col("has_body"))
    )


def _member(column: str, names: Iterable[str]) -> Column:
    names = sorted(names)
    return F.col(column).isin(*names) if names else F.lit(False)


def view(name: str, analysis: Iterable[str] = (), by: str = "source_domain", require_body: bool = True) -> Column:
    """The predicate of one view. Views are predicates, they may overlap; a null domain is in no view that excludes outlets."""
    kept, high, outlet = ~F.col("dismissed"), F.col("eff_severity") == "High", _member(by, analysis)
    body = F.col("has_body") if require_body else F.lit(True)
    return {
        "all": kept,
        "alerts": kept & high & body & ~outlet,
        "unconfirmed": kept & high & ~F.col("has_body") & ~outlet,
        "analysis": kept & outlet,
        "review": F.col("needs_review") & F.col("review_id").isNull(),
        "dismissed": F.col("dismissed"),
    }[name]


def category(analysis: Iterable[str] = (), by: str = "source_domain", require_body: bool = True) -> Column:
    """dismissed, else analysis, alert, unconfirmed or normal; a null domain is no analysis outlet."""
    high, outlet = F.col("eff_severity") == "High", F.coalesce(_member(by, analysis), F.lit(False))
    body = F.col("has_body") if require_body else F.lit(True)
    return F.when(F.col("dismissed"), "dismissed").when(outlet, "analysis").when(high & body, "alert").when(high, "unconfirmed").otherwise("normal")


def wanted(narrative: str | None = None, severity: str | None = None, source: str | None = None, q: str | None = None, since: str | None = None) -> Column:
    """Ad-hoc filters on effective labels, source or domain, headline and time."""
    cond = F.lit(True)
    if narrative:
        cond = cond & (F.col("eff_narrative") == narrative)
    if severity:
        cond = cond & (F.col("eff_severity") == severity)
    if source:
        cond = cond & ((F.col("source") == source) | (F.col("source_domain") == source))
    if q:
        cond = cond & F.col("headline").ilike(f"%{q}%")
    if since:
        cond = cond & (F.col("collected_at") >= F.lit(since).cast("timestamp"))
    return cond


def page(model: DataFrame, cond: Column, by_score: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page, newest first or by score, ties by id."""
    first = F.desc("p_high") if by_score else F.desc(F.coalesce("published_at", "collected_at"))
    return model.where(cond).orderBy(first, "doc_id").offset(offset).limit(limit)


def view_counts(model: DataFrame, analysis: Iterable[str] = (), by: str = "source_domain") -> DataFrame:
    """Sizes of all views in one pass."""
    return model.agg(*[F.coalesce(F.sum(F.coalesce(view(v, analysis, by), F.lit(False)).cast("long")), F.lit(0)).alias(f"n_{v}") for v in VIEWS])


def routing(has_body: Column, confidence: Column, severity: Column, rubric: Column, label: Column, below: float = 0.7) -> list[Column]:
    """Final narrative, its confidence and source, escalation and review with reasons."""
    by_rule = ~has_body & rubric.isNotNull()
    low = has_body & (confidence < below)
    escalate = F.array_compact(F.array(F.when(severity == "High", "severity_high"), F.when(low, "low_confidence")))
    review = F.array_compact(F.array(F.when(low, "low_confidence"), F.when(~has_body, "headline_only")))
    return [
        F.when(by_rule, rubric).otherwise(label).alias("final_narrative"),
        F.when(~by_rule, confidence).alias("final_conf"),
        F.when(by_rule, "rubric").otherwise("encoder").alias("narrative_source"),
        (F.size(escalate) > 0).alias("escalated"),
        F.array_join(escalate, ",").alias("escalation_reasons"),
        (F.size(review) > 0).alias("needs_review"),
        F.array_join(review, ",").alias("review_reasons"),
    ]


def verdict_error(narrative: Column, severity: Column, not_relevant: Column) -> Column:
    """Null for a valid analyst verdict, else what is wrong with it."""
    silent = narrative.isNull() & severity.isNull() & ~not_relevant
    return F.when(silent, "empty").when(not_relevant & (narrative.isNotNull() | severity.isNotNull()), "contradiction")
