"""The article life-cycle: state tables advanced by batches.

Every function takes tables and returns new ones; nothing is changed in place.
Articles have: article_id, url, url_hash, headline, headline_key, body,
feed_text, fetch_status, fetch_attempts, fetch_error, source, source_domain,
collected_at, relevant, status, resolved_hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepress.functions.urls import domain, is_blocked
from lakepress.plans.workdir import spill

ARTICLE_SCHEMA = (
    "article_id string, url string, url_hash string, headline string, headline_key string, body string, feed_text string, fetch_status string, "
    "fetch_attempts int, fetch_error string, source string, source_domain string, collected_at timestamp, relevant boolean, status string, resolved_hash string"
)
ATTEMPTS = 2
ERROR_CUT = 300


def _entry(relevant: Column, is_body: Column) -> tuple[Column, Column]:
    """(fetch_status, status) of a new article."""
    fetch = F.when(~relevant, "skipped").when(is_body, "ok").otherwise("pending")
    return fetch, F.when(relevant, "new").otherwise("irrelevant")


Lookup = Callable[[DataFrame], DataFrame]


def ingest_changes(items: DataFrame, urls: Lookup, headlines: Lookup, load: Lookup) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(new and changed articles, headline keys now taken, addresses (url_hash) of copies, report by source) of a batch; the rest of the store isn't read.

    ``items``: pos (global order of arrival), url, url_hash, headline,
    headline_key, text, is_body, source, source_domain, collected_at, blocked,
    relevant. In order: blocked items go and mark nothing; then items whose URL
    is stored or came earlier; then items whose headline key is stored or came
    earlier, which lend their body to an article that lacks one; the rest is
    stored. A later copy's body makes its article new again unless that is
    irrelevant or a duplicate. A copy is not stored, yet its URL has come: it
    must be kept for the batches that follow.

    ``urls`` maps (url_hash) to those known, ``headlines`` maps (headline_key)
    to the stored (headline_key, article_id), ``load`` maps (article_id) to
    articles. Items are judged without their texts, by the least position of
    an address or key, so that a very common one is summed up where it lies.
    """
    live = items.where(~F.col("blocked")).select("pos", "url_hash", "headline_key", "is_body", "relevant", "source")
    first = live.groupBy("url_hash").agg(F.min("pos").alias("__first"))
    known = first.join(urls(first.select("url_hash")).select("url_hash").distinct().withColumn("__u", F.lit(True)), "url_hash", "left")
    tagged = spill(live.join(known, "url_hash").withColumn("dup_url", F.col("__u").isNotNull() | (F.col("pos") > F.col("__first"))).drop("__u", "__first"), "tagged")
    fresh = tagged.where(~F.col("dup_url"))
    # of equal keys the stored one counts first, then the earliest item; items without a key never meet
    met = spill(fresh.where("headline_key is not null").groupBy("headline_key").agg(F.min("pos").alias("__first"), F.min(F.when(F.col("is_body"), F.col("pos"))).alias("__lends")), "keys")
    stored = headlines(met.select("headline_key")).select("headline_key", F.col("article_id").alias("__stored"))
    keys = met.join(stored, "headline_key", "left")
    twice = F.col("headline_key").isNotNull() & (F.col("__stored").isNotNull() | (F.col("pos") > F.col("__first")))
    judged = spill(fresh.join(keys, "headline_key", "left").withColumn("dup_headline", twice), "judged")
    # an article without a body takes the first one that comes under its key
    new = judged.where("not dup_headline").select("pos", F.when(~F.col("is_body"), F.col("__lends")).alias("__lends"))
    # of a stored article, loaded only where something is lent to it
    lent = spill(judged.where("dup_headline and __stored is not null and __lends = pos").select("pos", F.col("__stored").alias("article_id")), "lent")
    old = load(lent.select("article_id")).where("body is null")
    texts = items.select("pos", F.col("text").alias("__text"))
    taken = F.col("__lends").isNotNull()
    fetch, status = _entry(F.col("relevant"), F.col("is_body"))
    rows = items.join(new, "pos").join(texts.withColumnRenamed("pos", "__lends"), "__lends", "left").select(
        F.concat(F.lit("a_"), "url_hash").alias("article_id"),
        "url",
        "url_hash",
        "headline",
        "headline_key",
        F.when(F.col("is_body"), F.col("text")).when(taken, F.col("__text")).alias("body"),
        F.when(~F.col("is_body") & (F.coalesce("text", F.lit("")) != ""), F.col("text")).alias("feed_text"),
        F.when(taken, "ok").otherwise(fetch).alias("fetch_status"),
        F.lit(0).alias("fetch_attempts"),
        F.lit(None).cast("string").alias("fetch_error"),
        "source",
        "source_domain",
        "collected_at",
        "relevant",
        status.alias("status"),
        F.lit(None).cast("string").alias("resolved_hash"),
    )
    upgraded = attach_bodies(old, lent.join(texts, "pos").select("article_id", F.col("__text").alias("__body")))
    changed = spill(rows.unionByName(upgraded), "changed")
    marks = new.where(taken).select(F.col("__lends").alias("pos")).unionByName(lent.join(old.select("article_id"), "article_id", "left_semi").select("pos")).withColumn("__up", F.lit(True))
    flags = items.select("pos", "source", "blocked").join(tagged.select("pos", "dup_url"), "pos", "left").join(judged.select("pos", "dup_headline", "relevant", "is_body"), "pos", "left").join(marks, "pos", "left")
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    stored_now = ~F.col("dup_headline")
    report = flags.groupBy("source").agg(
        F.count(F.lit(1)).alias("fetched"),
        n(F.col("blocked")).alias("blocked"),
        n(F.col("dup_url")).alias("dup_url"),
        n(F.col("dup_headline")).alias("dup_headline"),
        n(F.col("__up")).alias("upgraded"),
        n(stored_now).alias("new"),
        n(stored_now & F.col("relevant")).alias("relevant"),
        n(stored_now & F.col("relevant") & F.col("is_body")).alias("with_body"),
    )
    own = judged.where("not dup_headline and headline_key is not null").select("headline_key", F.concat(F.lit("a_"), "url_hash").alias("article_id"))
    return changed, own, judged.where("dup_headline").select("url_hash"), report


def ingest(items: DataFrame, stored: DataFrame, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(articles after the batch, report by source), of a store that is one table; see ``ingest_changes``.

    ``seen`` has the addresses (url_hash) that came before, those of copies too, which ``stored`` lacks.
    """
    known = stored.select("url_hash") if seen is None else stored.select("url_hash").unionByName(seen.select("url_hash"))
    first = stored.where("headline_key is not null").groupBy("headline_key").agg(F.min_by("article_id", F.struct("collected_at", "article_id")).alias("article_id"))
    changed, _, _, report = ingest_changes(items, lambda _: known, lambda _: first, lambda ids: stored.join(ids.distinct(), "article_id", "left_semi"))
    return stored.join(changed.select("article_id"), "article_id", "left_anti").select(*changed.columns).unionByName(changed), report


def attach_bodies(articles: DataFrame, bodies: DataFrame) -> DataFrame:
    """Bodies (article_id, __body) for articles that lack one; the status goes back to new unless it is final."""
    cols = articles.columns
    j = articles.join(bodies, "article_id", "left").withColumn("__take", F.col("body").isNull() & F.col("__body").isNotNull())
    final = F.col("status").isin("irrelevant", "duplicate")
    return (
        j.withColumn("body", F.when(F.col("__take"), F.col("__body")).otherwise(F.col("body")))
        .withColumn("fetch_status", F.when(F.col("__take"), "ok").otherwise(F.col("fetch_status")))
        .withColumn("fetch_error", F.when(~F.col("__take"), F.col("fetch_error")))
        .withColumn("status", F.when(F.col("__take") & ~final, "new").otherwise(F.col("status")))
        .select(*cols)
    )


def expire(articles: DataFrame, now: Column, minutes: int = 60) -> DataFrame:
    """Pending articles collected strictly before the deadline fail; they stay and are classified as headlines."""
    late = (F.col("fetch_status") == "pending") & (F.col("collected_at") < now - F.expr(f"interval {minutes} minutes"))
    why = F.when(late, F.coalesce("fetch_error", F.lit("not fetched in time"))).otherwise(F.col("fetch_error"))
    return articles.withColumn("fetch_error", why).withColumn("fetch_status", F.when(late, "failed").otherwise(F.col("fetch_status")))


def record_failures(articles: DataFrame, failures: DataFrame, most: int = ATTEMPTS) -> DataFrame:
    """Failed fetches (article_id, error, final): one more attempt; given up at ``most`` or when final."""
    cols = articles.columns
    j = articles.join(failures.withColumnRenamed("error", "__error").withColumnRenamed("final", "__final"), "article_id", "left")
    hit = F.col("__error").isNotNull()
    n = F.col("fetch_attempts") + hit.cast("int")
    gone = hit & ((n >= most) | F.coalesce("__final", F.lit(False)))
    return (
        j.withColumn("fetch_status", F.when(gone, "failed").otherwise(F.col("fetch_status")))
        .withColumn("fetch_error", F.when(hit, F.substring("__error", 1, ERROR_CUT)).otherwise(F.col("fetch_error")))
        .withColumn("fetch_attempts", n)
        .select(*cols)
    )


def unfetchable(pending: DataFrame, page: Column, blocked: list[str]) -> DataFrame:
    """(article_id, error, final) of pending articles whose page lies in a domain that refuses machines; they are given up at once."""
    return pending.where((F.col("fetch_status") == "pending") & is_blocked(domain(page), blocked)).select("article_id", F.lit("site refuses automated access").alias("error"), F.lit(True).alias("final"))


def resolve(articles: DataFrame, resolved: DataFrame) -> DataFrame:
    """Resolved links (article_id, hash): an article whose page another one has is a duplicate and is not fetched."""
    cols = articles.columns
    others = articles.select(F.col("url_hash").alias("__hash"), F.col("article_id").alias("__other"))
    taken = resolved.join(others, resolved["hash"] == F.col("__hash")).where("article_id <> __other").select("article_id").distinct().withColumn("__dup", F.lit(True))
    j = articles.join(resolved, "article_id", "left").join(taken, "article_id", "left")
    return (
        j.withColumn("resolved_hash", F.coalesce("hash", "resolved_hash"))
        .withColumn("status", F.when(F.col("__dup"), "duplicate").otherwise(F.col("status")))
        .withColumn("fetch_status", F.when(F.col("__dup"), "skipped").otherwise(F.col("fetch_status")))
        .select(*cols)
    )


def to_classify(articles: DataFrame, limit: int | None = None) -> DataFrame:
    """Relevant new articles whose fetch is settled, oldest first."""
    ready = articles.where((F.col("status") == "new") & F.col("relevant") & (F.col("fetch_status") != "pending")).orderBy("collected_at", "article_id")
    return ready.limit(limit) if limit else ready


def save_predictions(articles: DataFrame, predictions: DataFrame, explanations: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles, predictions, explanations): new labels replace old ones and their explanations go."""
    ids = new.select("article_id").distinct()
    marked = articles.join(ids.withColumn("__new", F.lit(True)), "article_id", "left")
    done = marked.withColumn("status", F.when(F.col("__new"), "classified").otherwise(F.col("status"))).select(*articles.columns)
    return done, predictions.join(ids, "article_id", "left_anti").unionByName(new), explanations.join(ids, "article_id", "left_anti")


def take_lease(leases: DataFrame, name: str, owner: str, now: Column, until: Column) -> DataFrame:
    """The lease table after ``owner`` asks: taken when free, run out, or its own."""
    one = leases.sparkSession.range(1).select(F.lit(name).alias("name"))
    held = one.join(leases.where(F.col("name") == name), "name", "left")
    free = F.col("owner").isNull() | (F.col("until") <= now) | (F.col("owner") == owner)
    mine = held.select("name", F.when(free, F.lit(owner)).otherwise(F.col("owner")).alias("owner"), F.when(free, until).otherwise(F.col("until")).alias("until"))
    return leases.where(F.col("name") != name).unionByName(mine)
