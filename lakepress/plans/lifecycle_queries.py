"""Queries of the article life-cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepress.functions import text as T
from lakepress.functions import urls as U
from lakepress.operators import lifecycle as L
from lakepress.plans.registry import ART, NORM, Registry
from lakepress.plans.workdir import spill
from lakepress.sources import feeds as FD
from lakepress.sources import mapped as S
from lakepress.sources import tables as X

R = Registry()
NOW = "2024-01-20 00:00:00"


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as feed items; addresses repeat after 613 documents."""
    a = S.articles(spark, sf_dir)
    url = F.concat(F.lit("https://"), "source_domain", F.lit("/a/"), F.pmod(F.col("doc_id") * 3, F.lit(613)).cast("string"))
    return a.select(
        F.col("doc_id").alias("pos"),
        url.alias("url"),
        U.url_hash(url).alias("url_hash"),
        "headline",
        T.headline_key(F.col("headline")).alias("headline_key"),
        F.col("body").alias("text"),
        T.is_full_text(F.col("body")).alias("is_body"),
        "source",
        "source_domain",
        "collected_at",
        U.is_blocked(F.col("source_domain"), S.BLOCKED).alias("blocked"),
        (F.pmod("doc_id", F.lit(9)) != 0).alias("relevant"),
    )


def _addresses(items: DataFrame) -> DataFrame:
    return items.where("not blocked").select("url_hash").distinct()


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(store after the first half of arrivals, addresses seen in it, second half)."""
    items = arrivals(spark, sf_dir)
    none = spark.createDataFrame([], L.ARTICLE_SCHEMA)
    half = items.where("pos < 400")
    first, _ = L.ingest(half, none)
    return spill(first, "store"), _addresses(half), items.where("pos >= 400")


_KEY = f"CASE WHEN length({NORM.format('headline')}) - length(replace({NORM.format('headline')}, ' ', '')) >= 3 THEN {NORM.format('headline')} END"
ITEMS_SQL = (
    f"WITH {ART}, items AS (SELECT doc_id AS pos, 'https://' || source_domain || '/a/' || (doc_id * 3 % 613) AS url, {_KEY} AS k, coalesce(length(body) >= 1000, false) AS is_body, body, source, collected_at, "
    "(source_domain = 'example.net' OR ends_with(source_domain, '.example.net') OR source_domain = 'src5.example.org') AS blocked, doc_id % 9 <> 0 AS relevant FROM art), "
    # one pass over everything: what is first overall is first in its half or stored by the half before
    "u AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS ru FROM items WHERE NOT blocked), "
    "f AS (SELECT *, CASE WHEN k IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY k ORDER BY pos) END AS rk FROM u WHERE ru = 1)"
)


@R.add(
    f"{ITEMS_SQL}, up AS (SELECT min(x.pos) AS pos FROM f a JOIN f x ON x.k = a.k AND x.rk > 1 AND x.is_body AND x.pos >= 400 WHERE a.rk = 1 AND NOT a.is_body "
    "AND (a.pos >= 400 OR NOT EXISTS (SELECT 1 FROM f y WHERE y.k = a.k AND y.rk > 1 AND y.is_body AND y.pos < 400)) GROUP BY a.k) "
    "SELECT i.source, count(*) AS fetched, sum(i.blocked::INT)::BIGINT AS blocked, coalesce(sum((u.ru > 1)::INT), 0)::BIGINT AS dup_url, coalesce(sum((f.rk > 1)::INT), 0)::BIGINT AS dup_headline, count(up.pos) AS upgraded, coalesce(sum((f.rk = 1)::INT), 0)::BIGINT AS new, "
    "coalesce(sum((f.rk = 1 AND i.relevant)::INT), 0)::BIGINT AS relevant, coalesce(sum((f.rk = 1 AND i.relevant AND i.is_body)::INT), 0)::BIGINT AS with_body FROM items i LEFT JOIN u ON u.pos = i.pos LEFT JOIN f ON f.pos = i.pos LEFT JOIN up ON up.pos = i.pos WHERE i.pos >= 400 GROUP BY i.source"
)
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of the second of two ingest passes, by source, wholly blocked ones included."""
    stored, seen, items = _stored(spark, sf_dir)
    return L.ingest(items, stored, seen)[1]


@R.add(
    f"{ITEMS_SQL}, d AS (SELECT k, arg_min(body, pos) AS lent FROM f WHERE rk > 1 AND is_body GROUP BY k) SELECT substr(sha1(f.url), 1, 16) AS url_hash, f.k AS headline_key, coalesce(CASE WHEN f.is_body THEN length(f.body) ELSE length(d.lent) END, -1)::INT AS body_chars, "
    "CASE WHEN f.is_body OR d.lent IS NOT NULL THEN CASE WHEN f.relevant OR d.lent IS NOT NULL AND NOT f.is_body THEN 'ok' ELSE 'skipped' END WHEN f.relevant THEN 'pending' ELSE 'skipped' END AS fetch_status, CASE WHEN f.relevant THEN 'new' ELSE 'irrelevant' END AS status FROM f LEFT JOIN d ON d.k = f.k WHERE f.rk = 1"
)
def ingest_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after two passes, with bodies that later copies lent."""
    stored, seen, items = _stored(spark, sf_dir)
    return L.ingest(items, stored, seen)[0].select("url_hash", "headline_key", F.coalesce(F.length("body"), F.lit(-1)).alias("body_chars"), "fetch_status", "status")


@R.add("SELECT 0::BIGINT AS new, 0::BIGINT AS upgraded")
def ingest_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batch again stores nothing."""
    stored, seen, items = _stored(spark, sf_dir)
    after, _ = L.ingest(items, stored, seen)
    return L.ingest(items, spill(after, "store"), seen.unionByName(_addresses(items)))[1].agg(F.sum("new").alias("new"), F.sum("upgraded").alias("upgraded"))


@R.add(
    f"{ITEMS_SQL}, d AS (SELECT DISTINCT k FROM f WHERE rk > 1 AND is_body AND pos < 400) SELECT substr(sha1(f.url), 1, 16) AS url_hash, "
    "CASE WHEN NOT f.is_body AND d.k IS NOT NULL THEN 'ok' WHEN NOT f.relevant THEN 'skipped' WHEN f.is_body THEN 'ok' WHEN f.collected_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 60 MINUTE THEN 'failed' ELSE 'pending' END AS fetch_status "
    "FROM f LEFT JOIN d ON d.k = f.k WHERE f.rk = 1 AND f.pos < 400"
)
def expire_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending articles past the deadline fail; whoever has a body, its own or a lent one, does not."""
    stored, _, _ = _stored(spark, sf_dir)
    return L.expire(stored, F.lit(NOW).cast("timestamp")).select("url_hash", "fetch_status")


@R.add(f"WITH {ART} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 2 WHEN doc_id % 4 = 1 THEN 1 ELSE doc_id % 2 END::INT AS attempts, CASE WHEN doc_id % 4 = 0 OR doc_id % 12 = 1 THEN 'failed' ELSE 'pending' END AS fetch_status, CASE WHEN doc_id % 4 < 2 THEN 300 ELSE -1 END::INT AS error_chars FROM art")
def retry_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: attempts counted, errors cut, given up at the second or when final."""
    d = S.articles(spark, sf_dir)
    m4 = F.pmod("doc_id", F.lit(4))
    state = d.select(
        F.col("doc_id").cast("string").alias("article_id"), "doc_id", F.lit("pending").alias("fetch_status"), F.when(m4 == 0, 1).when(m4 == 1, 0).otherwise(F.pmod("doc_id", F.lit(2)).cast("int")).alias("fetch_attempts"), F.lit(None).cast("string").alias("fetch_error")
    )
    failures = d.where(m4 < 2).select(F.col("doc_id").cast("string").alias("article_id"), F.repeat(F.lit("timeout "), 50).alias("error"), (F.pmod("doc_id", F.lit(12)) == 1).alias("final"))
    return L.record_failures(state, failures).select("doc_id", F.col("fetch_attempts").alias("attempts"), "fetch_status", F.coalesce(F.length("fetch_error"), F.lit(-1)).alias("error_chars"))


@R.add("SELECT doc_id, CASE WHEN doc_id % 10 = 3 AND doc_id >= 2 THEN 'duplicate' ELSE 'new' END AS status, CASE WHEN doc_id % 10 = 3 AND doc_id >= 2 THEN 'skipped' ELSE 'pending' END AS fetch_status FROM documents")
def resolve_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that resolve to another article's page."""
    d = S.table(spark, sf_dir, "documents")
    h = lambda c: F.concat(F.lit("h"), c.cast("string"))
    state = d.select("doc_id", F.col("doc_id").cast("string").alias("article_id"), h(F.col("doc_id")).alias("url_hash"), F.lit("new").alias("status"), F.lit("pending").alias("fetch_status"), F.lit(None).cast("string").alias("resolved_hash"))
    resolved = d.where("doc_id % 10 in (3, 4)").select(F.col("doc_id").cast("string").alias("article_id"), F.when(F.col("doc_id") % 10 == 3, h(F.col("doc_id") - 2)).otherwise(h(F.col("doc_id"))).alias("hash"))
    return L.resolve(state, resolved).select("doc_id", "status", "fetch_status")


@R.add(f"WITH {ART} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new label' WHEN doc_id % 2 = 0 THEN 'old label' END AS label, CASE WHEN doc_id % 3 = 0 THEN 'classified' ELSE 'new' END AS status, doc_id % 2 = 0 AND doc_id % 3 <> 0 AS explained FROM art")
def saved_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New labels replace old ones, their explanations go."""
    d = S.table(spark, sf_dir, "documents")
    aid = F.col("doc_id").cast("string").alias("article_id")
    arts = d.select("doc_id", aid, F.lit("new").alias("status"))
    old = d.where("doc_id % 2 = 0").select(aid, F.lit("old label").alias("label"))
    expl = d.where("doc_id % 2 = 0").select(aid, F.lit(True).alias("explained"))
    new = d.where("doc_id % 3 = 0").select(aid, F.lit("new label").alias("label"))
    a, p, e = L.save_predictions(arts, old, expl, new)
    return a.join(p, "article_id", "left").join(e, "article_id", "left").select("doc_id", "label", "status", F.coalesce("explained", F.lit(False)).alias("explained"))


@R.add("SELECT doc_id, lang, ['de','en','es','fr'].list_position(lang) - 1 AS y FROM documents")
def encoded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2, U4: labels as contiguous ids."""
    return X.encode_labels(S.table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["de", "en", "es", "fr"], "y")


@R.add(f"WITH {ART} SELECT doc_id, lang FROM art WHERE has_body")
def bodied_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the rows of mode body_only."""
    return X.by_mode(S.articles(spark, sf_dir).select("doc_id", "lang", "has_body"), "body_only").drop("has_body")


@R.add("SELECT l.doc_id, l.quality, d.lang, d.source FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id WHERE l.doc_id % 5 IN (1, 3)")
def planned_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned runs only, joined to their corpus rows."""
    runs = S.table(spark, sf_dir, "labels").select("doc_id", "quality", (F.col("doc_id") % 5).cast("int").alias("fold"), F.lit(1).alias("seed"))
    plan = spark.createDataFrame([(1, 1), (1, 3)], "seed int, fold int")
    return X.planned_runs(runs, plan).select("doc_id", "quality").join(S.table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", "left")


_NO_TAGS = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<iframe\b[^>]*>.*?</iframe\s*>"
_LINES = f"regexp_replace(regexp_replace(html, '{_NO_TAGS}', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g')"
for _name, _char in T.ENTITIES:
    _LINES = f"replace({_LINES}, '{_name}', '{_char.replace(chr(39), chr(39) * 2)}')"
_TEXT = f"array_to_string(list_filter(list_transform(string_split({_LINES}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))"


@R.add(
    f"SELECT page_id AS source, 0 AS pos, 'Page ' || page_id AS headline, url, length({_TEXT}) >= 1000 AS is_body, '2024-01-15T09:00:00Z' AS published_at, regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '^www\\.', '') AS source_domain, NULL::VARCHAR AS error FROM pages "
    "UNION ALL SELECT page_id + 1000000000, NULL, NULL, NULL, NULL, NULL, NULL, 'not a feed' FROM pages"
)
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages wrapped as RSS and parsed back, and the same pages as they are, which are no feeds."""
    p = S.table(spark, sf_dir, "pages")
    head = "<?xml version='1.0' encoding='iso-8859-1'?><rss xmlns:content='http://purl.org/rss/1.0/modules/content/'><channel><title>Pages&nbsp;</title><item><title>"
    xml = F.concat(F.lit(head), F.concat(F.lit("Page "), F.col("page_id").cast("string")), F.lit("</title><link>"), "url", F.lit("</link><pubDate>Mon, 15 Jan 2024 10:00:00 +0100</pubDate><content:encoded><![CDATA["), "html", F.lit("]]></content:encoded></item></channel></rss>"))
    feeds = p.select(F.col("page_id").alias("source"), xml.alias("xml")).unionByName(p.select((F.col("page_id") + 1_000_000_000).alias("source"), F.col("html").alias("xml")))
    items = FD.parse_feeds(feeds).select("source", "pos", "headline", "url", "is_body", "published_at", "source_domain")
    return items.unionByName(FD.rejected_feeds(feeds).select("source", F.substring("error", 1, 10).alias("error")), allowMissingColumns=True)
