"""The engine's entities over the driver's tables.

An article is a document: its headline is the first line of the text, its body
the rest. Predictions, reviews and explanations are derived by fixed rules of
the id, so that a SQL oracle can state the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepress.functions import text as T

NARRATIVES = ("Alpha", "Beta", "Gamma", "Delta", "Other")
COLLAPSE = {"Alpha": "Main", "Beta": "Main", "Gamma": "Side", "Delta": "Side", "Other": "Other"}
#: keyword groups of words that occur in the tables
GROUPS = {"Alpha": ["thing", "attion"], "Beta": ["ertion", "oning"], "Gamma": ["thanea", "that"], "Delta": ["onand"], "Other": ["hethe", "hand"]}
GATE_WORDS = ["thing", "attion", "thanea"]
GATE_ACRONYMS = ["OF", "IS"]
ANALYSIS_SOURCES = ("src3", "src7")
#: bytes of rows that go to a Python worker at once
BATCH_BYTES = 8 << 20
BLOCKED = ["src5.example.org", "example.net"]


def taxonomy(spark: SparkSession) -> DataFrame:
    """(label, id, collapsed): the labels in the order of their ids, and the class that each falls into."""
    return spark.createDataFrame([(n, i, COLLAPSE[n]) for i, n in enumerate(NARRATIVES)], "label string, id int, collapsed string")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, in a session that sends rows to Python by bytes and not by number alone, so long texts don't pile up; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return table(spark, sf_dir, "documents")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, headline, body (null when blank), has_body, source, lang, collected_at, published_at."""
    d = table(spark, sf_dir, "documents")
    headline = F.substring_index("text", "\n", 1)
    body = F.substr(F.col("text"), F.length(headline) + 2, F.length("text"))
    day = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(pmod(doc_id, 30) as int), cast(pmod(doc_id * 7, 24) as int))")
    return d.select(
        "doc_id",
        headline.alias("headline"),
        F.when(T.has_body(body), body).alias("body"),
        T.has_body(body).alias("has_body"),
        "source",
        F.concat(F.col("source"), F.when(F.pmod("doc_id", F.lit(3)) == 0, ".example.net").when(F.pmod("doc_id", F.lit(3)) == 1, ".example.org").otherwise(".example.com")).alias("source_domain"),
        F.when(F.pmod("doc_id", F.lit(4)) == 0, "google_news").otherwise("rss").alias("source_kind"),
        "lang",
        day.alias("collected_at"),
        F.when(F.pmod("doc_id", F.lit(6)) != 0, F.expr("timestampadd(HOUR, -5, " + "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(pmod(doc_id, 30) as int), cast(pmod(doc_id * 7, 24) as int)))")).alias("published_at"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each article but every eleventh."""
    a = articles(spark, sf_dir).where(F.pmod("doc_id", F.lit(11)) != 0)
    conf = F.pmod(F.col("doc_id") * 37, F.lit(1000)) / 1000.0
    sev = F.when(F.pmod(F.col("doc_id") * 13, F.lit(10)) < 3, "High").otherwise("Low")
    sev_conf = 0.5 + F.pmod(F.col("doc_id") * 29, F.lit(500)) / 1000.0
    names = F.array(*[F.lit(n) for n in NARRATIVES])
    return a.select(
        F.col("doc_id").alias("article_id"),
        "has_body",
        F.element_at(names, (F.pmod(F.col("doc_id") * 7, F.lit(5)) + 1).cast("int")).alias("narrative"),
        conf.alias("narrative_conf"),
        sev.alias("severity"),
        sev_conf.alias("severity_conf"),
        F.round(F.when(sev == "High", sev_conf).otherwise(1 - sev_conf), 4).alias("p_high"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First reviews of every seventh document, second ones of every fourteenth."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    first = d.where("doc_id % 7 = 0").select(
        (F.col("doc_id") * 2).alias("review_id"),
        F.col("doc_id").alias("article_id"),
        F.when(F.col("doc_id") % 21 == 0, F.lit(None)).otherwise("Alpha").alias("narrative"),
        F.when(F.col("doc_id") % 35 == 0, F.lit(None)).otherwise("High").alias("severity"),
        (F.col("doc_id") % 49 == 0).alias("not_relevant"),
    )
    second = d.where("doc_id % 14 = 0").select(
        (F.col("doc_id") * 2 + 1).alias("review_id"),
        F.col("doc_id").alias("article_id"),
        F.lit(None).cast("string").alias("narrative"),
        F.when(F.col("doc_id") % 4 == 0, "Low").alias("severity"),
        (F.col("doc_id") % 70 == 0).alias("not_relevant"),
    )
    return first.unionByName(second)


def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id % 5 = 0")
    return d.select(F.col("doc_id").alias("article_id"), F.when(F.col("doc_id") % 10 == 0, "ok").otherwise("unverified").alias("ex_status"), F.substring("text", 1, 40).alias("ex_summary"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions: labelled documents with truth, prediction and confidence."""
    a = articles(spark, sf_dir).select("doc_id", "has_body", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    names = F.array(*[F.lit(n) for n in NARRATIVES])
    true_n = F.pmod(F.col("doc_id") * 3 + F.col("quality"), F.lit(5))
    wrong = F.pmod(F.col("doc_id") * 17, F.lit(10)) < 3
    pred_n = F.when(wrong, F.pmod(true_n + 1 + F.pmod("doc_id", F.lit(3)), F.lit(5))).otherwise(true_n)
    true_s = F.when(F.col("toxic") == 1, "High").otherwise("Low")
    flip = F.pmod(F.col("doc_id") * 11, F.lit(8)) == 0
    return a.select(
        "doc_id",
        "has_body",
        "source",
        "lang",
        F.pmod(F.col("doc_id") * 31, F.lit(5)).cast("int").alias("fold"),
        F.pmod("doc_id", F.lit(3)).cast("int").alias("seed"),
        F.element_at(names, (true_n + 1).cast("int")).alias("true_narrative"),
        F.element_at(names, (pred_n + 1).cast("int")).alias("pred_narrative"),
        (F.pmod(F.col("doc_id") * 37, F.lit(1000)) / 1000.0).alias("conf"),
        true_s.alias("true_severity"),
        F.when(flip, F.when(true_s == "High", "Low").otherwise("High")).otherwise(true_s).alias("pred_severity"),
    )
