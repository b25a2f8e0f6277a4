"""Near-duplicate, hold-out and fold queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepress.functions import text as T
from lakepress.operators import baselines as B
from lakepress.operators import dedupe as D
from lakepress.operators import folds as X
from lakepress.operators.graph import connected_components
from lakepress.plans.registry import ART, NORM, SCORED, Registry
from lakepress.plans.workdir import spill
from lakepress.sources import mapped as S

R = Registry()

_GRAMS = (
    f"{ART}, words AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(headline), '\\s+'), lambda w: w <> '')) AS w FROM art), "
    "padded AS (SELECT doc_id, ' ' || w || ' ' AS w FROM words), "
    "grams AS (SELECT doc_id, unnest(CASE WHEN length(w) <= 3 THEN [w] ELSE list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)) END) AS gram FROM padded "
    "UNION ALL SELECT doc_id, unnest(CASE WHEN length(w) <= 4 THEN [w] ELSE list_transform(range(1, length(w) - 2), lambda i: substr(w, i, 4)) END) FROM padded WHERE length(w) > 3 "
    "UNION ALL SELECT doc_id, unnest(CASE WHEN length(w) <= 5 THEN [w] ELSE list_transform(range(1, length(w) - 3), lambda i: substr(w, i, 5)) END) FROM padded WHERE length(w) > 4), "
    "tf AS (SELECT doc_id, gram, count(*) AS tf FROM grams GROUP BY 1, 2), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY 1), "
    "raw AS (SELECT doc_id, gram, (1 + ln(tf)) * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (gram)), "
    "tfidf AS (SELECT doc_id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw)"
)
_PAIRS = f"{_GRAMS}, pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, round(sum(x.w * y.w), 9) AS cosine FROM tfidf x JOIN tfidf y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY 1, 2 HAVING round(sum(x.w * y.w), 9) >= 0.85)"
_COMP = (
    f"{_PAIRS}, e AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs), "
    "walk AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT w.doc_id, e.y FROM walk w JOIN e ON e.x = w.reached), comp AS (SELECT doc_id, min(reached) AS component FROM walk GROUP BY doc_id)"
)


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.tfidf(S.articles(spark, sf_dir).select("doc_id", "headline"))


@R.add(f"WITH {_GRAMS} SELECT doc_id, count(*) AS n_grams, round(max(w), 6) AS top_weight, round(sum(w), 6) AS total FROM tfidf GROUP BY doc_id")
def headline_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: TF-IDF weights of in-word character grams."""
    return weights(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_grams"), F.round(F.max("weight"), 6).alias("top_weight"), F.round(F.sum("weight"), 6).alias("total"))


@R.add(f"WITH {_PAIRS} SELECT a, b, round(cosine, 6) AS cosine FROM pairs")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of headlines from cosine 0.85 on."""
    return D.near_pairs(S.articles(spark, sf_dir).select("doc_id", "headline")).withColumn("cosine", F.round("cosine", 6))


@R.add(f"WITH RECURSIVE {_COMP} SELECT * FROM comp")
def near_dup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that similar pairs chain together."""
    return D.near_clusters(S.articles(spark, sf_dir).select("doc_id", "headline"))


@R.add(f"WITH RECURSIVE {_COMP}, g AS (SELECT component, count(*) AS n, count(DISTINCT lang) AS nl FROM comp JOIN documents USING (doc_id) GROUP BY component) SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_exact_dups, count(*) AS n_groups, max(n) AS largest_group, CAST(sum((n > 1)::INT) AS BIGINT) AS multi_row_groups, CAST(sum((nl > 1)::INT) AS BIGINT) AS spanning_groups FROM g")
def near_dup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A3 over near-duplicate clusters."""
    a = S.articles(spark, sf_dir).select("doc_id", "headline", "lang")
    c = D.near_clusters(a)
    return D.summary(a.join(c, "doc_id"), "component", "lang")


_NORM = NORM.format("headline")
_HOLD = f"WITH {ART}, x AS (SELECT doc_id, {_NORM} AS grp FROM art), held AS (SELECT DISTINCT grp FROM x WHERE doc_id % 10 = 0)"


@R.add(f"{_HOLD} SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'holdout' WHEN grp IN (SELECT grp FROM held) THEN 'leaked' ELSE 'pool' END AS part FROM x")
def holdout_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold-out, rows that share a group with it, and the pool; together they are the input."""
    rows = S.articles(spark, sf_dir).select("doc_id", T.normal_headline(F.col("headline")).alias("grp"))
    held, rest = rows.where("doc_id % 10 = 0"), rows.where("doc_id % 10 <> 0")
    pool, leaked = X.hold_out(rest, held, "grp")
    part = lambda df, name: df.select("doc_id", F.lit(name).alias("part"))
    return part(held, "holdout").unionByName(part(leaked, "leaked")).unionByName(part(pool, "pool"))


@R.add("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6 on benchmark passages: documents that contain one whole.

    Both sides are cut into 12-word windows; a document and a passage meet on
    the passage's first window, and only those pairs are compared.
    """
    b = S.table(spark, sf_dir, "benchmark").withColumnRenamed("text", "passage")
    return B.containing(S.table(spark, sf_dir, "documents").select("doc_id", "text"), b.select("item_id", "passage"))


@R.add(f"WITH {ART} SELECT a.doc_id, CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'positive' ELSE 'q' || coalesce(l.quality, 0) END AS stratum FROM art a LEFT JOIN labels l ON l.doc_id = a.doc_id")
def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare positives get a stratum of their own."""
    a = S.articles(spark, sf_dir).select("doc_id").join(S.table(spark, sf_dir, "labels"), "doc_id", "left")
    return a.select("doc_id", X.stratum(F.coalesce("toxic", F.lit(0)) == 1, F.concat(F.lit("q"), F.coalesce("quality", F.lit(0)).cast("string"))).alias("stratum"))


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.articles(spark, sf_dir).select("doc_id", "lang", T.normal_headline(F.col("headline")).alias("grp"))


@R.add()
def group_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified group folds."""
    return X.group_folds(_grouped(spark, sf_dir), "grp", "lang", 5, 3).select("doc_id", "grp", "lang", "fold")


@R.add("SELECT 0::BIGINT AS spanning_groups, (SELECT count(*) FROM documents) AS n_rows, 5::BIGINT AS n_folds")
def group_kfold_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No group in two folds, every row once."""
    f = group_kfold(spark, sf_dir)
    spans = f.groupBy("grp").agg(F.countDistinct("fold").alias("k")).agg(F.sum((F.col("k") > 1).cast("long")).alias("spanning_groups"), F.lit(1).alias("one"))
    return spans.join(f.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("fold").alias("n_folds"), F.lit(1).alias("one")), "one").drop("one")


@R.add("SELECT doc_id, ((row_number() OVER (PARTITION BY lang ORDER BY md5('3:' || doc_id), doc_id) - 1) % 5)::INT AS fold FROM documents")
def plain_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain stratified folds, for contrast."""
    return X.plain_folds(_grouped(spark, sf_dir), "doc_id", "lang", 5, 3).select("doc_id", "fold")


@R.add()
def inner_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group-aware inner validation split."""
    return X.inner_split(_grouped(spark, sf_dir), "grp", "lang", 0.2, 5).select("doc_id", "grp", "is_validation")


@R.add(
    "WITH k AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'original' WHEN contains(text, 'thanea') THEN 'rubric' ELSE 'random' END AS bucket FROM documents), f AS (SELECT count(*) AS n FROM k WHERE bucket <> 'random'), "
    "r AS (SELECT *, row_number() OVER (ORDER BY md5('9:' || doc_id), doc_id) AS turn FROM k WHERE bucket = 'random') "
    "SELECT doc_id, bucket FROM k WHERE bucket <> 'random' UNION ALL SELECT doc_id, bucket FROM r, f WHERE turn <= 400 + (SELECT count(*) FROM documents) // 2 - f.n"
)
def review_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review sample of originals, rubric hits and random others."""
    d = S.table(spark, sf_dir, "documents")
    return X.review_buckets(d, "doc_id", F.col("doc_id") % 50 == 0, F.contains("text", F.lit("thanea")), 400 + d.count() // 2, 9)


@R.add(SCORED + "SELECT row_number() OVER (ORDER BY md5('4:' || doc_id), doc_id) AS position, doc_id, lang, true_severity FROM oof")
def blind_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blind sheet joined back to its key."""
    rows = S.scored(spark, sf_dir).select("doc_id", "lang", "true_severity")
    sheet, key = X.blind_sheet(rows, "doc_id", ["true_severity"], 4)
    return sheet.join(key, "position")


@R.add(SCORED + "SELECT doc_id, true_narrative FROM (SELECT *, row_number() OVER (PARTITION BY true_narrative ORDER BY md5('2:' || doc_id), doc_id) AS turn FROM oof) ORDER BY turn, md5('2:' || doc_id), doc_id LIMIT 32")
def overfit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small sample, even over classes."""
    return X.even_sample(S.scored(spark, sf_dir).select("doc_id", "true_narrative"), "doc_id", "true_narrative", 32, 2)


@R.add("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def remaining_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that were not chosen."""
    return S.table(spark, sf_dir, "documents").select("doc_id", "lang").join(S.table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@R.add(f"WITH {ART}, x AS (SELECT doc_id, {_NORM} AS grp, has_body FROM art), t AS (SELECT DISTINCT grp FROM x WHERE has_body) SELECT doc_id FROM x WHERE NOT has_body AND grp NOT IN (SELECT grp FROM t)")
def headline_only_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline-only rows that share no group with bodied rows."""
    a = S.articles(spark, sf_dir).select("doc_id", "has_body", T.normal_headline(F.col("headline")).alias("grp"))
    return a.where("not has_body").join(a.where("has_body").select("grp").distinct(), "grp", "left_anti").select("doc_id")


@R.add("SELECT count(*) AS common FROM (SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1)")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that two id sets share."""
    l = S.table(spark, sf_dir, "labels")  # noqa: E741
    return l.where("quality = 1").select("doc_id").intersect(l.where("toxic = 1").select("doc_id")).agg(F.count(F.lit(1)).alias("common"))


@R.add()
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5 on the graph of all orders and parts; a part's node is -1 less its key, so the two never meet.

    No SQL: a recursive closure over all of lineitem does not end in time; held against union-find instead.
    """
    li = S.table(spark, sf_dir, "lineitem")
    return connected_components(li.select(F.col("l_orderkey").cast("bigint").alias("a"), (-1 - F.col("l_partkey").cast("bigint")).alias("b")))


@R.add()
def text_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-gram TF-IDF and balanced logistic regression, each row predicted by other folds."""
    rows = S.table(spark, sf_dir, "documents").select("doc_id", "text").join(S.scored(spark, sf_dir).select("doc_id", "fold", F.col("true_severity").alias("label")), "doc_id")
    vectors, model = B.text_model(rows)
    return B.cross_predict(vectors, "doc_id", "fold", "label", model)


@R.add()
def keyword_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: logistic regression on keyword features."""
    rows = S.texts(spark, sf_dir).select("doc_id", "text").join(S.scored(spark, sf_dir).select("doc_id", "fold", F.col("true_narrative").alias("label")), "doc_id")
    counted, model = B.keyword_model(rows, S.GROUPS)
    return B.cross_predict(counted, "doc_id", "fold", "label", model)


@R.add()
def has_body_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: the control that sees only whether there is a body."""
    rows = spill(S.scored(spark, sf_dir).select("doc_id", "fold", "has_body", F.col("true_severity").alias("label")), "flags")
    return B.cross_predict(rows, "doc_id", "fold", "label", B.has_body_model)
