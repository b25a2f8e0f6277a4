"""Queries of readers, sinks and live state: what is written is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepress.functions import text as T
from lakepress.operators import lifecycle as L
from lakepress.operators import metrics as M
from lakepress.plans.lifecycle_queries import ITEMS_SQL, arrivals
from lakepress.plans.registry import MODEL, Registry
from lakepress.plans.workdir import shared_dir, spill
from lakepress.sources import mapped as S
from lakepress.sources import tables as X
from lakepress.streaming import cycle as C
from lakepress.streaming import store as ST
from lakepress.streaming import timers as TM

R = Registry()


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@R.add("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def corpus_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV corpus read back with the wanted columns only."""
    path = _folder(spark, "corpus")
    rows = S.table(spark, sf_dir, "customer")
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return X.read_corpus(spark, path, rows.schema, ["c_custkey", "c_name", "c_mktsegment"])


@R.add("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents")
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits by one CSV of ids each, joined back to the corpus."""
    d, paths = S.table(spark, sf_dir, "documents").select("doc_id"), {}
    for name, part in (("test", d.where("doc_id % 5 = 0")), ("train", d.where("doc_id % 5 <> 0"))):
        paths[name] = _folder(spark, "split")
        part.withColumnRenamed("doc_id", "id").write.option("header", True).csv(paths[name])
    members = X.split_members(spark, paths).select(F.col("id").cast("bigint").alias("doc_id"), "split")
    return d.join(members, "doc_id")


@R.add("SELECT doc_id AS id, (doc_id % 5)::INT AS fold, lang FROM documents")
def fold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds written a folder each, read back with their corpus rows."""
    d, path = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), _folder(spark, "folds")
    X.write_folds(d.select("id", (F.col("id") % 5).cast("int").alias("fold")), path)
    return X.read_folds(spark, path, d)


@R.add(
    "SELECT CASE WHEN q IS NULL THEN source ELSE source || '_' || q || '_news' END AS name, 'https://' || source || '.example.org' || CASE WHEN q IS NULL THEN '' ELSE '?q=' || upper(q) || '+news' END AS url, CASE WHEN q IS NULL THEN 'rss' ELSE 'search' END AS kind, source <> 'src1' AS gate "
    "FROM (SELECT DISTINCT source, CASE WHEN source <> 'src2' THEN lang END AS q FROM documents)"
)
def source_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of the documents' sources, each with a search for every language but one that is read as it is."""
    d = S.table(spark, sf_dir, "documents")
    asks = F.array_sort(F.collect_set(F.concat(F.upper("lang"), F.lit(" news"))))
    entries = d.groupBy(F.col("source").alias("name")).agg(asks.alias("asks")).select(
        "name", F.concat(F.lit("https://"), "name", F.lit(".example.org")).alias("url"), F.when(F.col("name") == "src2", "rss").otherwise("search").alias("kind"), (F.col("name") != "src1").alias("gate"), F.when(F.col("name") != "src2", F.col("asks")).alias("queries")
    )
    return X.catalogue(entries)


@R.add("SELECT o_custkey AS id, max(o_orderkey) AS line, arg_max(o_orderstatus, o_orderkey) AS answer FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 GROUP BY o_custkey")
def checkpoint_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON-lines checkpoint of one model and prompt in several files, the last line of each key."""
    o, path = S.table(spark, sf_dir, "orders"), _folder(spark, "lines")
    lines = o.select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("line"), F.when(F.col("o_orderkey") % 3 == 0, "old").otherwise("new").alias("model"),
        F.when(F.col("o_orderkey") % 2 == 0, "p1").otherwise("p2").alias("prompt"), F.col("o_orderstatus").alias("answer"),
    )
    # the order of lines is that of the files alone
    lines.orderBy("line").write.json(path)
    return X.last_lines(spark, path, "id bigint, line bigint, model string, prompt string, answer string", "id", "new", "p1").select("id", "line", "answer")


@R.add("SELECT seed, fold FROM (VALUES (1, 0), (1, 1), (2, 0), (2, 1)) t(seed, fold) WHERE NOT (seed = 1 OR fold = 1) UNION ALL SELECT -1, count(*)::INT FROM labels WHERE doc_id % 2 = 1")
def resumed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs written one by one and one of them twice; what is left to run, and the rows of the rewritten one."""
    path, l = _folder(spark, "runs"), S.table(spark, sf_dir, "labels")  # noqa: E741
    for seed, fold, rows in ((1, 0, l), (1, 1, l), (2, 1, l), (1, 0, l.where("doc_id % 2 = 1"))):
        X.write_run(rows, path, seed, fold)
    done = spark.read.parquet(path)
    plan = spark.createDataFrame([(s, f) for s in (1, 2) for f in (0, 1)], "seed int, fold int")
    again = done.where("seed = 1 and fold = 0").agg(F.count(F.lit(1)).cast("int").alias("fold")).select(F.lit(-1).alias("seed"), "fold")
    return X.missing_runs(plan, done).unionByName(again)


def _decided(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """What ``make`` decides on a stream of all events, landed as files with times to the millisecond; the watermark is ten minutes behind the last."""
    landing, out, at = _folder(spark, "landing"), _folder(spark, "decided"), _folder(spark, "stream")
    events = S.table(spark, sf_dir, "events").select("event_id", F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("ts"), "user_id", "event_type")
    events.write.parquet(landing)
    stream = make(spark.readStream.schema(events.schema).parquet(landing).withWatermark("ts", "10 minutes"))
    TM.to_table(stream, out, at).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


_MARK = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM ev)"
_EV = "ev AS (SELECT * REPLACE (date_trunc('milliseconds', ts) AS ts) FROM events)"


@R.add(
    f"WITH RECURSIVE {_EV}, asked AS (SELECT user_id, ts, count(*) AS n, bool_or(event_type = 'error') AS limited, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM ev GROUP BY user_id, ts), "
    "step AS (SELECT user_id, ts, n, true AS allowed, CASE WHEN limited THEN ts + INTERVAL 60 MINUTE END AS until, nth FROM asked WHERE nth = 1 "
    "UNION ALL SELECT a.user_id, a.ts, a.n, s.until IS NULL OR s.until <= a.ts, CASE WHEN s.until > a.ts THEN s.until WHEN a.limited THEN a.ts + INTERVAL 60 MINUTE END, a.nth FROM step s JOIN asked a ON a.user_id = s.user_id AND a.nth = s.nth + 1) "
    f"SELECT user_id, ts, n, allowed, until FROM step WHERE ts < {_MARK}"
)
def cool_downs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a user may ask, and until when a limit that was met pauses them; keyed state and timers over all events."""
    return _decided(spark, sf_dir, lambda e: TM.cool_downs(e, "user_id", "ts", F.col("event_type") == "error", 60))


@R.add(
    f"WITH {_EV} SELECT e.user_id, e.event_id, e.ts AS opened, coalesce(min(s.ts), e.ts + INTERVAL 6 HOUR) AS closed, CASE WHEN min(s.ts) IS NULL THEN 'expired' ELSE 'settled' END AS outcome "
    "FROM ev e LEFT JOIN ev s ON s.user_id = e.user_id AND s.event_type = 'purchase' AND s.ts >= e.ts AND s.ts < e.ts + INTERVAL 6 HOUR "
    f"WHERE e.event_type = 'view' AND e.ts + INTERVAL 6 HOUR < {_MARK} GROUP BY e.user_id, e.event_id, e.ts"
)
def pending_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What waits is settled by its user's next purchase or expires at its deadline; keyed state and timers over all events."""
    return _decided(spark, sf_dir, lambda e: TM.deadlines(e, "user_id", "event_id", "ts", F.col("event_type") == "view", F.col("event_type") == "purchase", 360))


@R.add(
    f"WITH RECURSIVE {_EV}, asked AS (SELECT user_id, event_id, ts, event_type AS owner, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM ev), "
    "step AS (SELECT user_id, event_id, ts, owner, true AS got, owner AS holder, ts + INTERVAL 12 HOUR AS until, nth FROM asked WHERE nth = 1 "
    "UNION ALL SELECT a.user_id, a.event_id, a.ts, a.owner, s.until <= a.ts OR s.holder = a.owner, CASE WHEN s.until <= a.ts OR s.holder = a.owner THEN a.owner ELSE s.holder END, "
    "CASE WHEN s.until <= a.ts OR s.holder = a.owner THEN a.ts + INTERVAL 12 HOUR ELSE s.until END, a.nth FROM step s JOIN asked a ON a.user_id = s.user_id AND a.nth = s.nth + 1) "
    f"SELECT user_id, event_id, ts, owner, got FROM step WHERE ts < {_MARK}"
)
def leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who asks for a lease gets it when it is free, run out or their own; keyed state over all events."""
    return _decided(spark, sf_dir, lambda e: TM.leases(e, "user_id", "event_id", "ts", F.col("event_type"), 720))


@R.add(
    "SELECT 3::BIGINT AS version, doc_id, doc_id % 2 = 0 AS high, CASE WHEN doc_id % 5 = 0 THEN doc_id % 10 = 0 ELSE false END AS not_relevant FROM documents"
)
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews written by version 1 and brought up, newer ones put over some of them."""
    root, ids = _folder(spark, "versions"), S.table(spark, sf_dir, "documents").select("doc_id")
    label = F.when(F.col("doc_id") % 2 == 0, "High").otherwise("Low").alias("label")
    schemas = {"reviews": "article_id bigint, label string"}
    old = ST.Store(spark, root, schemas, keys={"reviews": "article_id"}, version=1)
    old.add("reviews", ids.select(F.col("doc_id").alias("article_id"), label))
    old.commit()
    newer = {"reviews": "article_id bigint, label string, note string, not_relevant boolean"}
    store = ST.Store(spark, root, newer, keys=old.keys, version=3, steps={3: lambda s: s.write("reviews", s.read("reviews").fillna(False, ["not_relevant"]))})
    some = ids.where("doc_id % 5 = 0").select(F.col("doc_id").alias("article_id"), label, F.lit(None).cast("string").alias("note"), (F.col("doc_id") % 10 == 0).alias("not_relevant"))
    store.add("reviews", some)
    store.commit()
    return store.read("reviews").select(F.lit(store.stored_version).cast("bigint").alias("version"), F.col("article_id").alias("doc_id"), (F.col("label") == "High").alias("high"), "not_relevant")


@R.add(
    "SELECT * FROM (VALUES (1, 'ingest', true), (1, 'expire', true), (1, 'classify', true), (2, 'ingest', true), (2, 'expire', true), (2, 'classify', false)) t(run_id, stage, ok)"
)
def cycle_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cycles over the store, the second with a scorer that fails; its other stages run and the report says so."""
    root, now = _folder(spark, "cycle"), F.lit("2024-01-20 00:00:00").cast("timestamp")
    good = lambda df: df.select("article_id", F.lit("x").alias("label"), F.lit(0.5).alias("confidence"))
    for n, scorer in ((1, good), (2, lambda df: df.select("no such column"))):
        # each cycle starts from what is stored
        C.run_cycle(C.open_store(spark, root), arrivals(spark, sf_dir), scorer, now, n)
    return C.open_store(spark, root).read("runs").select(F.col("run_id").cast("int").alias("run_id"), "stage", "ok")


_BATCHES, _SAME_URL = 4, 613


@R.add(
    ITEMS_SQL.replace("SELECT doc_id AS pos,", f"SELECT (doc_id % {_SAME_URL}) * {_BATCHES} // {_SAME_URL} * 1099511627776 + doc_id AS pos,")
    + ", d AS (SELECT k, arg_min(body, pos) AS lent FROM f WHERE rk > 1 AND is_body GROUP BY k), "
    "g AS (SELECT f.*, CASE WHEN f.is_body THEN f.body ELSE d.lent END AS has, NOT f.is_body AND d.lent IS NOT NULL AS borrowed FROM f LEFT JOIN d ON d.k = f.k WHERE f.rk = 1), "
    "h AS (SELECT *, CASE WHEN borrowed THEN 'ok' WHEN NOT relevant THEN 'skipped' WHEN is_body THEN 'ok' WHEN collected_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 60 MINUTE THEN 'failed' ELSE 'pending' END AS fetched FROM g) "
    "SELECT substr(sha1(url), 1, 16) AS url_hash, k AS headline_key, coalesce(length(has), -1)::INT AS body_chars, fetched AS fetch_status, CASE WHEN NOT relevant THEN 'irrelevant' WHEN fetched = 'pending' THEN 'new' ELSE 'classified' END AS status, "
    "CASE WHEN relevant AND fetched <> 'pending' THEN CASE WHEN has IS NULL THEN 'headline' ELSE 'body' END END AS label, relevant AND fetched = 'pending' AS waiting FROM h"
)
def live_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after cycles of ingest, expiry and classification, each of which writes what it changes."""
    root, now = _folder(spark, "live"), F.lit("2024-01-20 00:00:00").cast("timestamp")
    # copies of an address come in one batch
    turn = F.floor(F.pmod("pos", F.lit(_SAME_URL)) * _BATCHES / _SAME_URL).cast("bigint")
    items = spill(arrivals(spark, sf_dir).withColumn("turn", turn).withColumn("pos", F.col("turn") * (1 << 40) + F.col("pos")), "arrivals")
    scorer = lambda df: df.select("article_id", F.when(F.col("body").isNull(), "headline").otherwise("body").alias("label"), F.lit(0.5).alias("confidence"))
    for n in range(_BATCHES):
        report = C.run_cycle(C.open_store(spark, root), items.where(F.col("turn") == n).drop("turn"), scorer, now, n, strict=True, owner="query")
        if failed := [r.detail for r in report.collect() if not r.ok]:
            raise RuntimeError(failed[0])
    store = C.open_store(spark, root)
    waiting = store.read("waiting", ["article_id"]).withColumn("waiting", F.lit(True))
    return store.read("articles").join(store.read("predictions").select("article_id", "label"), "article_id", "left").join(waiting, "article_id", "left").select(
        "url_hash", "headline_key", F.coalesce(F.length("body"), F.lit(-1)).alias("body_chars"), "fetch_status", "status", "label", F.coalesce("waiting", F.lit(False)).alias("waiting")
    )


@R.add()
def bootstrap_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the challenger replaces the champion: better in nine of ten of 2,000 paired resamples."""
    rows = S.scored(spark, sf_dir).select("doc_id", ((F.col("true_severity") == F.col("pred_severity")).cast("int") - (F.col("true_narrative") == F.col("pred_narrative")).cast("int")).alias("d"))
    won = M.paired_bootstrap(rows, F.col("d"), 2000)
    return won.select(F.lit(rows.count()).alias("n"), (F.col("p_better") >= M.SWITCH).alias("switch"))


@R.add(
    MODEL + "SELECT t.label, t.id, t.collapsed, count(f.doc_id) AS n FROM (VALUES ('Alpha', 0, 'Main'), ('Beta', 1, 'Main'), ('Gamma', 2, 'Side'), ('Delta', 3, 'Side'), ('Other', 4, 'Other')) t(label, id, collapsed) LEFT JOIN flags f ON f.narrative = t.label GROUP BY ALL"
)
def taxonomy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, their ids and collapsed classes, and how many predictions fall into each."""
    n = S.predictions(spark, sf_dir).groupBy(F.col("narrative").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return S.taxonomy(spark).join(n, "label", "left").select("label", "id", "collapsed", F.coalesce("n", F.lit(0)).alias("n"))


@R.add(
    "WITH h AS (SELECT doc_id, trim(split_part(text, chr(10), 1)) AS headline FROM documents WHERE trim(split_part(text, chr(10), 1)) <> '') "
    "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'given-' || doc_id ELSE 'rt_' || substr(sha1(headline || chr(10) || 'some body'), 1, 10) END AS id, headline FROM h"
)
def api_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as callers hand them in; ids that are missing are made of the text."""
    d = S.table(spark, sf_dir, "documents").select("doc_id", F.trim(F.substring_index("text", "\n", 1)).alias("headline")).where("headline <> ''")
    i = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, F.when(F.col("doc_id") % 2 == 0, "").otherwise("NaN")).otherwise(F.concat(F.lit("given-"), F.col("doc_id").cast("string")))
    a = T.api_article(i, F.col("headline"), F.lit(" some body "))
    return d.select("doc_id", a.alias("a")).select("doc_id", "a.id", "a.headline")


@R.add(
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'pending' END AS fetch_status, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS attempts, CASE WHEN doc_id % 3 = 0 THEN 'site refuses automated access' END AS error FROM documents"
)
def unfetchable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages of domains that refuse machines are given up at the first try."""
    d = S.table(spark, sf_dir, "documents").select("doc_id")
    host = F.when(F.col("doc_id") % 3 == 0, "a.example.net").otherwise("b.example.com")
    state = d.select("doc_id", F.col("doc_id").cast("string").alias("article_id"), F.concat(F.lit("https://"), host, F.lit("/p")).alias("page"), F.lit("pending").alias("fetch_status"), F.lit(0).alias("fetch_attempts"), F.lit(None).cast("string").alias("fetch_error"))
    after = L.record_failures(state, L.unfetchable(state, F.col("page"), S.BLOCKED))
    return after.select("doc_id", "fetch_status", F.col("fetch_attempts").alias("attempts"), F.col("fetch_error").alias("error"))


_Z = "(1.96 * 1.96)"
_MID, _HALF, _DEN = "({k}::DOUBLE / {n} + " + _Z + " / (2 * {n}))", "1.96 * sqrt({k}::DOUBLE / {n} * (1 - {k}::DOUBLE / {n}) / {n} + " + _Z + " / (4.0 * {n} * {n}))", "(1 + " + _Z + " / {n})"


def _bound(k: str, n: str, sign: str) -> str:
    mid, half, den = (x.format(k=k, n=n) for x in (_MID, _HALF, _DEN))
    return f"greatest({mid} / {den} - {half} / {den}, 0.0)" if sign == "-" else f"least({mid} / {den} + {half} / {den}, 1.0)"


@R.add(
    "WITH r AS (SELECT doc_id % 3 = 0 AS yes, coalesce(contains(text, 'thanea'), false) AS flagged, CASE WHEN doc_id % 50 = 0 THEN 'original' WHEN contains(text, 'thanea') THEN 'rubric' ELSE 'random' END AS bucket FROM documents), "
    "c AS (SELECT sum(flagged::INT) AS n, sum((flagged AND yes)::INT) AS k, sum((bucket = 'random')::INT) AS rn, sum((bucket = 'random' AND yes)::INT) AS rk, sum((NOT flagged)::INT) AS u FROM r) "
    f"SELECT n::BIGINT AS n_flagged, k::BIGINT AS n_right, k::DOUBLE / n AS precision, {_bound('k', 'n', '-')} AS precision_low, {_bound('k', 'n', '+')} AS precision_high, "
    f"rk::DOUBLE / rn * u AS missed, {_bound('rk', 'rn', '-')} * u AS missed_low, {_bound('rk', 'rn', '+')} * u AS missed_high, k::DOUBLE / (k + rk::DOUBLE / rn * u) AS recall FROM c"
)
def review_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule's precision, what it misses and its recall, estimated from a reviewed sample."""
    flagged = F.coalesce(F.contains("text", F.lit("thanea")), F.lit(False))
    rows = S.table(spark, sf_dir, "documents").select((F.col("doc_id") % 3 == 0).alias("yes"), flagged.alias("flagged"), F.when(F.col("doc_id") % 50 == 0, "original").when(flagged, "rubric").otherwise("random").alias("bucket"))
    return M.review_estimates(rows, rows.where("not flagged").count())
