"""Cycles over state tables, by batch or as a stream."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakepress.operators import lifecycle as L
from lakepress.plans.workdir import spill
from lakepress.streaming.store import Store

Scorer = Callable[[DataFrame], DataFrame]


SCHEMAS = {
    "articles": L.ARTICLE_SCHEMA,
    # the article that holds a headline key
    "headlines": "headline_key string, article_id string",
    # where copies of stored articles came from
    "addresses": "url_hash string",
    # relevant articles that are not classified yet
    "waiting": "article_id string, fetch_status string, collected_at timestamp",
    "predictions": "article_id string, label string, confidence double",
    "explanations": "article_id string, status string",
    "reviews": "review_id bigint, article_id string, label string, not_relevant boolean",
    "runs": "run_id bigint, stage string, ok boolean, detail string",
    "leases": "name string, owner string, until timestamp",
}
KEYS = {"articles": "article_id", "headlines": "headline_key", "addresses": "url_hash", "waiting": "article_id", "predictions": "article_id", "explanations": "article_id"}
VERSION = 3


def _dismissals(store: Store) -> None:
    """Version 3: reviews say whether an article is off the subject; older ones don't say so."""
    store.write("reviews", store.read("reviews").fillna(False, ["not_relevant"]))


#: version 2 added columns that are null in older rows, so nothing is rewritten for it
STEPS = {3: _dismissals}


def open_store(spark: SparkSession, root: str, **more) -> Store:
    """The live store of this version; an older one is brought up, a newer one raises."""
    return Store(spark, root, SCHEMAS, keys=KEYS, version=VERSION, steps=STEPS, **more)


def _queue(articles: DataFrame) -> DataFrame:
    return articles.where((F.col("status") == "new") & F.col("relevant")).select("article_id", "fetch_status", "collected_at")


def _ingest(store: Store, items: DataFrame) -> None:
    articles = lambda some: store.lookup("articles", some.select(F.concat(F.lit("a_"), "url_hash").alias("article_id")), ["url_hash"])
    urls = lambda some: articles(some).unionByName(store.lookup("addresses", some))
    changed, keys, copies, _ = L.ingest_changes(items, urls, lambda some: store.lookup("headlines", some), lambda some: store.lookup("articles", some))
    store.add("articles", changed)
    store.add("headlines", keys)
    store.add("addresses", copies)
    store.add("waiting", _queue(changed))


def _expire(store: Store, now: Column) -> None:
    """Deadlines are looked up among what waits."""
    waiting = store.read("waiting")
    late = spill(waiting.join(L.expire(waiting.withColumn("fetch_error", F.lit(None).cast("string")), now).where("fetch_status = 'failed'").select("article_id"), "article_id", "left_semi").where("fetch_status = 'pending'"), "late")
    store.add("articles", L.expire(store.lookup("articles", late.select("article_id")), now))
    store.add("waiting", late.withColumn("fetch_status", F.lit("failed")))


def _classify(store: Store, scorer: Scorer) -> None:
    ready = spill(store.read("waiting").where("fetch_status <> 'pending'").select("article_id"), "ready")
    articles = store.lookup("articles", ready)
    new = spill(scorer(L.to_classify(articles)), "scored")
    done = new.select("article_id")
    store.add("predictions", new)
    store.remove("explanations", done.join(store.read("explanations", ["article_id"]), "article_id", "left_semi"))
    store.add("articles", articles.join(done, "article_id", "left_semi").withColumn("status", F.lit("classified")))
    store.remove("waiting", done)


def run_cycle(store: Store, items: DataFrame, scorer: Scorer, now: Column, run_id: int = 0, strict: bool = False, owner: str | None = None, minutes: int = 45) -> DataFrame:
    """ingest, expire, classify; a stage that fails is reported and the rest run. Returns the report.

    What a stage reads and writes grows with the batch and with what waits, not
    with the store. A stage's tables are committed together or not at all. With
    ``strict`` a failed ingest is raised once the report is stored: its items
    are not stored yet, and the caller must offer them again. With an ``owner``
    the lease on cycles is held for ``minutes`` at most; where another has it,
    nothing runs and the report says so and is not stored.
    """
    if owner is not None and not store.lease("cycle", owner, now, now + F.expr(f"interval {minutes} minutes")):
        return store.spark.createDataFrame([(run_id, "cycle", False, "another cycle is running")], SCHEMAS["runs"])
    report: list[tuple[int, str, bool, str | None]] = []
    failed: dict[str, Exception] = {}
    try:
        for name, work in (("ingest", lambda: _ingest(store, items)), ("expire", lambda: _expire(store, now)), ("classify", lambda: _classify(store, scorer))):
            try:
                work()
                store.commit()
                report.append((run_id, name, True, None))
            except Exception as e:  # noqa: BLE001 - one dead stage must not stop the others
                store.refresh()
                failed[name] = e
                report.append((run_id, name, False, f"{type(e).__name__}: {e}"[:300]))
        rows = store.spark.createDataFrame(report, SCHEMAS["runs"])
        store.add("runs", rows)
        store.commit()
    finally:
        if owner is not None:
            store.release("cycle", owner)
    if strict and "ingest" in failed:
        raise failed["ingest"]
    return rows


def stream_cycles(stream: DataFrame, store: Store, scorer: Scorer, now: Column, checkpoint: str, every: str | None = None, owner: str | None = None) -> StreamingQuery:
    """A cycle for each micro-batch; without ``every`` what is there now is worked off and the query ends, which is a run on demand.

    A failed ingest, or a cycle that another owner's lease kept from running,
    fails the micro-batch, so its items come again after a restart; ingest
    stores nothing twice.
    """

    def one(batch: DataFrame, n: int) -> None:
        if run_cycle(store, batch, scorer, now, n, strict=True, owner=owner).where("stage = 'cycle'").limit(1).count():
            raise Busy("another cycle is running")

    out = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


class Busy(Exception):
    """Another cycle holds the lease."""


class ModelDown(Exception):
    """The explaining model can't be reached."""


def explain_waiting(store: Store, waiting: DataFrame, explainer: Scorer, most: int = 40, seconds: float = 300.0, at_once: int = 8, clock: Callable[[], float] = time.monotonic) -> tuple[int, str | None]:
    """(how many were explained, why the rest wait): the first ``most`` of ``waiting``, until the time is used or the model is down.

    ``explainer`` maps (article_id, ...) to (article_id, status). Each few are
    committed at once, so what is done stays done; what waits is what the next
    cycle asks for again. ``most`` ids reach the driver.
    """
    began, done = clock(), 0
    ids = [r.article_id for r in waiting.select("article_id").limit(most).collect()]
    for start in range(0, len(ids), at_once):
        if clock() - began > seconds:
            return done, "time budget used"
        some = ids[start : start + at_once]
        try:
            new = explainer(waiting.where(F.col("article_id").isin(some)))
            store.add("explanations", new)
            store.commit()
        except ModelDown as e:
            store.refresh()
            return done, f"model down: {e}"
        done += len(some)
    return done, None
