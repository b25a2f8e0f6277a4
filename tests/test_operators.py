"""Operators against hand-made numbers."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakepress.operators import dedupe as D
from lakepress.operators import folds as X
from lakepress.operators import lifecycle as L
from lakepress.operators import metrics as M
from lakepress.operators import views as V
from lakepress.operators.graph import connected_components
from lakepress.plans import cluster_queries
from lakepress.sources import config, feeds, tables
from lakepress.streaming import cycle


def test_components_chain(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 6), (5, 5), (None, 4)], "a int, b int")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 5: 5}


def test_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a int, b int")
    assert {r.component for r in connected_components(edges).collect()} == {0}


def test_graph_of_all_orders_and_parts(spark, tmp_path):
    rng = random.Random(6)
    lines = [(rng.randrange(1, 400), rng.randrange(1, 300), n % 4 + 1) for n in range(330)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for o, p, _ in lines:
        a, b = sorted((root(o), root(-1 - p)))
        up[b] = a
    assert {r.node: r.component for r in cluster_queries.graph_components(spark, str(tmp_path)).collect()} == {x: root(x) for x in list(up)}


def test_near_duplicates_without_dense_matrix(spark):
    rows = spark.createDataFrame([(1, "army moves to the border today"), (2, "army moves to the border today!"), (3, "rain falls in spring")], "doc_id int, headline string")
    pairs = D.similar_pairs(D.tfidf(rows))
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 2)]
    assert {r.doc_id: r.component for r in D.clusters(rows, pairs).collect()} == {1: 1, 2: 1, 3: 3}


def test_headlines_count_whole(spark):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(n))
    head, tail = words(30), words(90)  # heads of 239 characters
    heads = [f"{head} {words(90)}", f"{head} {words(90)}", f"{words(30)} {tail}", f"{words(4)} {tail}", words(3)]
    tf = []
    for h in heads:
        c = Counter()
        for w in h.split():
            w = f" {w} "
            c.update(w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1))
        tf.append(c)
    df = Counter(g for c in tf for g in c)
    raw = [{g: (1 + math.log(k)) * (math.log((1 + len(heads)) / (1 + df[g])) + 1) for g, k in c.items()} for c in tf]
    norm = [math.sqrt(sum(x * x for x in r.values())) for r in raw]
    cos = {(a, b): sum(w * raw[b].get(g, 0) for g, w in raw[a].items()) / norm[a] / norm[b] for a in range(5) for b in range(a + 1, 5)}
    rows = spark.createDataFrame(list(enumerate(heads)), "doc_id int, headline string")
    weights = D.tfidf(rows)
    assert {r.doc_id: r.n for r in weights.groupBy("doc_id").agg(F.count("gram").alias("n")).collect()} == {i: len(c) for i, c in enumerate(tf)}
    got = {(r.a, r.b): r.cosine for r in D.similar_pairs(weights, 0.5).collect()}
    assert got == {p: pytest.approx(c, abs=1e-8) for p, c in cos.items() if c >= 0.5} and (0, 1) not in got and (2, 3) in got


def test_word_grams(spark):
    got = spark.createDataFrame([("ab c",)], "t string").select(D.word_grams(F.col("t")).alias("g")).first().g
    assert sorted(got) == sorted([" ab", "ab ", " ab ", " c "])


def test_metrics(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "t string, p string")
    f = {r.label: r.f1 for r in M.per_class_f1(rows, "t", "p").collect()}
    assert f == {"a": 0.5, "b": pytest.approx(2 / 3), "c": 0.0}
    assert M.macro_f1(rows, "t", "p").first().macro_f1 == pytest.approx((0.5 + 2 / 3) / 3)
    empty = rows.where("t = 'none'")
    assert M.macro_f1(empty, "t", "p").first().macro_f1 is None


def test_threshold_sweep_numbers(spark):
    rows = spark.createDataFrame([(0.9, 1, 0), (0.8, 1, 0), (0.95, 1, 1), (0.6, 0, 0), (0.5, 0, 0), (0.65, 1, 0)], "conf double, ok int, high int")
    got = {r.threshold: r for r in M.threshold_sweep(rows, "conf", F.col("ok") == 1, F.col("high") == 1, [0.0, 0.7]).collect()}
    assert got[0.7].acc_confident == 1.0
    assert got[0.7].acc_uncertain == pytest.approx(1 / 3)
    assert got[0.7].errors_caught == 1.0
    assert got[0.0].escalated_share == pytest.approx(1 / 6)
    assert got[0.0].acc_uncertain is None


def test_wilson_without_trials(spark):
    low, high = M.wilson(F.col("k"), F.col("n"))
    r = spark.createDataFrame([(0, 0)], "k int, n int").select(low.alias("l"), high.alias("h")).first()
    assert (r.l, r.h) == (0.0, 1.0)


def test_bootstrap_query_takes_all_resamples(spark, monkeypatch):
    from lakepress.plans import metric_queries

    seen = {}
    monkeypatch.setattr(metric_queries.M, "paired_bootstrap", lambda *a, **k: seen.update(a=a[2:], k=k))
    metric_queries.bootstrap_ci(spark, "/root/testdata/sf0.001")
    assert seen == {"a": (), "k": {}}


@pytest.mark.parametrize("values", [lambda rng: rng.choice([0.0, 1.0, -1.0], 400, p=[0.5, 0.3, 0.2]), lambda rng: rng.normal(0.1, 2.0, 5000)])
def test_bootstrap_equals_numpy_within_sampling_error(spark, values):
    import numpy as np

    rng = np.random.default_rng(5)
    d = values(rng)
    got = M.paired_bootstrap(spark.createDataFrame([(float(x),) for x in d] + [(None,)], "d double").repartition(7), F.col("d")).first()
    means = np.array([rng.choice(d, len(d)).mean() for _ in range(4000)])
    assert got.resamples == 4000
    for c, w in (("median", np.median(means)), ("low", np.quantile(means, 0.025)), ("high", np.quantile(means, 0.975))):
        assert got[c] == pytest.approx(w, abs=0.15 * means.std()), c
    assert got.p_better == pytest.approx((means > 0).mean(), abs=0.03)


def test_bootstrap_repeats(spark):
    rows = spark.range(40).select("id", F.when(F.col("id") % 4 == 0, 0.0).otherwise(1.0).alias("d"))
    a, b = (M.paired_bootstrap(rows, F.col("d"), 200, 3).first() for _ in range(2))
    assert a == b and a.low <= 0.75 <= a.high and a.p_better == 1.0
    assert M.paired_bootstrap(rows.where("id < 0"), F.col("d")).first().resamples == 0


def test_group_folds(spark):
    rows = spark.range(60).select("id", F.floor(F.col("id") / 2).alias("grp"), F.when(F.col("id") % 7 == 0, "rare").otherwise("common").alias("y"))
    got = X.group_folds(rows, "grp", "y", 5, 1)
    assert got.count() == 60
    assert got.groupBy("grp").agg(F.countDistinct("fold").alias("k")).where("k > 1").count() == 0
    sizes = [r["count"] for r in got.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 6
    assert got.exceptAll(X.group_folds(rows, "grp", "y", 5, 1)).count() == 0


def test_review_budget(spark):
    rows = spark.range(30).withColumn("r", F.col("id") % 10 == 1)
    got = X.review_buckets(rows, "id", F.col("id") < 2, F.col("r"), 10)
    assert got.count() == 10
    with pytest.raises(ValueError, match="budget"):
        X.review_buckets(rows, "id", F.col("id") < 20, F.col("r"), 10)


def test_latest_review_takes_the_whole_row(spark):
    r = spark.createDataFrame([("a", 1, "x", "High"), ("a", 2, None, "Low")], "article_id string, review_id int, narrative string, severity string")
    assert V.latest_review(r).first().narrative is None


def test_null_domain_is_in_no_excluding_view(spark):
    m = spark.createDataFrame([(False, "High", True, None)], "dismissed boolean, eff_severity string, has_body boolean, source_domain string")
    got = m.select(V.view("alerts", ["x.org"]).alias("a"), V.category(["x.org"]).alias("c")).first()
    assert got.a is None and got.c == "alert"


def _items(spark, rows):
    return spark.createDataFrame(
        rows, "pos int, url string, url_hash string, headline string, headline_key string, text string, is_body boolean, source string, source_domain string, collected_at timestamp, blocked boolean, relevant boolean"
    )


def test_ingest_order_and_body_upgrade(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [
        (1, "u1", "h1", "A", "k1", "teaser", False, "pub", "d", t, False, True),
        (2, "u2", "h2", "A", "k1", "full", True, "gn", "d", t, False, True),
        (3, "u1", "h1", "A", "k1", "teaser", False, "pub", "d", t, False, True),
        (4, "u4", "h4", "B", None, None, False, "pub", "d", t, True, True),
        (5, "u4", "h4", "B", None, None, False, "pub", "d", t, False, False),
    ]
    none = spark.createDataFrame([], L.ARTICLE_SCHEMA)
    after, report = L.ingest(_items(spark, rows), none)
    got = {r.url: r for r in after.collect()}
    assert set(got) == {"u1", "u4"}
    assert (got["u1"].body, got["u1"].fetch_status, got["u1"].status) == ("full", "ok", "new")
    assert got["u4"].status == "irrelevant"
    rep = {r.source: r for r in report.collect()}
    assert (rep["pub"].new, rep["pub"].dup_url, rep["pub"].blocked) == (2, 1, 1)
    assert (rep["gn"].dup_headline, rep["gn"].upgraded) == (1, 1)
    again, rep2 = L.ingest(_items(spark, rows), after)
    assert again.count() == 2 and sum(r.new for r in rep2.collect()) == 0


def test_addresses_of_copies_are_kept(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    item = lambda pos, url, key: (pos, url, f"h{url}", "A", key, "full", True, "pub", "d", t, False, True)
    first, second = _items(spark, [item(1, "u1", "k1"), item(2, "u2", "k1")]), _items(spark, [item(3, "u2", "k2"), item(4, "u3", "k3")])
    after, _ = L.ingest(first, spark.createDataFrame([], L.ARTICLE_SCHEMA))
    got, report = L.ingest(second, after, first.select("url_hash"))
    assert sorted(r.url for r in got.collect()) == ["u1", "u3"] and report.first().dup_url == 1
    scorer = lambda df: df.select("article_id", F.lit("x").alias("label"), F.lit(0.5).alias("confidence"))
    for n, batch in enumerate((first, second)):
        cycle.run_cycle(cycle.open_store(spark, str(tmp_path)), batch, scorer, F.lit(t), n, strict=True)
    assert sorted(r.url for r in cycle.open_store(spark, str(tmp_path)).read("articles").collect()) == ["u1", "u3"]


def test_cycle_and_stream(spark, tmp_path):
    store = cycle.open_store(spark, str(tmp_path / "store"))
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    landing = tmp_path / "landing"
    items = _items(spark, [(i, f"u{i}", f"h{i}", "A", f"k{i}", "full", True, "pub", "d", t, False, True) for i in range(3)])
    items.write.parquet(str(landing))
    stream = spark.readStream.schema(items.schema).parquet(str(landing))
    scorer = lambda df: df.select("article_id", F.lit("x").alias("label"), F.lit(0.5).alias("confidence"))
    q = cycle.stream_cycles(stream, store, scorer, F.lit("2024-01-02").cast("timestamp"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert store.read("predictions").count() == 3
    assert [r.status for r in store.read("articles").collect()] == ["classified"] * 3 and store.read("waiting").count() == 0
    bad = cycle.run_cycle(store, items, lambda df: df.select("nothing"), F.lit("2024-01-02").cast("timestamp"), 9)
    assert {r.stage: r.ok for r in bad.collect()} == {"ingest": True, "expire": True, "classify": False}


def test_store_survives_restarts_and_other_writers(spark, tmp_path):
    import datetime as dt

    root = str(tmp_path / "store")
    at = lambda h: F.lit(dt.datetime(2024, 1, 1, h))
    runs = lambda n: spark.createDataFrame([(n, "s", True, None)], cycle.SCHEMAS["runs"])
    one = cycle.open_store(spark, root, keep=2)
    one.write("runs", runs(1))
    assert cycle.open_store(spark, root).read("runs").count() == 0  # not committed yet
    one.commit()
    two = cycle.open_store(spark, root, keep=2)
    assert two.read("runs").first().run_id == 1
    two.write("runs", runs(2))
    one.write("runs", runs(3))  # both from one state
    two.commit()
    with pytest.raises(Exception, match="exist"):
        one.commit()
    one.refresh()
    assert one.read("runs").first().run_id == 2
    # a writer that died while committing leaves a torn file, which is skipped and whose number stays taken
    (tmp_path / "store" / "commits" / f"{3:012d}").write_text('{"runs"')
    three = cycle.open_store(spark, root, keep=2)
    assert three.read("runs").first().run_id == 2
    for n in (4, 5, 6):
        three.write("runs", runs(n))
        three.commit()
    assert cycle.open_store(spark, root).read("runs").first().run_id == 6
    assert len(list((tmp_path / "store" / "runs").iterdir())) < 6  # superseded versions are gone
    assert one.lease("cycle", "a", at(1), at(5)) and not two.lease("cycle", "b", at(2), at(6)) and two.lease("cycle", "b", at(5), at(9))


def test_a_failed_ingest_fails_the_micro_batch(spark, tmp_path):
    import datetime as dt

    store = cycle.open_store(spark, str(tmp_path / "store"))
    items = _items(spark, [(1, "u", "h", "A", "k", "full", True, "pub", "d", dt.datetime(2024, 1, 1), False, True)])
    with pytest.raises(Exception, match="url_hash"):
        cycle.run_cycle(store, items.drop("url_hash"), lambda df: df.select("nothing"), F.lit("2024-01-02").cast("timestamp"), 1, strict=True)
    assert {r.stage: r.ok for r in cycle.open_store(spark, str(tmp_path / "store")).read("runs").collect()}["ingest"] is False


def test_explaining_stops_at_the_budget_and_when_the_model_is_down(spark, tmp_path):
    store = cycle.open_store(spark, str(tmp_path / "store"))
    waiting = spark.createDataFrame([(f"a{i}",) for i in range(9)], "article_id string").orderBy("article_id")
    good = lambda df: df.select("article_id", F.lit("ok").alias("status"))
    ticks = iter([0, 1, 5, 12, 20])
    assert cycle.explain_waiting(store, waiting, good, most=8, seconds=10, at_once=3, clock=lambda: next(ticks)) == (6, "time budget used")
    assert sorted(r.article_id for r in store.read("explanations").collect()) == [f"a{i}" for i in range(6)]

    def down(df):
        raise cycle.ModelDown("no answer")

    rest = waiting.join(store.read("explanations"), "article_id", "left_anti").orderBy("article_id")
    assert cycle.explain_waiting(store, rest, down) == (0, "model down: no answer")
    assert cycle.explain_waiting(store, rest, good) == (3, None) and cycle.open_store(spark, store.root).read("explanations").count() == 9


def test_version_stamps_and_blank_headlines(spark):
    assert config.version_stamp("org/Rules-Small", 42, {"a": 1, "b": [2]}) == config.version_stamp("rules-small", 42, {"b": [2], "a": 1})
    assert config.version_stamp("r", 1, {"a": 1}) != config.version_stamp("r", 1, {"a": 2})
    from lakepress.functions import text as T

    rows = spark.createDataFrame([("x", "  ", None)], "id string, headline string, body string")
    with pytest.raises(Exception, match="headline"):
        rows.select(T.api_article(F.col("id"), F.col("headline"), F.col("body"))).collect()


def test_numbers_in_order_over_hot_and_missing_groups(spark):
    from lakepress.operators import dedupe as D

    rows = [("hot" if i % 5 else None if i % 2 else "few", i * 10**12) for i in range(300)]
    got = D.number_in_order(spark.createDataFrame(rows, "g string, x bigint").repartition(3), ["x"], "n", ["g"]).collect()
    want = {}
    for g, x in sorted(rows, key=lambda r: r[1]):
        want.setdefault(g, []).append(x)
    assert {(r.g, r.x): r.n for r in got} == {(g, x): i for g, xs in want.items() for i, x in enumerate(xs)}


def test_near_clusters_equal_brute_force(spark):
    import math
    from collections import Counter

    from lakepress.operators import dedupe as D

    rng = __import__("random").Random(5)
    words = ["storm", "harbour", "council", "minister", "border", "river", "market", "signal", "winter"]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) + str(rng.randrange(40)) for _ in range(9)]
        texts.append(" ".join(base))
        texts += [texts[-1]] * rng.randrange(3)
        if rng.random() < 0.6:
            base[rng.randrange(9)] += "s"
            texts.append(" ".join(base) + " tail" * 60 * rng.randrange(2))
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "")]
    grams = {}
    for i, t in rows:
        c = Counter()
        for w in (t or "").lower().split():
            w = f" {w} "
            for k, n in enumerate((3, 4, 5)):
                if k == 0 or len(w) > (3, 4, 5)[k - 1]:
                    c.update(w[j : j + n] for j in range(max(1, len(w) - n + 1)))
        grams[i] = c
    df = Counter(g for c in grams.values() for g in c)
    vec = {}
    for i, c in grams.items():
        v = {g: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[g])) + 1) for g, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        vec[i] = {g: x / norm for g, x in v.items()}
    pairs = {(a, b) for a in vec for b in vec if a < b and round(sum(x * vec[b].get(g, 0) for g, x in vec[a].items()), 9) >= D.SIMILAR}
    df_rows = spark.createDataFrame(rows, "doc_id bigint, headline string")
    assert {(r.a, r.b) for r in D.near_pairs(df_rows).collect()} == pairs
    root = {i: i for i in vec}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in sorted(pairs):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert {r.doc_id: r.component for r in D.near_clusters(df_rows).collect()} == {i: find(i) for i in root}


@pytest.mark.parametrize("local", [500_000, 3])
def test_order_part_graph_equals_union_find(spark, tmp_path, monkeypatch, local):
    from lakepress.operators import graph
    from lakepress.plans import cluster_queries as C

    monkeypatch.setattr(graph, "LOCAL_EDGES", local)

    rng = __import__("random").Random(3)
    lines = [(rng.randrange(1, 60), rng.randrange(1, 90)) for _ in range(90)] + [(1, 1)] * 40
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for o, p in lines:
        x, y = sorted((find(o), find(-1 - p)))
        root[y] = x
    assert {r.node: r.component for r in C.graph_components(spark, str(tmp_path)).collect()} == {i: find(i) for i in root}


@pytest.mark.parametrize("local", [500_000, 3])
def test_components_of_loops_and_nulls(spark, monkeypatch, local):
    from lakepress.operators import graph

    monkeypatch.setattr(graph, "LOCAL_EDGES", local)
    edges = [("b", "a"), ("c", "b"), ("d", "d"), ("e", "f"), ("f", "f"), (None, "a"), ("g", None), ("z", "y"), ("y", "x"), ("x", "w"), ("b", "a")]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a string, b string").repartition(3)).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "e", "w": "w", "x": "w", "y": "w", "z": "w"}
    assert graph.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from lakepress.plans import workdir

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            workdir.shared_dir(N(conf=N(get=lambda *a: None), sparkContext=N(master=master)))


def test_lease(spark):
    import datetime as dt

    at = lambda h: F.lit(dt.datetime(2024, 1, 1, h))
    held = spark.createDataFrame([("cycle", "a", dt.datetime(2024, 1, 1, 5))], "name string, owner string, until timestamp")
    assert L.take_lease(held, "cycle", "b", at(4), at(9)).first().owner == "a"
    assert L.take_lease(held, "cycle", "b", at(5), at(9)).first().owner == "b"
    assert L.take_lease(held, "cycle", "a", at(4), at(9)).first().until.hour == 9


def test_sources(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown labels"):
        tables.encode_labels(spark.createDataFrame([("q",)], "y string"), "y", ["a"], "n")
    xml = "<rss><item><title>T1</title><link>https://www.x.org/a</link></item><item><title>no link</title></item><item><title>T2</title><link>https://x.org/b</link></item></rss>"
    got = feeds.parse_feeds(spark.createDataFrame([("s", xml), ("bad", "no feed")], "source string, xml string"), most=5).collect()
    assert [(r.headline, r.source_domain) for r in sorted(got, key=lambda r: r.pos)] == [("T1", "x.org"), ("T2", "x.org")]
    assert tables.source_list(spark, [{"name": "g", "url": "u", "queries": ["a b", "c"]}]).count() == 2
    with pytest.raises(ValueError, match="unique"):
        tables.source_list(spark, [{"name": "g", "url": "u"}, {"name": "g", "url": "v"}])


def test_config():
    base = {"a": {"b": 1, "c": True}}
    assert config.override(base, {"a.b": "5"}) == {"a": {"b": 5, "c": True}}
    assert config.override(base, {"a.c": "false"})["a"]["c"] is False
    with pytest.raises(KeyError):
        config.override(base, {"a.z": "1"})


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_a_gram_in_every_headline_is_dealt_out(spark, monkeypatch):
    import itertools
    import random

    from lakepress.operators import dedupe as D

    monkeypatch.setattr(D, "POSTINGS", 16)
    rng = random.Random(3)
    # few grams that all share, so that a common one lies in every prefix
    words = ["storm", "surge", "coast", "flood"]
    rows = [(i, " ".join(["alert", *rng.choices(words, k=rng.randrange(1, 4))])) for i in range(150)] + [(200, "alert"), (201, "ALERT"), (202, ""), (203, None)]
    df = spark.createDataFrame(rows, "doc_id int, headline string")
    vec = {}
    for r in D.tfidf(df).collect():
        vec.setdefault(r.doc_id, {})[r.gram] = r.weight
    want = {(a, b) for a, b in itertools.combinations(sorted(vec), 2) if round(sum(w * vec[b].get(g, 0.0) for g, w in vec[a].items()), 9) >= 0.85}
    got = [(r.a, r.b) for r in D.near_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_grams_counted_in_python_are_those_of_the_columns(spark):
    import random
    from collections import Counter

    from lakepress.operators import dedupe as D

    rng = random.Random(8)
    texts = ["".join(rng.choices("aB é\u0130\u03a3\x85\x1c\u2003\n日🎉", k=rng.randrange(25))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "rep int, text string").withColumn("copies", F.lit(1).cast("bigint"))
    want = {r.rep: Counter(r.g) for r in df.select("rep", D.word_grams(F.col("text")).alias("g")).collect()}
    assert {r.rep: Counter(dict(zip(r.grams, r.tf, strict=True))) for r in D._counted(df).collect()} == want


def test_a_constant_flag_makes_no_control(spark):
    from lakepress.operators import baselines as B

    rows = spark.createDataFrame([(i, i % 2, True, "ab"[i % 3 == 0]) for i in range(20)], "id int, fold int, has_body boolean, y string")
    assert B.cross_predict(rows, "id", "fold", "y", B.has_body_model).count() == 0
    mixed = rows.withColumn("has_body", F.col("id") < 10)
    assert B.cross_predict(mixed, "id", "fold", "y", B.has_body_model).count() == 20


def test_a_run_is_never_without_a_result(spark, tmp_path):
    from lakepress.sources import tables as X

    path = str(tmp_path / "runs")
    X.write_run(spark.range(3), path, 1, 0)
    # a writer died after the old result stepped aside
    (tmp_path / "runs" / "seed=1" / "fold=0").rename(tmp_path / "runs" / "_old-seed=1-fold=0")
    X.mend_run(spark, path, 1, 0)
    assert spark.read.parquet(path).count() == 3
    X.write_run(spark.range(5), path, 1, 0)
    assert spark.read.parquet(path).count() == 5 and not list((tmp_path / "runs").glob("_old*"))


def test_the_last_line_is_the_last_in_the_files(spark, tmp_path):
    import json

    from lakepress.sources import tables as X

    at = tmp_path / "lines"
    at.mkdir()
    line = lambda i, n, **more: json.dumps({"id": i, "model": "m", "prompt": "p", "n": n, **more})
    (at / "a.jsonl").write_text("\n".join([*[line(i % 50, i) for i in range(20_000)], line(3, -1)]) + "\n")
    (at / "b.jsonl").write_text("\n".join([line(7, -2), line(7, -3), line(7, -4, model="old"), line(7, -5, prompt="q"), '{"id": 7, "mod']))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")  # many splits
    try:
        got = {r.id: r.n for r in X.last_lines(spark, str(at), "id int, model string, prompt string, n int", "id", "m", "p").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {**{i: 19_950 + i for i in range(50)}, 3: -1, 7: -3}


def test_folds_of_very_different_groups_are_even_and_planned_from_few_rows(spark, monkeypatch):
    import random
    from collections import Counter, defaultdict

    rng = random.Random(12)
    rows = []
    for g in range(1500):  # hardly two groups alike
        n = int(rng.paretovariate(1.1)) + 1
        share = rng.random()
        rows += [(g, "rare" if rng.random() < 0.02 else "x" if rng.random() < share else "y") for _ in range(min(n, 400))]
    rows += [(None, "y")] * 30
    df = spark.createDataFrame(rows, "grp int, y string")
    seen, make = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: (seen.append(len(data)), make(self, data, *a, **k))[1])
    got = X.group_folds(df, "grp", "y", 5, 3).collect()
    assert len(got) == len(rows) and max(seen) < 250  # of 1,501 groups
    of, by = defaultdict(set), defaultdict(Counter)
    for r in got:
        of[r.grp].add(r.fold)
        by[r.y][r.fold] += 1
    assert all(len(f) == 1 for f in of.values())
    for y, c in by.items():
        n, largest = sum(c.values()), max(Counter(r[0] for r in rows if r[1] == y).values())
        assert max(c.values()) - min(c.values()) <= max(0.1 * n / 5, 1.5 * largest), (y, c)


def test_tables_of_grams_are_not_broadcast(spark):
    texts = spark.createDataFrame([(i, f"storm over the bay number {i}", 1) for i in range(9)], "rep bigint, text string, copies bigint")
    plan = D._raw(texts, 9)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan
