"""The live store: deltas, merging, atomic commits, versions, leases."""

import datetime as dt
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lakepress.streaming import cycle
from lakepress.streaming.store import Conflict, Store

AT = lambda h: F.lit(dt.datetime(2024, 1, 1, h))
ITEMS = "pos int, url string, url_hash string, headline string, headline_key string, text string, is_body boolean, source string, source_domain string, collected_at timestamp, blocked boolean, relevant boolean"


def scorer(df):
    return df.select("article_id", F.lit("x").alias("label"), F.lit(0.5).alias("confidence"))


def batch(spark, first, n):
    rows = [(i, f"u{i}", f"h{i}", "A", f"k{i}", "", True, "pub", "d", dt.datetime(2024, 1, 1), False, True) for i in range(first, first + n)]
    # texts that hardly compress
    return spark.createDataFrame(rows, ITEMS).withColumn("text", F.concat(*[F.sha2(F.concat("url", F.lit(str(k))).cast("binary"), 512) for k in range(20)]))


def written(root):
    return {p: p.stat().st_size for p in Path(root).rglob("*.parquet")}


def test_newest_row_of_a_key_counts_and_gone_ones_go(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), {"t": "id string, n int"}, keys={"t": "id"}, buckets=4)
    rows = lambda ids, n: spark.createDataFrame([(i, n) for i in ids], "id string, n int")
    model = {}
    for step, (ids, gone) in enumerate([("abcdefgh", ""), ("bx", "a"), ("a", "hx"), ("cy", ""), ("", "bcy"), ("z", "")]):
        if ids:
            s.add("t", rows(ids, step))
            model.update(dict.fromkeys(ids, step))
        if gone:
            s.remove("t", rows(gone, 0))
            for g in gone:
                model.pop(g)
        assert {r.id: r.n for r in s.read("t").collect()} == model  # before the commit as well
        s.commit()
        again = Store(spark, s.root, s.schemas, keys=s.keys)
        assert again.buckets == 4 and {r.id: r.n for r in again.read("t").collect()} == model
        some = rows("aqz", 0)
        assert {r.id: r.n for r in again.lookup("t", some).collect()} == {k: v for k, v in model.items() if k in "aqz"}
    s.write("t", rows("m", 9))
    s.commit()
    assert [tuple(r) for r in s.read("t").collect()] == [("m", 9)] and len(s.runs("t")) == 1


def test_a_cycle_writes_and_reads_what_its_batch_needs(spark, tmp_path):
    root = str(tmp_path / "s")
    store = cycle.open_store(spark, root, buckets=16)
    cycle.run_cycle(store, batch(spark, 0, 4000), scorer, AT(5), 0)
    before = written(root)
    assert sum(before.values()) > 10_000_000
    fresh = []
    for n in range(1, 4):
        cycle.run_cycle(store, batch(spark, 4000 + 3 * n, 3), scorer, AT(5), n)
        now = written(root)
        fresh.append(sum(size for p, size in now.items() if p not in before))
        before = now
    # three articles a cycle, whatever is stored; small files have some 5 kB of their own
    assert max(fresh) < 600_000
    assert store.read("articles").count() == 4009 and store.read("articles").where("status <> 'classified'").count() == 0
    # looking one address up opens its bucket in each run and no other
    ids = spark.createDataFrame([("a_h7",)], "article_id string")
    assert [r.url for r in store.lookup("articles", ids, ["url"]).collect()] == ["u7"]
    opened = store.lookup("articles", ids, ["url"]).inputFiles()
    assert len(opened) <= len(store.runs("articles")) < 8 and len(before) > 100
    bucket = spark.range(1).select(store.bucket(F.lit("a_h7"))).first()[0]
    assert all(f"__bucket={bucket}/" in f for f in opened)


def test_runs_stay_few(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), {"t": "id int", "log": "n int"}, keys={"t": "id"}, buckets=2)
    for n in range(12):
        s.add("t", spark.createDataFrame([(n,), (n + 1,)], "id int"))
        s.add("log", spark.createDataFrame([(n,)], "n int"))
        s.commit()
        assert len(s.runs("t")) <= 4 and len(s.runs("log")) <= 4
    assert s.read("t").count() == 13 and s.read("log").count() == 12


def test_a_reader_between_claim_and_rename_loses_nothing(spark, tmp_path):
    root = str(tmp_path / "s")
    make = lambda **k: Store(spark, root, {"t": "n int"}, **k)
    one = make()
    one.write("t", spark.range(3).select(F.col("id").cast("int").alias("n")))
    two, seen = make(), []
    fill = one._fill

    def halfway(fs, path, content):
        fill(fs, path, content)
        one._path("x")[0].create(one._path(f"commits/{1:012d}.claim")[1], False).close()  # as if another were committing now
        two.refresh()
        seen.append((two.number, two.read("t").count()))

    one._fill = halfway
    with pytest.raises(Conflict):
        one.commit()
    assert seen == [(0, 0)]
    # the claim's writer is taken for dead after some time, and its number can be had
    two.write("t", spark.range(5).select(F.col("id").cast("int").alias("n")))
    with pytest.raises(Conflict):
        two.commit()
    late = make(patience=0.0)
    late.write("t", spark.range(7).select(F.col("id").cast("int").alias("n")))
    late.commit()
    assert make().read("t").count() == 7 and make().number == 1


def test_of_many_writers_each_commit_is_seen(spark, tmp_path):
    root, done = str(tmp_path / "s"), []

    def work(k):
        s = Store(spark, root, {"t": "n int"})
        while True:
            s.refresh()
            s.add("t", spark.createDataFrame([(k,)], "n int"))
            try:
                s.commit()
                return done.append(k)
            except Conflict:
                continue

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert sorted(done) == [0, 1, 2, 3] and sorted(r.n for r in Store(spark, root, {"t": "n int"}).read("t").collect()) == [0, 1, 2, 3]


def test_versions(spark, tmp_path):
    root = str(tmp_path / "s")
    first = {**cycle.SCHEMAS, "reviews": "review_id bigint, article_id string, label string", "articles": cycle.SCHEMAS["articles"].replace(", resolved_hash string", "").replace("fetch_error string, ", "")}
    old = Store(spark, root, first, keys=cycle.KEYS, version=1)
    old.add("reviews", spark.createDataFrame([(1, "a", "High")], first["reviews"]))
    old.add("articles", spark.createDataFrame([("a", "u", "h", "H", "k", None, None, "ok", 0, "s", "d", None, True, "new")], first["articles"]))
    old.commit()
    new = cycle.open_store(spark, root)
    assert new.stored_version == 3 and [tuple(r) for r in new.read("reviews").collect()] == [(1, "a", "High", False)]
    row = new.read("articles").first()
    assert (row.url, row.resolved_hash, row.fetch_error) == ("u", None, None)
    with pytest.raises(ValueError, match="version 3"):
        Store(spark, root, first, keys=cycle.KEYS, version=2)
    assert cycle.open_store(spark, root).number == new.number  # nothing left to bring up


def test_one_cycle_at_a_time(spark, tmp_path):
    store = cycle.open_store(spark, str(tmp_path / "s"))
    other = cycle.open_store(spark, store.root)
    assert other.lease("cycle", "b", AT(1), AT(3))
    (row,) = cycle.run_cycle(store, batch(spark, 0, 2), scorer, AT(2), 1, owner="a").collect()
    assert (row.stage, row.ok) == ("cycle", False) and store.read("articles").count() == 0 and store.read("runs").count() == 0
    other.release("cycle", "b")
    assert cycle.run_cycle(store, batch(spark, 0, 2), scorer, AT(2), 1, owner="a").where("ok").count() == 3
    assert store.read("leases").count() == 0 and store.read("articles").count() == 2


def test_a_full_disk_is_no_lost_lease(spark, tmp_path, monkeypatch):
    store = cycle.open_store(spark, str(tmp_path / "s"))
    monkeypatch.setattr(store, "_fill", lambda *a: (_ for _ in ()).throw(OSError("no space")))
    with pytest.raises(OSError, match="no space"):
        store.lease("cycle", "a", AT(1), AT(2))
