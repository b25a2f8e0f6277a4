"""Text, URL and keyword columns on small rows."""

import pytest
from pyspark.sql import functions as F

from lakepress.functions import keywords as K
from lakepress.functions import text as T
from lakepress.functions import urls as U
from lakepress.plans import text_queries


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("IAF Chief visits France! - News18", "iaf chief visits france"),
        ("Joint drill\tbegins | Some Outlet", "joint drill begins"),
        ("Café  déjà vu", "caf dj vu"),
        ("", ""),
    ],
)
def test_normal_headline(spark, raw, want):
    assert one(spark, T.normal_headline(F.col("h")), h=raw) == want


def test_headline_key_needs_four_words(spark):
    assert one(spark, T.headline_key(F.col("h")), h="Top news today") is None
    assert one(spark, T.headline_key(F.col("h")), h="One two three four") == "one two three four"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTPS://WWW.Example.com/a/b/?utm_source=x&id=7#top", "https://www.example.com/a/b?id=7"),
        ("http://example.com/", "http://example.com"),
        ("https://example.com:8080/x?q=a+b&fbclid=1", "https://example.com:8080/x?q=a+b"),
        ("https://example.com/x?blank=", "https://example.com/x?blank="),
    ],
)
def test_canonical_url(spark, raw, want):
    assert one(spark, U.canonical_url(F.col("u")), u=raw) == want


def test_blocked_domains(spark):
    rows = spark.createDataFrame([("a.example.net",), ("example.net",), ("myexample.net",), (None,)], "d string")
    assert [r.x for r in rows.select(U.is_blocked(F.col("d"), ["www.Example.net"]).alias("x")).collect()] == [True, True, False, False]


def test_terms_respect_unicode_words(spark):
    text = "éaid aid, AID attack terrorist attack"
    assert one(spark, K.count(F.col("t"), ["aid"]), t=text) == 2
    # overlapping terms count each on their own
    assert one(spark, K.count(F.col("t"), ["attack", "terrorist attack"]), t=text) == 3


def test_top_group_ties_go_to_the_first(spark):
    groups = {"x": ["one"], "y": ["two"]}
    assert one(spark, K.top_group(F.col("t"), groups), t="two one") == "x"
    assert one(spark, K.top_group(F.col("t"), groups), t="two two one") == "y"
    assert one(spark, K.top_group(F.col("t"), groups), t="none") is None


def test_gate(spark):
    passes, terms = K.relevant(F.col("h"), F.col("t"), ["army", "fighter jets", "fighter"], ["UN"])
    rows = spark.createDataFrame([("Army moves", "x"), ("Quiet", "fighter jets and the UN"), ("Quiet", "the fighter"), ("un", None)], "h string, t string")
    got = rows.select(passes.alias("p"), terms.alias("t")).collect()
    assert [r.p for r in got] == [True, True, False, False]
    assert got[1].t == ["fighter jets", "UN"]


def test_html_text(spark):
    html = "<html><head><title>A &amp; B</title><style>p{}</style></head><body><script>x</script><p>One &lt;two&gt;</p>\n<p> </p><p>Three</p></body></html>"
    assert one(spark, T.html_text(F.col("h")), h=html) == "A & B\nOne <two>\nThree"
    assert one(spark, T.page_title(F.col("h")), h=html) == "A &amp; B"


def test_evidence_and_clip(spark):
    assert one(spark, T.evidence_found(F.col("q"), F.col("t")), q="“Troops   moved” ", t='He said "troops moved" today')
    assert not one(spark, T.evidence_found(F.col("q"), F.col("t")), q="a", t="a b")
    assert one(spark, T.clip(F.col("t"), 10), t="alpha beta gamma") == "alpha ..."


def test_feed_dates(spark):
    assert one(spark, T.feed_date(F.col("d")), d="Mon, 15 Jan 2024 10:00:00 +0100") == "2024-01-15T09:00:00Z"
    assert one(spark, T.feed_date(F.col("d")), d="yesterday") is None


def test_has_body_is_blank_safe(spark):
    rows = spark.createDataFrame([("  \n",), (None,), ("x",)], "b string")
    assert [r.x for r in rows.select(T.has_body(F.col("b")).alias("x")).collect()] == [False, False, True]


def test_terms_in_one_pass_equal_one_pattern_a_term(spark):
    import random
    import time

    from lakepress.functions import keywords as K

    rng = random.Random(4)
    terms = ["storm", "storm surge", "surge", "STORM", "c++", "e-mail", "a a", "é", "straße", "sst", "k", "_x", "日本", "x.y", "(a)", "ﬁ", "i̇", "ω"]
    glue = [" ", "  ", "-", "_", ".", "", "\n", "́", "‍", "Ⓐ", "٣", "é", "(", ")"]
    texts = [None, "", "a a a a", "Storm SURGE storm_surge storm‍", "STRASSE straße STRAẞE", "K k ſst SST", "İ i̇ I", "Ω ω"] + ["".join(rng.choice([*terms, *map(str.upper, terms)]) + rng.choice(glue) for _ in range(rng.randrange(30))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    single = [F.coalesce(F.regexp_count("text", F.lit(K.pattern(t))), F.lit(0)).alias(f"t{i}") for i, t in enumerate(terms)]
    want = {r.id: {terms[i]: r[f"t{i}"] for i in range(len(terms)) if r[f"t{i}"]} for r in df.select("id", *single).collect()}
    got = {r.id: {x["term"]: x["n"] for x in r.x} for r in df.select("id", K.term_counts(F.col("text"), {"g": terms}).alias("x")).collect()}
    assert got == want
    groups = {"one": terms[:5], "none": [], "two": terms[5:]}
    for r in df.select("id", *K.counts(F.col("text"), groups), K.top_group(F.col("text"), groups).alias("top"), K.hits(F.col("text"), terms).alias("hits")).collect():
        sums = {g: sum(want[r.id].get(t, 0) for t in ts) for g, ts in groups.items()}
        assert (r.n_one, r.n_none, r.n_two) == tuple(sums.values()) and r.hits == [t for t in terms if t in want[r.id]]
        assert r.top == (max(sums, key=sums.get) if any(sums.values()) else None)
    # a hundred times the terms, about the same time
    words = [f"w{i}" for i in range(1000)]
    long = spark.range(400).select(F.repeat(F.concat(F.lit("some words of text and w"), F.col("id").cast("string"), F.lit(" ")), 400).alias("text")).cache()
    took = []
    for n in (10, 1000, 10, 1000):
        began = time.time()
        assert long.select(K.count(F.col("text"), words[:n]).alias("n")).agg(F.sum("n")).first()[0] == 400 * min(n, 400)
        took.append(time.time() - began)
    assert took[3] < 3 * took[2] + 1


PROSE = "The river rose again on Monday and the town moved its market to higher ground, as it has done for years. "


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, None),
        ("", ""),
        ("plain words, no tags at all but quite a lot of them", "plain words, no tags at all but quite a lot of them"),
        (f"<nav><a href=x>Home</a></nav><div class='ad banner'>{PROSE}</div><div><h1>Flood</h1><p>{PROSE * 2}<p>Short one.<p>{PROSE}</div><ul><li><a href=y>{PROSE}</a><li><a>More</a></ul><footer>{PROSE}</footer>", f"Flood\n{PROSE * 2}\nShort one.\n{PROSE}"),
        (f"<article><a href=1>teaser one</a></article><article><p>{PROSE}</p><p>{PROSE}</p></article><p>{PROSE * 9}</p>", f"{PROSE}\n{PROSE}"),
        (f"<body><script>var a = '<p>{PROSE}</p>'</script><p>A &amp; B: {PROSE}</p><br/><div id=sidebar><p>{PROSE * 3}</p></div></div></p>", f"A & B: {PROSE}"),
        ("<nav>menu</nav><p><a href=x>only links here</a>", ""),
        (f"<div><h2>Tiny</h2><p>{PROSE}</p><p>The end.</p><p><a href=z>next</a></p></div><div>Elsewhere.</div>", f"Tiny\n{PROSE}\nThe end."),
        ("<nav>menu</nav><div><p>One.<p>Two.</div>", "One.\nTwo."),
    ],
)
def test_article_of_a_page(html, want):
    from lakepress.functions.pages import main_text

    got = main_text(html)
    assert got == (want if want is None else "\n".join(" ".join(x.split()) for x in want.split("\n")))


def test_article_words_of_cut_references(spark, tmp_path):
    page = "<html><body><nav><a href='/a'>a</a></nav><article><h1>{}</h1><p><b>{}<br></article><footer>x</footer></body></html>"
    heads = [("one two&amp;&amp;&amp", "one two&amp;&amp;&amp;&amp;"), ("one two &lt", "one two &lt; three"), ("a &quot", "a &quot;b&quot;"), ("it&#x27s &#39", "it&#x27;s"), ("a &am", "a &amp; c d e f g h i")]
    rows = [(i, page.format(*h)) for i, h in enumerate(heads)]
    spark.createDataFrame(rows, "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = text_queries.article_words(spark, str(tmp_path)).collect()
    assert len(got) == 5 and all(r.precise and r.complete and r.marked_alike for r in got)


def test_keyword_texts_go_to_python_by_bytes(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.createDataFrame([(1, "that thing")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get(name)
    spark.conf.unset(name)
    try:
        assert text_queries.keyword_features(spark, str(tmp_path)).count() == 1 and spark.conf.get(name) == str(8 << 20)
    finally:
        spark.conf.set(name, before)
