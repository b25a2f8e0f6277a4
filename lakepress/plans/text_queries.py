"""Queries over text, URL and keyword columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakepress.functions import keywords as K
from lakepress.functions import pages as PG
from lakepress.functions import text as T
from lakepress.functions import urls as U
from lakepress.plans.registry import ART, NORM, Registry
from lakepress.sources import mapped as S

R = Registry()
_N = NORM.format("headline")


@R.add(f"WITH {ART} SELECT doc_id, regexp_replace(headline, '\\s+[-|]\\s+[^-|]{{2,45}}$', '') AS stripped, {_N} AS norm, CASE WHEN length({_N}) - length(replace({_N}, ' ', '')) >= 3 THEN {_N} END AS headline_key, has_body FROM art")
def headline_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stripped and normalised headlines, dedupe keys."""
    a = S.articles(spark, sf_dir)
    return a.select("doc_id", T.strip_source(F.col("headline")).alias("stripped"), T.normal_headline(F.col("headline")).alias("norm"), T.headline_key(F.col("headline")).alias("headline_key"), "has_body")


@R.add(f"WITH {ART} SELECT doc_id, md5(CASE WHEN has_body THEN headline || ' [SEP] ' || body ELSE '[NO_BODY] ' || headline END) AS text_md5, 'rt_' || substr(sha1(headline || chr(10) || coalesce(body, '')), 1, 10) AS generated_id, CASE WHEN length(headline) <= 60 THEN headline ELSE regexp_replace(substr(headline, 1, 60), ' [^ ]*$', '') || ' ...' END AS clipped, coalesce(length(body) >= 1000, false) AS full_text FROM art")
def model_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model input text, generated id, clip, teaser or body."""
    h, b = F.col("headline"), F.col("body")
    return S.articles(spark, sf_dir).select("doc_id", F.md5(T.model_text(h, b).cast("binary")).alias("text_md5"), T.generated_id(h, b).alias("generated_id"), T.clip(h, 60).alias("clipped"), T.is_full_text(b).alias("full_text"))


@R.add(r"SELECT doc_id, regexp_replace(regexp_replace(lower(source || ' / ' || lang || '!'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, 'https://news.example.com/search?q=' || source || '+when%3A7d' AS search_url FROM documents")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs and search URLs."""
    d = S.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.slug(F.concat_ws("", "source", F.lit(" / "), "lang", F.lit("!"))).alias("slug"), U.search_url("https://news.example.com/search", F.col("source"), "7d").alias("search_url"))


_CANON = r"""
WITH parts AS (
  SELECT page_id, url, lower(regexp_extract(url, '^([^:]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS auth,
         regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
         list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_')
           AND NOT list_contains(['fbclid','gclid','ref','ref_src','cmpid','ito','from','source','pfrom','s_cid','icid','mc_cid','mc_eid','ocid'], lower(split_part(x, '=', 1)))) AS q
  FROM pages),
canon AS (SELECT page_id, url, scheme || '://' || auth || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical, regexp_replace(auth, '^www\.', '') AS domain FROM parts)
"""


@R.add(_CANON + "SELECT page_id, canonical, substr(sha1(canonical), 1, 16) AS url_hash, 'a_' || substr(sha1(canonical), 1, 16) AS article_id, domain FROM canon")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical URL, hash, article id, domain."""
    u = F.col("url")
    return S.table(spark, sf_dir, "pages").select("page_id", U.canonical_url(u).alias("canonical"), U.url_hash(u).alias("url_hash"), U.article_id(u).alias("article_id"), U.domain(u).alias("domain"))


@R.add(_CANON + "SELECT domain, count(*) AS n_pages, count(DISTINCT canonical) AS n_urls, CAST(sum(CASE WHEN domain = 'example.net' OR ends_with(domain, '.example.net') OR domain = 'src5.example.org' OR ends_with(domain, '.src5.example.org') THEN 1 ELSE 0 END) AS BIGINT) AS n_blocked FROM canon GROUP BY domain")
def url_domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by domain and how many of them are blocked."""
    p = S.table(spark, sf_dir, "pages").select(U.domain(F.col("url")).alias("domain"), U.canonical_url(F.col("url")).alias("canonical"))
    return p.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_pages"), F.countDistinct("canonical").alias("n_urls"), F.sum(U.is_blocked(F.col("domain"), S.BLOCKED).cast("long")).alias("n_blocked")
    )


@R.add(r"SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first title element."""
    return S.table(spark, sf_dir, "pages").select("page_id", T.page_title(F.col("html")).alias("title"))


_STOP = "[" + ",".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def _words_sql(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) > 3 AND NOT list_contains({_STOP}, w)))"


@R.add(
    f"WITH {ART}, w AS (SELECT a.doc_id, {_words_sql(chr(39) + chr(39) + ' || a.headline')} AS wanted, {_words_sql('a.headline')} AS h, {_words_sql('p.text')} AS present FROM (SELECT doc_id, regexp_replace(headline, '\\s+[-|]\\s+[^-|]{{2,45}}$', '') AS headline FROM art) a JOIN (SELECT doc_id, substr(text, 1, 4000) AS text FROM documents) p ON p.doc_id = a.doc_id + 1) "
    "SELECT doc_id, CAST(len(wanted) AS INT) AS n_wanted, CASE WHEN len(wanted) < 3 THEN true ELSE len(list_intersect(wanted, present)) >= 0.4 * len(wanted) END AS matches FROM w"
)
def headline_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the next document read like the page of this headline?"""
    a = S.articles(spark, sf_dir).select("doc_id", "headline")
    p = S.table(spark, sf_dir, "documents").select((F.col("doc_id") - 1).alias("doc_id"), "text")
    h = F.col("headline")
    return a.join(p, "doc_id").select("doc_id", F.size(T.content_words(T.strip_source(h))).alias("n_wanted"), T.headline_matches(h, F.lit(""), F.col("text")).alias("matches"))


@R.add()
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of a page and of its article."""
    p = S.table(spark, sf_dir, "pages")
    return p.select("page_id", F.md5(T.html_text(F.col("html")).cast("binary")).alias("text_md5"), F.length(T.html_text(T.article_html(F.col("html")))).alias("article_chars"))


@R.add("SELECT page_id, true AS precise, true AS complete, true AS marked_alike FROM pages")
def article_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article found in pages whose article element is renamed, against the words of that element."""
    p = S.table(spark, sf_dir, "pages")
    renamed = F.regexp_replace("html", r"(?i)<(/?)article\b", "<$1div")
    words = lambda c: F.split(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), " ")
    x = p.select("page_id", words(T.html_text(T.whole_references(T.article_html(F.col("html"))))).alias("gold"), PG.article_text(renamed).alias("found"), PG.article_text(F.col("html")).alias("marked"))
    got = x.select("page_id", "gold", words(F.col("found")).alias("got"), words(F.col("marked")).alias("own"))
    common = lambda a, b: F.size(F.array_intersect(a, b))
    n = common("gold", "got")
    share = 0.9
    return got.select("page_id", (n >= share * F.size(F.array_distinct("got"))).alias("precise"), (n >= share * F.size(F.array_distinct("gold"))).alias("complete"), (common("gold", "own") >= share * F.size(F.array_distinct("gold"))).alias("marked_alike"))


@R.add(
    r"WITH q AS (SELECT doc_id, text, replace(substr(text, 20, 30), ' ', '  ') || CASE WHEN doc_id % 2 = 0 THEN 'zqzq' ELSE '' END AS quote FROM documents), n AS (SELECT doc_id, trim(regexp_replace(lower(regexp_replace(text, '[\"''“”‘’]', '', 'g')), '\s+', ' ', 'g')) AS t, trim(regexp_replace(lower(regexp_replace(quote, '[\"''“”‘’]', '', 'g')), '\s+', ' ', 'g')) AS q FROM q)"
    " SELECT doc_id, length(q) >= 3 AND contains(t, q) AS found FROM n"
)
def evidence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that occur in their text but for blanks."""
    d = S.table(spark, sf_dir, "documents")
    quote = F.concat(F.replace(F.substring("text", 20, 30), F.lit(" "), F.lit("  ")), F.when(F.col("doc_id") % 2 == 0, "zqzq").otherwise(""))
    return d.select("doc_id", T.evidence_found(quote, F.col("text")).alias("found"))


@R.add(
    r"WITH g AS (SELECT doc_id, list_filter([substr(text, 1, 30), substr(text, 10, 12), 'not a quote of this text at all'], lambda q: length(q) >= 20 AND length(trim(q)) >= 3 AND contains(trim(regexp_replace(lower(regexp_replace(text, '[\"''“”‘’]', '', 'g')), '\s+', ' ', 'g')), trim(regexp_replace(lower(regexp_replace(q, '[\"''“”‘’]', '', 'g')), '\s+', ' ', 'g')))) AS kept, text FROM documents)"
    " SELECT doc_id, CASE WHEN len(kept) > 0 THEN 'ok' ELSE 'unverified' END AS status, CAST(len(kept) AS INT) AS n_kept, CAST(3 - len(kept) AS INT) AS dropped, CAST(length(substr(text, 1, 800)) AS INT) AS summary_chars FROM g"
)
def explanation_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded explanations."""
    t = F.col("text")
    quotes = F.array(F.substring(t, 1, 30), F.substring(t, 10, 12), F.lit("not a quote of this text at all"))
    g = S.table(spark, sf_dir, "documents").select("doc_id", T.grade(quotes, t, t).alias("g"))
    return g.select("doc_id", "g.status", F.size("g.evidence").alias("n_kept"), "g.dropped", F.length("g.summary").alias("summary_chars"))


def _count_sql(term: str, x: str = "d") -> str:
    return rf"len(regexp_extract_all({x}, '(?i)(?:^|[^\p{{L}}\p{{N}}_]){term}(?:[^\p{{L}}\p{{N}}_]|$)'))"


_DOUBLED = r"regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g')"
_GROUP_SUMS = {g: "(" + " + ".join(_count_sql(t) for t in ts) + ")" for g, ts in S.GROUPS.items()}


@R.add(f"WITH x AS (SELECT doc_id, {_DOUBLED} AS d FROM documents) SELECT doc_id, " + ", ".join(f"CAST({s} AS INT) AS n_{g}" for g, s in _GROUP_SUMS.items()) + " FROM x")
def keyword_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K3: occurrences of each group's terms."""
    return S.texts(spark, sf_dir).select("doc_id", *K.counts(F.col("text"), S.GROUPS))


@R.add(
    f"WITH x AS (SELECT doc_id, {_DOUBLED} AS d FROM documents), c AS (SELECT doc_id, " + ", ".join(f"{s} AS {g}" for g, s in _GROUP_SUMS.items()) + " FROM x) SELECT doc_id, "
    + ", ".join(f"round(ln(1 + {g}), 9) AS log1p_{g}, CASE WHEN {g} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS binary_{g}" for g in S.GROUPS)
    + " FROM c"
)
def keyword_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: group features."""
    t = F.col("text")
    df = S.texts(spark, sf_dir).select("doc_id", *K.features(t, S.GROUPS), *K.features(t, S.GROUPS, "binary"))
    return df.select("doc_id", *[F.round(f"log1p_{g}", 9).alias(f"log1p_{g}") for g in S.GROUPS], *[f"binary_{g}" for g in S.GROUPS])


_TERMS = [(g, t) for g, ts in S.GROUPS.items() for t in ts]


@R.add(
    f"WITH x AS (SELECT doc_id, {_DOUBLED} AS d FROM documents), c AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{g}' AS grp, '{t}' AS term, CAST({_count_sql(t)} AS INT) AS n FROM x" for g, t in _TERMS)
    + ") SELECT * FROM c WHERE n > 0"
)
def keyword_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, K5: terms that occur, in long form."""
    d = S.texts(spark, sf_dir).select("doc_id", F.explode(K.term_counts(F.col("text"), S.GROUPS)).alias("x"))
    return d.select("doc_id", F.col("x.group").alias("grp"), "x.term", "x.n")


@R.add(
    f"WITH x AS (SELECT doc_id, {_DOUBLED} AS d FROM documents), c AS (SELECT doc_id, " + ", ".join(f"{s} AS {g}" for g, s in _GROUP_SUMS.items()) + " FROM x), m AS (SELECT *, greatest(" + ", ".join(S.GROUPS) + ") AS best FROM c) "
    "SELECT doc_id, CASE WHEN best = 0 THEN 'Other' " + " ".join(f"WHEN {g} = best THEN '{g}'" for g in S.GROUPS) + " END AS label FROM m"
)
def rule_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6, M4: the group of most hits, first of equals, else the fallback."""
    return S.texts(spark, sf_dir).select("doc_id", F.coalesce(K.top_group(F.col("text"), S.GROUPS), F.lit("Other")).alias("label"))


def _present(t: str, x: str, case: bool = False) -> str:
    return rf"CASE WHEN regexp_matches({x}, '{'' if case else '(?i)'}(?:^|[^\p{{L}}\p{{N}}_]){t}(?:[^\p{{L}}\p{{N}}_]|$)') THEN 1 ELSE 0 END"


def _gate_sql(x: str) -> str:
    return "(" + " + ".join([*(_present(t, x) for t in S.GATE_WORDS), *(_present(t, x, True) for t in S.GATE_ACRONYMS)]) + ")"


@R.add(f"WITH {ART}, g AS (SELECT doc_id, source, {_gate_sql('headline')} AS nh, {_gate_sql('text')} AS nt FROM art) SELECT doc_id, source = 'src1' OR nh > 0 OR nt >= 2 AS relevant, CASE WHEN source = 'src1' THEN 0 ELSE CAST(least(nt, 5) AS INT) END AS n_terms FROM g")
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate with distinct terms; one specialist source bypasses it."""
    a = S.articles(spark, sf_dir)
    passes, terms = K.relevant(F.col("headline"), F.col("body"), S.GATE_WORDS, S.GATE_ACRONYMS)
    special = F.col("source") == "src1"
    return a.select("doc_id", (special | passes).alias("relevant"), F.when(special, 0).otherwise(F.size(terms)).alias("n_terms"))


@R.add()
def keyword_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline marks, exclusion of noisy terms, hits as text."""
    groups = K.without(S.GROUPS, ["THAT"])
    t = F.col("text")
    return S.texts(spark, sf_dir).select("doc_id", F.md5(K.mark(t, groups["Alpha"]).cast("binary")).alias("marked_md5"), K.hits_text(t, groups).alias("hits"))


@R.add(
    f"WITH {ART}, x AS (SELECT *, {_N} AS norm FROM art) SELECT doc_id, norm, CAST(dense_rank() OVER (ORDER BY m) - 1 AS INT) AS exact_group, rn > 1 AS is_exact_dup FROM (SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS m, row_number() OVER (PARTITION BY norm ORDER BY doc_id) AS rn FROM x)"
)
def exact_dup_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form, group number in order of first appearance, copy flag."""
    from lakepress.operators import dedupe

    return dedupe.exact_groups(S.articles(spark, sf_dir).select("doc_id", T.normal_headline(F.col("headline")).alias("norm")))


@R.add(f"WITH {ART}, x AS (SELECT doc_id, {_N} AS norm FROM art) SELECT min(doc_id) AS doc_id, norm FROM x GROUP BY norm")
def drop_exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first copy of each headline stays."""
    a = S.articles(spark, sf_dir).select("doc_id", T.normal_headline(F.col("headline")).alias("norm"))
    return a.groupBy("norm").agg(F.min("doc_id").alias("doc_id"))


@R.add(
    f"WITH {ART}, x AS (SELECT doc_id, lang, {_N} AS norm FROM art), g AS (SELECT norm, count(*) AS n, count(DISTINCT lang) AS nl FROM x GROUP BY norm) "
    "SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_exact_dups, count(*) AS n_groups, max(n) AS largest_group, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS multi_row_groups, CAST(sum(CASE WHEN nl > 1 THEN 1 ELSE 0 END) AS BIGINT) AS spanning_groups FROM g"
)
def exact_dup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: duplicate summary; groups that span languages stand for those that span splits."""
    from lakepress.operators import dedupe

    return dedupe.summary(S.articles(spark, sf_dir).select("doc_id", "lang", T.normal_headline(F.col("headline")).alias("norm")), "norm", "lang")


@R.add(f"WITH {ART}, d AS (SELECT doc_id, headline, source, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS pos FROM art) SELECT doc_id, source, pos FROM d WHERE pos <= 5")
def first_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five items a source, newest first."""
    a = S.articles(spark, sf_dir)
    pos = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("doc_id")))
    return a.select("doc_id", "source", pos.cast("long").alias("pos")).where("pos <= 5")


@R.add(f"WITH {ART}, x AS (SELECT doc_id, source, {_N} AS norm FROM art), k AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY source, doc_id) AS rn FROM x) SELECT doc_id, source, norm FROM k WHERE rn = 1")
def first_copy_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Across ordered sources the first copy of a headline wins."""
    a = S.articles(spark, sf_dir).select("doc_id", "source", T.normal_headline(F.col("headline")).alias("norm"))
    best = a.groupBy("norm").agg(F.min(F.struct("source", "doc_id")).alias("x"))
    return best.select("x.doc_id", "x.source", "norm")
