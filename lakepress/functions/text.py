"""Text columns: headlines, keys, bodies, evidence. All JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: an aggregator's tail: blank, dash or bar, blank, 2 to 45 characters without either
SOURCE_TAIL = r"(?U)\s+[-|]\s+[^-|]{2,45}$"
#: headlines of fewer words are no key
KEY_WORDS = 4
#: bodies from this length on are full text, shorter ones are teasers
BODY_CHARS = 1000
#: fixed values: words that say nothing about which article a page is
STOP_WORDS = (
    "about after against among amid also been before being between both could during from have "
    "here into more most over said says such than that their them then there these they this "
    "those through under until upon very were what when where which while with would your will "
    "india indian news today latest live update updates"
).split()
FEED_FOOTER = r"(?i)\n?the post .{0,400} appeared first on .{0,200}$"


def squeeze(c: Column) -> Column:
    """White-space runs as one blank, ends trimmed; any Unicode white space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_all(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def has_body(body: Column) -> Column:
    """Whether there is anything but white space; the search stops at the first such character."""
    return F.coalesce(body.rlike(r"(?U)\S"), F.lit(False))


def model_text(headline: Column, body: Column, sep: str = " [SEP] ", mark: str = "[NO_BODY] ") -> Column:
    return F.when(has_body(body), F.concat(headline, F.lit(sep), body)).otherwise(F.concat(F.lit(mark), headline))


def strip_source(headline: Column) -> Column:
    return F.regexp_replace(headline, SOURCE_TAIL, "")


def normal_headline(headline: Column) -> Column:
    """Equal normal forms make exact duplicates. Blanks are collapsed before other characters go."""
    spaced = F.regexp_replace(F.lower(strip_source(headline)), r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, "[^a-z0-9 ]", ""), " +", " "))


def headline_key(headline: Column) -> Column:
    """The normal form, null where it is too short to trust."""
    k = normal_headline(headline)
    return F.when(F.size(F.split(k, " ")) >= KEY_WORDS, k)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def is_full_text(c: Column, least: int = BODY_CHARS) -> Column:
    return F.coalesce(F.length(c) >= least, F.lit(False))


def content_words(c: Column) -> Column:
    """Distinct lower-case words of more than three characters that are no stop words."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_except(F.filter(words, lambda w: F.length(w) > 3), stop)


def headline_matches(headline: Column, title: Column, text: Column, share: float = 0.4, head: int = 4000) -> Column:
    """Whether a page is about its headline: enough of the headline's words occur; under three words always."""
    wanted = content_words(strip_source(headline))
    present = content_words(F.concat(title, F.lit("\n"), F.substring(text, 1, head)))
    n = F.size(wanted)
    return F.when(n < 3, F.lit(True)).otherwise(F.size(F.array_intersect(wanted, present)) >= F.lit(share) * n)


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def whole_references(html: Column) -> Column:
    """Character references that HTML reads without a semicolon, as a cut text leaves them, with one; apostrophes by number in one form."""
    closed = F.regexp_replace(html, "&(amp|lt|gt|quot|nbsp)(?!;)", "&$1;")
    return F.regexp_replace(closed, "(?i)&#(?:x0*27(?![0-9a-f])|0*39(?![0-9]));?", "&#39;")


def html_text(html: Column) -> Column:
    """Visible text, a line for each tag-separated piece, without scripts, styles and feed footers."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|noscript|iframe)\b[^>]*>.*?</\1\s*>", "\n")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", "\n")
    for name, char in ENTITIES:
        bare = F.replace(bare, F.lit(name), F.lit(char))
    lines = F.filter(F.transform(F.split(bare, "\n"), strip_all), lambda x: x != "")
    return F.regexp_replace(F.array_join(lines, "\n"), FEED_FOOTER, "")


def article_html(html: Column) -> Column:
    """The <article> element where there is one, else the whole page."""
    inner = F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*)</article>", 1)
    return F.when(inner != "", inner).otherwise(html)


def plain_quote(c: Column) -> Column:
    return squeeze(F.lower(F.regexp_replace(c, "[\"'“”‘’]", "")))


def evidence_found(quote: Column, *texts: Column) -> Column:
    """Whether a quote of three characters or more occurs in one of the texts, but for case, quotes and blanks."""
    q = plain_quote(quote)
    hit = F.lit(False)
    for t in texts:
        hit = hit | F.coalesce(F.contains(plain_quote(t), q), F.lit(False))
    return (F.length(q) >= 3) & hit


def grade(quotes: Column, summary: Column, text: Column, least: int = 20, cut: int = 800) -> Column:
    """struct(status, evidence, dropped, summary): quotes that are long enough and occur in the text."""
    kept = F.filter(quotes, lambda q: (F.length(q) >= least) & evidence_found(q, text))
    status = F.when(F.coalesce(F.trim(summary), F.lit("")) == "", "failed").when(F.size(kept) > 0, "ok").otherwise("unverified")
    return F.struct(status.alias("status"), kept.alias("evidence"), (F.size(quotes) - F.size(kept)).alias("dropped"), F.substring(summary, 1, cut).alias("summary"))


def clip(c: Column, n: int, mark: str = " ...") -> Column:
    """Cut at ``n`` characters, back to the last whole word."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, n), " [^ ]*$", ""), F.lit(mark)))


def generated_id(headline: Column, body: Column) -> Column:
    return F.concat(F.lit("rt_"), F.substring(F.sha1(F.concat(headline, F.lit("\n"), F.coalesce(body, F.lit(""))).cast("binary")), 1, 10))


def given_id(i: Column, headline: Column, body: Column) -> Column:
    """The caller's id; where it is null, empty or NaN, one made of the text."""
    return F.when(i.isNull() | i.isin("", "nan", "NaN"), generated_id(headline, body)).otherwise(i)


def api_article(i: Column, headline: Column, body: Column) -> Column:
    """struct(id, headline, body) as the rest of the engine wants them; a blank headline raises."""
    h, b = strip_all(F.coalesce(headline, F.lit(""))), strip_all(F.coalesce(body, F.lit("")))
    h = F.when(h != "", h).otherwise(F.raise_error(F.lit("every article needs a headline")))
    return F.struct(given_id(i, h, b).alias("id"), h.alias("headline"), b.alias("body"))


def feed_date(c: Column) -> Column:
    """An RFC 822 or ISO date as UTC text, null where it is neither."""
    iso = F.try_to_timestamp(c)
    rfc = F.try_to_timestamp(F.regexp_replace(c, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.date_format(F.coalesce(rfc, iso), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def truncated(tokens: Column, most: int) -> Column:
    return F.size(tokens) >= most
