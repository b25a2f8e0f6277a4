"""RSS and Atom documents, read with a pull parser.

Namespaces, CDATA sections (nested ones too), character references and links
given as attributes are what the parser knows; named HTML entities and bare
ampersands, which many feeds contain, are put right before. A document that
breaks off keeps the entries before the break. What gives no entry and is no
feed, or breaks before the first, is rejected with the reason: a site that
starts to send error pages must not look like a quiet day.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepress.functions import text as T
from lakepress.functions import urls as U

_CDATA = re.compile(r"(<!\[CDATA\[.*?\]\]>)", re.S)
_NAMED = re.compile(r"&(?!(?:amp|lt|gt|quot|apos);)([A-Za-z][A-Za-z0-9]*);")
_BARE = re.compile(r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)")
#: characters that XML does not know
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
ROOTS = frozenset(("rss", "feed", "RDF"))
#: how Google News items are marked, whose description repeats the headline
SEARCH = "google_news"
PARSED = "source string, kind string, pos int, title string, link string, body string, date string, origin string, error string"


def _mended(xml: str) -> str:
    named = lambda m: html.escape(got, quote=False) if (got := html.unescape(m[0])) != m[0] else f"&amp;{m[1]};"
    parts = _CDATA.split(_FORBIDDEN.sub("", xml))
    return "".join(p if k % 2 else _BARE.sub("&amp;", _NAMED.sub(named, p)) for k, p in enumerate(parts))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _entry(item: ElementTree.Element) -> dict:
    """The fields of an item or entry; of several of a kind the first that says something."""
    found: dict[str, str] = {}
    for e in item:
        name, text = _local(e.tag), "".join(e.itertext()).strip()
        if name == "link":
            text = text or (e.get("href", "").strip() if e.get("rel", "alternate") == "alternate" else "")
        elif name == "source":
            text = e.get("url") or next((x.get("href") for x in e if _local(x.tag) == "link" and x.get("href")), "")
        elif name == "content" and e.get("type") == "xhtml":
            text = "".join(ElementTree.tostring(x, encoding="unicode") for x in e)
        if text:
            found.setdefault("encoded" if name == "encoded" else name, text)
    first = lambda *names: next((found[n] for n in names if n in found), None)
    return {"title": first("title"), "link": first("link"), "body": first("encoded", "content", "description", "summary"), "date": first("pubDate", "published", "date", "updated"), "origin": first("source")}


def entries(xml: str | None, most: int) -> tuple[list[dict], str | None]:
    """(the first ``most`` entries, why this is no feed)."""
    out: list[dict] = []
    root, broken = None, None
    parser = ElementTree.XMLPullParser(("start", "end"))
    try:
        # a declared encoding says how the bytes were, which are text by now
        parser.feed(re.sub(r"^\s*<\?xml[^>]*\?>", "", _mended(xml or "")))
        parser.close()
    except ElementTree.ParseError as e:
        broken = str(e)
    try:
        for event, e in parser.read_events():
            root = root or _local(e.tag)
            if event == "end" and _local(e.tag) in ("item", "entry"):
                out.append(_entry(e))
                e.clear()
                if len(out) >= most:
                    break
    except ElementTree.ParseError as e:
        broken = broken or str(e)
    if out and root in ROOTS:
        return out, None
    if root in ROOTS and not broken:
        return [], None
    return [], f"not a feed: {broken or 'no RSS or Atom document'}"


def _parsed(feeds: DataFrame, most: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for source, kind, xml in zip(f["source"], f["kind"], f["xml"], strict=True):
                found, error = entries(xml, most)
                if error:
                    rows.append((source, kind, None, None, None, None, None, None, error))
                kept = [e for e in found if e["title"] and e["link"]]
                rows += [(source, kind, n, e["title"], e["link"], e["body"], e["date"], e["origin"], None) for n, e in enumerate(kept)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")], dtype=object)
            out["pos"] = out["pos"].astype("Int32")
            yield out

    kind = F.col("kind") if "kind" in feeds.columns else F.lit("rss")
    return feeds.select(F.col("source").cast("string").alias("source"), kind.alias("kind"), F.col("xml").cast("string").alias("xml")).mapInPandas(run, PARSED)


def parse_feeds(feeds: DataFrame, most: int = 200, body_chars: int = T.BODY_CHARS) -> DataFrame:
    """Items of RSS and Atom documents (source, xml, and kind where some are searches).

    source, pos, headline, url, text, is_body, published_at, source_domain. The
    first ``most`` entries of a document count, and of those the ones that have
    a title and a link; a document is cut where it is read. A search's item has
    no text, and its domain is that of the publisher it names.
    """
    p = _parsed(feeds, most).where("error is null")
    search = F.col("kind") == SEARCH
    text = F.when(search, "").otherwise(T.html_text(F.coalesce("body", F.lit(""))))
    full = p.select("source", "pos", F.replace(T.html_text(F.col("title")), F.lit("\n"), F.lit(" ")).alias("headline"), F.col("link").alias("url"), text.alias("text"), T.feed_date(F.coalesce("date", F.lit(""))).alias("published_at"), U.domain(F.when(search, F.coalesce("origin", "link")).otherwise(F.col("link"))).alias("source_domain"))
    kind: Column = F.col("source").cast(feeds.schema["source"].dataType)
    return full.where("headline <> ''").select(kind.alias("source"), "pos", "headline", "url", "text", T.is_full_text(F.col("text"), body_chars).alias("is_body"), "published_at", "source_domain")


def rejected_feeds(feeds: DataFrame) -> DataFrame:
    """(source, error) of the documents that are no feeds."""
    return _parsed(feeds, 1).where("error is not null").select(F.col("source").cast(feeds.schema["source"].dataType).alias("source"), "error")
