"""URL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: query keys that only track a click
TRACKING_KEYS = ("fbclid", "gclid", "ref", "ref_src", "cmpid", "ito", "from", "source", "pfrom", "s_cid", "icid", "mc_cid", "mc_eid", "ocid")
TRACKING_PREFIX = "utm_"


def _recoded(c: Column) -> Column:
    """Decoded and encoded as a form field; ~ stays and * is encoded."""
    plain = F.coalesce(F.try_url_decode(c), c)
    return F.replace(F.replace(F.url_encode(plain), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical_url(url: Column) -> Column:
    """Lower scheme and host, no tracking parameters, fragment or trailing slash; null for what is no URL."""
    u = F.trim(url)
    query = F.coalesce(F.try_parse_url(u, F.lit("QUERY")), F.lit(""))
    pairs = F.filter(
        F.split(query, "&"),
        lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING_KEYS) & ~F.startswith(F.lower(p), F.lit(TRACKING_PREFIX)),
    )
    fields = F.transform(pairs, lambda p: F.concat(_recoded(F.substring_index(p, "=", 1)), F.lit("="), _recoded(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise(""))))
    path = F.regexp_replace(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), "/+$", "")
    head = F.concat(F.lower(F.try_parse_url(u, F.lit("PROTOCOL"))), F.lit("://"), F.lower(F.try_parse_url(u, F.lit("AUTHORITY"))), path)
    return F.when(F.size(fields) > 0, F.concat(head, F.lit("?"), F.array_join(fields, "&"))).otherwise(head)


def url_hash(url: Column) -> Column:
    return F.substring(F.sha1(canonical_url(url).cast("binary")), 1, 16)


def article_id(url: Column) -> Column:
    return F.concat(F.lit("a_"), url_hash(url))


def domain(url: Column) -> Column:
    """Host without a leading www."""
    return F.regexp_replace(F.lower(F.try_parse_url(F.trim(url), F.lit("AUTHORITY"))), r"^www\.", "")


def is_blocked(host: Column, blocked: list[str]) -> Column:
    """The host is on the list or below an entry of it."""
    hit = F.lit(False)
    for b in sorted({x.lower().removeprefix("www.") for x in blocked}):
        hit = hit | (host == b) | F.endswith(host, F.lit("." + b))
    return F.coalesce(hit, F.lit(False))


def search_url(base: str, query: Column, window: str | None = None) -> Column:
    q = F.concat(query, F.lit(f" when:{window}")) if window else query
    return F.concat(F.lit(base), F.lit("?q="), F.url_encode(q))
