"""The article in a web page, by its blocks of text.

A page is read as a stream of tags. Text between two tags that break a line is
a block; blocks inside navigation, footers, forms, asides or elements whose
class or id names advertising, sharing, comments and the like are left out.
Every other block weighs its words that aren't links, less ``LINKED`` times
those that are, less ``SHORT``: prose weighs much, menus and captions less than
nothing. The article is the run of consecutive blocks of the largest weight,
so a short paragraph between long ones stays and a list of links at the end
does not. Blocks without links beside the run that lie in the same element as
its longest block belong to it however short they are; where no run weighs
anything, the element with the most words outside links is taken. Where the page marks one element as its article, only that is
looked at; of several such (teasers) each is a candidate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SHORT, LINKED = 6, 3
# fixed values: what elements are
BREAKING = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
SILENT = frozenset("script style noscript template head svg iframe select button".split())
ASIDE = frozenset("nav footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|footer|menu|nav\w*|newsletter|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|teasers?|widget)(?:$|[\s_-])", re.I)
HOLDING = frozenset("body main article section div td blockquote".split())
#: elements that close at the next of their kind
CLOSING = {"p": "p", "li": "li", "td": "td", "th": "td", "tr": "tr", "dd": "dd", "dt": "dd", "option": "option"}


class _Blocks(HTMLParser):
    """(article, words, linked words, text, element) of every block that counts; article is the number of the marked element, or 0."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[int, int, int, str, int]] = []
        self.open: list[tuple[str, bool, bool]] = []  # tag, whether it is silent, whether it is beside the article
        self.silent = self.beside = self.links = 0
        self.articles: list[int] = []
        self.n_articles, self.parts, self.linked = 0, [], []
        self.holders, self.n_holders = [0], 0

    def _end(self) -> None:
        text, linked = " ".join("".join(self.parts).split()), "".join(self.linked).split()
        if text and not self.beside:
            self.blocks.append((self.articles[-1] if self.articles else 0, len(text.split()), len(linked), text, self.holders[-1]))
        self.parts, self.linked = [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BREAKING:
            self._end()
        if tag in CLOSING and any(CLOSING.get(t) == CLOSING[tag] for t, *_ in self.open[-2:]):
            self.handle_endtag(next(t for t, *_ in reversed(self.open) if CLOSING.get(t) == CLOSING[tag]))
        if tag in VOID:
            return
        named = any(v and k in ("class", "id", "role") and NAMED.search(v) for k, v in attrs)
        state = (tag, tag in SILENT, tag in ASIDE or (named and tag not in ("body", "html", "article", "main")))
        self.open.append(state)
        self.silent += state[1]
        self.beside += state[2]
        self.links += tag == "a"
        if tag in HOLDING:
            self.n_holders += 1
            self.holders.append(self.n_holders)
        if tag == "article":
            self.n_articles += 1
            self.articles.append(self.n_articles)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in BREAKING:
            self._end()

    def handle_endtag(self, tag: str) -> None:
        if tag in BREAKING:
            self._end()
        if not any(t == tag for t, *_ in self.open):
            return
        while self.open:
            last, silent, beside = self.open.pop()
            self.silent -= silent
            self.beside -= beside
            self.links -= last == "a"
            if last in HOLDING:
                self.holders.pop()
            if last == "article" and self.articles:
                self.articles.pop()
            if last == tag:
                break

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked.append(data + " ")


def _best_run(blocks: list[tuple[int, int, int, str, int]]) -> tuple[float, list[str]]:
    """(weight, texts) of the consecutive blocks of the largest summed weight, and of what belongs to them."""
    best, first, last, total, start = 0.0, 0, 0, 0.0, 0
    for i, (_, words, linked, *_) in enumerate(blocks):
        if total <= 0:
            total, start = 0.0, i
        total += (words - linked) - LINKED * linked - SHORT
        if total > best:
            best, first, last = total, start, i + 1
    if first < last:
        home = max(blocks[first:last], key=lambda b: b[1])[4]
        while first and blocks[first - 1][4] == home and not blocks[first - 1][2]:
            first -= 1
        while last < len(blocks) and blocks[last][4] == home and not blocks[last][2]:
            last += 1
        return best, [b[3] for b in blocks[first:last]]
    words: dict[int, int] = {}
    for b in blocks:
        words[b[4]] = words.get(b[4], 0) + b[1] - b[2]
    home = max(words, key=lambda k: (words[k], -k), default=None)
    return best, [b[3] for b in blocks if b[4] == home and words[home] > 0]


def main_text(html: str | None) -> str | None:
    """The article's blocks, a line each; empty where nothing reads like one, null for a null page."""
    if html is None:
        return None
    page = _Blocks()
    page.feed(html)
    page.close()
    page._end()
    marked = [[b for b in page.blocks if b[0] == k] for k in range(1, page.n_articles + 1)]
    return "\n".join(max(map(_best_run, [m for m in marked if m] or [page.blocks]), key=lambda r: r[0])[1])


def article_text(html: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p) for p in pages], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(html)
