"""Keyword columns over term groups that the caller supplies.

Groups are an ordered mapping of names to terms. A term matches without regard
to case where no word character touches it; word characters are Unicode's.

Counts come from one pass over a text, whatever the number of terms: an
automaton of all terms, built once in each worker, gives every place where a
term ends, and what touches a word there is passed over. Each term counts on
its own, so terms may overlap one another; a term's own matches don't overlap.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Groups = dict[str, list[str]]


def _quoted(term: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term)


def pattern(term: str) -> str:
    return rf"(?iU)(?<!\w){_quoted(term)}(?!\w)"


def any_pattern(terms: list[str], ignore_case: bool = True) -> str:
    """One alternation, longest first."""
    body = "|".join(_quoted(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    return rf"({'?iU' if ignore_case else '?U'})(?<!\w)(?:{body})(?!\w)"


@lru_cache(maxsize=1)
def _folding() -> dict[int, str]:
    """What folding adds to lower case: characters whose upper case has another lower case of one character."""
    one = lambda s, c: s if len(s) == 1 else c
    fold = lambda c: one(one(c.upper(), c).lower(), c)
    return {i: fold(c) for i in range(128, 0x10000) if not 0xD800 <= i < 0xE000 and (c := chr(i)) and fold(c) != c}


def _folded(text: str) -> str:
    """``text`` by character without case, as long as it was."""
    if text.isascii():
        return text.lower()
    return "".join([c.lower() if c < "\x80" else c for c in text.translate(_folding())])


class _Automaton:
    """All terms at once; ids are the terms' places."""

    def __init__(self, terms: tuple[str, ...]):
        import ahocorasick
        import regex

        ids: dict[str, list[int]] = {}
        for i, t in enumerate(terms):
            if t:
                ids.setdefault(_folded(t), []).append(i)
        self.word = regex.compile(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\u200c\u200d]").match
        self.machine = ahocorasick.Automaton()
        for t, at in ids.items():
            self.machine.add_word(t, (len(t), tuple(at)))
        self.any = bool(ids)
        if ids:
            self.machine.make_automaton()

    def counts(self, text: str) -> dict[int, int]:
        found: dict[int, int] = {}
        if not self.any:
            return found
        low, ends, word, last = _folded(text), {}, self.word, len(text) - 1
        for end, (length, ids) in self.machine.iter(low):
            start = end - length + 1
            if (start and word(text[start - 1])) or (end < last and word(text[end + 1])) or start <= ends.get(ids, -1):
                continue
            ends[ids] = end
            for i in ids:
                found[i] = found.get(i, 0) + 1
        return found


@lru_cache(maxsize=8)
def _automaton(terms: tuple[str, ...]) -> _Automaton:
    return _Automaton(terms)


@lru_cache(maxsize=32)
def _counter(sizes: tuple[int, ...] | None, terms: tuple[str, ...]) -> Callable[[Column], Column]:
    """A column of counts: by group of consecutive terms where ``sizes`` are given, else id and count of each term that occurs."""
    if sizes is not None:
        group = np.repeat(np.arange(len(sizes)), sizes)

    def one(text: str | None) -> np.ndarray | list:
        found = _automaton(terms).counts(text) if text else {}
        if sizes is None:
            return [[i, found[i]] for i in sorted(found)]
        out = np.zeros(len(sizes), dtype="int32")
        for i, n in found.items():
            out[group[i]] += n
        return out

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<array<int>>" if sizes is None else "array<int>")


def _by_group(text: Column, groups: Groups) -> Column:
    """array<int>, a sum for each group."""
    return _counter(tuple(len(ts) for ts in groups.values()), tuple(t for ts in groups.values() for t in ts))(text)


def _by_term(text: Column, terms: list[str]) -> Column:
    """array<struct<i, n>> of the terms that occur, in their order."""
    return F.transform(_counter(None, tuple(terms))(text), lambda p: F.struct(F.get(p, F.lit(0)).alias("i"), F.get(p, F.lit(1)).alias("n")))


def hits(text: Column, terms: list[str]) -> Column:
    """The terms that occur, in their own order."""
    names = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    return F.transform(_by_term(text, terms), lambda x: F.get(names, x["i"]))


def hits_by_group(text: Column, groups: Groups) -> Column:
    """array<struct<group, terms>> of the groups that occur."""
    every = F.array(*[F.struct(F.lit(g).alias("group"), hits(text, ts).alias("terms")) for g, ts in groups.items()])
    return F.filter(every, lambda x: F.size(x["terms"]) > 0)


def count(text: Column, terms: list[str]) -> Column:
    """Occurrences of all terms, each counted on its own."""
    return F.get(_by_group(text, {"": terms}), F.lit(0))


def counts(text: Column, groups: Groups, prefix: str = "n_") -> list[Column]:
    """A column for each group, all from the same pass."""
    sums = _by_group(text, groups)
    return [F.get(sums, F.lit(i)).alias(f"{prefix}{g}") for i, g in enumerate(groups)]


def features(text: Column, groups: Groups, kind: str = "log1p") -> list[Column]:
    """A column for each group: log1p of the count, whether it is positive, or the count."""
    shape = {"log1p": lambda n: F.log1p(n.cast("double")), "binary": lambda n: (n > 0).cast("double"), "raw": lambda n: n.cast("double")}[kind]
    sums = _by_group(text, groups)
    return [shape(F.get(sums, F.lit(i))).alias(f"{kind}_{g}") for i, g in enumerate(groups)]


def term_counts(text: Column, groups: Groups) -> Column:
    """array<struct<group, term, n>> of the terms that occur."""
    terms = [(g, t) for g, ts in groups.items() for t in ts]
    names = F.array(*[F.struct(F.lit(g).alias("group"), F.lit(t).alias("term")) for g, t in terms])
    return F.transform(_by_term(text, [t for _, t in terms]), lambda x: F.struct(F.get(names, x["i"])["group"].alias("group"), F.get(names, x["i"])["term"].alias("term"), x["n"].alias("n")))


def top_group(text: Column, groups: Groups) -> Column:
    """The group of most occurrences, the first of equals; null where nothing occurs."""
    sums, names = _by_group(text, groups), F.array(*[F.lit(g) for g in groups])
    most = F.array_max(sums)
    return F.when(most > 0, F.get(names, (F.array_position(sums, most) - 1).cast("int")))


def mark(text: Column, terms: list[str], before: str = "[[", after: str = "]]") -> Column:
    """Every match between marks; later terms see what earlier ones made."""
    for t in terms:
        text = F.regexp_replace(text, f"({pattern(t)})", f"{before}$1{after}")
    return text


def without(groups: Groups, noisy: list[str]) -> Groups:
    low = {t.lower() for t in noisy}
    return {g: [t for t in ts if t.lower() not in low] for g, ts in groups.items()}


def gate_terms(text: Column, words: list[str], acronyms: list[str], groups: Groups | None = None) -> Column:
    """Distinct matches, words first, then case-sensitive acronyms, then group terms; first spelling kept."""
    found = F.concat(
        F.regexp_extract_all(text, F.lit(any_pattern(words)), F.lit(0)),
        F.regexp_extract_all(text, F.lit(any_pattern(acronyms, False)), F.lit(0)),
        hits(text, [t for ts in (groups or {}).values() for t in ts]) if groups else F.array().cast("array<string>"),
    )
    # reserve() would keep order, but not the first of spellings that differ in case
    return F.aggregate(found, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))


def relevant(headline: Column, text: Column, words: list[str], acronyms: list[str], groups: Groups | None = None, least: int = 2, most: int = 5) -> tuple[Column, Column]:
    """(passes, terms reported): a term in the headline, or several anywhere."""
    found = gate_terms(F.concat(headline, F.lit("\n"), F.coalesce(text, F.lit(""))), words, acronyms, groups)
    passes = (F.size(gate_terms(headline, words, acronyms, groups)) > 0) | (F.size(found) >= least)
    return passes, F.slice(found, 1, most)


def hits_text(text: Column, groups: Groups) -> Column:
    """'group: a, b; group: c'."""
    return F.array_join(F.transform(hits_by_group(text, groups), lambda x: F.concat(x["group"], F.lit(": "), F.array_join(x["terms"], ", "))), "; ")
