"""Line dedup by content-defined chunks of lines.

A text is a run of lines (a long line is wrapped after each sentence). A
rolling hash over the last two line hashes ends a chunk where it falls into a
residue, so equal passages end up in equal chunks whatever precedes them.
Where a stretch of more than ``PASSAGE`` words holds no listed chunk that its
own lines settle, a window of it is listed as well, chosen by its lines alone,
so that every repeated run of lines of so many words holds a listed unit.
Units that occur again are removed everywhere but at their first occurrence,
the one of the smallest id, then position. A unit is removed only after its
bytes were compared with those of the occurrence that stays; the comparison
then runs on over the neighbouring lines, so that a repeated passage goes up
to its last equal line. Digests that a sample of documents shows to be very
common are dealt into several tasks at each step.

What is removed always stays in a row of smaller id or earlier position.

Defined results for odd input: a null text stays null; an empty text stays
empty; repeated rows (equal id and text) count as one document and stay alike;
rows with a null id never lose text; an empty table gives no rows; other
columns pass through as they are, but for n_lines and n_removed in any case of
letters, which the result's own replace.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from lakepress.llm.frames import bounded, objects, quoted, tidy, unused, without
from lakepress.plans.workdir import spill

_END = re.compile(rb"\n|[.!?]+ ")
_LINE = re.compile(rb"[^\n]*\n|[^\n]+")
#: a line of more bytes is wrapped after its sentences
LONG_LINE = 120
#: one line in so many ends a chunk
DIVISOR = 2
#: lines and words that a repeated chunk must hold
MIN_LINES, MIN_WORDS = 2, 8
#: a repeated run of lines of more words than this holds a listed unit; a comparison runs on over so many words on either side
PASSAGE = 50
#: words that a window holds at least
WINDOW = 25
#: lines of a context; only blank lines by the hundred reach this
MOST_LINES = 300
#: occurrences of one unit that are compared in one task, about
SPLIT_ROWS = 1024
#: documents of which one is looked at for hot digests, times that a hot one is seen there, parts it is dealt into, hot digests at most
SAMPLE, HOT_SEEN, SALTS, MOST_HOT = 64, 8, 61, 4096
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def line_ends(data: bytes) -> list[int]:
    out: list[int] = []
    for m in _LINE.finditer(data):
        a, b = m.span()
        if b - a > LONG_LINE:
            out += [e.end() for e in _END.finditer(data, a, b)]
        if not out or out[-1] != b:
            out.append(b)
    return out


def line_bounds(data: bytes) -> list[int]:
    return [0, *line_ends(data)]


def units(data: bytes) -> tuple[list[int], set[tuple[int, int]]]:
    """(line bounds, listed units as first line and line after the last)."""
    bounds = line_bounds(data)
    n = len(bounds) - 1
    digest = xxhash.xxh3_64_intdigest
    hashes, total, cuts, last = [], [0], [0], 0
    for i in range(n):
        line = data[bounds[i] : bounds[i + 1]]
        h = digest(line)
        hashes.append(h)
        total.append(total[-1] + len(line.split()))
        if ((last * _ODD + h) & _MASK) >> 33 & (DIVISOR - 1) == 0 and i:
            cuts.append(i + 1)
        last = h
    whole = len(cuts)
    if cuts[-1] < n:
        cuts.append(n)
    chunks = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a >= MIN_LINES and total[b] - total[a] >= MIN_WORDS]
    out = set(chunks)
    if chunks and whole < len(cuts) and chunks[-1][1] == n:
        chunks.pop()  # ends with the text, not by a cut
    # for each stretch of just over PASSAGE words: a chunk that its own lines settle, or else its window of the least hash
    filled = [i for i in range(n) if total[i + 1] > total[i]]
    stops: list[int] = []
    stop = 0
    for i in filled:
        while stop < n and total[stop] - total[i] < WINDOW:
            stop += 1
        stops.append(stop if total[stop] - total[i] >= WINDOW else n + 1)
    taken: dict[bytes, int] = {}
    end = at = 0
    for k, i in enumerate(filled):
        if total[n] - total[i] <= PASSAGE:
            break
        while total[end] - total[i] <= PASSAGE:
            end += 1
        # the cut before a chunk comes from the two lines ahead of it
        while at < len(chunks) and chunks[at][0] < i + 2:
            at += 1
        if at < len(chunks) and chunks[at][1] <= end:
            continue
        best = k
        for j in range(k + 1, len(filled)):
            if stops[j] > end:
                break
            if hashes[filled[j]] < hashes[filled[best]]:
                best = j
        a, b = filled[best], stops[best]
        body = data[bounds[a] : bounds[b]]
        # equal windows of one text do not overlap, so the first of them stays whole
        if taken.get(body, 0) <= a:
            taken[body] = b
            out.add((a, b))
    return bounds, out


UNITS = "doc_id bigint, row bigint, line int, n int, d1 bigint, d2 bigint, salt int"


def _lister(hot: frozenset[bytes]) -> Callable:
    """The listed units of (doc_id, row, text); ``salt`` is 0, or spreads the occurrences of a hot digest."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids, rows, places, sizes, digests, salts = [], [], [], [], [], []
            for doc_id, row, text in zip(f["doc_id"], f["row"], f["text"], strict=True):
                if not text:
                    continue
                data = text.encode()
                bounds, listed = units(data)
                for a, b in listed:
                    d = xxhash.xxh3_128_digest(data[bounds[a] : bounds[b]])
                    ids.append(doc_id)
                    rows.append(row)
                    places.append(a)
                    sizes.append(b - a)
                    digests.append(d)
                    salts.append(1 + row % SALTS if d in hot else 0)
            halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            yield pd.DataFrame(
                {
                    "doc_id": np.array(ids, dtype="int64"),
                    "row": np.array(rows, dtype="int64"),
                    "line": np.array(places, dtype="int32"),
                    "n": np.array(sizes, dtype="int32"),
                    "d1": halves[:, 0],
                    "d2": halves[:, 1],
                    "salt": np.array(salts, dtype="int32"),
                }
            )

    return tidy(run)


def hot_units(listed: DataFrame) -> frozenset[bytes]:
    """Digests of very common units, by one document in ``SAMPLE``; they are only dealt differently, so a missed one costs balance alone."""
    some = listed.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0).mapInPandas(_lister(frozenset()), UNITS)
    seen = some.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("seen")).where(F.col("seen") >= HOT_SEEN)
    return frozenset(np.array([r.d1, r.d2], dtype=np.int64).tobytes() for r in seen.orderBy(F.desc("seen"), "d1", "d2").limit(MOST_HOT).collect())


def _marked(listed: DataFrame) -> DataFrame:
    """(row, line, n, d1, d2, splits, stays) of the units that occur again; one occurrence stays.

    One exchange of the listed units serves all that is asked of a digest. Hot
    digests go by digest and salt; their occurrences meet as sums alone.
    """
    hot = hot_units(listed)
    found = listed.mapInPandas(_lister(hot), UNITS)
    same = Window.partitionBy("d1", "d2", "salt")
    several = (F.min("row").over(same) != F.max("row").over(same)) | (F.min("line").over(same) != F.max("line").over(same))
    # a common unit meets its bytes in several tasks
    splits = (F.count(F.lit(1)).over(same) / SPLIT_ROWS).cast("int") + 1
    place = F.struct("doc_id", "row", "line")
    grouped = found.select("*", several.alias("several"), splits.alias("splits"), (place == F.min(place).over(same)).alias("stays"))
    kept = spill(grouped.where("several or salt > 0").select("row", "line", "n", "d1", "d2", "salt", "splits", "stays", F.when(F.col("salt") > 0, F.col("doc_id")).alias("doc_id")), "repeated")
    names = ("row", "line", "n", "d1", "d2", "splits", "stays")
    plain = kept.where("salt = 0").select(*names)
    if not hot:
        return plain
    common = kept.where("salt > 0").drop("splits", "stays")
    # at most MOST_HOT rows
    tops = common.groupBy("d1", "d2").agg(
        F.min(place).alias("first"), (F.count(F.lit(1)) / SPLIT_ROWS).cast("int").alias("more"), ((F.min("row") != F.max("row")) | (F.min("line") != F.max("line"))).alias("several")
    )
    joined = common.join(F.broadcast(tops.where("several")), ["d1", "d2"])
    return plain.unionByName(joined.select("row", "line", "n", "d1", "d2", (F.col("more") + 1).alias("splits"), (place == F.col("first")).alias("stays")))


def _context(data: bytes, bounds: list[int], at: int, step: int) -> list[bytes]:
    """The lines from ``at`` on, in steps of 1 or -1, that hold ``PASSAGE`` words at most."""
    out, words = [], 0
    while 0 <= at < len(bounds) - 1 and len(out) < MOST_LINES:
        line = data[bounds[at] : bounds[at + 1]]
        words += len(line.split())
        if words > PASSAGE:
            break
        out.append(line)
        at += step
    return out


def _kept_bytes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The units that stay, with the lines around them, the nearest first."""
    for f in frames:
        out = []
        for text, kept in zip(f["text"], f["kept"], strict=True):
            if text is None or kept is None or not len(kept):
                continue
            data = text.encode()
            bounds = line_bounds(data)
            for k in kept:
                a, b = k["line"], k["line"] + k["n"]
                if b < len(bounds):
                    out.append((k["d1"], k["d2"], k["splits"], _context(data, bounds, a - 1, -1), data[bounds[a] : bounds[b]], _context(data, bounds, b, 1)))
        yield pd.DataFrame({n: objects([o[i] for o in out]) for i, n in enumerate(("d1", "d2", "splits", "before", "body", "after"))}).astype({"d1": "int64", "d2": "int64", "splits": "int32"})


BODIES = "d1 bigint, d2 bigint, splits int, before array<binary>, body binary, after array<binary>"


def strip(text: str, repeats: list) -> tuple[str, int, int]:
    """(text without its repeats, lines removed, lines)."""
    data = text.encode()
    bounds = line_bounds(data)
    n = len(bounds) - 1
    lines = [data[bounds[i] : bounds[i + 1]] for i in range(n)]
    gone = bytearray(n)
    for r in repeats:
        body, before, after = bytes(r["body"]), r["before"], r["after"]
        for a in r["lines"]:
            stop = bounds[a] + len(body) if a < n else -1
            b = bisect_left(bounds, stop)
            if b > n or bounds[b] != stop or data[bounds[a] : stop] != body:
                continue
            lo, hi = a, b
            while lo > 0 and a - lo < len(before) and lines[lo - 1] == before[a - lo]:
                lo -= 1
            while hi < n and hi - b < len(after) and lines[hi] == after[hi - b]:
                hi += 1
            gone[lo:hi] = b"\1" * (hi - lo)
    if not any(gone):
        return text, 0, n
    return b"".join(x for x, g in zip(lines, gone, strict=True) if not g).decode(), sum(gone), n


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text``, and n_lines, n_removed (both null for a null text)."""
    row, at, more = unused(docs, "row"), unused(docs, "kept"), unused(docs, "repeats")
    base = bounded(docs).select(*map(quoted, without(docs, "n_lines", "n_removed"))).withColumn(row, F.xxhash64(F.col(key), F.col(text)))
    listed = base.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), F.col(row).alias("row"), F.col(text).alias("text"))
    marked = _marked(listed)
    kept = marked.where("stays").distinct().groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("line", "n", "d1", "d2", "splits")).alias(at))

    def bodies_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _kept_bytes(f[[text, at]].set_axis(["text", "kept"], axis=1) for f in frames)

    # both joins read the same exchange of whole rows by their hash, so texts are shuffled once
    bodies = base.join(kept, row).mapInPandas(tidy(bodies_of), BODIES).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    # one exchange serves the repeated rows' bodies and the join
    bodies = bodies.dropDuplicates(["d1", "d2", "part"])
    copies = marked.where("not stays").groupBy("row", "d1", "d2", F.pmod(F.xxhash64("row"), F.col("splits")).cast("int").alias("part")).agg(F.collect_set("line").alias("lines"))
    repeats = copies.join(bodies, ["d1", "d2", "part"]).groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("lines", "before", "body", "after")).alias(more))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, repeats in batches:
            left: list[tuple] = []
            for t, r in zip(texts, repeats, strict=True):
                if t is None:
                    left.append((None, None, None))
                elif r is None or not len(r):
                    left.append((t, len(line_ends(t.encode())), 0))
                else:
                    got, gone, n = strip(t, r)
                    left.append((got, n, gone))
            yield pd.DataFrame({"text": objects([x[0] for x in left]), "n_lines": pd.array([x[1] for x in left], dtype="Int64"), "n_removed": pd.array([x[2] for x in left], dtype="Int64")})

    stripped = F.pandas_udf(tidy(run), "text string, n_lines bigint, n_removed bigint", PandasUDFType.SCALAR_ITER)
    done = base.join(repeats, row, "left").withColumn(at, stripped(F.col(text), F.col(more)))
    own = [F.col(f"{at}.text").alias(c) if c.lower() == text.lower() else F.col(quoted(c)) for c in base.columns if c != row]
    return done.select(*own, f"{at}.n_lines", f"{at}.n_removed")
