"""Exact and near duplicates of headlines."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakepress.operators.graph import connected_components, contracted
from lakepress.plans.workdir import spill

#: similarity from which two headlines are near duplicates
SIMILAR = 0.85
GRAMS = (3, 4, 5)
#: a task looks at the square of it in pairs of postings at once
POSTINGS = 1024
#: characters of a block of texts; two blocks are compared in one task
BLOCK_CHARS = 6 << 20
#: characters whose grams are counted at once
CHUNK_CHARS = 1 << 18
#: copies of a text that are multiplied with as many others in one row
COPIES = 1024
#: shares of the weight, rarest grams first, after which a pair is given up if it has no chance left
BANDS = (0.25, 0.5, 0.75)
#: below a bound by this much a pair is still looked at
SLACK = 1e-6


def exact_groups(rows: DataFrame, key: str = "norm", order: str = "doc_id") -> DataFrame:
    """``rows`` with exact_group (in order of first appearance) and is_exact_dup.

    Groups are numbered over the distinct keys' first rows alone.
    """
    first = rows.groupBy(key).agg(F.min(order).alias("__first"))
    numbered = number_in_order(first, ["__first"], "exact_group")
    return rows.join(numbered, key).select(*rows.columns, F.col("exact_group").cast("int").alias("exact_group"), (F.col(order) > F.col("__first")).alias("is_exact_dup"))


def number_in_order(rows: DataFrame, order: list[str], to: str, within: list[str] | None = None) -> DataFrame:
    """``rows`` with dense numbers from 0 by ``order``, which no two rows share, in each group of ``within``.

    Rows are dealt by ranges of group and order, so neither a large group nor
    sparse values put all rows into one task; ranges are numbered each on their
    own, and only their sizes meet.
    """
    within = within or []
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *within, *order).withColumn("__part", F.spark_partition_id())
    placed = spill(ranged, "ranges")
    sizes = placed.groupBy(*within, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(within)], F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy(*within, "__part").orderBy(*order)) - 1
    meet = F.col("__part") == F.col("__p")
    for i, c in enumerate(within):
        meet = meet & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return placed.withColumn("__place", place).join(starts, meet).select(*rows.columns, (F.col("__start") + F.col("__place")).alias(to))


def summary(rows: DataFrame, key: str, split: str) -> DataFrame:
    """One row: rows, copies, groups, largest, groups of several rows, groups that span splits."""
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(split).alias("n_splits"))
    return g.agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.col("n") - 1).alias("n_exact_dups"),
        F.count(F.lit(1)).alias("n_groups"),
        F.max("n").alias("largest_group"),
        F.sum((F.col("n") > 1).cast("long")).alias("multi_row_groups"),
        F.sum((F.col("n_splits") > 1).cast("long")).alias("spanning_groups"),
    )


def _windows(w: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))


def word_grams(text: Column, sizes: tuple[int, ...] = GRAMS) -> Column:
    """Character grams inside padded words; a padded word no longer than n gives itself once, for the first such n only."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w: Column) -> Column:
        parts = []
        for k, n in enumerate(sizes):
            slide = _windows(w, n)
            # past the first size that covers the word, it is not given again
            parts.append(slide if k == 0 else F.when(F.length(w) > sizes[k - 1], slide).otherwise(F.array().cast("array<string>")))
        return F.concat(*parts)

    return F.flatten(F.transform(padded, grams))


def distinct_texts(rows: DataFrame, key: str = "doc_id", text: str = "headline") -> tuple[DataFrame, DataFrame]:
    """((key, rep), (rep, text, copies)): equal texts stand behind the one of the smallest key; null texts are left out."""
    marked = rows.where(F.col(text).isNotNull()).select(key, F.col(text).alias("text"), F.md5(F.col(text).cast("binary")).alias("__t"))
    texts = marked.groupBy("__t").agg(F.min(key).alias("rep"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    texts = spill(texts, "texts")
    return marked.select(key, "__t").join(texts.select("__t", "rep"), "__t").select(key, "rep"), texts.select("rep", "text", "copies")


def _counted(texts: DataFrame) -> DataFrame:
    """(rep, copies, grams, tf): each text's grams and how often they occur, as arrays of one length."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        blank = regex.compile(r"\s+").split
        for f in frames:
            found = [_gram_counts(blank(t)) for t in f["text"]]
            yield pd.DataFrame({"rep": f["rep"], "copies": f["copies"], "grams": [list(c) for c in found], "tf": [list(c.values()) for c in found]})

    kind = texts.schema["rep"].dataType.simpleString()
    return texts.select("rep", "copies", F.lower("text").alias("text")).mapInPandas(run, f"rep {kind}, copies bigint, grams array<string>, tf array<int>")


def _gram_counts(words: list[str]) -> Counter:
    """What ``word_grams`` gives, counted."""
    out: Counter = Counter()
    for word, times in Counter(words).items():
        if word:
            w = f" {word} "
            for k, n in enumerate(GRAMS):
                if k and len(w) <= GRAMS[k - 1]:
                    break
                for i in range(max(1, len(w) - n + 1)):
                    out[w[i : i + n]] += times
    return out


def _raw(texts: DataFrame, n: int) -> DataFrame:
    """(rep, gram, df, w); a gram's frequency counts the copies of texts, of ``n`` rows in all.

    A text's few bytes become many rows of grams, which no estimate of sizes
    knows of, so the tables of grams are merged and never broadcast.
    """
    counted = spill(_counted(texts), "counted")
    df = counted.select("copies", F.explode("grams").alias("gram")).groupBy("gram").agg(F.sum("copies").alias("df"))
    flat = counted.select("rep", F.explode(F.arrays_zip("grams", "tf")).alias("x")).select("rep", F.col("x.grams").alias("gram"), F.col("x.tf").alias("tf"))
    w = (1 + F.log("tf")) * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1)
    return flat.hint("merge").join(df, "gram").select("rep", "gram", "df", w.alias("w"))


def tfidf(rows: DataFrame, key: str = "doc_id", text: str = "headline") -> DataFrame:
    """(key, gram, df, weight): 1 + ln tf, times ln((1 + N) / (1 + df)) + 1, scaled to length one."""
    members, texts = distinct_texts(rows, key, text)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("rep")))
    weights = _raw(texts, rows.count()).select("rep", "gram", "df", (F.col("w") / norm).alias("weight"))
    return members.join(weights.hint("merge"), "rep").select(key, "gram", "df", "weight")


def _vectors(weights: DataFrame, key: str) -> DataFrame:
    """(key, ids, weights) of (key, gram, df, w): one row for each vector, of length one, its grams numbered from rare to frequent."""
    vocabulary = number_in_order(weights.select("df", "gram").distinct(), ["df", "gram"], "id").select("gram", "id")
    each = weights.hint("merge").join(vocabulary, "gram").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("id", "w"))).alias("x"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return each.select(key, F.col("x.id").alias("ids"), F.transform("x", lambda e: e["w"] / F.col("norm")).alias("weights"))


def similar_pairs(w: DataFrame, least: float = SIMILAR, key: str = "doc_id") -> DataFrame:
    """(a, b, cosine) of pairs from ``least`` on, of vectors given as (key, gram, df, weight)."""
    vectors = spill(_vectors(w.withColumnRenamed("weight", "w"), key), "vectors")
    n = max(1, math.ceil((vectors.agg(F.sum(F.size("ids"))).first()[0] or 0) / BLOCK_CHARS))

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        ids, local = np.unique(np.concatenate(f["ids"].tolist()), return_inverse=True)
        return _block_row(f["block"].iloc[0], f[key], f["ids"].map(len).to_numpy(), local, np.concatenate(f["weights"].tolist()), ids, np.ones(len(ids)))

    blocks = _dealt(vectors, key, n).groupBy("block").applyInPandas(pack, _block_schema(vectors.schema[key].dataType.simpleString()))
    return _block_pairs(spill(blocks, "blocks"), n, least)


def _dealt(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``rows`` with the block, of ``n``, that each belongs to."""
    return rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def _block_schema(kind: str) -> str:
    return f"block int, keys array<{kind}>, sizes binary, local binary, part binary, ids binary, scale binary"


def _packed(a: np.ndarray) -> bytes:
    """The first bytes of all numbers, then their second ones, and so on, compressed."""
    return zlib.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1)


def _unpacked(b: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _block_row(block: int, keys: pd.Series, sizes: np.ndarray, local: np.ndarray, part: np.ndarray, ids: np.ndarray, scale: np.ndarray) -> pd.DataFrame:
    """A block of vectors as one row.

    Each vector has ``sizes`` grams, given by their places in ``ids``, in order;
    a weight is ``part`` times the ``scale`` of its gram, before it is scaled to length one.
    """
    steps = np.diff(local.astype(np.int32), prepend=np.int32(0))
    cells = {"sizes": sizes.astype(np.int32), "local": steps, "part": part.astype(np.float64), "ids": ids.astype(np.int64), "scale": scale.astype(np.float64)}
    return pd.DataFrame({"block": [block], "keys": [keys.tolist()]} | {k: [_packed(v)] for k, v in cells.items()})


class _Block(NamedTuple):
    """Vectors of length one, grams from rare to frequent; vector i has ``first[i]`` to ``first[i + 1]`` of gram and w."""

    keys: np.ndarray
    first: np.ndarray
    gram: np.ndarray
    w: np.ndarray
    ids: np.ndarray


def _unpacked_block(keys: list, sizes: bytes, local: bytes, part: bytes, ids: bytes, scale: bytes) -> _Block:
    n = _unpacked(sizes, np.int32)
    first = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
    gram = np.cumsum(_unpacked(local, np.int32), dtype=np.int32)
    w = _unpacked(part, np.float64) * _unpacked(scale, np.float64)[gram]
    w /= np.repeat(np.sqrt(np.add.reduceat(w * w, first[:-1])), n)
    return _Block(np.asarray(keys), first, gram, w, _unpacked(ids, np.int64))


class _Prefix(NamedTuple):
    """The postings by which a vector can meet one that reaches the threshold; ``after`` is the length of what is beyond each."""

    row: np.ndarray
    gram: np.ndarray
    w: np.ndarray
    after: np.ndarray


def _prefix(x: _Block, gram: np.ndarray, least: float) -> _Prefix:
    n = np.diff(x.first)
    square = x.w * x.w
    upto = np.cumsum(square)
    upto -= np.repeat(upto[x.first[:-1]] - square[x.first[:-1]], n)
    at = np.flatnonzero(upto - square <= 1.0 - (least - SLACK) ** 2)
    return _Prefix(np.repeat(np.arange(len(n)), n)[at], gram[at], x.w[at], np.sqrt(np.maximum(1.0 - upto[at], 0.0)))


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... ``n[0]`` of them, then those from first[1] on, and so on."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def _met(p: _Prefix, q: _Prefix, n_grams: int, n_q: int, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, each once, that share a prefix gram at which they can still reach ``least`` if they share none before it."""
    order = np.argsort(q.gram, kind="stable")
    q = _Prefix(*(c[order] for c in q))
    held = np.bincount(q.gram, minlength=n_grams)
    start = (np.cumsum(held) - held)[p.gram]
    n = held[p.gram]
    upto = np.cumsum(n)
    ends = np.flatnonzero(np.diff(p.row, append=-1)) + 1  # whole rows of p at a time
    lo = done = 0
    while lo < len(n):
        done = max(done + 1, int(np.searchsorted(upto[ends - 1], (upto[lo - 1] if lo else 0) + POSTINGS * POSTINGS, side="right")))
        hi = int(ends[done - 1])
        i, j = np.repeat(np.arange(lo, hi), n[lo:hi]), _spans(start[lo:hi], n[lo:hi])
        near = p.w[i] * q.w[j] + p.after[i] * q.after[j] >= least - SLACK
        if same:
            near &= p.row[i] < q.row[j]
        pairs = np.unique(p.row[i[near]] * n_q + q.row[j[near]])
        yield pairs // n_q, pairs % n_q
        lo = hi


def _dots(a: np.ndarray, b: np.ndarray, x: _Block, y: _Block, of_x: list, of_y: list, dense: np.ndarray) -> np.ndarray:
    """Products of the vectors a of x, in order, and b of y, over the postings that ``of_x`` and ``of_y`` (from, to) name; ``dense`` is of zeros, one for each gram."""
    out = np.zeros(len(a))
    runs = np.flatnonzero(np.diff(a, prepend=-1))
    for lo, hi in zip(runs, np.append(runs, len(a))[1:], strict=True):
        mine = slice(of_x[0][a[lo]], of_x[1][a[lo]])
        dense[x.gram[mine]] = x.w[mine]
        # as many at once as a chunk of postings
        for at in range(lo, hi, POSTINGS):
            others = b[at : min(hi, at + POSTINGS)]
            n = of_y[1][others] - of_y[0][others]
            where = _spans(of_y[0][others], n)
            # a last 0 for vectors without postings at the end
            products = np.append(dense[y.gram[where]] * y.w[where], 0.0)
            out[at : at + len(others)] = np.where(n > 0, np.add.reduceat(products, np.cumsum(n) - n), 0.0)
        dense[x.gram[mine]] = 0.0
    return out


def _compared(x: _Block, y: _Block, same: bool, least: float) -> Iterator[pd.DataFrame]:
    """(a, b, cosine) of the pairs of two blocks from ``least`` on."""
    ids = np.union1d(x.ids, y.ids)
    x, y = (v._replace(gram=np.searchsorted(ids, v.ids).astype(np.int32)[v.gram]) for v in (x, y))
    # bands of grams, from rare to frequent; common ones are compared only where the rarer leave a chance
    mass = np.cumsum(sum(np.bincount(v.gram, weights=v.w * v.w, minlength=len(ids)) for v in (x, y)))
    cuts = [0, *np.searchsorted(mass, mass[-1] * np.array(BANDS)).tolist(), len(ids)]
    begin, rest = [], []
    for v in (x, y):
        begin.append([v.first[:-1] + np.add.reduceat((v.gram < c).astype(np.int64), v.first[:-1]) for c in cuts])
        rest.append([np.sqrt(np.add.reduceat(np.where(v.gram >= c, v.w * v.w, 0.0), v.first[:-1])) for c in cuts[1:]])
    dense = np.zeros(len(ids))
    for a, b in _met(_prefix(x, x.gram, least), _prefix(y, y.gram, least), len(ids), len(y.keys), least, same):
        dot = np.zeros(len(a))
        for k in range(len(cuts) - 1):
            dot += _dots(a, b, x, y, begin[0][k : k + 2], begin[1][k : k + 2], dense)
            near = dot + rest[0][k][a] * rest[1][k][b] >= least - SLACK
            a, b, dot = a[near], b[near], dot[near]
        cosine = np.round(dot, 9)
        near = cosine >= least
        if near.any():
            yield pd.DataFrame({"a": x.keys[a[near]], "b": y.keys[b[near]], "cosine": cosine[near]})


def _block_pairs(blocks: DataFrame, n: int, least: float, links: bool = False) -> DataFrame:
    """(a, b, cosine) of pairs from ``least`` on, by prefix filtering within each two of the ``n`` blocks.

    A pair can reach the threshold only if it shares a gram within the prefixes
    whose rests have a squared length below its square. At the first that it
    shares, that gram and the lengths of what either has beyond it bound the
    cosine; pairs that pass are compared vector by vector. Each two blocks meet
    in a task of their own, which reads them from one exchange and writes only
    the pairs that it finds: neither postings nor candidates are shuffled, and
    a gram that many prefixes hold is spread over all tasks. ``links``: (a, b)
    alone, and of each task's pairs only as many as connect the same vectors.
    """
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    cells = ("block", "keys", "sizes", "local", "part", "ids", "scale")
    placed = blocks.repartitionByRange(n, "block")
    side = lambda name: placed.select(*[F.col(c).alias(f"{c}_{name}") for c in cells])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = (pairs for f in frames for r in f.itertuples(index=False) for pairs in compare(r))
        yield from contracted(found) if links else found

    def compare(r) -> Iterator[pd.DataFrame]:
        x, y = (_unpacked_block(*(getattr(r, f"{c}_{name}") for c in cells[1:])) for name in "xy")
        return _compared(x, y, r.block_x == r.block_y, least)

    met = side("x").hint("shuffle_replicate_nl").join(side("y"), F.col("block_x") <= F.col("block_y"))
    got = met.mapInPandas(run, f"a {kind}, b {kind}" + (", cosine double" if not links else ""))
    return got.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *[c for c in got.columns if c == "cosine"])


def _spaces() -> np.ndarray:
    """Code points of white space, as words are split by."""
    import regex

    return np.array([ord(c) for c in regex.findall(r"\s", "".join(map(chr, range(0x3001))))], dtype=np.uint32)


def _gram_keys(texts: list[str], spaces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) of every place where ``word_grams`` has a gram, a gram as a number.

    Grams of characters below 4,096 are numbers of 12 bits each, no two alike;
    others are hashed to 62 bits.
    """
    raw = [np.frombuffer(f" {t} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    owner, c = np.repeat(np.arange(len(raw)), [len(r) for r in raw]), np.concatenate(raw)
    blank = np.isin(c, spaces)
    keep = ~blank
    keep[0] = True
    keep[1:] |= ~blank[:-1]  # one blank after each word
    owner, c, blank = owner[keep], np.where(blank, np.uint32(32), c)[keep].astype(np.uint64), blank[keep]
    owners, keys = [], []
    for n in GRAMS:
        m = len(c) - n + 1
        if m <= 0:
            break
        # blanks only at the ends
        at = np.flatnonzero(~np.logical_or.reduce([blank[i : m + i] for i in range(1, n - 1)]))
        narrow, wide, top = np.full(len(at), n - GRAMS[0], np.uint64), np.full(len(at), n, np.uint64), np.zeros(len(at), np.uint64)
        for i in range(n):
            x = c[at + i]
            narrow = (narrow << np.uint64(12)) | x
            wide = (wide ^ x) * np.uint64(0x9E3779B97F4A7C15)
            wide ^= wide >> np.uint64(29)
            top = np.maximum(top, x)
        keys.append(np.where(top < 4096, narrow, (wide >> np.uint64(2)) | np.uint64(1 << 62)).astype(np.int64))
        owners.append(owner[at + 1])
    return (np.concatenate(owners), np.concatenate(keys)) if keys else (np.empty(0, np.int64), np.empty(0, np.int64))


def _tallies(texts: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the first text, grams, text, place of the gram, count) of some texts at a time; texts and grams in order."""
    spaces, all_texts = _spaces(), texts.tolist()
    part = np.cumsum([len(t) for t in all_texts]) // CHUNK_CHARS
    begins = np.flatnonzero(np.diff(part, prepend=-1))
    for lo, hi in zip(begins, np.append(begins, len(all_texts))[1:], strict=True):
        owner, keys = _gram_keys(all_texts[lo:hi], spaces)
        grams, place = np.unique(keys, return_inverse=True)
        if len(grams):
            both, count = np.unique(owner * len(grams) + place, return_counts=True)
            yield int(lo), grams, both // len(grams), both % len(grams), count


def _text_blocks(texts: DataFrame, n_rows: int) -> tuple[DataFrame, int]:
    """The blocks of the vectors of (rep, text, copies), and how many; texts without grams have no vector.

    Each block lists its own grams once, with the copies that hold them, and
    gets their places in the order from rare to frequent and their frequencies
    back; texts, not their postings, are shuffled.
    """
    size = texts.agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("rows")).first()
    n = max(1, math.ceil((size.chars or 0) / BLOCK_CHARS), min(12, math.ceil(size.rows / 1000)))
    dealt = _dealt(texts.select("rep", F.lower("text").alias("text"), "copies"), "rep", n)

    def held(f: pd.DataFrame) -> pd.DataFrame:
        copies, grams, n_held = f["copies"].to_numpy(), [np.empty(0, np.int64)], [np.empty(0)]
        for lo, g, text, place, _ in _tallies(f["text"]):
            grams.append(g)
            n_held.append(np.bincount(place, weights=copies[lo + text], minlength=len(g)))
        g, place = np.unique(np.concatenate(grams), return_inverse=True)
        return pd.DataFrame({"block": f["block"].iloc[0], "gram": g, "n": np.bincount(place, weights=np.concatenate(n_held), minlength=len(g)).astype(np.int64)})

    def pack(f: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("gram")
        grams, ids = known["gram"].to_numpy(), known["id"].to_numpy()
        rank = np.argsort(np.argsort(ids))
        texts_, places, counts = [], [], []
        for lo, g, text, place, count in _tallies(f["text"]):
            at = rank[np.searchsorted(grams, g)][place]
            order = np.argsort(text * len(ids) + at)
            texts_.append(lo + text[order])
            places.append(at[order].astype(np.int32))
            counts.append(count[order])
        if not texts_:
            return pd.DataFrame(columns=["block", "keys", "sizes", "local", "part", "ids", "scale"])
        sizes = np.bincount(np.concatenate(texts_), minlength=len(f))
        by_id = known.sort_values("id")
        scale = np.log((1.0 + n_rows) / (1.0 + by_id["df"].to_numpy())) + 1
        return _block_row(f["block"].iloc[0], f["rep"][sizes > 0], sizes[sizes > 0], np.concatenate(places), 1 + np.log(np.concatenate(counts)), by_id["id"].to_numpy(), scale)

    lists = spill(dealt.groupBy("block").applyInPandas(held, "block int, gram bigint, n bigint"), "grams")
    order = number_in_order(lists.groupBy("gram").agg(F.sum("n").alias("df")), ["df", "gram"], "id")
    known = lists.select("block", "gram").hint("merge").join(order, "gram")
    kind = texts.schema["rep"].dataType.simpleString()
    return spill(dealt.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(pack, _block_schema(kind)), "blocks"), n


def near_pairs(rows: DataFrame, least: float = SIMILAR, key: str = "doc_id", text: str = "headline") -> DataFrame:
    """(a, b, cosine) of all pairs of rows; equal texts are compared once and multiplied out at the end.

    The copies of a text are put together in lists of about ``COPIES``; each two
    lists that meet are a row, and are multiplied out wherever it has been dealt to.
    """
    members, texts = distinct_texts(rows, key, text)
    blocks, n = _text_blocks(texts, rows.count())
    pairs = _block_pairs(blocks, n, least).unionByName(blocks.select(F.explode("keys").alias("a")).select("a", F.col("a").alias("b"), F.lit(1.0).alias("cosine")))
    # a text with itself only where it has copies
    pairs = pairs.join(texts.where("copies = 1").select(F.col("rep").alias("a"), F.col("rep").alias("b")), ["a", "b"], "left_anti")
    listed = members.join(texts.select("rep", "copies"), "rep").groupBy("rep", F.pmod(F.xxhash64(key), F.ceil(F.col("copies") / COPIES)).alias("list")).agg(F.collect_list(key).alias("keys"))
    listed = spill(listed, "copies")
    side = lambda end, name: listed.select(F.col("rep").alias(end), F.col("list").alias(f"list_{name}"), F.col("keys").alias(f"keys_{name}"))
    lists = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where((F.col("a") != F.col("b")) | (F.col("list_x") <= F.col("list_y")))
    spread = lists.repartition("a", "list_x", "b", "list_y")
    every = spread.withColumn("x", F.explode("keys_x")).withColumn("y", F.explode("keys_y")).where((F.col("a") != F.col("b")) | (F.col("list_x") != F.col("list_y")) | (F.col("x") < F.col("y")))
    return every.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cosine")


def near_clusters(rows: DataFrame, least: float = SIMILAR, key: str = "doc_id", text: str = "headline") -> DataFrame:
    """(key, component): the smallest id that similar texts connect; rows of no other stand alone.

    Only one row of each distinct text takes part in the join, so the links do
    not grow with the square of a text's copies. Texts without grams stand
    alone, copies included.
    """
    members, texts = distinct_texts(rows, key, text)
    blocks, n = _text_blocks(texts, rows.count())
    cc = connected_components(_block_pairs(blocks, n, least, links=True)).withColumnRenamed("node", "rep")
    placed = members.join(blocks.select(F.explode("keys").alias("rep")), "rep").join(cc, "rep", "left").select(key, F.coalesce("component", "rep").alias("component"))
    return rows.select(key).join(placed, key, "left").select(key, F.coalesce("component", key).alias("component"))


def clusters(rows: DataFrame, pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, component): the smallest id that similar pairs connect; rows without a pair stand alone."""
    cc = connected_components(pairs).withColumnRenamed("node", key)
    return rows.select(key).join(cc, key, "left").select(key, F.coalesce("component", key).alias("component"))
