"""Approximate nearest neighbours over an inverted multi-index.

A vector, scaled to length one, is quantised in two halves by separate
k-means codebooks, so a pair of centroids names one of k * k cells. A query
visits cells in order of the summed distance of its halves to the two
centroids, drawn from a heap, until the visited cells hold a given share of
the rows; those are reranked by exact cosine on the original vectors.

The codebooks are fitted on a bounded sample (``SAMPLE_ROWS``), on which the
share is measured too: the least one that finds ``TARGET`` of the sample's own
nearest neighbours. Every row is indexed. The driver holds the codebooks and the k * k cell sizes, never rows.
Cells of one first-half centroid form a block, and a block of many rows, such
as one with a very common vector, is split by a hash of the row's number; a
query goes only to blocks that hold cells it visits. Queries are dealt into
parts as well, so a task holds at most about ``BLOCK_ROWS`` rows and
``QUERY_ROWS`` queries at once. A block's rows are compared by one matrix
product and the cells that a query doesn't visit are masked; the nearest are
scored again in double precision, each by the same operations wherever it is.

Vectors that are null, zero, or hold null or non-finite components take no
part, nor do rows with a null id. Vectors of any magnitude do: a row is scaled
by a power of two before anything is squared. Vectors of different dimensions
have no angle; each dimension is an index
of its own, and a query finds rows of its own dimension. An empty table gives
no rows. Ties go to the smaller id. Rows are told apart by number, not by id:
of repeated ids each is a candidate for the others and, where it is a query,
has a ranking of its own. Other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakepress.llm.frames import bounded, objects, tidy
from lakepress.plans.workdir import spill

SAMPLE_ROWS = 20_000
ROUNDS = 12
BLOCK_ROWS, QUERY_ROWS = 16_384, 4096
#: queries that are compared with a block in one product
TOGETHER = 128
#: rows that a query's visited cells must hold, at least
CANDIDATES = 500
#: recall that the share of visited rows is measured for, and the queries it is measured with
TARGET, TRIALS = 0.94, 400
K_MIN, K_MAX = 8, 256


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        a = _nearest(x, c)
        n = np.bincount(a, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _distances(x, c).argmin(1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows by a power of two that brings their largest component near one: no angle changes, and no square under- or overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


class MultiIndex:
    """Two codebooks and the number of rows in each cell."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 7):
        self.dim, self.half = sample.shape[1], sample.shape[1] // 2
        u = _unit(sample)
        self.books = (_kmeans(u[:, : self.half], k, seed), _kmeans(u[:, self.half :], k, seed + 1))
        self.sizes = np.zeros((len(self.books[0]), len(self.books[1])), dtype=np.int64)
        self.share = self._share(u)

    def _share(self, u: np.ndarray, top: int = 5) -> float:
        """Share of rows in the cells up to a neighbour's, at the ``TARGET`` quantile."""
        trials = u[:TRIALS]
        a, b = self.cells(u)
        far = _distances(trials[:, : self.half], self.books[0])[:, a] + _distances(trials[:, self.half :], self.books[1])[:, b]
        near = trials @ u.T
        near[np.arange(len(trials)), np.arange(len(trials))] = -np.inf
        n = min(top, len(u) - 1)
        if n < 1:
            return 1.0
        best = np.argpartition(-near, n - 1, axis=1)[:, :n]
        need = [(far[i] <= far[i, j]).mean() for i in range(len(trials)) for j in best[i]]
        return float(np.quantile(need, TARGET))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = _unit(x)
        return _nearest(u[:, : self.half], self.books[0]), _nearest(u[:, self.half :], self.books[1])

    def visit(self, query: np.ndarray, candidates: int) -> list[tuple[int, int]]:
        """Cells in order of summed distance until they hold enough rows."""
        u = _unit(query[None])[0]
        d1, d2 = (_distances(h[None], b)[0] for h, b in zip((u[: self.half], u[self.half :]), self.books, strict=True))
        o1, o2 = d1.argsort(kind="stable"), d2.argsort(kind="stable")
        heap, out, held = [(d1[o1[0]] + d2[o2[0]], 0, 0)], [], 0
        while heap and held < candidates:
            _, i, j = heapq.heappop(heap)
            a, b = int(o1[i]), int(o2[j])
            if self.sizes[a, b]:
                out.append((a, b))
                held += int(self.sizes[a, b])
            if j + 1 < len(o2):
                heapq.heappush(heap, (d1[o1[i]] + d2[o2[j + 1]], i, j + 1))
            if j == 0 and i + 1 < len(o1):
                heapq.heappush(heap, (d1[o1[i + 1]] + d2[o2[0]], i + 1, 0))
        return out


def usable(vector: str):
    """No null or non-finite component, and not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def build(rows: DataFrame, n: int, seed: int = 7) -> MultiIndex:
    """The index of ``n`` rows (id, v, row) of one dimension."""
    grid = 1 << 20
    share = int(min(1.0, 1.2 * SAMPLE_ROWS / n) * grid) + 1
    # by a hash of the row itself, so neither partitions nor repeated rows change the sample
    some = rows.select("v", F.xxhash64("id", "v").alias("h")).where(F.pmod("h", F.lit(grid)) < share).groupBy("h").agg(F.first("v").alias("v"))
    picked = some.orderBy("h").limit(SAMPLE_ROWS).collect() or rows.select("v", F.xxhash64("id", "v").alias("h")).orderBy("h").limit(1).collect()
    k = int(np.clip(round(n**0.25 * 8), K_MIN, K_MAX))
    index = MultiIndex(np.array([r.v for r in picked], dtype=float), k, seed)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                a, b = index.cells(np.stack(f["v"]).astype(float))
                yield pd.DataFrame({"a": a.astype("int32"), "b": b.astype("int32")})

    for r in rows.select("v").mapInPandas(tidy(run), "a int, b int").groupBy("a", "b").count().collect():
        index.sizes[r.a, r.b] = r["count"]
    return index


def _row_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines, each by the same sequence of operations whatever else is in ``x``."""
    x, q = _scaled(x), _scaled(q[None])[0]
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def _best(rough: np.ndarray, ids: np.ndarray, x: np.ndarray, q: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the ``top`` nearest of those whose rough cosine is finite."""
    if len(rough) > top:
        least = np.partition(rough, len(rough) - top)[len(rough) - top]
        some = np.flatnonzero(rough >= least - 1e-9) if np.isfinite(least) else np.flatnonzero(np.isfinite(rough))
    else:
        some = np.flatnonzero(np.isfinite(rough))
    s = _row_scores(x[some], q)
    order = np.lexsort((ids[some], -s))[:top]
    return some[order], s[order]


def rerank(data: pd.DataFrame, queries: pd.DataFrame, width: int, top: int) -> pd.DataFrame:
    """(query, query_id, vec_id, score): the nearest of a block's rows to each query, in the cells that it visits."""
    got: list[tuple] = []
    if len(data) and len(queries):
        ids, number, cell, x = data["id"].to_numpy(), data["row"].to_numpy(), data["b"].to_numpy(), np.stack(data["v"])
        unit, wanted = _unit(x), np.stack(queries["v"]).astype(float)
        for start in range(0, len(queries), TOGETHER):
            part = queries.iloc[start : start + TOGETHER]
            visited = np.zeros((len(part), width), dtype=bool)
            for i, cells in enumerate(part["cells"]):
                visited[i, cells] = True
            rough = _unit(wanted[start : start + TOGETHER]) @ unit.T
            rough[~visited[:, cell]] = -np.inf
            for i, (query, own) in enumerate(zip(part["row"], part["id"], strict=True)):
                rough[i, number == query] = -np.inf
                at, s = _best(rough[i], ids, x, wanted[start + i], top)
                got += [(query, own, c, z) for c, z in zip(ids[at].tolist(), s.tolist(), strict=True)]
    return pd.DataFrame(got, columns=["query", "query_id", "vec_id", "score"]).astype({"query": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})


def _search(rows: DataFrame, n: int, n_queries: int, every: int, top: int, candidates: int | None) -> DataFrame:
    """(query, query_id, vec_id, score) over the rows of one dimension: each block's nearest."""
    index = build(rows, n)
    candidates = candidates or max(CANDIDATES, int(index.share * n) + 1)
    splits = np.maximum(1, -(-index.sizes.sum(1) // BLOCK_ROWS)).tolist()
    width, parts = index.sizes.shape[1], max(1, -(-n_queries // QUERY_ROWS))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                a, b = index.cells(np.stack(f["v"]))
                part = (f["row"].to_numpy(dtype=np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % np.array(splits)[a]
                yield pd.DataFrame({"a": a.astype("int32"), "part": part.astype("int32"), "b": b.astype("int32"), "id": f["id"], "row": f["row"], "v": f["v"]})

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for own, row, v in zip(f["id"], f["row"], f["v"], strict=True):
                by: dict[int, list[int]] = {}
                for a, b in index.visit(np.asarray(v, dtype=float), candidates + 1):
                    by.setdefault(a, []).append(b)
                got = [(a, part, row % parts, own, row, v, bs) for a, bs in by.items() for part in range(splits[a])]
                frame = {c: objects([g[i] for g in got]) for i, c in enumerate(("a", "part", "turn", "id", "row", "v", "cells"))}
                yield pd.DataFrame(frame).astype({"a": "int32", "part": "int32", "turn": "int32", "id": "int64", "row": "int64"})

    turns = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if parts > 1 else F.lit(0)
    placed = rows.mapInPandas(tidy(place), "a int, part int, b int, id bigint, row bigint, v array<double>").withColumn("turn", turns)
    queries = rows.where(F.col("id") % every == 0).mapInPandas(tidy(send), "a int, part int, turn int, id bigint, row bigint, v array<double>, cells array<int>")
    key = ("a", "part", "turn")
    return placed.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(lambda d, q: rerank(d, q, width, top), "query bigint, query_id bigint, vec_id bigint, score double")


def search(vectors: DataFrame, every: int = 50, top: int = 5, candidates: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's nearest rows; queries are the rows whose id ``every`` divides."""
    rows = bounded(vectors).where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.monotonically_increasing_id().alias("row"))
    # written once: the numbers stay what they are, and later passes don't test the vectors again
    rows = spill(rows.withColumn("dim", F.size("v")), "vectors")
    out = None
    for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % every == 0).alias("q")).orderBy("dim").collect():
        if r.q:
            part = _search(rows.where(F.col("dim") == r.dim).drop("dim"), r.n, r.q, every, top, candidates)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, top: int = 5) -> dict[int, list[int]]:
    """The nearest of all other rows, for distinct ids."""
    at, out = {int(i): k for k, i in enumerate(ids)}, {}
    for q in queries.tolist():
        s = _row_scores(x, x[at[q]])
        s[at[q]] = -np.inf
        out[q] = ids[np.lexsort((ids, -s))[: min(top, len(ids) - 1)]].tolist()
    return out
