"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Vectors are put on an integer grid: an entry c becomes floor(64 * c) +
1,000,000. The model is fitted on each distinct grid vector once. A partition
keeps its number of vectors, their exact sums and the singular values and
right vectors of its centred rows, all of them: a block of a batch's rows is
decomposed and merged into what the partition has. Two such summaries are
merged by stacking both scaled bases and one more row, the difference of the
means times sqrt(n m / (n + m)), and decomposing again; the stack has the same
inner products as the centred rows of both together, so nothing is lost.
Summaries are merged in a tree, ``FAN`` at a time, until one is left. It has d
by d numbers, and is all that reaches the driver.

Components are the right vectors by falling singular value. A vector's
coordinate on one is its centred projection over the square root of the
component's variance. A second pass over the fit list measures how far the
coordinates' covariance is from the identity, in the same tree.

Defined results for odd input: rows whose vector is null or empty, or holds
null or non-finite entries, take no part; rows with a null id do, as any
other, and repeated rows each have their result. Vectors of different
dimensions are whitened apart. A component without variance (numerically, or
as there are fewer vectors than dimensions) has null coordinates and takes no
part in the error, which is 0 where no component has variance. Entries beyond
2**55 in size count as 2**55, and a deviation beyond 64 bits is null. An empty
table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepress.llm.frames import bounded, objects, tidy
from lakepress.plans.workdir import spill

#: steps of the grid in a unit, and what is added to its numbers
GRID, SHIFT = 64, 1_000_000
LARGEST = float(1 << 55)
#: components returned
COMPONENTS = 16
#: summaries that a task merges, and rows that are decomposed at once
FAN, BLOCK = 16, 4096
SUMMARY = "dim int, part bigint, n bigint, total array<bigint>, spread array<double>, base array<double>"
MOMENTS = "dim int, part bigint, n bigint, mean array<double>, product array<double>"


class Summary:
    """Of some centred vectors: their number, exact sums, and singular values times right vectors (``scaled``, r by d)."""

    __slots__ = ("n", "scaled", "total")

    def __init__(self, n: int, total: list[int], scaled: np.ndarray):
        self.n, self.total, self.scaled = n, total, scaled

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        total = x.sum(0, dtype=object) if np.abs(x).max(initial=0) > 1 << 40 else x.sum(0)
        centred = x - _mean(total, len(x))
        return cls(len(x), [int(t) for t in total], _decomposed(centred))

    def merged(self, other: Summary) -> Summary:
        a, b = self.n, other.n
        apart = _mean(self.total, a) - _mean(other.total, b)
        row = np.sqrt(a / (a + b) * b) * apart
        total = [s + t for s, t in zip(self.total, other.total, strict=True)]
        return Summary(a + b, total, _decomposed(np.vstack([self.scaled, other.scaled, row[None]])))

    def row(self, dim: int, part: int) -> dict:
        spread = np.sqrt((self.scaled * self.scaled).sum(1))
        return {"dim": dim, "part": part, "n": self.n, "total": self.total, "spread": spread.tolist(), "base": (self.scaled / np.where(spread > 0, spread, 1)[:, None]).ravel().tolist()}

    @classmethod
    def read(cls, r) -> Summary:
        spread = np.asarray(r["spread"], dtype=float)
        base = np.asarray(r["base"], dtype=float).reshape(len(spread), r["dim"])
        return cls(int(r["n"]), [int(t) for t in r["total"]], spread[:, None] * base)


def _mean(total, n: int) -> np.ndarray:
    return np.array([int(t) / n for t in total], dtype=float)


def _decomposed(rows: np.ndarray) -> np.ndarray:
    """Singular values times right vectors, by falling value; no more rows than dimensions."""
    if len(rows) > 2 * rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * vt


class Whitening:
    """What the last summary says: components as columns, their variances and shares of the trace."""

    def __init__(self, s: Summary, components: int = COMPONENTS):
        spread = np.sqrt((s.scaled * s.scaled).sum(1))
        d, self.n, self.total = len(s.total), s.n, s.total
        variance = np.zeros(d)
        variance[: len(spread)] = spread**2 / s.n
        self.mean = _mean(s.total, s.n)
        trace, k = variance.sum(), min(components, d)
        # beneath this a direction holds rounding alone
        floor = (np.finfo(float).eps * max(d, s.scaled.shape[0]) * (spread.max(initial=0))) ** 2 / s.n
        self.valid = variance[:k] > floor
        self.explained = variance[:k] / trace if trace > 0 else np.zeros(k)
        self.variance, self.axes = variance[:k], np.zeros((d, k))
        for i in np.flatnonzero(self.valid):
            self.axes[:, i] = s.scaled[i] / spread[i]
        self.error = 0.0

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Coordinates of grid vectors; 0 where a component has no variance."""
        scale = np.sqrt(np.where(self.valid, self.variance, 1))
        return (x - self.mean) @ self.axes / scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, in whole numbers."""
        far = float(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.total), default=0)
        if far < 2.0**61 and far * far * x.shape[1] < 2.0**62:
            d = x * self.n - np.array(self.total, dtype=np.int64)
            return (d * d).sum(1).tolist()
        exact = [sum((v * self.n - t) ** 2 for v, t in zip(row, self.total, strict=True)) for row in x.tolist()]
        return [e if e < 1 << 63 else None for e in exact]


def grid(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x): rows that take part, x less ``SHIFT``, so that what is summed and multiplied stays small.

    Ids go to Python as strings, so that a null among them changes no number.
    """
    v = F.col(vector)
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    step = lambda c: F.floor(F.greatest(F.least(c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST)) * GRID)
    return vectors.where(F.coalesce(v.isNotNull() & (F.size(v) > 0) & whole, F.lit(False))).select(F.col(key).cast("string").alias("id"), F.transform(v, step).cast("array<bigint>").alias("x"))


def _by_dimension(f: pd.DataFrame) -> Iterator[np.ndarray]:
    """Blocks of rows of one dimension each."""
    sizes = f["x"].map(len).to_numpy()
    for d in np.unique(sizes):
        x = np.stack(f["x"][sizes == d].to_numpy()).astype(np.int64)
        for at in range(0, len(x), BLOCK):
            yield x[at : at + BLOCK]


def _tree(rows: DataFrame, schema: str, merge: Callable[[pd.DataFrame], dict]) -> list:
    """One row for each dimension: rows of equal (dim, part / FAN) are merged, level by level."""
    level = 0
    while True:
        rows = spill(rows, f"summaries-{level}")
        if rows.count() == rows.select("dim").distinct().count():
            return rows.collect()
        up = rows.withColumn("part", F.floor(F.col("part") / FAN))
        # parts of a level are numbered without gaps at first, so every level has FAN times fewer
        rows = up.groupBy("dim", "part").applyInPandas(lambda f: pd.DataFrame({k: objects([v]) for k, v in merge(f).items()}), schema)
        level += 1


def fit(fit_list: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """A model for each dimension of the distinct grid vectors ``fit_list`` (x)."""

    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held: dict[int, Summary] = {}
        for f in frames:
            for x in _by_dimension(f) if len(f) else ():
                s, d = Summary.of(x), x.shape[1]
                held[d] = held[d].merged(s) if d in held else s
        out = [s.row(d, TaskContext.get().partitionId()) for d, s in held.items()]
        yield pd.DataFrame({c.split()[0]: objects([r[c.split()[0]] for r in out]) for c in SUMMARY.split(", ")})

    def merge(f: pd.DataFrame) -> dict:
        rows = f.sort_values("n").to_dict("records")
        s = Summary.read(rows[0])
        for r in rows[1:]:
            s = s.merged(Summary.read(r))
        return s.row(rows[0]["dim"], rows[0]["part"])

    last = _tree(fit_list.select("x").mapInPandas(tidy(summarise), SUMMARY), SUMMARY, merge)
    models = {r.dim: Whitening(Summary.read(r.asDict()), components) for r in last}

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held: dict[int, tuple] = {}
        for f in frames:
            for x in _by_dimension(f) if len(f) else ():
                w = models[x.shape[1]].apply(x)
                mean = w.mean(0)
                part = (len(w), mean, (w - mean).T @ (w - mean))
                held[x.shape[1]] = _pooled(held[x.shape[1]], part) if x.shape[1] in held else part
        out = [_moment_row(d, TaskContext.get().partitionId(), m) for d, m in held.items()]
        yield pd.DataFrame({c.split()[0]: objects([r[c.split()[0]] for r in out]) for c in MOMENTS.split(", ")})

    def pool(f: pd.DataFrame) -> dict:
        rows = f.to_dict("records")
        read = lambda r: (int(r["n"]), np.asarray(r["mean"], dtype=float), np.asarray(r["product"], dtype=float).reshape(len(r["mean"]), -1))
        m = read(rows[0])
        for r in rows[1:]:
            m = _pooled(m, read(r))
        return _moment_row(rows[0]["dim"], rows[0]["part"], m)

    for r in _tree(fit_list.select("x").mapInPandas(tidy(moments), MOMENTS), MOMENTS, pool):
        m, k = models[r.dim], len(r.mean)
        off = np.abs(np.array(r["product"]).reshape(k, k) / r.n - np.eye(k))
        m.error = float(off[np.ix_(m.valid, m.valid)].max(initial=0.0))
    return models


def _pooled(a: tuple, b: tuple) -> tuple:
    """(n, mean, centred products) of both together."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] / n * b[0])


def _moment_row(dim: int, part: int, m: tuple) -> dict:
    return {"dim": dim, "part": part, "n": m[0], "mean": m[1].tolist(), "product": m[2].ravel().tolist()}


def whiten(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component from 1, n, deviation, whitened, explained, identity_error), a row for each vector and component."""
    rows = spill(grid(bounded(vectors), key, vector), "grid")
    models = fit(spill(rows.select("x").distinct(), "fit-list"), components)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sizes = f["x"].map(len).to_numpy()
            for d in np.unique(sizes):
                own, m = f[sizes == d], models[int(d)]
                x = np.stack(own["x"].to_numpy()).astype(np.int64)
                w, exact = m.apply(x), m.deviation(x)
                shares = m.explained.tolist()
                found = [[{"whitened": z if ok else None, "explained": e} for z, e, ok in zip(r, shares, m.valid.tolist(), strict=True)] for r in w.tolist()]
                yield pd.DataFrame({"id": own["id"].to_numpy(), "n": m.n, "deviation": pd.array(exact, dtype="Int64"), "identity_error": m.error, "found": objects(found)})

    schema = "id string, n bigint, deviation bigint, identity_error double, found array<struct<whitened:double,explained:double>>"
    each = rows.mapInPandas(tidy(run), schema).select("id", "n", "deviation", "identity_error", F.posexplode("found").alias("at", "c"))
    return each.select(F.col("id").cast(vectors.schema[key].dataType).alias(key), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
