"""N-gram Jaccard join as a blocked sparse matrix product.

Documents are rows and distinct five-word shingles are columns of a 0/1
incidence matrix. The join is the product of that matrix with its transpose,
computed on blocks, and thinned by bounds that follow from set sizes alone:

1. Column pass. Blocks of documents are cut by column range; each range counts
   which columns hold one document only, and those counts are summed up per
   document. A partner of a document with n shingles shares at least
   ceil(0.8 n) of them, so a document with more lonely columns than that
   leaves is dropped. One pass over half of the columns (any half bounds
   safely) thins the corpus; another over all columns of the distinct
   remaining sets drops what was only an exact copy.
2. Prefix pass. The remaining sets order their columns by document frequency
   and keep only the rare prefix that any partner must touch, within size
   bands. Each set is compared with one central pivot of its columns, and
   links are drawn together into components.
3. Product pass. Columns that still hold several components chain sets into
   clusters. A cluster's rows are dealt into blocks, and every two blocks are
   multiplied: overlap counts are summed up over slices of columns, and counts
   below the bound of the two sizes are discarded. No link between components
   is lost, and no pair of documents is ever a row.

Shingles are 64-bit hashes. Exact copies count as one set throughout.

Defined results for odd input: documents without words or text have no
shingles and are their own component; with fewer than five words the whole
sequence is the one shingle; repeated ids join one component when their texts
link; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepress.llm.frames import bounded, objects, tidy
from lakepress.operators.graph import connected_components
from lakepress.plans.workdir import spill

WORDS = 5
#: Jaccard threshold, as a fraction
NUM, DEN = 4, 5
#: bytes of text hashed at once
BATCH_BYTES = 1 << 19
#: postings that a block of documents may hold before it is cut by column range
BLOCK_POSTINGS = 1_000_000
#: postings that a column range holds, about
RANGE_POSTINGS = 400_000
#: sets and shingles of a block, and columns of a slice, in the product of what is left
BLOCK_ROWS, BLOCK_SHINGLES, SLICE = 1024, 500_000, 2048
#: sets whose tables go to one file, about
FILE_SETS = 1000
#: rounds of comparisons with pivots before what is left is multiplied out
STAR_ROUNDS = 1

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = _mix(np.arange(11, 11 + WORDS, dtype=np.uint64) * _ODD) | np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Distinct shingle hashes of texts, hashed many texts at a time."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted distinct hashes of each text."""
        raw = [t.encode() for t in texts]
        out: list[np.ndarray] = []
        at = 0
        while at < len(raw):
            stop, size = at, 0
            while stop < len(raw) and (stop == at or size + len(raw[stop]) < BATCH_BYTES):
                size += len(raw[stop]) + 1
                stop += 1
            out += self._batch(raw[at:stop])
            at = stop
        return out

    def _batch(self, raw: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer((b"\n".join(raw) + b"\n").lower(), dtype=np.uint8)
        if len(self.up) <= len(data):
            n = max(len(data) + 1, BATCH_BYTES + (1 << 16))
            self.up, self.down = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        run = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[data] * self.up[: len(data)], dtype=np.uint64)])
        words = _mix((run[ends] - run[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * _ODD)
        bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
        first = np.searchsorted(starts, bounds)
        n_words = np.diff(first)
        full = np.zeros(max(0, len(words) - WORDS + 1), dtype=np.uint64)
        for k in range(WORDS):
            full += words[k : k + len(full)] * _PLACE[k]
        full = _mix(full)
        out = []
        for a, n in zip(first[:-1].tolist(), n_words.tolist(), strict=True):
            if n >= WORDS:
                out.append(np.unique(full[a : a + n - WORDS + 1]))
            elif n:
                short = (words[a : a + n] * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)
                out.append(_mix(np.array([short], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        return out


def signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def needed(n: int) -> int:
    """Least overlap with any partner of a set of n."""
    return (NUM * n + DEN - 1) // DEN


# ---- sets of documents ---------------------------------------------------------


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n, sig; sig null where there are no shingles."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for f in frames:
            sets = shingler.sets([t or "" for t in f["text"]])
            yield pd.DataFrame(
                {
                    "doc_id": f["doc_id"].astype("Int64"),
                    "text_hash": f["text_hash"],
                    "n": np.array([len(s) for s in sets], dtype="int64"),
                    "sig": objects([signature(s) if len(s) else None for s in sets]),
                }
            )

    return bounded(docs).select("doc_id", "text_hash", "text").mapInPandas(tidy(run), "doc_id bigint, text_hash bigint, n bigint, sig binary")


Sets = Iterator[tuple[bytes, np.ndarray]]


def _sets_of_texts(frames: Iterator[pd.DataFrame]) -> Sets:
    shingler = Shingler()
    for f in frames:
        for s in shingler.sets([t or "" for t in f["text"]]):
            if len(s):
                yield signature(s), s


def _sets_of_rows(frames: Iterator[pd.DataFrame]) -> Sets:
    for f in frames:
        for sig, s in zip(f["sig"], f["shingles"], strict=True):
            yield bytes(sig), np.frombuffer(s, dtype=np.uint64)


# ---- column pass ---------------------------------------------------------------

_META = np.dtype([("sig", "V16"), ("n", "<u4")])


def not_lonely(source: DataFrame, read: Callable[[Iterator[pd.DataFrame]], Sets], one_in: int, shingles: int) -> DataFrame:
    """(sig) of the sets that may have a partner, judged by one in ``one_in`` columns; ``source`` holds ``shingles`` about."""
    ranges = max(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shingles // (one_in * RANGE_POSTINGS)))

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 24
        metas: dict[bytes, int] = {}
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pd.DataFrame:
            meta = np.array(list(metas.items()), dtype=[("sig", "O"), ("n", "O")])
            table = np.zeros(len(meta), dtype=_META)
            table["sig"] = np.frombuffer(b"".join(metas), dtype="V16")
            table["n"] = list(metas.values())
            columns = np.concatenate(held)
            owner = np.repeat(np.arange(len(held), dtype=np.uint16), [len(h) for h in held])
            where = (columns >> np.uint64(32)) % np.uint64(ranges)
            order = np.argsort(where.astype(np.uint32), kind="stable")
            low, owner = columns.astype(np.uint32)[order], owner[order]
            cut = np.searchsorted(where[order], np.arange(ranges + 1))
            own = number % ranges
            rows = [(r, low[a:b].tobytes(), owner[a:b].tobytes(), table.tobytes() if r == own else None) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a or r == own]
            return pd.DataFrame(
                {
                    "range": np.array([r[0] for r in rows], dtype="int32"),
                    "block": np.full(len(rows), number, dtype="int64"),
                    "columns": objects([r[1] for r in rows]),
                    "owners": objects([r[2] for r in rows]),
                    "meta": objects([r[3] for r in rows]),
                }
            )

        for sig, s in read(frames):
            if sig in metas:
                continue
            if len(metas) == 65_535 or size > BLOCK_POSTINGS:
                yield flush()
                metas, held, size = {}, [], 0
                number += 1
            metas[sig] = len(s)
            held.append(s[s % np.uint64(one_in) == 0] if one_in > 1 else s)
            size += len(held[-1])
        if metas:
            yield flush()

    def lonely(f: pd.DataFrame) -> pd.DataFrame:
        columns = [np.frombuffer(c, dtype=np.uint32) for c in f["columns"]]
        sizes = [len(c) for c in columns]
        flat = np.concatenate(columns)
        order = np.argsort(flat, kind="stable")
        same = flat[order]
        edge = same[1:] == same[:-1]
        shared = np.concatenate([[False], edge]) | np.concatenate([edge, [False]]) if len(same) else np.zeros(0, dtype=bool)
        alone = np.empty(len(flat), dtype=bool)
        alone[order] = ~shared
        out, at = [], 0
        for n, owners in zip(sizes, f["owners"], strict=True):
            docs, counts = np.unique(np.frombuffer(owners, dtype=np.uint16)[alone[at : at + n]], return_counts=True)
            at += n
            big = counts > 255
            counts[big] = 255  # fewer lonely columns only keep more sets
            out.append(docs.tobytes() + counts.astype(np.uint8).tobytes())
        return pd.DataFrame({"block": f["block"], "counts": objects(out), "meta": f["meta"]})

    def judged(f: pd.DataFrame) -> pd.DataFrame:
        meta = np.frombuffer(next(m for m in f["meta"] if m is not None), dtype=_META)
        total = np.zeros(len(meta), dtype=np.int64)
        for c in f["counts"]:
            n = len(c) // 3
            total[np.frombuffer(c[: 2 * n], dtype=np.uint16)] += np.frombuffer(c[2 * n :], dtype=np.uint8)
        n = meta["n"].astype(np.int64)
        keep = n - total >= (NUM * n + DEN - 1) // DEN
        return pd.DataFrame({"sig": objects([x.tobytes() for x in meta["sig"][keep]])})

    postings = bounded(source).mapInPandas(tidy(blocks), "range int, block bigint, columns binary, owners binary, meta binary")
    counts = postings.groupBy("range").applyInPandas(lonely, "block bigint, counts binary, meta binary")
    return counts.groupBy("block").applyInPandas(judged, "sig binary").distinct()


# ---- product pass --------------------------------------------------------------


def _prefixes(sets: DataFrame) -> DataFrame:
    """(column, sig, n, shared, score, rest, band): the rare columns that a partner must touch.

    ``shared`` counts the columns that other sets have too, ``score`` is the
    mean frequency of all columns, ``rest`` is how many columns lie beyond the
    prefix.
    """
    cells = sets.select("sig", "n", F.explode(F.col("columns")).alias("column"))
    frequency = cells.groupBy("column").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = cells.join(frequency, "column").groupBy("sig", "n").agg(F.sort_array(F.collect_list(F.struct("df", "column"))).alias("cells"))
    prefix = F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1
    kept = prefix - (F.col("n") - F.size("cells"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM)) + 1e-9).cast("int")
    return (
        shared.where(kept > 0)
        .where(F.size("cells") >= F.ceil(F.col("n") * NUM / DEN))
        .select(
            "sig",
            "n",
            F.size("cells").alias("shared"),
            (F.aggregate("cells", F.lit(0).cast("bigint"), lambda t, c: t + c["df"]) / F.col("n")).alias("score"),
            (F.col("n") - prefix).alias("rest"),
            band.alias("band"),
            F.slice("cells", 1, kept.cast("int"))["column"].alias("columns"),
        )
        .select("sig", "n", "shared", "score", "rest", "band", F.explode("columns").alias("column"))
    )


def _possible(n1: str, s1: str, n2: str, s2: str):
    """Whether two sets can link by their sizes: the overlap is at most what either shares with anyone."""
    return F.least(s1, s2) * (NUM + DEN) >= (F.col(n1) + F.col(n2)) * NUM


def _open(placed: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries, with their component, of columns that hold more than one component."""
    marked = placed.join(labels, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    mixed = marked.groupBy("column", "place").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("column", "place")
    return marked.join(mixed, ["column", "place"])


def _stars(entries: DataFrame, rank: int, tried: DataFrame | None) -> DataFrame:
    """(a, b): each set with the pivot that it meets in most columns; pivots are the most central of a column, later of its largest component."""
    if rank == 0:
        pivots = entries.groupBy("column", "place").agg(F.max(F.struct("score", "sig", "n", "shared")).alias("p"))
    else:
        # the most central set of the column's largest component
        heads = entries.groupBy("column", "place", "component").agg(F.max(F.struct("score", "sig", "n", "shared")).alias("h"), F.count(F.lit(1)).alias("k"))
        pivots = heads.groupBy("column", "place").agg(F.max(F.struct("k", "h"))["h"].alias("p"))
    meet = entries.join(pivots, ["column", "place"]).where(F.col("sig") != F.col("p.sig")).where(_possible("n", "shared", "p.n", "p.shared"))
    if "component" in entries.columns:
        own = entries.select(F.col("sig").alias("__p"), F.col("component").alias("__c")).distinct()
        meet = meet.join(own, F.col("p.sig") == F.col("__p")).where("component <> __c")
    best = meet.groupBy("sig", F.col("p.sig").alias("pivot")).agg(F.countDistinct("column").alias("met")).groupBy("sig").agg(F.max(F.struct("met", "pivot"))["pivot"].alias("pivot"))
    pairs = best.select(F.least("sig", "pivot").alias("a"), F.greatest("sig", "pivot").alias("b")).distinct()
    return pairs.join(tried, ["a", "b"], "left_anti") if tried is not None else pairs


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of ``pairs`` whose whole sets link."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = []
            for x, y in zip(f["sa"], f["sb"], strict=True):
                p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = np.intersect1d(p, q, assume_unique=True).size
                keep.append(DEN * both >= NUM * (len(p) + len(q) - both))
            yield f.loc[keep, ["a", "b"]]

    left = sets.select(F.col("sig").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("sig").alias("b"), F.col("shingles").alias("sb"))
    return bounded(pairs).select("a", "b").join(left, "a").join(right, "b").mapInPandas(tidy(run), "a binary, b binary")


def _product(f: pd.DataFrame) -> pd.DataFrame:
    """One link for each two components that a pair of sets of this block links.

    The block's incidence matrix is built slice by slice of its columns, and
    overlap counts are summed up over the slices.
    """
    sets = [np.frombuffer(s, dtype=np.uint64) for s in f["shingles"]]
    size = np.array([len(s) for s in sets])
    column, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = np.bincount(at, minlength=len(column)) > 1
    at, row = (np.cumsum(shared) - 1)[at[shared[at]]], row[shared[at]]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    left = np.flatnonzero(f["block"].to_numpy() == f["lo"].to_numpy())
    right = np.flatnonzero(f["block"].to_numpy() == f["hi"].to_numpy())
    counts = np.zeros((len(left), len(right)), dtype=np.float32)
    for start in range(0, int(shared.sum()), SLICE):
        a, b = np.searchsorted(at, [start, start + SLICE])
        m = np.zeros((len(sets), SLICE), dtype=np.float32)
        m[row[a:b], at[a:b] - start] = 1
        counts += m[left] @ m[right].T
    group = pd.factorize(f["component"].map(bytes))[0]
    linked = (NUM + DEN) * counts.astype(np.int64) >= NUM * (size[left][:, None] + size[right][None])
    x, y = np.nonzero(linked & (group[left][:, None] != group[right][None]))
    x, y = left[x], right[y]
    _, one = np.unique(np.stack([np.minimum(group[x], group[y]), np.maximum(group[x], group[y])]), axis=1, return_index=True)
    sig = f["sig"].to_numpy()
    return pd.DataFrame({"a": objects(list(sig[x[one]])), "b": objects(list(sig[y[one]]))})


def _block_links(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between different components that share a column, from products of blocks.

    Sets that columns chain together form a cluster; its rows are dealt into
    blocks, and each two blocks are multiplied by a task of their own, so a
    task holds two blocks at most, however large the cluster or its sets are.
    """
    heads = open_.groupBy("column", "place").agg(F.min("sig").alias("b"))
    chained = open_.join(heads, ["column", "place"]).select(F.col("sig").alias("a"), "b").distinct()
    clusters = connected_components(chained).select(F.col("node").alias("sig"), F.col("component").alias("cluster"))
    members = open_.select("sig", "n", "component").distinct().join(clusters, "sig")
    full = F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)
    blocks = members.groupBy("cluster").agg(F.ceil(full).cast("int").alias("blocks"))
    dealt = members.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", "sig", "component", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    )
    rows = pairs.join(sets.select("sig", "shingles"), "sig")
    return rows.groupBy("cluster", "lo", "hi").applyInPandas(_product, "a binary, b binary")


def links(sets: DataFrame) -> DataFrame:
    """(a, b): links that connect whatever the full join of (sig, n, shingles) connects."""

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"sig": f["sig"], "n": f["n"], "columns": objects([np.frombuffer(s, dtype=np.int64) for s in f["shingles"]])})

    # small tables go to few files
    files = max(8, min(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sets.count() // FILE_SETS)))
    cells = spill(_prefixes(bounded(sets).mapInPandas(tidy(unpack), "sig binary, n bigint, columns array<bigint>")).coalesce(files), "prefixes")
    # a set stands in its own size band and the next, so that sizes within the bound meet
    placed = cells.select("*", F.explode(F.array("band", F.col("band") + 1)).alias("place"))
    found, tried, labels = None, None, None
    for rank in range(STAR_ROUNDS):
        marked = placed if labels is None else _open(placed, labels)
        stars = _stars(marked, rank, tried)
        stars = spill(stars.coalesce(files), "stars")
        new = spill(_verified(stars, sets).coalesce(files), "links")
        tried = stars if tried is None else tried.unionByName(stars)
        found = new if found is None else found.unionByName(new)
        labels = connected_components(found).select(F.col("node").alias("sig"), "component")
    return found.unionByName(_block_links(spill(_open(placed, labels).coalesce(files), "open"), sets))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    known = spill(document_sets(rows), "sets")
    shingles = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    # the first pass reads texts; one text stands for each remaining set
    some = not_lonely(rows.select("text"), _sets_of_texts, 2, shingles)
    picked = known.where("sig is not null").groupBy("sig").agg(F.min("text_hash").alias("text_hash")).join(some, "sig").select("text_hash")

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for sig, s in _sets_of_texts(frames):
            if sig not in seen:
                seen.add(sig)
                yield pd.DataFrame({"sig": objects([sig]), "n": np.array([len(s)], dtype="int64"), "shingles": objects([s.tobytes()])})

    texts = rows.select("text_hash", "text").join(picked, "text_hash", "left_semi").select("text")
    sets = spill(texts.mapInPandas(tidy(whole), "sig binary, n bigint, shingles binary").dropDuplicates(["sig"]), "candidates")
    sets = spill(sets.join(not_lonely(sets, _sets_of_rows, 1, shingles), "sig", "left_semi"), "partners")
    classes = connected_components(links(sets)).select(F.col("node").alias("sig"), "component")
    grouped = known.where("sig is not null").join(classes, "sig", "left").withColumn("class", F.coalesce("component", "sig"))
    # read from a table, so both sides of the join are plain exchanges and a class of many copies can be split between tasks
    least = spill(grouped.groupBy("class").agg(F.min("doc_id").alias("component_id")), "least")
    linked = grouped.join(least, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = known.where("sig is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
