"""Minimax contiguous partition of atomic groups into shards.

Documents with equal text form one atomic group. Groups are ordered by the
SHA-256 of their text, and the ordered line of group sizes is cut into
``n_shards`` contiguous runs so that the largest run is as small as any
contiguous cut can make it. The smallest feasible capacity is found by binary
search; a capacity is checked greedily (fill a shard until the next group does
not fit).

The line of groups is never collected. The driver works on a bounded summary,
the sizes of digest-prefix ranges, and narrows the search in rounds: treating
ranges as indivisible gives a feasible capacity, treating them as divisible
gives a lower bound, and only the ranges in which a cut can still fall are
expanded to longer prefixes. Once both bounds meet the capacity is exact.

Defined results for odd input: a null text is an empty text (size 8, CRC of
no bytes); an empty table gives no rows; repeated rows each get their own
slot; with fewer groups than shards some shards stay empty; other columns of
the input are ignored. Null ids are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakepress.plans.workdir import spill

FIRST_PREFIX = 3
STEP = 2
ROWS_PER_BUCKET = 20_000
ROW_OVERHEAD = 8


class Range:
    """Consecutive groups whose digests share ``prefix``."""

    __slots__ = ("largest", "n", "prefix", "total")

    def __init__(self, prefix: str, total: int, n: int, largest: int):
        self.prefix, self.total, self.n, self.largest = prefix, total, n, largest


def greedy_cuts(ranges: list[Range], capacity: int, divisible: bool) -> list[int] | None:
    """Index of the range in which each further shard begins; None if one range can't fit.

    With ``divisible``, a range of several groups may be cut anywhere, which
    never needs more shards than the true groups do.
    """
    cuts, room = [], capacity
    for i, r in enumerate(ranges):
        left = r.total
        if divisible and r.n > 1:
            if left > room:
                left -= room
                whole = -(-left // capacity)
                cuts += [i] * whole
                room = capacity * whole - left
                continue
        elif left > room:
            if left > capacity:
                return None
            cuts.append(i)
            room = capacity
        room -= left
    return cuts


def smallest_capacity(ranges: list[Range], n_shards: int, divisible: bool, low: int, high: int) -> int:
    """Binary search; ``high`` is feasible."""
    while low < high:
        mid = (low + high) // 2
        cuts = greedy_cuts(ranges, mid, divisible)
        if cuts is not None and len(cuts) < n_shards:
            high = mid
        else:
            low = mid + 1
    return high


def _summary(groups: DataFrame, width: int, within: list[str] | None) -> list[Range]:
    if within is not None:
        by_len: dict[int, list[str]] = {}
        for p in within:
            by_len.setdefault(len(p), []).append(p)
        keep = F.lit(False)
        for n, ps in by_len.items():
            keep = keep | F.substring("digest", 1, n).isin(ps)
        groups = groups.where(keep)
    rows = (
        groups.groupBy(F.substring("digest", 1, width).alias("prefix"))
        .agg(F.sum("total").alias("total"), F.count(F.lit(1)).alias("n"), F.max("total").alias("largest"))
        .collect()
    )
    return sorted((Range(r.prefix, r.total, r.n, r.largest) for r in rows), key=lambda r: r.prefix)


def minimax_cuts(groups: DataFrame, n_shards: int) -> tuple[int, list[str]]:
    """(smallest feasible capacity, digest prefixes at which shards 1, 2, ... begin) of (digest, total)."""
    ranges = _summary(groups, FIRST_PREFIX, None)
    if not ranges:
        return 0, []
    width, total = FIRST_PREFIX, sum(r.total for r in ranges)
    low = max(max(r.largest for r in ranges), -(-total // n_shards))
    while True:
        high = smallest_capacity(ranges, n_shards, False, low, total)
        low = smallest_capacity(ranges, n_shards, True, low, high)
        if low == high:
            return high, [ranges[i].prefix for i in greedy_cuts(ranges, high, False)]
        first = greedy_cuts(ranges, low, False)
        last = greedy_cuts(ranges, high, True)
        open_: set[int] = set()
        for j in range(n_shards - 1):
            a = first[j] if first is not None and j < len(first) else 0
            b = last[j] if j < len(last) else len(ranges) - 1
            if first is not None and j >= len(first):
                continue
            open_.update(i for i in range(min(a, b), max(a, b) + 1) if ranges[i].n > 1)
        open_ = open_ or {i for i, r in enumerate(ranges) if r.n > 1}
        width = max(len(ranges[i].prefix) for i in open_) + STEP
        finer = _summary(groups, width, [ranges[i].prefix for i in open_])
        ranges = sorted([r for i, r in enumerate(ranges) if i not in open_] + finer, key=lambda r: r.prefix)


def _shard_of(digest: Column, cuts: list[str]) -> Column:
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= digest))


def shard_documents(docs: DataFrame, n_shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``key``, size, text_crc32, digest, shard, slot. ``slot`` counts from 0 in each shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = spill(
        docs.select(
            F.col(key).alias("key"),
            (F.octet_length(body).cast("long") + ROW_OVERHEAD).alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.sha2(body.cast("binary"), 256).alias("digest"),
        ),
        "shard-rows",
    )
    groups = spill(rows.groupBy("digest").agg(F.sum("size").alias("total")), "shard-groups")
    _, cuts = minimax_cuts(groups, n_shards)
    n_buckets = max(1, rows.count() // (n_shards * ROWS_PER_BUCKET))
    placed = rows.withColumn("shard", _shard_of(F.col("digest"), cuts)).withColumn(
        "bucket", F.pmod(F.xxhash64("key", "digest"), F.lit(n_buckets)).cast("int")
    )
    # a shard's rows are numbered in many buckets at once; only bucket counts meet
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "digest"))
    return (
        placed.withColumn("place", place)
        .join(starts, ["shard", "bucket"])
        .select(
            F.col("key").alias(key), "size", "text_crc32", "digest", "shard", (F.col("start") + F.col("place") - 1).alias("slot")
        )
    )
