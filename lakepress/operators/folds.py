"""Leakage-safe folds, hold-outs and seeded selections."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepress.operators.dedupe import number_in_order
from lakepress.plans.workdir import spill


def shuffled(key: str, seed: int) -> Column:
    """What a seeded order sorts by: a digest that any engine can state."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def _turns(rows: DataFrame, key: str, seed: int, to: str, within: list[str] | None = None) -> DataFrame:
    """``rows`` with their place in the seeded order, in each group of ``within``."""
    return number_in_order(rows.withColumn("__order", shuffled(key, seed)), ["__order", key], to, within).drop("__order")


def hold_out(rows: DataFrame, protected: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """(pool, leaked): rows that share no group with protected rows, and those that do."""
    groups = protected.select(group).distinct()
    return rows.join(groups, group, "left_anti"), rows.join(groups, group, "left_semi")


def stratum(positive: Column, label: Column) -> Column:
    """Rare positives make a stratum of their own."""
    return F.when(positive, "positive").otherwise(label)


#: size classes in a doubling, sizes up to which each is a class of its own, and classes of the leading label's share
STEPS, EXACT, SHARES = 4, 16, 8


def _signature(size: Column, leading: Column, most: Column) -> Column:
    """What groups of one kind have in common: leading label, rough size, rough share of the leading label."""
    rough = F.when(size <= EXACT, size).otherwise(EXACT + F.floor(F.log2(size / EXACT) * STEPS)).cast("int")
    return F.concat_ws("|", rough, F.floor(most * SHARES / size).cast("int"), leading.cast("string"))


def group_folds(rows: DataFrame, group: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """``rows`` with fold, no group in two folds, strata spread evenly.

    Groups are summed up by signature, and only that table reaches the driver:
    with L labels it has at most L times (``EXACT`` + ``STEPS`` a doubling of
    size) times (``SHARES`` + 1) signatures, some 1,600 for each label where
    groups have up to 2**40 rows, whatever the number and variety of groups.
    Signatures, large ones first, take the folds in the order in which they fit
    best so far, and their groups are dealt round from large to small.
    """
    counts = rows.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    leading = F.max_by(F.struct(F.col(label).alias("label"), "n"), F.struct("n", F.md5(F.col(label).cast("string").cast("binary")))).alias("lead")
    sized = counts.groupBy(group).agg(F.sum("n").alias("size"), leading).select(F.col(group).alias("__group"), "size", _signature(F.col("size"), F.coalesce(F.col("lead.label").cast("string"), F.lit("")), F.col("lead.n")).alias("signature"))
    sized = spill(sized, "groups")
    inside = counts.join(sized, F.col(group).eqNullSafe(F.col("__group"))).groupBy("signature", label).agg(F.sum("n").alias("n")).collect()
    groups = {r.signature: r.groups for r in sized.groupBy("signature").agg(F.count(F.lit(1)).alias("groups")).collect()}
    total: Counter = Counter()
    mean: dict[str, dict] = {}
    for r in inside:
        total[r[label]] += r.n
        mean.setdefault(r.signature, {})[r[label]] = r.n / groups[r.signature]
    held = [Counter() for _ in range(k)]
    plan = []
    for signature, labels in sorted(mean.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        order = sorted(range(k), key=lambda f: (sum((held[f][y] + n) / total[y] for y, n in labels.items()), (f + seed) % k))  # noqa: B023 - used at once
        for place, f in enumerate(order):
            share = groups[signature] // k + (place < groups[signature] % k)
            for y, n in labels.items():
                held[f][y] += n * share
        plan.append((signature, order))
    dealt = rows.sparkSession.createDataFrame(plan, "signature string, order array<int>")
    turns = number_in_order(sized.withColumn("__smaller", -F.col("size")).withColumn("__order", shuffled("__group", seed)), ["__smaller", "__order", "__group"], "turn", ["signature"])
    folds = turns.join(dealt, "signature").select("__group", F.get("order", F.pmod("turn", F.lit(k)).cast("int")).alias("fold"))
    return rows.join(folds, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")


def plain_folds(rows: DataFrame, key: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Stratified folds that ignore groups, for contrast."""
    return _turns(rows, key, seed, "__turn", [label]).withColumn("fold", F.pmod("__turn", F.lit(k)).cast("int")).drop("__turn")


def inner_split(rows: DataFrame, group: str, label: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """``rows`` with is_validation: one of round(1 / share) group folds."""
    return group_folds(rows, group, label, round(1 / share), seed).withColumn("is_validation", F.col("fold") == 0).drop("fold")


def review_buckets(rows: DataFrame, key: str, original: Column, rubric: Column, budget: int, seed: int = 0) -> DataFrame:
    """(key, bucket): all originals, all rubric hits, and random others up to the budget; a budget that the first two exceed raises."""
    kind = rows.select(key, F.when(original, "original").when(rubric, "rubric").otherwise("random").alias("bucket"))
    fixed = kind.where("bucket <> 'random'").count()
    if fixed > budget:
        raise ValueError(f"{fixed} rows are fixed, the budget is {budget}")
    others = kind.where("bucket = 'random'").orderBy(shuffled(key, seed), key).limit(budget - fixed)
    return kind.where("bucket <> 'random'").unionByName(others)


def blind_sheet(rows: DataFrame, key: str, hidden: list[str], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sheet, key sheet): the same shuffled positions from 1, labels only in the second."""
    placed = spill(_turns(rows, key, seed, "position").withColumn("position", F.col("position") + 1), "sheet")
    return placed.drop(key, *hidden), placed.select("position", key, *hidden)


def even_sample(rows: DataFrame, key: str, label: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows, as even over classes as their sizes allow."""
    return _turns(rows, key, seed, "__turn", [label]).orderBy("__turn", shuffled(key, seed), key).limit(n).drop("__turn")
