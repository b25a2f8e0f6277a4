"""Readers and sinks: corpora, splits, feeds, checkpoints, prediction runs, state tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_corpus(spark: SparkSession, path: str, schema: StructType | str, keep: list[str]) -> DataFrame:
    """A CSV corpus with quoted line breaks, projected; a missing column raises."""
    have = spark.read.option("header", True).csv(path).columns
    if missing := [c for c in keep if c not in have]:
        raise ValueError(f"columns are missing: {missing}")
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
    return read.schema(schema).csv(path).select(*keep)


def split_members(spark: SparkSession, paths: dict[str, str], key: str = "id") -> DataFrame:
    """(key, split) from one CSV of ids for each split."""
    out = None
    for name, path in paths.items():
        part = spark.read.option("header", True).csv(path).select(key, F.lit(name).alias("split"))
        out = part if out is None else out.unionByName(part)
    return out


def encode_labels(rows: DataFrame, column: str, labels: list[str], to: str) -> DataFrame:
    """``rows`` with the label's number; an unknown label raises."""
    unknown = rows.where(F.col(column).isNotNull() & ~F.col(column).isin(*labels)).select(column).distinct().limit(5).collect()
    if unknown:
        raise ValueError(f"unknown labels: {[r[0] for r in unknown]}")
    return rows.withColumn(to, F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(column)).cast("int") - 1)


def by_mode(rows: DataFrame, mode: str) -> DataFrame:
    if mode not in ("all", "body_only"):
        raise ValueError(f"unknown mode {mode!r}")
    return rows if mode == "all" else rows.where("has_body")


FOLD_COLUMNS = ("id", "fold")


def write_folds(rows: DataFrame, path: str) -> None:
    """Folds as Parquet, a folder for each; the columns of ``FOLD_COLUMNS`` must be there."""
    if missing := [c for c in FOLD_COLUMNS if c not in rows.columns]:
        raise ValueError(f"columns are missing: {missing}")
    rows.write.mode("overwrite").partitionBy("fold").parquet(path)


def read_folds(spark: SparkSession, path: str, corpus: DataFrame, key: str = "id") -> DataFrame:
    """Folds with corpus text; a key that is not unique on either side raises."""
    folds = spark.read.parquet(path)
    for name, df in (("folds", folds), ("corpus", corpus)):
        if df.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{key} is not unique in {name}")
    return folds.join(corpus, key, "left")


def last_lines(spark: SparkSession, path: str, schema: str, key: str, model: str, prompt: str | None = None) -> DataFrame:
    """JSON-lines checkpoint of one model, and of one prompt where it is given: the last line of each key.

    Lines follow one another as they lie in their file, and files by name; no
    field says so. A split's place in its file orders splits, and a line's turn
    orders lines within one. Lines that are no JSON, such as one that a writer
    left half done, are passed over.
    """
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("__at"))
    rows = lines.select(F.from_json("value", schema).alias("x"), "__at").select("x.*", "__at").where((F.col("model") == model) & F.col(key).isNotNull())
    rows = rows if prompt is None else rows.where(F.col("prompt") == prompt)
    rest = [c for c in rows.columns if c not in (key, "__at")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "__at").alias("x")).select(key, "x.*")


def planned_runs(runs: DataFrame, plan: DataFrame) -> DataFrame:
    """Predictions of the planned (seed, fold) runs only, whatever else lies in the folder."""
    return runs.join(plan.select("seed", "fold").distinct(), ["seed", "fold"], "left_semi")


def missing_runs(plan: DataFrame, done: DataFrame) -> DataFrame:
    """What is left to run after a restart."""
    return plan.join(done.select("seed", "fold").distinct(), ["seed", "fold"], "left_anti")


def _run_paths(spark: SparkSession, path: str, seed: int, fold: int):
    """(file system, a run's folder, where its old result is kept while the new one takes its place)."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    last, old = at(f"{path}/seed={seed}/fold={fold}"), at(f"{path}/_old-seed={seed}-fold={fold}")
    return last.getFileSystem(spark._jsc.hadoopConfiguration()), last, old


def mend_run(spark: SparkSession, path: str, seed: int, fold: int) -> None:
    """Put a run's old result back where a writer died before the new one was in its place."""
    fs, last, old = _run_paths(spark, path, seed, fold)
    if fs.exists(old):
        if fs.exists(last):
            fs.delete(old, True)
        else:
            fs.rename(old, last)


def write_run(rows: DataFrame, path: str, seed: int, fold: int) -> None:
    """One run's predictions in its own folder; writing it again replaces that folder alone.

    The run is written whole to a hidden folder. The old result steps aside,
    the new one is renamed into its place, and only then the old one goes: at
    every moment one of them is there whole, and ``mend_run``, which every
    writing begins with, finds it.
    """
    spark, fresh = rows.sparkSession, f"{path}/_run-{uuid.uuid4().hex}"
    rows.drop("seed", "fold").write.parquet(fresh)
    mend_run(spark, path, seed, fold)
    fs, last, old = _run_paths(spark, path, seed, fold)
    fs.mkdirs(last.getParent())
    if fs.exists(last) and not fs.rename(last, old):
        raise OSError(f"{last} can't be moved")
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(fresh), last):
        mend_run(spark, path, seed, fold)
        raise OSError(f"{last} can't be written")
    fs.delete(old, True)


def evolve(spark: SparkSession, path: str, schema: StructType, version: int, known: int) -> DataFrame:
    """A state table with columns that older versions lack as nulls; a newer version on disk raises."""
    if version > known:
        raise ValueError(f"the table has version {version}, this code knows {known}")
    old = spark.read.option("mergeSchema", True).parquet(path)
    have = set(old.columns)
    return old.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def catalogue(entries: DataFrame) -> DataFrame:
    """Sources (name, url, kind, gate, queries): an entry with queries becomes one source a query; equal names raise."""
    each = entries.select("name", "url", "kind", "gate", F.explode_outer("queries").alias("q"))
    asked = F.col("q").isNotNull()
    name = F.when(asked, F.concat("name", F.lit("_"), F.array_join(F.split(F.trim(F.lower("q")), r"\s+"), "_"))).otherwise(F.col("name"))
    url = F.when(asked, F.concat("url", F.lit("?q="), F.replace("q", F.lit(" "), F.lit("+")))).otherwise(F.col("url"))
    out = each.select(name.alias("name"), url.alias("url"), "kind", "gate")
    if out.groupBy("name").count().where("count > 1").limit(1).count():
        raise ValueError("source names are not unique")
    return out


def source_list(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """The catalogue of entries from a configuration."""
    rows = [(e["name"], e["url"], e.get("kind", "rss"), bool(e.get("gate", True)), e.get("queries") or None) for e in entries]
    return catalogue(spark.createDataFrame(rows, "name string, url string, kind string, gate boolean, queries array<string>"))
