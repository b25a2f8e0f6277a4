"""Corpus pipeline: toxicity, line dedup, near-duplicate join, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each result as Parquet and hands it to the next stage.

Defined results for odd input, in every stage: a null text stays null and an
empty one empty (packing: a document of the end token alone); rows with a null
id are kept; repeated rows stay or go together, but for near copies, of which
those with the smallest id stay; an empty table gives no rows; columns beyond
those of documents are dropped, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepress.llm import line_chunks, ngram_join, packing, secret_scan, toxicity
from lakepress.plans.workdir import spill

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; null and empty texts score low and stay. The model learns from the labels of this stage's own input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; a document of which only white space is left goes with them, one that was empty before stays."""
    # n_chars is counted anew; with it both joins of the operator would not read the same exchange of texts
    left = line_chunks.dedup_lines(docs.select(*[c for c in COLUMNS if c != "n_chars"]))
    emptied = (F.col("n_removed") > 0) & (F.trim(F.translate("text", "\n\t\r", "   ")) == "")
    return _columns(left.where(~F.coalesce(emptied, F.lit(False))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest id; so do rows without an id."""
    classes = ngram_join.near_duplicates(docs.select("doc_id", "text"))
    gone = classes.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark in the text; overlapping ones by one mark."""
    scanned = secret_scan.scan_secrets(docs.select(*COLUMNS))
    clean = F.when(F.size("secret_spans") > 0, secret_scan.redact(F.col("text"), F.col("secret_spans"))).otherwise(F.col("text"))
    return _columns(scanned.withColumn("text", clean))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: the pieces of every document, null and empty texts included."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: decoding, chunking and packing have no SQL form; tests/llm/test_odd_input.py holds the first four stages against
#: brute-force versions, tests/llm/test_llm.py packing against the tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = spill(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
