"""A part of the registered queries against their oracles on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from lakepress.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ("headline_keys", "canonical_urls", "keyword_group_counts", "relevance_gate", "exact_dup_columns", "view_alerts", "view_counts", "breakdown", "daily_trend", "article_page", "routing_records", "macro_f1_by_fold", "reliability_table", "threshold_sweep", "near_dup_pairs", "near_dup_components", "ingest_store", "ingest_report", "expire_pending", "encoded_labels", "bodied_rows", "plain_kfold", "blind_sheet", "overfit_rows", "review_buckets", "random_sample", "group_kfold_invariants", "benchmark_leaks", "corpus_csv", "split_rows", "fold_table", "source_catalogue", "checkpoint_lines", "resumed_runs", "cool_downs", "leases", "cycle_reports", "taxonomy_table", "api_articles", "unfetchable_pages", "review_estimates", "live_store", "pending_deadlines", "store_versions", "article_words", "feed_items", "keyword_term_counts", "rule_classifier", "headline_tfidf", "near_dup_summary")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(frame):
    cell = lambda v: "NULL" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_oracle(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas().astype(object)) == rows(duck.execute(ORACLE_SQL[name]).df().astype(object))
