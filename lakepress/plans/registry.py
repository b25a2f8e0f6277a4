"""How queries and their oracles are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a query under its function's name, with its DuckDB oracle where there is one."""

        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return put


#: the mapped articles, as sources.mapped has them
ART = r"""
art AS (
  SELECT doc_id, headline, CASE WHEN regexp_matches(rest, '\S') THEN rest END AS body, regexp_matches(rest, '\S') AS has_body,
         source, source || CASE doc_id % 3 WHEN 0 THEN '.example.net' WHEN 1 THEN '.example.org' ELSE '.example.com' END AS source_domain,
         CASE WHEN doc_id % 4 = 0 THEN 'google_news' ELSE 'rss' END AS source_kind, lang, text,
         TIMESTAMP '2024-01-01 00:00:00' + to_days((doc_id % 30)::INT) + to_hours(((doc_id * 7) % 24)::BIGINT) AS collected_at,
         CASE WHEN doc_id % 6 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_days((doc_id % 30)::INT) + to_hours(((doc_id * 7) % 24 - 5)::BIGINT) END AS published_at
  FROM (SELECT *, split_part(text, chr(10), 1) AS headline, substr(text, length(split_part(text, chr(10), 1)) + 2) AS rest FROM documents))
"""
NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({0}, '\s+[-|]\s+[^-|]{{2,45}}$', '')), '\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"
PRED = r"""
pred AS (
  SELECT doc_id AS article_id, has_body, ['Alpha','Beta','Gamma','Delta','Other'][(doc_id * 7 % 5 + 1)::INT] AS narrative,
         (doc_id * 37 % 1000) / 1000.0 AS narrative_conf, CASE WHEN doc_id * 13 % 10 < 3 THEN 'High' ELSE 'Low' END AS severity,
         0.5 + (doc_id * 29 % 500) / 1000.0 AS severity_conf,
         round(CASE WHEN doc_id * 13 % 10 < 3 THEN 0.5 + (doc_id * 29 % 500) / 1000.0 ELSE 1 - (0.5 + (doc_id * 29 % 500) / 1000.0) END, 4)::DOUBLE AS p_high
  FROM art WHERE doc_id % 11 <> 0)
"""
REV = r"""
rev AS (
  SELECT doc_id * 2 AS review_id, doc_id AS article_id, CASE WHEN doc_id % 21 = 0 THEN NULL ELSE 'Alpha' END AS narrative,
         CASE WHEN doc_id % 35 = 0 THEN NULL ELSE 'High' END AS severity, doc_id % 49 = 0 AS not_relevant FROM documents WHERE doc_id % 7 = 0
  UNION ALL
  SELECT doc_id * 2 + 1, doc_id, NULL, CASE WHEN doc_id % 4 = 0 THEN 'Low' END, doc_id % 70 = 0 FROM documents WHERE doc_id % 14 = 0),
latest AS (SELECT * FROM rev r WHERE review_id = (SELECT max(review_id) FROM rev q WHERE q.article_id = r.article_id)),
expl AS (SELECT doc_id AS article_id, CASE WHEN doc_id % 10 = 0 THEN 'ok' ELSE 'unverified' END AS ex_status, substr(text, 1, 40) AS ex_summary FROM documents WHERE doc_id % 5 = 0)
"""
MODEL = (
    f"WITH {ART}, {PRED}, {REV}, "
    + r"""
model AS (
  SELECT a.doc_id, a.headline, a.source, a.source_kind, a.source_domain, a.published_at, a.collected_at,
         p.has_body, p.narrative, p.narrative_conf, p.severity, p.severity_conf, p.p_high, e.ex_status, e.ex_summary,
         r.review_id, r.narrative AS r_narrative, r.severity AS r_severity, coalesce(r.not_relevant, false) AS dismissed,
         coalesce(r.narrative, p.narrative) AS eff_narrative, coalesce(r.severity, p.severity) AS eff_severity,
         (p.has_body AND p.narrative_conf < 0.7) OR NOT p.has_body AS needs_review
  FROM pred p JOIN art a ON a.doc_id = p.article_id LEFT JOIN expl e ON e.article_id = a.doc_id LEFT JOIN latest r ON r.article_id = a.doc_id),
flags AS (
  SELECT *, NOT dismissed AS v_all,
         NOT dismissed AND eff_severity = 'High' AND has_body AND source NOT IN ('src3', 'src7') AS v_alerts,
         NOT dismissed AND eff_severity = 'High' AND NOT has_body AND source NOT IN ('src3', 'src7') AS v_unconfirmed,
         NOT dismissed AND source IN ('src3', 'src7') AS v_analysis, needs_review AND review_id IS NULL AS v_review, dismissed AS v_dismissed
  FROM model)
"""
)
SCORED = (
    f"WITH {ART}, "
    + r"""
oof AS (
  SELECT doc_id, has_body, source, lang, (doc_id * 31 % 5)::INT AS fold, (doc_id % 3)::INT AS seed,
         n[(tn + 1)::INT] AS true_narrative, n[(CASE WHEN doc_id * 17 % 10 < 3 THEN (tn + 1 + doc_id % 3) % 5 ELSE tn END + 1)::INT] AS pred_narrative,
         (doc_id * 37 % 1000)::DOUBLE / 1000.0 AS conf, ts AS true_severity,
         CASE WHEN doc_id * 11 % 8 = 0 THEN CASE WHEN ts = 'High' THEN 'Low' ELSE 'High' END ELSE ts END AS pred_severity
  FROM (SELECT a.*, (a.doc_id * 3 + l.quality) % 5 AS tn, CASE WHEN l.toxic = 1 THEN 'High' ELSE 'Low' END AS ts, ['Alpha','Beta','Gamma','Delta','Other'] AS n
        FROM art a JOIN labels l ON a.doc_id = l.doc_id))
"""
)
