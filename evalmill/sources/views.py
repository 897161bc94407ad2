"""Evaluation tables read off the driver's tables, in SQL that Spark and DuckDB both read.

The driver's tables hold no model runs, so each view projects one: events
become case results, order lines evaluations, conversations text pairs. Every
view makes the nulls and failures that the operators must tell apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Names that differ between the dialects.
SPARK = {"json": "get_json_object", "array": "array", "long": "BIGINT"}
DUCKDB = {"json": "json_extract_string", "array": "list_value", "long": "BIGINT"}

CASE_RESULTS = """
SELECT event_id, run_no, case_no,
  concat('run-', CAST(run_no AS STRING)) AS run_id,
  concat('case-', lpad(CAST(case_no AS STRING), 9, '0')) AS case_id,
  concat('h', CAST(case_no AS STRING), CASE WHEN run_no % 2 = 1 AND case_no % 10 = 0 THEN 'x' ELSE '' END) AS case_hash,
  CASE WHEN run_no < 3 THEN 'acme' WHEN run_no < 5 THEN 'globex' ELSE 'initech' END AS provider,
  CASE run_no WHEN 0 THEN 'acme-large' WHEN 1 THEN 'acme-large-2' WHEN 2 THEN 'acme-small'
    WHEN 3 THEN 'globex-v1' WHEN 4 THEN 'globex-mini' ELSE 'tps' END AS model,
  CASE WHEN user_id % 11 = 0 THEN NULL ELSE event_type END AS category,
  {array}(concat('u', CAST(user_id % 4 AS STRING)), CASE WHEN value > 60 THEN 'slow' ELSE 'fast' END) AS tags,
  status,
  CASE WHEN status <> 'ok' OR event_type = 'view' THEN NULL ELSE value < 60 END AS passed,
  CASE WHEN status <> 'ok' OR user_id % 13 = 0 THEN NULL WHEN value > 400 THEN 1.0 ELSE value / 400.0 END AS score,
  CASE WHEN status = 'error' AND event_id % 4 = 0 THEN 'rate_limit' WHEN status = 'error' AND event_id % 4 = 1 THEN 'server' END AS error_kind,
  value AS latency_ms,
  CASE WHEN event_id % 19 <> 0 THEN 100 + 7 * CAST({json}(props, '$.k') AS {long}) END AS input_tokens,
  CASE WHEN event_id % 23 <> 0 THEN 20 + user_id END AS output_tokens,
  CASE WHEN user_id % 3 = 0 THEN 50 ELSE 0 END AS cached_tokens,
  CASE WHEN user_id % 5 = 0 THEN 0.0005 END AS judge_cost,
  ts AS completed_at
FROM (SELECT *, event_id % 6 AS run_no, CAST((event_id - event_id % 6) / 6 AS {long}) AS case_no,
        CASE WHEN event_type = 'error' AND event_id % 3 <> 2 THEN 'error' WHEN event_id % 37 = 0 THEN 'timeout' ELSE 'ok' END AS status
      FROM events) base
"""

EVALUATIONS = """
SELECT concat('run-', CAST(o_orderkey % 2 AS STRING)) AS run_id,
  concat('case-', lpad(CAST(o_orderkey AS STRING), 9, '0')) AS case_id,
  concat('ev', CAST(l_suppkey % 5 AS STRING)) AS evaluator_id,
  CASE l_suppkey % 5 WHEN 0 THEN 'json_valid' WHEN 1 THEN 'json_valid' WHEN 2 THEN 'exact_match' ELSE 'llm_judge' END AS evaluator_type,
  CASE WHEN l_partkey % 31 = 0 THEN 'error' WHEN l_partkey % 29 = 0 THEN 'skipped' WHEN l_suppkey % 5 = 4 THEN 'passed'
    WHEN l_returnflag = 'R' THEN 'failed' ELSE 'passed' END AS status,
  CASE WHEN l_partkey % 31 = 0 OR l_partkey % 29 = 0 OR l_suppkey % 5 = 4 THEN NULL ELSE l_returnflag <> 'R' END AS passed,
  CASE WHEN l_partkey % 31 = 0 OR l_partkey % 29 = 0 OR l_partkey % 17 = 0 THEN NULL ELSE l_discount * 10 END AS score,
  l_quantity AS weight, l_linestatus = 'F' AS required, l_linenumber AS ord
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

TEXT_PAIRS = """
SELECT a.conv_id, a.turn, a.text AS expected_text,
  CASE (a.conv_id + a.turn) % 4 WHEN 0 THEN a.text WHEN 1 THEN concat('  ', upper(a.text), ' ')
    WHEN 2 THEN concat(substr(a.text, 1, 40), ' = ', CAST(a.turn * 3 AS STRING), '.5') ELSE b.text END AS output_text
FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
"""

PRICES = """
SELECT * FROM (VALUES
  (0, 'acme', 'acme-large', 'exact', CAST(3.0 AS DECIMAL(12,6)), CAST(15.0 AS DECIMAL(12,6)), CAST(0.3 AS DECIMAL(12,6))),
  (1, 'acme', 'acme-', 'prefix', CAST(0.5 AS DECIMAL(12,6)), CAST(1.5 AS DECIMAL(12,6)), NULL),
  (2, 'acme', 'acme-lar', 'prefix', CAST(2.5 AS DECIMAL(12,6)), CAST(9.75 AS DECIMAL(12,6)), CAST(0.25 AS DECIMAL(12,6))),
  (3, 'globex', '-v[0-9]$', 'regex', CAST(1.0 AS DECIMAL(12,6)), CAST(4.0 AS DECIMAL(12,6)), NULL),
  (4, 'globex', 'v1', 'regex', CAST(7.0 AS DECIMAL(12,6)), CAST(8.0 AS DECIMAL(12,6)), NULL)
) AS p(ord, provider, model, match, input_per_mtok, output_per_mtok, cached_input_per_mtok)
"""

LABELLED = """
SELECT d.doc_id, d.lang AS category, d.source, CASE WHEN l.quality IS NULL THEN NULL ELSE l.quality = 1 END AS passed,
  CASE WHEN l.toxic = 1 THEN {array}('toxic', d.lang) ELSE {array}(d.lang) END AS tags
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

VIEWS = {
    "case_results": CASE_RESULTS,
    "evaluations": EVALUATIONS,
    "text_pairs": TEXT_PAIRS,
    "prices": PRICES,
    "labelled": LABELLED,
}
_TABLES = ("events", "orders", "lineitem", "conversations", "documents", "labels", "embeddings", "customer", "nation")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over the tables in ``sf_dir``."""
    text = VIEWS[name].format(**SPARK)
    used = {}
    for source in _TABLES:
        for word in (f"FROM {source} ", f"JOIN {source} ", f"FROM {source}\n", f"FROM {source})"):
            if word in text + "\n":
                text = (text + "\n").replace(word, word.replace(source, f"{{{source}}}"))
                used[source] = table(spark, sf_dir, source)
    return spark.sql(text, **used)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL that begins with the definitions of these views."""
    parts = ",\n".join(f"v_{n} AS ({VIEWS[n].format(**DUCKDB)})" for n in names)
    return f"WITH {parts}{',' if sql.lstrip().upper().startswith('WITH ') else ''}\n{sql.lstrip()[5:] if sql.lstrip().upper().startswith('WITH ') else sql}"
