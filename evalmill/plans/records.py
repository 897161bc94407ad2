"""Nested cases, counts of pages, judge costs and documents as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmill.operators import leaderboard, pricing, records, rollup
from evalmill.plans.metrics import _PRICED
from evalmill.plans.serving import _BOARD, _runs, _stored
from evalmill.plans.shared import entry, r, wilson_high, wilson_low
from evalmill.sources import tables
from evalmill.sources.views import table, view


def _nested(spark, sf):
    rows = view(spark, sf, "case_results")
    responses = rows.filter("event_id % 7 <> 0").select("run_id", "case_id", F.col("category").alias("text"), "latency_ms")
    evaluations = view(spark, sf, "evaluations").select("run_id", "case_id", "ord", "evaluator_id", "status")
    found = records.nested_cases(rows.select("run_id", "case_id", "status"), responses, evaluations)
    names = F.transform("evaluations", lambda e: F.concat_ws(":", e["evaluator_id"], e["status"]))
    return found.select(
        "run_id", "case_id", "status", "response.text", "response.latency_ms", F.size("evaluations").cast("long").alias("n"),
        F.array_join(names, ",").alias("evaluations"),
    )


_NESTED = """WITH e AS (SELECT run_id, case_id, count(*) AS n, string_agg(evaluator_id || ':' || status, ',' ORDER BY ord, evaluator_id, status) AS found FROM v_evaluations GROUP BY ALL)
SELECT c.run_id, c.case_id, c.status, CASE WHEN event_id % 7 <> 0 THEN category END AS text, round(CASE WHEN event_id % 7 <> 0 THEN latency_ms END, 9) AS latency_ms,
  coalesce(n, 0) AS n, coalesce(found, '') AS evaluations FROM v_case_results c LEFT JOIN e ON e.run_id = c.run_id AND e.case_id = c.case_id"""


def _specs(spark, sf):
    specs = F.transform("tags", lambda t: F.struct(t.alias("type")))
    cases = view(spark, sf, "case_results").select(F.col("event_id").alias("id"), specs.alias("evaluators"))
    return records.evaluator_specs(cases).select("id", "place", "spec.type")


def _judged(spark, sf):
    rows = view(spark, sf, "case_results").withColumn("case_id", F.col("case_no") % 50)
    model = F.concat_ws(":", "provider", "model")
    judges = F.when(F.col("case_no") % 4 == 0, F.array(model, F.lit("acme:other"))).otherwise(F.array(model))
    return records.judge_costs(rows.withColumn("judge_models", judges), view(spark, sf, "prices"))


def _page_total(spark, sf):
    found = leaderboard.filtered_cases(view(spark, sf, "case_results"), "run-2", status="ok", query="CASE-0000", tag="fast")
    return leaderboard.count_of(found)


def _newest(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("suite_hash"), F.col("o_orderdate").alias("created_at"))
    return records.newest_snapshots(orders, 20)


def _baselines(spark, sf):
    runs = _runs(spark, sf).select("run_id", "created_at", "model")
    number = F.substring("run_id", 5, 9).cast("int")
    return records.baseline_reports(runs.withColumn("baseline_run_id", F.when(number > 0, F.concat(F.lit("run-"), (number - 1).cast("string")))))


def _documents(spark, sf):
    rows = pricing.case_costs(view(spark, sf, "case_results"), view(spark, sf, "prices"))
    return records.metrics_document(pricing.cost_rollup(rows).select("run_id", "n_units", "n_priced", "total_cost", "priced", "unpriced_reason"))


def _whole_documents(spark, sf):
    """Figures of each part of the whole document, read back from it."""
    cases = view(spark, sf, "case_results")
    costs = pricing.case_costs(cases, view(spark, sf, "prices"))
    found = records.run_documents(cases, view(spark, sf, "evaluations"), costs)
    read = lambda path, kind="string": F.get_json_object("document", f"$.{path}").cast(kind)
    size = lambda name: F.coalesce(F.json_array_length(read(name)), F.lit(-1)).cast("long")
    numbers = ("pass_rate", "ci_low", "ci_high", "error_rate", "mean_score", "median_score", "latency.p95_ms", "tokens.usage_coverage", "cost.coverage")
    return found.select(
        "run_id", read("error_policy").alias("error_policy"), *(read(x, "double").alias(x.replace(".", "_")) for x in numbers),
        *(read(x, "long").alias(x.replace(".", "_")) for x in ("n_attempted", "n_passed", "tokens.total_tokens", "latency.n")),
        read("cost.total_cost").alias("total_cost"), read("errors[0].error").alias("first_error"), read("errors[0].n", "long").alias("first_error_n"),
        size("categories").alias("n_categories"), read("categories[0].category").alias("first_category"), read("categories[0].pass_rate", "double").alias("first_category_rate"),
        size("tags").alias("n_tags"), read("tags[1].tag").alias("second_tag"), read("tags[1].n", "long").alias("second_tag_n"),
        size("evaluators").alias("n_evaluators"), read("evaluators[0].evaluator_type").alias("first_type"), read("evaluators[0].n_score_only", "long").alias("first_score_only"),
    )


_OK = "CASE WHEN status <> 'ok' THEN NULL ELSE passed END"
_DOCUMENT_SQL = f"""WITH {_PRICED}, c AS (SELECT *, {_OK} AS outcome, CASE WHEN status = 'ok' THEN score END AS ok_score, CASE WHEN status = 'ok' THEN latency_ms END AS ok_ms FROM v_case_results),
head AS (SELECT run_id, 'exclude' AS error_policy, count(*) FILTER (outcome) / count(outcome) AS pass_rate, count(*) FILTER (outcome) AS x, count(outcome) AS d, count(*) FILTER (status <> 'ok') / count(*) AS error_rate,
    avg(ok_score) AS mean_score, median(ok_score) AS median_score, quantile_cont(ok_ms, 0.95) AS p95, count(*) FILTER (input_tokens IS NOT NULL AND output_tokens IS NOT NULL) / count(*) AS usage,
    count(*) AS n_attempted, CAST(sum(CASE WHEN input_tokens IS NOT NULL AND output_tokens IS NOT NULL THEN input_tokens + output_tokens END) AS BIGINT) AS tokens, count(ok_ms) AS timed FROM c GROUP BY run_id),
money AS (SELECT run_id, CAST(CAST(sum(total_cost) AS DECIMAL(28,12)) AS VARCHAR) AS total_cost, count(*) FILTER (priced) / count(*) AS coverage FROM costs GROUP BY run_id),
errors AS (SELECT run_id, coalesce(error_kind, CASE WHEN status = 'error' THEN 'evaluation_error' END, status) AS error, count(*) AS n FROM c WHERE status <> 'ok' GROUP BY ALL),
cats AS (SELECT run_id, category, count(*) FILTER (outcome) / nullif(count(outcome), 0) AS rate FROM c WHERE category IS NOT NULL GROUP BY ALL),
tagged AS (SELECT run_id, tag, count(*) AS n, row_number() OVER (PARTITION BY run_id ORDER BY tag) AS place FROM (SELECT run_id, unnest(tags) AS tag FROM c) GROUP BY run_id, tag),
evs AS (SELECT run_id, evaluator_id, arg_min(evaluator_type, (case_id, ord, evaluator_type)) AS kind, count(*) FILTER (status = 'passed' AND passed IS NULL AND score IS NOT NULL) AS opinions FROM v_evaluations GROUP BY ALL)
SELECT run_id, error_policy, {r("pass_rate", "pass_rate")}, {r(wilson_low("x", "d"), "ci_low")}, {r(wilson_high("x", "d"), "ci_high")}, {r("error_rate", "error_rate")}, {r("mean_score", "mean_score")},
  {r("median_score", "median_score")}, {r("p95", "latency_p95_ms")}, {r("usage", "tokens_usage_coverage")}, {r("coverage", "cost_coverage")}, n_attempted, x AS n_passed, tokens AS tokens_total_tokens, timed AS latency_n, total_cost,
  (SELECT min(error) FROM errors e WHERE e.run_id = head.run_id) AS first_error, (SELECT arg_min(n, error) FROM errors e WHERE e.run_id = head.run_id) AS first_error_n,
  (SELECT count(*) FROM cats e WHERE e.run_id = head.run_id) AS n_categories, (SELECT min(category) FROM cats e WHERE e.run_id = head.run_id) AS first_category,
  {r("(SELECT first(rate ORDER BY category) FROM cats e WHERE e.run_id = head.run_id)", "first_category_rate")},
  (SELECT count(*) FROM tagged e WHERE e.run_id = head.run_id) AS n_tags, (SELECT max(tag) FROM tagged e WHERE e.run_id = head.run_id AND place = 2) AS second_tag, (SELECT max(n) FROM tagged e WHERE e.run_id = head.run_id AND place = 2) AS second_tag_n,
  (SELECT count(*) FROM evs e WHERE e.run_id = head.run_id) AS n_evaluators, (SELECT first(kind ORDER BY evaluator_id) FROM evs e WHERE e.run_id = head.run_id) AS first_type,
  (SELECT first(opinions ORDER BY evaluator_id) FROM evs e WHERE e.run_id = head.run_id) AS first_score_only
FROM head JOIN money USING (run_id)"""


def _whole_rows(spark, sf):
    rows = pricing.case_costs(view(spark, sf, "case_results"), view(spark, sf, "prices"))
    started = F.col("completed_at") - F.make_dt_interval(mins=F.lit(2))
    more = {"attempts": (F.col("event_id") % 3 + 1).cast("int"), "total_latency_ms": F.col("latency_ms") + 100, "started_at": started}
    return tables.case_rows(rows.withColumns(more))


def _expected(spark, sf):
    kinds = [F.to_json(F.array("event_type")), F.concat(F.lit('"'), "event_type", F.lit('"')), F.col("user_id").cast("string"), F.lit("true"), F.lit("null")]
    expected = F.coalesce(*(F.when(F.col("event_id") % 5 == i, k) for i, k in enumerate(kinds)))
    return table(spark, sf, "events").select("event_id", records.expected_as_text(expected).alias("expected"))


ENTRIES = [
    entry("nested_cases", _nested, _NESTED, "case_results", "evaluations"),
    entry(
        "evaluator_specs",
        _specs,
        "SELECT event_id AS id, CAST(i - 1 AS INTEGER) AS place, tags[i] AS type FROM (SELECT event_id, tags, unnest(range(1, len(tags) + 1)) AS i FROM v_case_results)",
        "case_results",
    ),
    entry(
        "judge_costs",
        _judged,
        f"WITH {_PRICED} SELECT run_id, case_no % 50 AS case_id, CAST(sum(total_cost) FILTER (case_no % 4 <> 0) AS DECIMAL(28,12)) AS judge_cost FROM costs GROUP BY ALL",
        "case_results", "prices",
    ),
    entry(
        "case_page_total",
        _page_total,
        "SELECT count(*) AS total FROM v_case_results WHERE run_id = 'run-2' AND status = 'ok' AND case_id ILIKE '%CASE-0000%' AND list_contains(tags, 'fast')",
        "case_results",
    ),
    entry("snapshots_newest", _newest, "SELECT o_orderkey AS suite_hash, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20"),
    entry(
        "best_models",
        lambda s, d: leaderboard.by_pass_rate(leaderboard.leaderboard(_stored(s, d))).select("provider", "model", "n_runs").limit(3),
        f"WITH {_BOARD} SELECT provider, model, n_runs FROM board ORDER BY coalesce(pass_rate, -1) DESC, provider, model LIMIT 3",
        "case_results", "prices",
    ),
    entry(
        "frequent_errors",
        lambda s, d: leaderboard.errors_by_count(rollup.error_breakdown(view(s, d, "case_results"))).select("error", "n").limit(1),
        """SELECT coalesce(error_kind, CASE WHEN status = 'error' THEN 'evaluation_error' END, status) AS error, count(*) AS n
        FROM v_case_results WHERE status <> 'ok' GROUP BY run_id, 1 ORDER BY n DESC, error LIMIT 1""",
        "case_results",
    ),
    entry(
        "baseline_runs",
        _baselines,
        """WITH r AS (SELECT run_id, run_no, model, min(completed_at) AS created_at FROM v_case_results GROUP BY ALL)
        SELECT b.run_id AS baseline_run_id, a.run_id, a.created_at, a.model, b.created_at AS baseline_created_at, b.model AS baseline_model
        FROM r a LEFT JOIN r b ON b.run_no = a.run_no - 1""",
        "case_results",
    ),
    entry(
        "metrics_document",
        _documents,
        f"""WITH {_PRICED}, sums AS (SELECT run_id, count(*) AS n, count(*) FILTER (priced) AS p, CAST(sum(total_cost) AS DECIMAL(28,12)) AS total FROM costs GROUP BY run_id),
        reasons AS (SELECT run_id, unpriced_reason, count(*) AS n FROM costs WHERE unpriced_reason IS NOT NULL GROUP BY ALL),
        top AS (SELECT run_id, unpriced_reason FROM reasons QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC, unpriced_reason) = 1)
        SELECT run_id, '{{"run_id":"' || run_id || '","n_units":' || n || ',"n_priced":' || p || ',"total_cost":' || coalesce('"' || CAST(total AS STRING) || '"', 'null')
          || ',"priced":' || CAST(p = n AND p > 0 AS STRING) || ',"unpriced_reason":'
          || coalesce('"' || CASE WHEN p = 0 THEN unpriced_reason WHEN p < n THEN 'partial_coverage' END || '"', 'null') || '}}' AS document
        FROM sums LEFT JOIN top USING (run_id)""",
        "case_results", "prices",
    ),
    entry("run_documents", _whole_documents, _DOCUMENT_SQL, "case_results", "evaluations", "prices"),
    entry(
        "case_rows",
        _whole_rows,
        f"""WITH {_PRICED} SELECT run_id, case_id, case_hash, status, passed, {r("score", "score")}, CAST(event_id % 3 + 1 AS INTEGER) AS attempts, category, array_to_string(tags, ',') AS tags, {r("latency_ms", "latency_ms")},
          {r("latency_ms + 100", "total_latency_ms")}, input_tokens, output_tokens, input_tokens + output_tokens AS total_tokens, CAST(total_cost AS STRING) AS total_cost, CAST(judge_cost AS STRING) AS judge_cost, priced, unpriced_reason, error_kind,
          strftime(completed_at - INTERVAL 2 MINUTE, '%Y-%m-%dT%H:%M:%S.%fZ') AS started_at, strftime(completed_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS completed_at FROM costs""",
        "case_results", "prices",
    ),
    entry(
        "expected_text",
        _expected,
        "SELECT event_id, CASE event_id % 5 WHEN 1 THEN event_type WHEN 2 THEN CAST(user_id AS STRING) WHEN 3 THEN 'true' END AS expected FROM events",
    ),
]
