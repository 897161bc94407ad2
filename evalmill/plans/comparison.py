"""Two runs against each other, policies over them, and folds of evaluations, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmill.operators import compare, policy, rollup, verdicts
from evalmill.plans.shared import OUTCOME, entry, r, rate_columns, wilson_high, wilson_low
from evalmill.sources.views import view

BASELINE, CANDIDATE = "run-0", "run-1"


def _two_runs(spark, sf):
    """Both runs, each without some of the other's cases."""
    gone = ((F.col("run_no") == 0) & (F.col("case_no") % 50 == 7)) | ((F.col("run_no") == 1) & (F.col("case_no") % 50 == 9))
    return view(spark, sf, "case_results").filter((F.col("run_no") < 2) & ~gone)


def _pairs(spark, sf):
    return compare.pair_runs(_two_runs(spark, sf), BASELINE, CANDIDATE)


_TWO = "two AS (SELECT *, {outcome} AS outcome, CASE WHEN status = 'ok' THEN score END AS ok_score FROM v_case_results WHERE run_no < 2 AND NOT (run_no = 0 AND case_no % 50 = 7) AND NOT (run_no = 1 AND case_no % 50 = 9))".format(
    outcome=OUTCOME["exclude"]
)
_PAIRS = f"""{_TWO},
pairs AS (
  SELECT coalesce(b.case_id, c.case_id) AS case_id,
    CASE WHEN c.case_id IS NULL THEN 'only_in_baseline' WHEN b.case_id IS NULL THEN 'only_in_candidate'
      WHEN b.case_hash = c.case_hash THEN 'paired' ELSE 'changed' END AS kind,
    b.outcome AS b_outcome, c.outcome AS c_outcome, b.ok_score AS b_score, c.ok_score AS c_score, c.ok_score - b.ok_score AS score_delta
  FROM (SELECT * FROM two WHERE run_no = 0) b FULL JOIN (SELECT * FROM two WHERE run_no = 1) c ON b.case_id = c.case_id)"""

# The table's cells, then the statistics by their formulas.
_CONCORDANCE = f"""WITH {_PAIRS}, t AS (
  SELECT count(*) FILTER (b_outcome AND c_outcome) AS a, count(*) FILTER (b_outcome AND NOT c_outcome) AS b,
    count(*) FILTER (NOT b_outcome AND c_outcome) AS c, count(*) FILTER (NOT b_outcome AND NOT c_outcome) AS d
  FROM pairs WHERE kind = 'paired' AND b_outcome IS NOT NULL AND c_outcome IS NOT NULL),
w AS (
  SELECT *, a + b + c + d AS n, CAST(a + b AS DOUBLE) / (a + b + c + d) AS p1, CAST(a + c AS DOUBLE) / (a + b + c + d) AS p2,
    {wilson_low("a + b", "a + b + c + d")} AS l1, {wilson_high("a + b", "a + b + c + d")} AS u1,
    {wilson_low("a + c", "a + b + c + d")} AS l2, {wilson_high("a + c", "a + b + c + d")} AS u2,
    CASE WHEN CAST(a + b AS DOUBLE) * (c + d) * (a + c) * (b + d) > 0
      THEN (CAST(a AS DOUBLE) * d - CAST(b AS DOUBLE) * c) / sqrt(CAST(a + b AS DOUBLE) * (c + d) * (a + c) * (b + d)) ELSE 0.0 END AS phi
  FROM t),
stats AS (SELECT a AS both_pass, b AS baseline_only, c AS candidate_only, d AS neither, n AS n_paired, p1 AS baseline_rate, p2 AS candidate_rate, phi,
  -((p1 - p2) + sqrt(greatest(0.0, (p1 - l1) ** 2 - 2 * phi * (p1 - l1) * (u2 - p2) + (u2 - p2) ** 2))) AS unused,
  -((p1 - p2) + sqrt(greatest(0.0, (u1 - p1) ** 2 - 2 * phi * (u1 - p1) * (p2 - l2) + (p2 - l2) ** 2))) AS ci_low,
  -((p1 - p2) - sqrt(greatest(0.0, (p1 - l1) ** 2 - 2 * phi * (p1 - l1) * (u2 - p2) + (u2 - p2) ** 2))) AS ci_high,
  CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1),
    lambda k: exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2))))) END AS mcnemar_p FROM w)
"""

CHECKS = policy.Policy(
    (
        policy.Check("pass_rate", label="overall", max_absolute_decrease=0.02),
        policy.Check("category.*.pass_rate", label="by category", max_absolute_decrease=0.02, min_samples=10),
        policy.Check("evaluator_type.json_valid.pass_rate", max_absolute_decrease=0.0),
        policy.Check("evaluator_type.json_schema.pass_rate", label="schema", max_absolute_decrease=0.0),
        policy.Check("latency.p95_ms", "lower_is_better", max_relative_increase=0.01, min_samples=20),
        policy.Check("error_rate", "lower_is_better", max_value=0.01, severity="warning"),
        policy.Check("tag.slow.mean_score", min_value=0.1, max_relative_decrease=0.05),
        policy.Check("evaluator.*.mean_score", label="scores", max_absolute_decrease=0.001, max_absolute_increase=0.001),
        policy.Check("category.none.pass_rate", min_value=0.5),
        policy.Check("mean_score", min_value=0.05, min_samples=10_000_000),
    ),
    paired=False,
)


def _metrics(spark, sf):
    return policy.grain_metrics(_two_runs(spark, sf), view(spark, sf, "evaluations"))


def _metrics_of_rollups(spark, sf):
    cases, evaluations = _two_runs(spark, sf), view(spark, sf, "evaluations")
    return policy.long_metrics(
        rollup.run_rollup(cases), rollup.latency_stats(cases), rollup.by_category(cases), rollup.by_tag(cases), rollup.by_evaluator(evaluations)
    )


def _outcomes(spark, sf):
    bound = policy.expand(policy.checks_table(spark, CHECKS), _metrics(spark, sf), BASELINE, CANDIDATE)
    return policy.evaluate(bound).select("ord", "metric", "label", "status", "b_value", "c_value", "b_n", "c_n", "delta", "bound", "threshold")


def _verdict(spark, sf):
    return policy.with_exit_code(policy.verdict(_outcomes(spark, sf)))


def _report(spark, sf):
    """The default policy in paired mode, with its advisory figures and notes."""
    table = compare.concordance(_pairs(spark, sf))
    found = policy.compare_runs(_metrics(spark, sf), table, policy.DEFAULT_POLICY, BASELINE, CANDIDATE, policies_differ=True)
    columns = ("ord", "metric", "status", "mode", "b_value", "c_value", "b_n", "c_n", "delta_low", "delta_high", "mcnemar_p", "straddles", "overlaps", "significant")
    return found.outcomes.select(*columns, F.array_join("notes", "; ").alias("notes"))


def _bucket(scope: str, key: str, leaf: str, value: str, n: str, source: str, x: str = "NULL", d: str = "NULL") -> str:
    return (
        f"SELECT run_id, '{scope}' AS scope, {key} AS key, CAST(NULL AS STRING) AS kind, '{leaf}' AS leaf, CAST({value} AS DOUBLE) AS value, CAST({n} AS BIGINT) AS n, "
        f"CAST({x} AS BIGINT) AS x, CAST({d} AS BIGINT) AS d FROM {source} GROUP BY ALL"
    )


_OF_PASSES = ("count(*) FILTER (outcome)", "count(outcome)")
_RATE = "CASE WHEN count(outcome) > 0 THEN count(*) FILTER (outcome) / count(outcome) END"
_LATENCIES = ", ".join(f"quantile_cont(latency_ms, {p / 100}) AS p{p}_ms" for p in (50, 90, 95, 99))
_METRICS = f"""{_TWO},
tagged AS (SELECT *, unnest(tags) AS tag FROM two),
evals AS (SELECT *, CASE WHEN status <> 'error' THEN passed END AS outcome, CASE WHEN status <> 'error' THEN score END AS ok_score FROM v_evaluations),
kinds AS (SELECT run_id, evaluator_id, min(evaluator_type) AS kind FROM evals GROUP BY ALL),
slow AS (SELECT run_id, count(*) AS n, avg(latency_ms) AS mean_ms, {_LATENCIES}, max(latency_ms) AS max_ms FROM two WHERE status = 'ok' GROUP BY run_id),
metrics AS (
  {_bucket("run", "''", "pass_rate", _RATE, "count(outcome)", "two", *_OF_PASSES)}
  UNION ALL {_bucket("run", "''", "error_rate", "count(*) FILTER (status <> 'ok') / count(*)", "count(*)", "two", "count(*) FILTER (status <> 'ok')", "count(*)")}
  UNION ALL {_bucket("run", "''", "mean_score", "avg(ok_score)", "count(ok_score)", "two")}
  UNION ALL {_bucket("run", "''", "median_score", "median(ok_score)", "count(ok_score)", "two")}
  UNION ALL SELECT run_id, 'latency', '', NULL, leaf, value, n, NULL, NULL FROM (UNPIVOT slow ON mean_ms, p50_ms, p90_ms, p95_ms, p99_ms, max_ms INTO NAME leaf VALUE value)
  UNION ALL {_bucket("category", "category", "pass_rate", _RATE, "count(*)", "two WHERE category IS NOT NULL", *_OF_PASSES)}
  UNION ALL {_bucket("category", "category", "mean_score", "avg(ok_score)", "count(*)", "two WHERE category IS NOT NULL")}
  UNION ALL {_bucket("tag", "tag", "pass_rate", _RATE, "count(*)", "tagged", *_OF_PASSES)}
  UNION ALL {_bucket("tag", "tag", "mean_score", "avg(ok_score)", "count(*)", "tagged")}
  UNION ALL SELECT e.* REPLACE (k.kind AS kind) FROM ({_bucket("evaluator", "evaluator_id", "pass_rate", _RATE, "count(outcome)", "evals", *_OF_PASSES)}) e
    JOIN kinds k ON k.run_id = e.run_id AND k.evaluator_id = e.key
  UNION ALL SELECT e.* REPLACE (k.kind AS kind) FROM ({_bucket("evaluator", "evaluator_id", "mean_score", "avg(ok_score)", "count(*)", "evals")}) e
    JOIN kinds k ON k.run_id = e.run_id AND k.evaluator_id = e.key)"""


def _literal(value) -> str:
    return "NULL" if value is None else repr(value) if not isinstance(value, str) else f"'{value}'"


def _check_rows(checks) -> str:
    return ", ".join(
        "({})".format(", ".join(map(_literal, (i, c.metric, *policy.parse_path(c.metric), c.label, c.severity, c.min_samples, *(getattr(c, b) for b in policy.BOUNDS)))))
        for i, c in enumerate(checks)
    )


_CLOSE = "(abs({a} - {b}) <= greatest(1e-9 * greatest(abs({a}), abs({b})), 1e-12))"


def _beyond(a: str, sign: str, b: str) -> str:
    return f"({a} {sign} {b} AND NOT {_CLOSE.format(a=f'({a})', b=f'({b})')})"


_BOUND_SQL = {
    "min_value": ("min_value", _beyond("c_value", "<", "min_value")),
    "max_value": ("max_value", f"({_beyond('c_value', '>', 'max_value')} OR {_CLOSE.format(a='c_value', b='max_value')})"),
    "max_absolute_decrease": ("b_value - max_absolute_decrease", _beyond("(c_value - b_value)", "<", "-max_absolute_decrease")),
    "max_absolute_increase": ("b_value + max_absolute_increase", _beyond("(c_value - b_value)", ">", "max_absolute_increase")),
    "max_relative_decrease": ("b_value * (1 - max_relative_decrease)", _beyond("c_value", "<", "b_value * (1 - max_relative_decrease)")),
    "max_relative_increase": ("b_value * (1 + max_relative_increase)", _beyond("c_value", ">", "b_value * (1 + max_relative_increase)")),
}
_STATES = ", ".join(f"CASE WHEN {b} IS NOT NULL THEN {{'name': '{b}', 'threshold': CAST({t} AS DOUBLE), 'violated': {v}}} END" for b, (t, v) in _BOUND_SQL.items())
_ALL_OUTCOMES = f"""{_METRICS},
checks AS (SELECT * FROM (VALUES CHECK_ROWS) AS c(ord, path, scope, selector, leaf, label, severity, min_samples, {", ".join(policy.BOUNDS)})),
hits AS (
  SELECT c.ord, m.run_id, m.key, m.value, m.n, m.x, m.d FROM checks c JOIN metrics m ON m.leaf = c.leaf AND m.run_id IN ('run-0', 'run-1')
    AND m.scope = CASE WHEN c.scope = 'evaluator_type' THEN 'evaluator' ELSE c.scope END
    AND (c.selector IN ('', '*') OR CASE WHEN c.scope = 'evaluator_type' THEN m.kind = c.selector ELSE m.key = c.selector END)),
instances AS (
  SELECT c.*, h.* EXCLUDE (ord, b_n, c_n), coalesce(h.b_n, 0) AS b_n, coalesce(h.c_n, 0) AS c_n, c.scope NOT IN ('run', 'latency') AS many
  FROM checks c LEFT JOIN (
    SELECT ord, key, count(*) FILTER (run_id = 'run-0') > 0 AS b_there, count(*) FILTER (run_id = 'run-1') > 0 AS c_there,
      max(value) FILTER (run_id = 'run-0') AS b_value, max(value) FILTER (run_id = 'run-1') AS c_value,
      max(n) FILTER (run_id = 'run-0') AS b_n, max(n) FILTER (run_id = 'run-1') AS c_n, max(x) FILTER (run_id = 'run-0') AS b_x, max(d) FILTER (run_id = 'run-0') AS b_d,
      max(x) FILTER (run_id = 'run-1') AS c_x, max(d) FILTER (run_id = 'run-1') AS c_d FROM hits GROUP BY ord, key) h USING (ord)),
BOUND,
gated AS (
  SELECT *, list_filter([{_STATES}], lambda s: s IS NOT NULL) AS states,
    CASE WHEN many AND NOT coalesce(b_there AND c_there, false) THEN 'insufficient_data'
      WHEN b_value IS NULL AND c_value IS NULL THEN 'insufficient_data'
      WHEN c_value IS NULL OR (b_value IS NULL AND coalesce(max_absolute_decrease, max_absolute_increase, max_relative_decrease, max_relative_increase) IS NOT NULL) THEN 'missing_metric'
      WHEN least(b_n, c_n) < min_samples THEN 'insufficient_data'
      WHEN coalesce(max_relative_decrease, max_relative_increase) IS NOT NULL AND b_value = 0 THEN 'insufficient_data' END AS gate
  FROM bound),
outcomes AS (
  SELECT *, list_filter(states, lambda s: s.violated)[1] AS breach, coalesce(list_filter(states, lambda s: s.violated)[1], states[1]) AS shown,
    CASE WHEN many AND key IS NOT NULL THEN concat_ws('.', CASE WHEN scope = 'evaluator_type' THEN 'evaluator' ELSE scope END, key, leaf) ELSE path END AS metric
  FROM gated),
final AS (
  SELECT ord, metric, CASE WHEN label IS NULL THEN metric WHEN many AND key IS NOT NULL THEN label || ' (' || key || ')' ELSE label END AS label,
    CASE WHEN gate IS NOT NULL THEN gate WHEN breach IS NULL THEN 'passed' WHEN severity = 'warning' THEN 'warning' ELSE 'failed' END AS status,
    {r("b_value", "b_value")}, {r("c_value", "c_value")}, CAST(b_n AS BIGINT) AS b_n, CAST(c_n AS BIGINT) AS c_n, {r("c_value - b_value", "delta")},
    CASE WHEN gate IS NULL THEN shown.name END AS bound, {r("CASE WHEN gate IS NULL THEN shown.threshold END", "threshold")} FROM outcomes)"""
_OUTCOMES = _ALL_OUTCOMES.replace("CHECK_ROWS", _check_rows(CHECKS.checks)).replace("BOUND,", "bound AS (SELECT * FROM instances),")

# The default policy in paired mode: the overall pass rate is that of the paired cases.
_PAIRED = """paired AS (
  SELECT i.*, path = 'pass_rate' AND n_paired >= 1 AS used, n_paired, stats.ci_low, stats.ci_high, baseline_rate, candidate_rate, stats.mcnemar_p FROM instances i CROSS JOIN stats),
bound AS (
  SELECT * REPLACE (CASE WHEN used THEN baseline_rate ELSE b_value END AS b_value, CASE WHEN used THEN candidate_rate ELSE c_value END AS c_value,
    CASE WHEN used THEN n_paired ELSE b_n END AS b_n, CASE WHEN used THEN n_paired ELSE c_n END AS c_n), b_n AS b_all, c_n AS c_all FROM paired),"""
_DEFAULT = (_CONCORDANCE.rstrip() + "," + _ALL_OUTCOMES.removeprefix(_TWO + ",")).replace("CHECK_ROWS", _check_rows(policy.DEFAULT_POLICY.checks)).replace("BOUND,", _PAIRED)
_REPORT_SQL = f"""{_DEFAULT},
told AS (
  SELECT *, CASE WHEN gate IS NOT NULL THEN gate WHEN breach IS NULL THEN 'passed' ELSE 'failed' END AS status,
    used AND ci_low < -max_absolute_decrease AND -max_absolute_decrease < ci_high AS straddles,
    NOT used AND coalesce({wilson_low("b_x", "b_d")} <= {wilson_high("c_x", "c_d")} AND {wilson_low("c_x", "c_d")} <= {wilson_high("b_x", "b_d")}, false) AS shared,
    CASE WHEN many AND NOT coalesce(b_there OR c_there, false) THEN 'neither run has ' || CASE selector WHEN '*' THEN 'any instance' ELSE chr(39) || selector || chr(39) END || ' under ' || scope
      WHEN many AND NOT coalesce(b_there AND c_there, false) THEN 'only the ' || CASE WHEN c_there THEN 'candidate' ELSE 'baseline' END || ' run has it'
      WHEN b_value IS NULL AND c_value IS NULL THEN 'neither run reports it' WHEN gate = 'missing_metric' THEN 'one run does not report it'
      WHEN least(b_n, c_n) < min_samples THEN 'samples ' || b_n || ' and ' || c_n || ' of ' || min_samples WHEN gate IS NOT NULL THEN 'a relative bound needs a baseline other than zero' END AS reason
  FROM outcomes)
SELECT ord, metric, status, CASE WHEN n_paired >= 1 THEN 'paired' ELSE 'unpaired' END AS mode, {r("b_value", "b_value")}, {r("c_value", "c_value")}, CAST(b_n AS BIGINT) AS b_n, CAST(c_n AS BIGINT) AS c_n,
  {r("CASE WHEN used THEN ci_low END", "delta_low")}, {r("CASE WHEN used THEN ci_high END", "delta_high")}, {r("CASE WHEN used THEN mcnemar_p END", "mcnemar_p")},
  coalesce(straddles, false) AS straddles, shared AS "overlaps", CASE WHEN used THEN mcnemar_p < 0.05 END AS significant,
  concat_ws('; ', CASE WHEN scope = 'latency' THEN '{policy.NOTES["latency"]}' END, CASE WHEN path = 'pass_rate' THEN '{policy.NOTES["policies"]}' END,
    CASE WHEN used AND (n_paired <> b_all OR n_paired <> c_all) THEN 'over the ' || n_paired || ' cases that both runs ran unchanged and reached a verdict on, of ' || b_all || ' and ' || c_all END,
    reason, CASE WHEN gate IS NULL AND straddles THEN CASE WHEN status = 'passed' THEN '{policy.NOTES["close"]}' ELSE '{policy.NOTES["unsure"]}' END END,
    CASE WHEN gate IS NULL AND shared THEN '{policy.NOTES["overlap"]}' END) AS notes
FROM told"""


def _warnings(spark, sf):
    flags = {
        "errors": F.col("status") == "error",
        "skips": F.col("status") == "skipped",
        "heavy_failures": (F.col("status") == "failed") & (F.col("weight") > 49),
    }
    return verdicts.run_warnings(view(spark, sf, "evaluations"), flags)


ENTRIES = [
    entry("pair_cases", _pairs, f"WITH {_PAIRS} SELECT case_id, kind, b_outcome, c_outcome, {r('b_score', 'b_score')}, {r('c_score', 'c_score')}, {r('score_delta', 'score_delta')} FROM pairs", "case_results"),
    entry("pair_counts", lambda s, d: compare.pair_counts(_pairs(s, d)), f"WITH {_PAIRS} SELECT kind, count(*) AS n FROM pairs GROUP BY kind", "case_results"),
    entry(
        "only_in_one_run",
        lambda s, d: _pairs(s, d).filter(F.col("kind").startswith("only")).select("case_id", "kind"),
        f"WITH {_PAIRS} SELECT case_id, kind FROM pairs WHERE kind LIKE 'only%'",
        "case_results",
    ),
    entry(
        "concordance",
        lambda s, d: compare.concordance(_pairs(s, d)),
        f"""{"WITH " + _CONCORDANCE[5:]} SELECT both_pass, baseline_only, candidate_only, neither, n_paired, {r("baseline_rate", "baseline_rate")}, {r("candidate_rate", "candidate_rate")},
          {r("phi", "phi")}, {r("ci_low", "ci_low")}, {r("ci_high", "ci_high")}, {r("mcnemar_p", "mcnemar_p")} FROM stats""",
        "case_results",
    ),
    entry(
        "flips",
        lambda s, d: compare.flips(_pairs(s, d)),
        f"""WITH {_PAIRS} SELECT case_id, CASE WHEN b_outcome AND NOT c_outcome THEN 'newly_failing' WHEN NOT b_outcome AND c_outcome THEN 'newly_passing' ELSE 'still_failing' END AS change
        FROM pairs WHERE kind = 'paired' AND b_outcome IS NOT NULL AND c_outcome IS NOT NULL AND NOT (b_outcome AND c_outcome)""",
        "case_results",
    ),
    entry(
        "largest_score_drops",
        lambda s, d: compare.largest_score_drops(_pairs(s, d)),
        f"""WITH {_PAIRS} SELECT case_id, {r("b_score", "b_score")}, {r("c_score", "c_score")}, round(score_delta, 9) AS score_delta FROM pairs
        WHERE kind = 'paired' AND score_delta < 0 ORDER BY pairs.score_delta, case_id LIMIT 5""",
        "case_results",
    ),
    entry(
        "metric_long",
        lambda s, d: _metrics(s, d).select("run_id", "scope", "key", "leaf", "value", "n").filter(F.col("run_id").isin(BASELINE, CANDIDATE)),
        f"WITH {_METRICS} SELECT run_id, scope, key, leaf, {r('value', 'value')}, n FROM metrics",
        "case_results", "evaluations",
    ),
    entry(
        "metric_long_rollups",
        lambda s, d: _metrics_of_rollups(s, d).select("run_id", "scope", "key", "leaf", "value", "n", "ci_low", "ci_high").filter(F.col("run_id").isin(BASELINE, CANDIDATE)),
        f"WITH {_METRICS} SELECT run_id, scope, key, leaf, {r('value', 'value')}, n, {r(wilson_low('x', 'd'), 'ci_low')}, {r(wilson_high('x', 'd'), 'ci_high')} FROM metrics",
        "case_results", "evaluations",
    ),
    entry("policy_checks", _outcomes, f"WITH {_OUTCOMES} SELECT * FROM final", "case_results", "evaluations"),
    entry(
        "policy_verdict",
        _verdict,
        f"""WITH {_OUTCOMES}, v AS (
          SELECT CASE WHEN count(*) FILTER (status IN ('failed', 'missing_metric')) > 0 THEN 'fail' WHEN count(*) FILTER (status = 'warning') > 0 THEN 'warn' ELSE 'pass' END AS verdict,
            {", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in ("passed", "warning", "failed", "missing_metric", "insufficient_data"))} FROM final)
        SELECT *, CASE verdict WHEN 'fail' THEN 4 WHEN 'incomparable' THEN 6 ELSE 0 END AS exit_code FROM v""",
        "case_results", "evaluations",
    ),
    entry("default_policy_report", _report, _REPORT_SQL, "case_results", "evaluations"),
    entry(
        "case_verdict_fold",
        lambda s, d: verdicts.case_verdicts(view(s, d, "evaluations")),
        f"""SELECT run_id, case_id, bool_and(passed) FILTER (required AND passed IS NOT NULL) AS passed,
          {r("CASE WHEN sum(weight) FILTER (score IS NOT NULL) > 0 THEN sum(score * weight) / sum(weight) FILTER (score IS NOT NULL) END", "score")},
          CASE WHEN bool_or(status = 'error') THEN 'error' ELSE 'ok' END AS status FROM v_evaluations GROUP BY run_id, case_id""",
        "evaluations",
    ),
    *(
        entry(
            f"case_verdict_on_error_{mode}",
            lambda s, d, mode=mode: verdicts.case_verdicts(verdicts.on_error(view(s, d, "evaluations"), mode)).groupBy("run_id", "status", "passed").agg(F.count(F.lit(1)).alias("n")),
            f"""WITH e AS (SELECT run_id, case_id, required, CASE WHEN status = 'error' THEN {'false' if mode == 'fail' else 'NULL'} ELSE passed END AS passed FROM v_evaluations),
            c AS (SELECT run_id, case_id, bool_and(passed) FILTER (required AND passed IS NOT NULL) AS passed FROM e GROUP BY ALL)
            SELECT run_id, 'ok' AS status, passed, count(*) AS n FROM c GROUP BY ALL""",
            "evaluations",
        )
        for mode in ("fail", "skip")
    ),
    entry(
        "run_final_status",
        lambda s, d: verdicts.run_states(view(s, d, "case_results"), ["run-5"], 0.15),
        """WITH c AS (SELECT run_id, count(*) AS n_cases, count(*) FILTER (status = 'ok') AS n_completed, count(*) FILTER (status <> 'ok') AS n_errors FROM v_case_results GROUP BY run_id)
        SELECT *, CASE WHEN run_id = 'run-5' THEN 'cancelled' WHEN n_errors / n_cases > 0.15 THEN 'failed' WHEN n_errors > 0 THEN 'partial' ELSE 'completed' END AS run_status FROM c""",
        "case_results",
    ),
    entry(
        "run_warnings",
        _warnings,
        """SELECT run_id, concat_ws(',', CASE WHEN bool_or(status = 'error') THEN 'errors' END, CASE WHEN bool_or(status = 'skipped') THEN 'skips' END,
          CASE WHEN bool_or(status = 'failed' AND weight > 49) THEN 'heavy_failures' END) AS warnings FROM v_evaluations GROUP BY run_id""",
        "evaluations",
    ),
    entry(
        "spec_catalogue",
        lambda s, d: verdicts.spec_catalogue(view(s, d, "evaluations")),
        "SELECT run_id, evaluator_type || ':' || evaluator_id AS spec, min(case_id) AS first_case FROM v_evaluations GROUP BY ALL",
        "evaluations",
    ),
]
