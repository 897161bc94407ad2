"""Cases with evaluators of many types, as queries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from evalmill.operators import mixed
from evalmill.plans.shared import entry, r
from evalmill.sources.views import view

_NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"
_RUBRIC = {"criteria": [{"id": "accuracy", "weight": 2}, {"id": "style"}], "scale": {"minimum": 1, "maximum": 5, "integral": True}}


def _spec(name, kind, params, weight=1.0, required=True, on_error="error"):
    parts = {"id": name, "type": kind, "params": json.dumps(params), "weight": weight, "required": required, "on_error": on_error}
    return parts


_SPECS = [
    [_spec("same", "exact_match_ci", {}, 2.0), _spec("words", "contains", {"values": ["the", "en", "zz"], "mode": "any"}, 1.0, False)],
    [
        _spec("form", "regex", {"pattern": r"(\w+)[^\w\s]*$", "group": 1}),
        _spec("figure", "numeric_tolerance", {"abs_tol": 0.01}, 3.0, True, "skip"),
        _spec("graded", "llm_judge", {**_RUBRIC, "pass_threshold": 3, "aggregation": "mean"}, 1.0, True, "fail"),
    ],
    [_spec("opinion", "llm_judge", _RUBRIC, 2.0, False), _spec("short", "regex", {"pattern": "a{e}|[[:digit:]]", "must_match": False}), _spec("odd", "no_such_type", {}, 1.0, False, "skip")],
]


def _cases(spark, sf):
    kind = (F.col("conv_id") + F.col("turn")) % 3
    specs = F.coalesce(*(F.when(kind == i, F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in one.items())) for one in s))) for i, s in enumerate(_SPECS)))
    expected = F.when(kind == 1, F.when(F.col("turn") % 2 == 0, F.concat((F.col("turn") * 3).cast("string"), F.lit(".5")))).otherwise(F.col("expected_text"))
    return view(spark, sf, "text_pairs").select(
        F.concat(F.lit("run-"), (F.col("conv_id") % 2).cast("string")).alias("run_id"), F.concat_ws("-", "conv_id", "turn").alias("case_id"),
        F.lit("acme").alias("provider"), F.when(F.col("turn") % 4 == 0, "a").otherwise("c").alias("model"),
        F.col("output_text").alias("output"), expected.alias("expected"), specs.alias("specs"), "conv_id", "turn",
    )


def _answers(spark, sf):
    """Three calls of two judges for each model-graded case; some are prose, some failed, some cases have none."""
    number = F.col("conv_id") + F.col("turn")
    cases = _cases(spark, sf).filter((number % 3 > 0) & (F.col("conv_id") % 7 > 0))
    calls = cases.withColumn("call", F.explode(F.array(*map(F.lit, range(3)))))
    score = lambda x: (1 + x % 5).cast("string")
    rated = F.concat(
        F.lit('{"criteria": [{"name": "accuracy", "score": '), score(F.col("conv_id") + F.col("call")),
        F.lit('}, {"name": "style", "score": '), score(F.col("turn") * 2 + F.col("call")), F.lit("}]}"),
    )
    answer = F.when(F.col("conv_id") % 11 == 0, None).when((F.col("conv_id") % 5 == 0) | ((F.col("call") == 1) & (F.col("turn") % 2 == 0)), "no rating").otherwise(rated)
    return calls.select(
        "run_id", "case_id", F.when(number % 3 == 1, "graded").otherwise("opinion").alias("evaluator_id"),
        F.when(F.col("call") < 2, "acme:a").otherwise("globex:b").alias("judge"), answer.alias("answer"),
    )


def _evaluated(spark, sf):
    return mixed.evaluations(_cases(spark, sf), _answers(spark, sf))


def _rows(spark, sf):
    columns = ("run_id", "case_id", "ord", "evaluator_id", "evaluator_type", "weight", "required", "status", "passed", "score", "raw", "error")
    found = _evaluated(spark, sf)
    said = {"captured": "$.captured", "agreement": "$.agreement", "self_preference": "$.self_preference_risk", "missing": "$.missing"}
    return found.select(*columns, *(F.get_json_object("detail", path).alias(name) for name, path in said.items()))


_TRIM = "lower(regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', ''))"
_SQL = f"""WITH pairs AS (
  SELECT *, (conv_id + turn) % 3 AS kind, concat('run-', CAST(conv_id % 2 AS STRING)) AS run_id, conv_id || '-' || turn AS case_id FROM v_text_pairs),
calls AS (
  SELECT run_id, case_id, kind, turn, CASE WHEN call < 2 THEN 'acme:a' ELSE 'globex:b' END AS judge, conv_id % 11 = 0 AS failed,
    CASE WHEN conv_id % 11 = 0 OR conv_id % 5 = 0 OR (call = 1 AND turn % 2 = 0) THEN NULL
      ELSE (2.0 * (1 + (conv_id + call) % 5) + 1 + (turn * 2 + call) % 5) / 3 END AS rating
  FROM (SELECT *, unnest(range(3)) AS call FROM pairs WHERE kind > 0 AND conv_id % 7 > 0)),
own AS (
  SELECT run_id, case_id, kind, judge, CASE WHEN kind = 1 THEN avg(rating) ELSE median(rating) END AS value, min(rating) AS least, max(rating) AS most,
    bool_and(failed) AS failed, bool_or(judge = 'acme:' || CASE WHEN turn % 4 = 0 THEN 'a' ELSE 'c' END) AS own_model
  FROM calls GROUP BY run_id, case_id, kind, judge),
panel AS (
  SELECT run_id, case_id, kind, median(value) AS v, max(most) - min(least) AS spread, bool_and(failed) AS failed, bool_or(own_model) AS own_model
  FROM own GROUP BY ALL),
graded AS (
  SELECT p.*, v, spread, own_model,
    CASE WHEN output_text IS NULL THEN 'no_output' WHEN failed IS NULL THEN 'judge_no_judgments' WHEN failed THEN 'judge_provider_error' WHEN v IS NULL THEN 'judge_unparseable' END AS error
  FROM pairs p LEFT JOIN panel USING (run_id, case_id, kind) WHERE kind > 0),
numbers AS (
  SELECT *, TRY_CAST(regexp_extract(output_text, '{_NUMBER}') AS DOUBLE) AS seen, CASE WHEN turn % 2 = 0 THEN turn * 3 + 0.5 END AS wanted FROM pairs WHERE kind = 1),
found AS (
  SELECT run_id, case_id, 0 AS ord, 'same' AS evaluator_id, 'exact_match_ci' AS evaluator_type, 2.0 AS weight, true AS required, 'error' AS on_error,
    CASE WHEN output_text IS NULL THEN 'no_output' WHEN expected_text IS NULL THEN 'missing_expected' END AS error,
    replace({_TRIM.format("output_text")}, 'ß', 'ss') = replace({_TRIM.format("expected_text")}, 'ß', 'ss') AS hit,
    CASE WHEN hit THEN 1.0 ELSE 0.0 END AS own_score, NULL AS own_raw, NULL AS captured, NULL AS agreement, NULL AS self_preference, NULL AS missing
  FROM pairs WHERE kind = 0
  UNION ALL
  SELECT run_id, case_id, 1, 'words', 'contains', 1.0, false, 'error', CASE WHEN output_text IS NULL THEN 'no_output' END, n > 0, n / 3, n, NULL, NULL, NULL,
    CASE WHEN output_text IS NOT NULL THEN '[' || array_to_string(list_transform(list_filter(['the', 'en', 'zz'], lambda w: NOT contains(output_text, w)), lambda w: '"' || w || '"'), ',') || ']' END
  FROM (SELECT *, contains(output_text, 'the')::INT + contains(output_text, 'en')::INT + contains(output_text, 'zz')::INT AS n FROM pairs WHERE kind = 0)
  UNION ALL
  SELECT run_id, case_id, 0, 'form', 'regex', 1.0, true, 'error', CASE WHEN output_text IS NULL THEN 'no_output' END, last <> '', CASE WHEN last <> '' THEN 1.0 ELSE 0.0 END, NULL, nullif(last, ''), NULL, NULL, NULL
  FROM (SELECT *, regexp_extract(output_text, '([\\pL\\pN_]+)[^\\pL\\pN_\\s]*\\n?$', 1) AS last FROM pairs WHERE kind = 1)
  UNION ALL
  SELECT run_id, case_id, 1, 'figure', 'numeric_tolerance', 3.0, true, 'skip', CASE WHEN output_text IS NULL THEN 'no_output' WHEN wanted IS NULL THEN 'missing_expected' END,
    coalesce(abs(seen - wanted) <= 0.01, false), CASE WHEN abs(seen - wanted) <= 0.01 THEN 1.0 ELSE 0.0 END, seen, NULL, NULL, NULL, NULL
  FROM numbers
  UNION ALL
  SELECT run_id, case_id, CASE WHEN kind = 1 THEN 2 ELSE 0 END, CASE WHEN kind = 1 THEN 'graded' ELSE 'opinion' END, 'llm_judge', CASE WHEN kind = 1 THEN 1.0 ELSE 2.0 END, kind = 1,
    CASE WHEN kind = 1 THEN 'fail' ELSE 'error' END, error, CASE WHEN kind = 1 THEN v >= 3 END, (v - 1) / 4, v, NULL,
    CASE WHEN error IS NULL THEN greatest(0.0, least(1.0, 1 - spread / 4)) END, CASE WHEN error IS NULL THEN CAST(own_model AS STRING) END, NULL
  FROM graded
  UNION ALL
  SELECT run_id, case_id, 1, 'short', 'regex', 1.0, true, 'error', CASE WHEN output_text IS NULL THEN 'no_output' END, hit, CASE WHEN hit THEN 1.0 ELSE 0.0 END, NULL, NULL, NULL, NULL, NULL
  FROM (SELECT *, NOT regexp_matches(output_text, 'a\\{{e\\}}|[\\[:digt]\\]') AS hit FROM pairs WHERE kind = 2)
  UNION ALL
  SELECT run_id, case_id, 2, 'odd', 'no_such_type', 1.0, false, 'skip', 'bad_spec', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM pairs WHERE kind = 2),
results AS (
  SELECT run_id, case_id, CAST(ord AS INTEGER) AS ord, evaluator_id, evaluator_type, CAST(weight AS DOUBLE) AS weight, required,
    CASE WHEN error IS NULL THEN CASE WHEN coalesce(hit, true) THEN 'passed' ELSE 'failed' END WHEN on_error = 'fail' THEN 'failed' WHEN on_error = 'skip' THEN 'skipped' ELSE 'error' END AS status,
    CASE WHEN error IS NULL THEN hit WHEN on_error = 'fail' THEN false END AS passed,
    CAST(CASE WHEN error IS NULL THEN own_score WHEN on_error = 'fail' THEN 0 END AS DOUBLE) AS score, CAST(CASE WHEN error IS NULL THEN own_raw END AS DOUBLE) AS raw,
    error, captured, agreement, self_preference, missing
  FROM found)
"""

ENTRIES = [
    entry(
        "mixed_evaluations",
        lambda s, d: _rows(s, d).withColumn("agreement", F.col("agreement").cast("double")),
        _SQL + f"SELECT run_id, case_id, ord, evaluator_id, evaluator_type, weight, required, status, passed, {r('score', 'score')}, {r('raw', 'raw')}, error, captured, "
        f"{r('CAST(agreement AS DOUBLE)', 'agreement')}, self_preference, missing FROM results",
        "text_pairs",
    ),
    entry(
        "mixed_verdicts",
        lambda s, d: mixed.case_results(_evaluated(s, d)),
        _SQL + f"""SELECT run_id, case_id, bool_and(passed) FILTER (required AND passed IS NOT NULL) AS passed,
        {r("CASE WHEN sum(weight) FILTER (score IS NOT NULL) > 0 THEN sum(score * weight) / sum(weight) FILTER (score IS NOT NULL) END", "score")},
        CASE WHEN bool_or(status = 'error') THEN 'error' ELSE 'ok' END AS status FROM results GROUP BY ALL""",
        "text_pairs",
    ),
]
