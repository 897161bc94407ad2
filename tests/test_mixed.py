"""Mixed evaluators as fixed cases, written from what each must say."""

from __future__ import annotations

import json

import pytest

from evalmill.operators import mixed

CASES = f"run_id string, case_id string, provider string, model string, output string, expected string, specs array<{mixed.SPEC}>"
ANSWERS = "run_id string, case_id string, evaluator_id string, judge string, answer string"


def spec(name, kind, params="{}", weight=1.0, required=True, on_error="error"):
    return (name, kind, params if isinstance(params, str) else json.dumps(params), weight, required, on_error)


def answer(*scores):
    return json.dumps({"criteria": [{"name": n, "score": s} for n, s in zip(("a", "b"), scores, strict=True)]})


def evaluated(spark, cases, answers=()):
    found = mixed.evaluations(spark.createDataFrame(cases, CASES), spark.createDataFrame(list(answers), ANSWERS))
    return {(r.case_id, r.evaluator_id): r for r in found.collect()}, found


RUBRIC = {"criteria": [{"id": "a", "weight": 3}, {"id": "b"}]}


def test_types_and_parameters_are_kept_apart(spark):
    specs = [spec("near", "numeric_tolerance", {"abs_tol": 1}), spec("far", "numeric_tolerance", {"abs_tol": 10}), spec("same", "exact_match")]
    cases = [("r", "c1", "p", "m", "15", "10", specs), ("r", "c2", "p", "m", "10", "10", specs[:2]), ("r", "c3", "p", "m", None, "1", specs[2:]), ("r", "c4", "p", "m", "x", "y", [])]
    rows, found = evaluated(spark, cases)
    assert {k: r.passed for k, r in rows.items()} == {
        ("c1", "near"): False, ("c1", "far"): True, ("c1", "same"): False, ("c2", "near"): True, ("c2", "far"): True, ("c3", "same"): None,
    }
    assert rows["c3", "same"].error == "no_output"
    verdicts = {r.case_id: (r.passed, r.score, r.status) for r in mixed.case_results(found).collect()}
    assert verdicts == {"c1": (False, pytest.approx(1 / 3), "ok"), "c2": (True, 1.0, "ok"), "c3": (None, None, "error")}


def test_judges_are_put_together_before_a_panel(spark):
    specs = [spec("j", "llm_judge", {**RUBRIC, "aggregation": "mean", "pass_threshold": 3.5}), spec("o", "llm_judge", {**RUBRIC, "high_variance_threshold": 0.5})]
    calls = [("x:1", answer(5, 5)), ("x:1", answer(1, 1)), ("x:1", "prose"), ("p:m", answer(4, 4))]
    answers = [("r", "c", name, judge, said) for name in "jo" for judge, said in calls]
    rows, _ = evaluated(spark, [("r", "c", "p", "m", "out", None, specs)], answers)
    graded, opinion = rows["c", "j"], rows["c", "o"]
    # Judge x:1 has 5 and 1, so 3; judge p:m has 4; the panel's median is 3.5 of 1 to 5.
    assert (graded.status, graded.passed, graded.raw, graded.score) == ("passed", True, 3.5, 0.625)
    assert (opinion.status, opinion.passed, opinion.raw) == ("passed", None, 3.5)
    assert json.loads(graded.detail) == {
        "n_judges": 2, "parse_failures": 1, "agreement": 0.0, "high_variance": True, "judge_disagreement": False, "self_preference_risk": True,
    }
    assert json.loads(opinion.detail)["judge_disagreement"] is True


def test_judgements_that_fail_tell_why(spark):
    graded = [spec("j", "llm_judge", {**RUBRIC, "pass_threshold": 3})]
    cases = [("r", c, "p", "m", None if c == "silent" else "out", None, graded) for c in ("silent", "alone", "down", "prose", "partly")]
    answers = [("r", "silent", "j", "x:1", answer(3, 3)), ("r", "down", "j", "x:1", None), ("r", "prose", "j", "x:1", "well"), ("r", "prose", "j", "x:1", None)]
    answers += [("r", "partly", "j", "x:1", None), ("r", "partly", "j", "y:1", answer(2, 3)), ("r", "partly", "other", "y:1", answer(5, 5))]
    rows, _ = evaluated(spark, cases, answers)
    assert {c: r.error for (c, _), r in rows.items()} == {
        "silent": "no_output", "alone": "judge_no_judgments", "down": "judge_provider_error", "prose": "judge_unparseable", "partly": None,
    }
    assert rows["partly", "j"].raw == 2.25 and rows["partly", "j"].passed is False
    alone, _ = evaluated(spark, cases[:2])
    assert {r.error for r in alone.values()} == {"no_output", "judge_no_judgments"}


@pytest.mark.parametrize(
    ("kind", "params", "message"),
    [("none", {}, "unknown evaluator type"), ("regex", {"pattern": "("}, "missing"), ("regex", "[]", "no object"), ("contains", {"values": []}, "values"),
     ("exact_match", "{", "Expecting"), ("llm_judge", {**RUBRIC, "pass_threshold": 9}, "scale"), ("llm_judge", {"criteria": [{"id": "a"}, {"id": "a"}]}, "repeated"),
     ("llm_judge", {"criteria": [{"id": "a", "weight": 0}]}, "weights"), ("llm_judge", {**RUBRIC, "aggregation": "max"}, "aggregation"), (None, None, "unknown")],
)
def test_a_spec_that_cannot_be_built_is_an_error_of_its_rows(spark, kind, params, message):
    params = params if params is None or isinstance(params, str) else json.dumps(params)
    specs = [(mode, kind, params, None, None, mode) for mode in ("error", "fail", "skip")] + [("fine", "exact_match", None, None, None, None)]
    rows, _ = evaluated(spark, [("r", "c", "p", "m", "a", "a", specs)])
    assert all(rows["c", mode].error == "bad_spec" and message in json.loads(rows["c", mode].detail)["message"] for mode in ("error", "fail", "skip"))
    assert [(rows["c", m].status, rows["c", m].passed, rows["c", m].score) for m in ("error", "fail", "skip")] == [("error", None, None), ("failed", False, 0.0), ("skipped", None, None)]
    assert rows["c", "fine"].passed is True and rows["c", "fine"].weight == 1.0 and rows["c", "fine"].required is True


def test_no_cases(spark):
    assert evaluated(spark, [])[0] == {}
