"""Cases that are judged by evaluators of many types, each with its own parameters, in one plan.

A case names its evaluators as specs: id, type, parameters as JSON, weight,
whether a pass is required, and what an error counts as. Specs are exploded to
one row each; the distinct ones, as many as a suite's author wrote, are built
once; every type then works on its own rows, and one union puts the results
together. Model-graded specs read the judges' answers from a table of calls.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.functions.stats import normalized_rating
from evalmill.operators import evaluators, judge, verdicts
from evalmill.session import stage

#: Distinct specs (type and parameters) that one plan holds at most: each is an expression of the plan.
MOST_SPECS = 1000
KEY = ("run_id", "case_id", "ord")
ROW = (*KEY, "evaluator_id", "evaluator_type", "params", "weight", "required", "on_error")
SPEC = "struct<id:string,type:string,params:string,weight:double,required:boolean,on_error:string>"
JUDGE = "llm_judge"
AGGREGATIONS = ("mean", "median", "majority", "min")


@dataclass(frozen=True)
class JudgeSpec:
    """How judges' answers become one score; ``pass_threshold`` is on the raw scale, and without it the result is a score only."""

    criteria: tuple[tuple[str, float], ...] = ()
    minimum: float = 1.0
    maximum: float = 5.0
    integral: bool = False
    aggregation: str = "median"
    high_variance_threshold: float = 1.0
    pass_threshold: float | None = None

    @staticmethod
    def of(params: dict[str, Any]) -> JudgeSpec:
        """From a spec's parameters; raises ``ValueError`` for what couldn't give a score that means something."""
        criteria = tuple((c["id"], float(c.get("weight", 1.0))) for c in params.get("criteria", []))
        scale = params.get("scale", {})
        found = JudgeSpec(
            criteria,
            float(scale.get("minimum", 1.0)),
            float(scale.get("maximum", 5.0)),
            bool(scale.get("integral", False)),
            params.get("aggregation", "median"),
            float(params.get("high_variance_threshold", 1.0)),
            None if params.get("pass_threshold") is None else float(params["pass_threshold"]),
        )
        names = [name for name, _ in criteria]
        if repeated := sorted({n for n in names if names.count(n) > 1}):
            raise ValueError(f"repeated criteria: {', '.join(repeated)}")
        if criteria and not sum(w for _, w in criteria) > 0:
            raise ValueError("the criteria's weights must have a sum above zero")
        if not found.minimum < found.maximum or not math.isfinite(found.maximum - found.minimum):
            raise ValueError("the scale must have a range")
        if found.aggregation not in AGGREGATIONS:
            raise ValueError(f"unknown aggregation {found.aggregation!r}; known: {', '.join(AGGREGATIONS)}")
        if found.pass_threshold is not None and not found.minimum <= found.pass_threshold <= found.maximum:
            raise ValueError("pass_threshold is off the scale")
        return found


def spec_rows(cases: DataFrame) -> DataFrame:
    """A row for each case and spec, in the order in which the case names them."""
    spec = F.col("spec").cast(SPEC)
    rest = [c for c in cases.columns if c not in ("run_id", "case_id", "specs")]
    exploded = cases.select("run_id", "case_id", *rest, F.posexplode("specs").alias("ord", "spec"))
    return exploded.select(
        *KEY,
        spec["id"].alias("evaluator_id"),
        F.coalesce(spec["type"], F.lit("")).alias("evaluator_type"),
        F.coalesce(spec["params"], F.lit("{}")).alias("params"),
        F.coalesce(spec["weight"], F.lit(1.0)).alias("weight"),
        F.coalesce(spec["required"], F.lit(True)).alias("required"),
        F.coalesce(spec["on_error"], F.lit("error")).alias("on_error"),
        *rest,
    )


def _built(kind: str, params: str) -> evaluators.Evaluator | JudgeSpec | str:
    """What a spec stands for, or what is wrong with it."""
    try:
        read = json.loads(params)
        if not isinstance(read, dict):
            return "the parameters are no object"
        return JudgeSpec.of(read) if kind == JUDGE else evaluators.evaluator(kind, **read)
    except (ValueError, TypeError, KeyError, AttributeError, re.error, RecursionError) as e:
        return str(e)[:200] or type(e).__name__


def _bad(message: str) -> Column:
    detail = evaluators.as_detail(message=F.lit(message))
    return evaluators.error("bad_spec").withField("detail", detail)


def _by_type(rows: DataFrame, specs: dict[str, evaluators.Evaluator | str]) -> DataFrame:
    """Rows of one type: each is judged by the spec whose parameters it has. A spec's function sees its own rows only."""
    found = None
    for params, build in specs.items():
        mine = F.col("params") == params
        if isinstance(build, str):
            each = _bad(build)
        else:
            each = build(F.when(mine, F.col("output")), F.when(mine, F.col("expected")))
        found = F.when(mine, each) if found is None else found.when(mine, each)
    return rows.select(*ROW, found.alias("result"))


def judged(rows: DataFrame, answers: DataFrame, specs: dict[str, JudgeSpec | str]) -> DataFrame:
    """Rows of model-graded specs with their results.

    ``answers`` has run_id, case_id, evaluator_id, judge (provider:model) and
    answer, one row a call; an answer is null if the call failed. A judge's calls
    are put together first, then the judges: one that was asked more often
    doesn't count more.
    """
    good = {p: s for p, s in specs.items() if isinstance(s, JudgeSpec)}

    @F.pandas_udf("double")
    def rating(answer: pd.Series, params: pd.Series) -> pd.Series:
        def one(text: str | None, key: str) -> float | None:
            if text is None or key not in good:
                return None
            s = good[key]
            return judge.parse_verdict(text, dict(s.criteria), s.minimum, s.maximum, s.integral)["raw"]

        return pd.Series([one(a, p) for a, p in zip(answer, params, strict=True)], dtype="float64")

    def chosen(get, kind: str) -> Column:
        values = [F.when(F.col("params") == p, F.lit(get(s)).cast(kind)) for p, s in good.items()]
        return F.coalesce(*values, F.lit(None).cast(kind))

    key = ["run_id", "case_id", "evaluator_id"]
    said = answers.select(*(F.col(c).alias(f"a_{c}") for c in key), "judge", "answer")
    # Texts stay behind: only whether there is one is grouped.
    slim = rows.select(*ROW, "provider", "model", F.col("output").isNotNull().alias("there"))
    at = [slim[c].eqNullSafe(said[f"a_{c}"]) for c in key]
    calls = slim.join(said, at, "left").drop(*(f"a_{c}" for c in key))
    # NaN, which pandas has for a missing double, is no rating.
    raw = F.nanvl(rating("answer", "params"), F.lit(None).cast("double"))
    calls = calls.withColumn("raw", raw).withColumn("own_model", F.col("judge") == F.concat_ws(":", "provider", "model"))
    how = chosen(lambda s: s.aggregation, "string")
    per_judge = calls.groupBy(*ROW, "there", "judge").agg(
        *(judge.repetition_value(F.col("raw"), a).alias(a) for a in AGGREGATIONS),
        F.min("raw").alias("least"),
        F.max("raw").alias("most"),
        F.count("answer").alias("answered"),
        F.count("raw").alias("rated"),
        F.count("judge").alias("calls"),
        F.bool_or("own_model").alias("own_model"),
    )
    value = F.coalesce(*(F.when(how == a, F.col(a)) for a in AGGREGATIONS))
    panel = per_judge.withColumn("value", value).groupBy(*ROW, "there").agg(
        F.median("value").alias("raw_score"),
        (F.max("most") - F.min("least")).alias("dispersion"),
        (F.max("value") - F.min("value")).alias("judge_range"),
        F.count("value").alias("n_judges"),
        F.sum("rated").alias("rated"),
        F.sum("answered").alias("answered"),
        F.sum("calls").alias("calls"),
        F.bool_or("own_model").alias("own_model"),
    )
    low, high = chosen(lambda s: s.minimum, "double"), chosen(lambda s: s.maximum, "double")
    wide, least = chosen(lambda s: s.high_variance_threshold, "double"), chosen(lambda s: s.pass_threshold, "double")
    agreement = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("dispersion") / (high - low)))
    detail = evaluators.as_detail(
        n_judges=F.col("n_judges"),
        parse_failures=F.col("answered") - F.col("rated"),
        agreement=F.round(agreement, 9),
        high_variance=F.col("dispersion") > wide,
        judge_disagreement=(F.col("n_judges") > 1) & (F.col("judge_range") > wide),
        self_preference_risk=F.coalesce("own_model", F.lit(False)),
    )
    scored = evaluators.result(F.col("raw_score") >= least, normalized_rating(F.col("raw_score"), low, high), F.col("raw_score"), detail)
    opinion = scored.withField("status", F.lit("passed")).withField("passed", F.lit(None).cast("boolean"))
    found = (
        F.when(~F.col("there"), evaluators.error("no_output"))
        .when(F.col("calls") == 0, evaluators.error("judge_no_judgments"))
        .when((F.col("rated") == 0) & (F.col("answered") == 0), evaluators.error("judge_provider_error"))
        .when(F.col("rated") == 0, evaluators.error("judge_unparseable"))
        .when(least.isNull(), opinion)
        .otherwise(scored)
    )
    for params, spec in specs.items():
        if isinstance(spec, str):
            found = F.when(F.col("params") == params, _bad(spec)).otherwise(found)
    return panel.select(*ROW, found.alias("result"))


def evaluations(cases: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """One row for each case and spec: its key, the spec's id, type, weight and required, and the result's fields.

    ``cases`` has run_id, case_id, provider, model, output and expected (texts),
    and ``specs``, an array of the fields of ``SPEC``. A spec that can't be built
    is an error ``bad_spec`` of its rows. Errors are reshaped as the spec asks.
    """
    rows = stage(spec_rows(cases), "spec-rows")
    distinct = rows.select("evaluator_type", "params").distinct().limit(MOST_SPECS + 1).collect()
    if len(distinct) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} distinct specs")
    by_type: dict[str, dict] = {}
    for r in sorted(distinct):
        by_type.setdefault(r.evaluator_type, {})[r.params] = _built(r.evaluator_type, r.params)
    parts = []
    for kind, specs in by_type.items():
        mine = rows.filter(F.col("evaluator_type") == kind)
        if kind == JUDGE:
            none = rows.sparkSession.createDataFrame([], "run_id string, case_id string, evaluator_id string, judge string, answer string")
            parts.append(judged(mine, none if answers is None else answers, specs))
        else:
            parts.append(_by_type(mine, specs))
    if not parts:
        parts = [rows.select(*ROW, evaluators.error("bad_spec").alias("result"))]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return _reshaped(found.select(*ROW, "result.*"))


def _reshaped(found: DataFrame) -> DataFrame:
    """Errors as each spec counts them: as errors, as failures, or not at all; ``error`` still tells what they were."""
    hit = F.col("status") == "error"
    failed, skipped = hit & (F.col("on_error") == "fail"), hit & (F.col("on_error") == "skip")
    changes = {
        "status": F.when(failed, "failed").when(skipped, "skipped").otherwise(F.col("status")),
        "passed": F.when(failed, F.lit(False)).otherwise(F.col("passed")),
        "score": F.when(failed, F.lit(0.0)).otherwise(F.col("score")),
    }
    return found.select(*(changes.get(c, F.col(c)).alias(c) for c in found.columns if c not in ("params", "on_error")))


def case_results(found: DataFrame) -> DataFrame:
    """Each case's verdict, weighted score and status."""
    return verdicts.case_verdicts(found)
