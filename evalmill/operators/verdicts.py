"""Folds of evaluations into case verdicts, and of cases into the state of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def case_verdicts(evaluations: DataFrame) -> DataFrame:
    """Per case: passed (all required verdicts; null without any), weighted score, and status."""
    counts = F.col("required") & F.col("passed").isNotNull()
    scored = F.col("score").isNotNull()
    weight = F.sum(F.when(scored, F.col("weight")))
    return evaluations.groupBy("run_id", "case_id").agg(
        F.bool_and(F.when(counts, F.col("passed"))).alias("passed"),
        F.when(weight > 0, F.sum(F.when(scored, F.col("score") * F.col("weight"))) / weight).alias("score"),
        F.when(F.bool_or(F.col("status") == "error"), "error").otherwise("ok").alias("status"),
    )


def on_error(evaluations: DataFrame, mode: str) -> DataFrame:
    """Reshape evaluations that ended in an error: keep, count as failed, or skip."""
    if mode == "error":
        return evaluations
    hit = F.col("status") == "error"
    failed = mode == "fail"
    changes = {
        "passed": F.when(hit, F.lit(False if failed else None).cast("boolean")).otherwise(F.col("passed")),
        "score": F.when(hit, F.lit(0.0 if failed else None).cast("double")).otherwise(F.col("score")),
        "status": F.when(hit, F.lit("failed" if failed else "skipped")).otherwise(F.col("status")),
    }
    return evaluations.select(*(changes.get(c, F.col(c)).alias(c) for c in evaluations.columns))


def final_status(cancelled: Column, n_errors: Column, n: Column, max_error_rate: float) -> Column:
    rate = F.coalesce(F.try_divide(n_errors, n), F.lit(0.0))
    return (
        F.when(cancelled, "cancelled")
        .when(rate > max_error_rate, "failed")
        .when(n_errors > 0, "partial")
        .otherwise("completed")
    )


def run_states(cases: DataFrame, cancelled_runs: list[str] | None = None, max_error_rate: float = 0.25) -> DataFrame:
    """Counters of each run and the status it ends in."""
    bad = F.count_if(F.col("status") != "ok")
    cancelled = F.col("run_id").isin(cancelled_runs) if cancelled_runs else F.lit(False)
    return cases.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.count_if(F.col("status") == "ok").alias("n_completed"),
        bad.alias("n_errors"),
    ).select(
        "run_id", "n_cases", "n_completed", "n_errors",
        final_status(cancelled, F.col("n_errors"), F.col("n_cases"), max_error_rate).alias("run_status"),
    )


def run_warnings(evaluations: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """For each run, the names of the conditions that any of its evaluations meets, in their given order."""
    seen = [F.bool_or(F.coalesce(c, F.lit(False))).alias(name) for name, c in flags.items()]
    names = F.array(*(F.when(F.col(name), F.lit(name)) for name in flags))
    found = F.filter(names, lambda x: x.isNotNull())
    return evaluations.groupBy("run_id").agg(*seen).select("run_id", F.array_join(found, ",").alias("warnings"))


def spec_catalogue(evaluations: DataFrame) -> DataFrame:
    """The distinct evaluators of each run by ``type:id``, in the order first seen."""
    return evaluations.groupBy("run_id", F.concat_ws(":", "evaluator_type", "evaluator_id").alias("spec")).agg(
        F.min(F.struct("case_id", "ord")).alias("first")
    ).select("run_id", "spec", F.col("first.case_id").alias("first_case"))
