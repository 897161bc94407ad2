"""The one definition of pass rates, and the predicates they rest on.

A case is errored when its status is not ``ok``. Under the policy ``exclude``
errored cases leave the denominator, under ``fail`` they join it as failures.
A case that isn't errored and has no verdict leaves it under both. An empty
denominator gives a null rate. Rows are values: unknown is null, never zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalmill.functions.stats import Z_95, wilson_interval

POLICIES = ("exclude", "fail")
TERMINAL = ("completed", "partial", "failed", "cancelled", "interrupted")


def checked_policy(policy: str, fallback: bool = False) -> str:
    """A known error policy; an unknown one raises, or becomes ``exclude`` in a listing."""
    if policy in POLICIES:
        return policy
    if fallback:
        return "exclude"
    raise ValueError(f"unknown error policy {policy!r}; known: {', '.join(POLICIES)}")


def errored(status: str = "status") -> Column:
    return F.col(status) != "ok"


def case_outcome(policy: str, status: str = "status", passed: str = "passed") -> Column:
    """True or false where the case counts, null where it leaves the denominator."""
    failed = F.lit(False) if checked_policy(policy) == "fail" else F.lit(None).cast("boolean")
    return F.when(errored(status), failed).otherwise(F.col(passed))


def rates(outcome: Column, z: float = Z_95) -> dict[str, Column]:
    """Aggregates n_passed, n_denominator, pass_rate, ci_low and ci_high of an outcome."""
    n_passed = F.count_if(F.coalesce(outcome, F.lit(False)))
    n = F.count(outcome)
    low, high = wilson_interval(n_passed, n, z)
    return {
        "n_passed": n_passed,
        "n_denominator": n,
        "pass_rate": F.try_divide(n_passed, n),
        "ci_low": low,
        "ci_high": high,
    }


def aliased(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


def is_score_only() -> Column:
    """An evaluation that passed without a verdict but with a score."""
    return (F.col("status") == "passed") & F.col("passed").isNull() & F.col("score").isNotNull()
