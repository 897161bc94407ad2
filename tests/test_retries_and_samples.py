"""Retry budgets and seeded samples as fixed cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evalmill.operators import cases, runs

ATTEMPTS = "call_id string, attempt int, kind string, retry_after double, draw double"


def chains(spark, rows, **policy):
    df = spark.createDataFrame(rows, ATTEMPTS).repartition(3)
    found = runs.retry_chains(df, runs.RetryPolicy(**policy), F.col("draw")).collect()
    return {(r.call_id, r.attempt): (r.retried, r.delay_s, r.waited_s, r.reason) for r in found}


def test_each_wait_depends_on_those_granted_before(spark):
    rows = [("a", i, "server", None, 0.5) for i in range(1, 7)] + [("b", 1, "auth", None, 0.5), ("b", 2, "server", None, 0.5), ("c", 1, None, None, 0.5)]
    found = chains(spark, rows, jitter="none", total=3.0, tries=5)
    assert [found["a", i] for i in range(1, 7)] == [
        (True, 0.5, 0.5, None), (True, 1.0, 1.5, None), (False, None, 1.5, "over_budget"), (False, None, 1.5, "not_reached"),
        (False, None, 1.5, "not_reached"), (False, None, None, "not_reached"),
    ]
    assert found["b", 1][3] == "not_retryable" and found["b", 2][3] == "not_reached" and found["c", 1][3] == "not_retryable"


def test_a_budget_that_is_met_exactly_is_kept(spark):
    rows = [("a", i, "timeout", None, 0.0) for i in range(1, 4)]
    assert [chains(spark, rows, jitter="none", total=1.5)["a", i][3] for i in (1, 2, 3)] == [None, None, "over_budget"]
    assert [chains(spark, rows, jitter="none", tries=3)["a", i][3] for i in (1, 2, 3)] == [None, None, "exhausted"]


@pytest.mark.parametrize(("jitter", "wait"), [("none", 4.0), ("equal", 2.5), ("full", 1.0)])
def test_jitter_and_the_wait_that_a_vendor_names(spark, jitter, wait):
    rows = [("a", 1, "server", None, 0.25), ("b", 1, "rate_limit", 3.0, 0.25), ("c", 1, "rate_limit", -5.0, 0.25), ("a", 1, "server", None, 0.25)]
    found = chains(spark, rows, base=4.0, jitter=jitter)
    assert found["a", 1][1] == wait and found["b", 1][1] == max(wait, 3.0) and found["c", 1][1] == wait
    assert chains(spark, rows, base=4.0, jitter=jitter, respect_retry_after=False)["b", 1][1] == wait


def test_jitter_is_drawn_alike_for_the_same_seed(spark):
    df = spark.createDataFrame([(f"c{i}", 1, "server", None, None) for i in range(200)], ATTEMPTS)
    draws = lambda seed: sorted(r.delay_s for r in runs.retry_chains(df, runs.RetryPolicy(base=1.0), seed=seed).collect())
    assert draws(1) == draws(1) != draws(2) and 0 <= draws(1)[0] < 0.2 and 0.8 < draws(1)[-1] < 1
    with pytest.raises(ValueError, match="jitter"):
        runs.RetryPolicy(jitter="some")


@pytest.mark.parametrize(("sample", "seed"), [(7, 0), (250, 3), (0, 1)])
def test_the_sample_is_that_of_the_generator(spark, sample, seed):
    n = 100_000
    rows = spark.range(n).select(F.format_string("case-%06d", "id").alias("id"), (F.lit(n) - F.col("id")).alias("ord")).repartition(9)
    there = [f"case-{i:06d}" for i in range(n - 1, -1, -1)]
    found = cases.select_cases(rows, sample=sample, seed=seed)
    assert [r.id for r in found.collect()] == sorted(random.Random(seed).sample(there, sample))
    assert "case-0" not in found._jdf.queryExecution().analyzed().toString()


def test_a_sample_that_is_no_smaller_is_everything(spark):
    rows = spark.createDataFrame([("b", 1, ["x"]), ("a", 2, ["y"]), ("c", 3, ["x"])], "id string, ord int, tags array<string>")
    ids = lambda **how: [r.id for r in cases.select_cases(rows, **how).collect()]
    assert sorted(ids(sample=3)) == ["a", "b", "c"] and ids(sample=5, limit=2) == ["b", "a"]
    assert ids(tags=["x"], sample=1, seed=4) == random.Random(4).sample(["b", "c"], 1) and ids(sample=2, seed=1, limit=1) == sorted(random.Random(1).sample(["b", "a", "c"], 2))[:1]
    numbered = cases.with_ordinals(rows, "id").collect()
    assert sorted((r.id, r.ordinal) for r in numbered) == [("a", 0), ("b", 1), ("c", 2)]
