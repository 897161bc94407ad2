"""Figures of large counts, and logs of one large provider, against plain versions."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from evalmill.functions import stats
from evalmill.operators import runs


def exact_p(b: int, c: int) -> float:
    n, term, total = b + c, 1, 0
    for k in range(min(b, c) + 1):
        total += term
        term = term * (n - k) // (k + 1)
    return min(1.0, float(2 * total * 10**40 // 2**n) / 1e40) if n else 1.0


def test_mcnemar_of_few_and_of_many_pairs(spark):
    pairs = [(0, 0), (0, 7), (3, 9), (40, 41), (999, 1100), (1000, 1001), (1001, 1100), (1500, 1500), (2500, 2900), (1200, 2000)]
    df = spark.createDataFrame(pairs, "b long, c long")
    for r in df.select("b", "c", stats.mcnemar_exact(F.col("b"), F.col("c")).alias("p")).collect():
        assert r["p"] == pytest.approx(exact_p(r["b"], r["c"]), rel=1e-8), r


def test_mcnemar_of_a_hundred_million_pairs(spark):
    df = spark.createDataFrame([(10**8, 10**8 + 30_000)], "b long, c long")
    found = df.select(stats.mcnemar_exact(F.col("b"), F.col("c")).alias("p")).first()["p"]
    # The normal limit of the binomial, with half a step of continuity.
    z = (15_000 - 0.5) / (math.sqrt(2 * 10**8 + 30_000) / 2)
    assert found == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-4)


def test_a_gate_over_many_hours(spark):
    rows = [(i, i % 2 if i % 11 else None, float(i * 500 % 40_000) + i / 100, float((i * 37) % 150) if i % 5 else None) for i in range(200)]
    found = runs.gate_closings(spark.createDataFrame(rows, "event_id int, provider int, at double, retry_after double")).collect()
    assert len(found) == len(rows)
    for r in found:
        until = [a + min(w or runs.USUAL_COOLDOWN, 120.0) for _, p, a, w in rows if p == r["provider"] and a <= r["at"]]
        assert r["closed_until"] == max(until)
