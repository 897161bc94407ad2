"""What the query modules share: entries, rounding, and SQL of common figures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.functions.stats import Z_95
from evalmill.sources.views import with_views

PLACES = 9


@dataclass(frozen=True)
class Entry:
    name: str
    query: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def entry(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None, *views: str) -> Entry:
    """A query with the DuckDB SQL that gives its rows; the views named are defined before the SQL."""
    return Entry(name, lambda spark, sf_dir: rounded(query(spark, sf_dir)), with_views(sql, *views) if sql and views else sql)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to nine places, so that the order of a sum doesn't show."""
    return df.select(*(F.round(c, PLACES).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes))


def r(expression: str, name: str) -> str:
    return f"round({expression}, {PLACES}) AS {name}"


def wilson_low(x: str, n: str) -> str:
    return _wilson(x, n, "-", "greatest(0.0, {})")


def wilson_high(x: str, n: str) -> str:
    return _wilson(x, n, "+", "least(1.0, {})")


def _wilson(x: str, n: str, sign: str, clamp: str) -> str:
    x, n, z = f"CAST({x} AS DOUBLE)", f"CAST({n} AS DOUBLE)", f"CAST({Z_95!r} AS DOUBLE)"
    p = f"({x} / {n})"
    center = f"({p} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n})"
    margin = f"{z} / (1 + {z} * {z} / {n}) * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n} * {n}))"
    return f"CASE WHEN {n} > 0 THEN {clamp.format(f'{center} {sign} {margin}')} END"


OUTCOME = {
    "exclude": "CASE WHEN status <> 'ok' THEN NULL ELSE passed END",
    "fail": "CASE WHEN status <> 'ok' THEN false ELSE passed END",
}


def rate_columns(outcome: str) -> str:
    x, n = f"count(*) FILTER ({outcome})", f"count({outcome})"
    return (
        f"{x} AS n_passed, {n} AS n_denominator, {r(f'CASE WHEN {n} > 0 THEN {x} / {n} END', 'pass_rate')}, "
        f"{r(wilson_low(x, n), 'ci_low')}, {r(wilson_high(x, n), 'ci_high')}"
    )
