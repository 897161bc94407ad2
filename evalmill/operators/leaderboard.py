"""Leaderboards over stored roll-ups, and the listings that serve runs and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.functions.stats import wilson_interval
from evalmill.operators.scoring import TERMINAL

#: Runs that a leaderboard pools at most, newest first, and rows of a listing at most.
MOST_RUNS, MOST_ROWS = 2000, 500


def leaderboard(metrics: DataFrame, most_runs: int = MOST_RUNS) -> DataFrame:
    """By provider and model: pooled pass rate, median of the runs' p95, spend, and coverage by completed cases.

    ``metrics`` has a row for each run with a stored roll-up.
    """
    newest = metrics.orderBy(F.desc("finished_at"), "run_id").limit(most_runs)
    passed, n = F.sum("n_passed"), F.sum("n_denominator")
    low, high = wilson_interval(passed, n)
    priced_cases = F.sum(F.when(F.col("total_cost").isNotNull(), F.col("n_completed")))
    return newest.groupBy("provider", "model").agg(
        F.count(F.lit(1)).alias("n_runs"),
        passed.alias("n_passed"),
        n.alias("n_denominator"),
        F.try_divide(passed, n).alias("pass_rate"),
        low.alias("ci_low"),
        high.alias("ci_high"),
        F.median("p95_ms").alias("median_p95_ms"),
        F.sum("total_cost").cast("decimal(28,12)").alias("total_cost"),
        F.try_divide(F.sum("total_cost").cast("double"), priced_cases).alias("cost_per_case"),
        F.try_divide(F.sum(F.col("coverage") * F.col("n_completed")), F.sum("n_completed")).alias("coverage"),
        F.max("finished_at").alias("last_run_at"),
    )


def overview(board: DataFrame) -> DataFrame:
    """One row over a leaderboard: runs, spend, and the median of its medians."""
    return board.agg(
        F.sum("n_runs").alias("n_runs"),
        F.count(F.lit(1)).alias("n_models"),
        F.sum("total_cost").cast("decimal(28,12)").alias("total_cost"),
        F.median("median_p95_ms").alias("median_p95_ms"),
    )


def by_pass_rate(board: DataFrame) -> DataFrame:
    """The best first; models without a rate come last."""
    return board.orderBy(F.desc(F.coalesce("pass_rate", F.lit(-1.0))), "provider", "model")


def errors_by_count(breakdown: DataFrame) -> DataFrame:
    return breakdown.orderBy(F.desc("n"), "error")


def filtered_runs(runs: DataFrame, **equal) -> DataFrame:
    for column, value in equal.items():
        runs = runs.filter(F.col("created_at") >= value) if column == "since" else runs.filter(F.col(column) == value)
    return runs


def count_of(rows: DataFrame) -> DataFrame:
    """How many rows the pages of a listing share: one row, of the same filters without order and paging."""
    return rows.agg(F.count(F.lit(1)).alias("total"))


def list_runs(
    runs: DataFrame, metrics: DataFrame, verdicts: DataFrame, limit: int = 50, offset: int = 0, newest: bool = True, **equal
) -> DataFrame:
    """A page of runs with their pass rate: the stored one where a roll-up exists, else from the verdicts.

    ``metrics`` and ``verdicts`` have run_id and pass_rate; a stored null stays null.
    """
    rows = filtered_runs(runs, **equal)
    m = metrics.select(F.col("run_id").alias("m_run"), F.col("pass_rate").alias("stored"))
    v = verdicts.select(F.col("run_id").alias("v_run"), F.col("pass_rate").alias("computed"))
    joined = rows.join(m, rows["run_id"] == m["m_run"], "left").join(v, rows["run_id"] == v["v_run"], "left")
    rate = F.when(F.col("m_run").isNotNull(), F.col("stored")).otherwise(F.col("computed"))
    out = joined.select(*(rows[c] for c in rows.columns), rate.alias("pass_rate"), F.col("m_run").isNotNull().alias("has_rollup"))
    order = F.desc("created_at") if newest else F.asc("created_at")
    return out.orderBy(order, "run_id").offset(offset).limit(min(limit, MOST_ROWS))


def list_cases(
    cases: DataFrame, run_id: str, status: str | None = None, passed: bool | None = None, category: str | None = None,
    query: str | None = None, tag: str | None = None, limit: int = 50, offset: int = 0,
) -> DataFrame:
    """A page of a run's cases, in their order. All filters, that of the tag too, come before paging."""
    rows = filtered_cases(cases, run_id, status, passed, category, query, tag)
    return rows.orderBy("case_id").offset(offset).limit(min(limit, MOST_ROWS))


def filtered_cases(
    cases: DataFrame, run_id: str, status: str | None = None, passed: bool | None = None, category: str | None = None,
    query: str | None = None, tag: str | None = None,
) -> DataFrame:
    rows = cases.filter(F.col("run_id") == run_id)
    for column, value in (("status", status), ("passed", passed), ("category", category)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    if query is not None:
        rows = rows.filter(F.col("case_id").ilike(f"%{query}%"))
    if tag is not None:
        rows = rows.filter(F.array_contains("tags", tag))
    return rows


def is_terminal(status: str = "status"):
    return F.col(status).isin(*TERMINAL)


def model_catalogue(advertised: DataFrame, priced: DataFrame) -> DataFrame:
    """Advertised models with their price entry, and exact price entries that nobody advertises."""
    p = priced.select(F.col("provider").alias("p_provider"), F.col("model").alias("p_model"), "match", "input_per_mtok")
    exact = p.filter("match = 'exact'")
    known = advertised.join(exact, (F.col("provider") == F.col("p_provider")) & (F.col("model") == F.col("p_model")), "left").select(
        "provider", "model", F.lit(True).alias("advertised"), "input_per_mtok"
    )
    more = p.join(advertised, (F.col("provider") == F.col("p_provider")) & (F.col("model") == F.col("p_model")), "left_anti").select(
        F.col("p_provider").alias("provider"), F.col("p_model").alias("model"), F.lit(False).alias("advertised"), "input_per_mtok"
    )
    return known.unionByName(more)
