"""Stored records put together: cases with their parts, what a page counts, what judges cost, documents for export."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evalmill.operators import rollup
from evalmill.operators.pricing import case_costs, cost_rollup

_KEY = ("run_id", "case_id")


def nested_cases(cases: DataFrame, responses: DataFrame, evaluations: DataFrame) -> DataFrame:
    """``cases`` with ``response``, a struct or null, and ``evaluations``, a list in the order of their columns, empty if none.

    Both sides are one row a case before they are joined; a case's evaluations
    are as many as its suite has evaluators.
    """
    rest = [c for c in responses.columns if c not in _KEY]
    said = responses.select(*(F.col(c).alias(f"r_{c}") for c in _KEY), F.struct(*rest).alias("response"))
    parts = F.struct(*(c for c in evaluations.columns if c not in _KEY))
    lists = evaluations.groupBy(*(F.col(c).alias(f"e_{c}") for c in _KEY)).agg(F.array_sort(F.collect_list(parts)).alias("found"))
    both = lambda other, x: (cases["run_id"] == other[f"{x}_run_id"]) & (cases["case_id"] == other[f"{x}_case_id"])
    joined = cases.join(said, both(said, "r"), "left").join(lists, both(lists, "e"), "left")
    empty = F.array().cast(lists.schema["found"].dataType)
    return joined.select(*(cases[c] for c in cases.columns), "response", F.coalesce("found", empty).alias("evaluations"))


def evaluator_specs(cases: DataFrame) -> DataFrame:
    """A row for each case and evaluator: (id, place, spec), in the order in which the case runs them."""
    return cases.select("id", F.posexplode("evaluators").alias("place", "spec"))


def judge_costs(evaluations: DataFrame, prices: DataFrame) -> DataFrame:
    """(run_id, case_id, judge_cost) of each case that judges have seen.

    ``evaluations`` has judge_models, as texts provider:model, and the tokens of
    all calls. Tokens of several models have no one price and add nothing; a
    case of which nothing is priced has the cost null.
    """
    only = F.element_at("judge_models", 1)
    one = evaluations.filter(F.size("judge_models") == 1).select(
        *_KEY, F.substring_index(only, ":", 1).alias("provider"), F.regexp_replace(only, "^[^:]*:?", "").alias("model"),
        "input_tokens", "output_tokens", "cached_tokens",
    )
    costs = case_costs(one, prices).select(*_KEY, "total_cost")
    others = evaluations.filter(F.size("judge_models") != 1).select(*_KEY, F.lit(None).cast("decimal(20,12)").alias("total_cost"))
    return costs.unionByName(others).groupBy(*_KEY).agg(F.sum("total_cost").cast("decimal(28,12)").alias("judge_cost"))


def newest_snapshots(snapshots: DataFrame, limit: int) -> DataFrame:
    return snapshots.orderBy(F.desc("created_at"), "suite_hash").limit(limit)


def baseline_reports(runs: DataFrame, most: int = 6) -> DataFrame:
    """The newest runs beside their baselines, null where one has none."""
    base = runs.select(*(F.col(c).alias(f"baseline_{c}") for c in runs.columns if c != "baseline_run_id"))
    recent = runs.orderBy(F.desc("created_at"), "run_id").limit(most)
    return recent.join(base, "baseline_run_id", "left")


def metrics_document(figures: DataFrame) -> DataFrame:
    """(run_id, document): a run's figures as JSON, decimals as text, nulls kept."""
    text = _as_text(figures, figures.columns)
    return figures.select("run_id", F.to_json(F.struct(*text), {"ignoreNullFields": "false"}).alias("document"))


def run_documents(cases: DataFrame, evaluations: DataFrame, costs: DataFrame, error_policy: str = "exclude") -> DataFrame:
    """(run_id, document): the whole roll-up of each run as one JSON object.

    Headline figures with their interval, latency with its marks of small
    samples, tokens, costs as exact text, errors by kind, and the breakdowns by
    category, tag and evaluator, each in the order of its name. Parts that a run
    doesn't have are null or empty. ``costs`` are of :func:`pricing.case_costs`.
    """

    def part(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c != "run_id"]
        return df.select(F.col("run_id").alias(f"{name}_of"), F.struct(*_as_text(df, rest)).alias(name))

    def listed(df: DataFrame, name: str, first: str) -> DataFrame:
        rest = [first, *(c for c in df.columns if c not in ("run_id", first))]
        rows = df.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(*_as_text(df, rest)))).alias(name))
        return rows.withColumnRenamed("run_id", f"{name}_of")

    latency = rollup.latency_stats(cases)
    marks = F.filter(F.split("low_confidence", ","), lambda x: x != "")
    parts = [
        part(latency.withColumn("low_confidence", marks), "latency"),
        part(rollup.token_totals(cases), "tokens"),
        part(cost_rollup(costs), "cost"),
        listed(rollup.error_breakdown(cases), "errors", "error"),
        listed(rollup.by_category(cases, error_policy), "categories", "category"),
        listed(rollup.by_tag(cases, error_policy), "tags", "tag"),
        listed(rollup.by_evaluator(evaluations), "evaluators", "evaluator_id"),
    ]
    found = rollup.run_rollup(cases, error_policy).withColumn("error_policy", F.lit(error_policy))
    columns = list(found.columns)
    for df in parts:
        name = df.columns[1]
        found = found.join(df, found["run_id"] == df[f"{name}_of"], "left").drop(f"{name}_of")
        empty = F.array().cast(df.schema[name].dataType) if df.schema[name].dataType.typeName() == "array" else F.lit(None)
        columns.append(F.coalesce(F.col(name), empty).alias(name))
    return found.select("run_id", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("document"))


def _as_text(df: DataFrame, columns: list[str]) -> list[Column]:
    kinds = dict(df.dtypes)
    return [F.col(c).cast("string").alias(c) if kinds[c].startswith("decimal") else F.col(c) for c in columns]


def own_rollup(figures: DataFrame, run_id: str) -> DataFrame:
    """``figures``, which fail when it is read if they hold another run's row."""
    wrong = F.raise_error(F.concat(F.lit("the roll-up belongs to "), "run_id", F.lit(f", not {run_id}")))
    return figures.withColumn("run_id", F.when(F.col("run_id") == run_id, F.col("run_id")).otherwise(wrong.cast("string")))


@F.pandas_udf(StringType())
def _scalar_text(expected: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        value = None if text is None else json.loads(text)
        if isinstance(value, bool):
            return "true" if value else "false"
        return str(value) if isinstance(value, (str, int, float)) else None

    return expected.map(one)


def expected_as_text(expected: Column, override: str | None = None) -> Column:
    """The expected answer (JSON) as text: strings as they are, numbers as Python writes them; null for lists and objects."""
    return F.lit(override) if override is not None else _scalar_text(expected)
