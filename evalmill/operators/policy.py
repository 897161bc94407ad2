"""Threshold policies: metric paths, their expansion over two runs, bounds, gates and the verdict.

A policy is a table of checks in order; the metrics of both runs are one long
table (run_id, scope, key, evaluator_type, leaf, value, n, ci_low, ci_high).
Checks meet metrics by joins, so a policy of any size over any number of
instances is one plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.functions.stats import is_close, wilson_interval
from evalmill.operators.rollup import by_evaluator
from evalmill.operators.scoring import aliased, case_outcome, errored, rates

# Names of metrics, scopes and bounds, and the codes a process ends with.
ROOT = ("pass_rate", "error_rate", "mean_score", "median_score")
LATENCY = ("mean_ms", "p50_ms", "p90_ms", "p95_ms", "p99_ms", "max_ms")
SCOPES = ("category", "tag", "evaluator", "evaluator_type")
#: Bounds in the order they are tried.
BOUNDS = (
    "min_value", "max_value", "max_absolute_decrease", "max_absolute_increase", "max_relative_decrease",
    "max_relative_increase",
)
METRICS = "run_id string, scope string, key string, evaluator_type string, leaf string, value double, n long, ci_low double, ci_high double"
EXIT_CODES = {"pass": 0, "warn": 0, "fail": 4, "incomparable": 6}


def parse_path(path: str) -> tuple[str, str, str]:
    """(scope, selector, leaf) of a metric path; what it doesn't allow raises ``ValueError``."""
    parts = path.split(".")
    if len(parts) == 1 and parts[0] in ROOT:
        return "run", "", parts[0]
    if len(parts) == 2 and parts[0] == "latency" and parts[1] in LATENCY:
        return "latency", "", parts[1]
    if len(parts) == 3 and parts[0] in SCOPES and parts[1] and parts[2] in ("pass_rate", "mean_score"):
        return parts[0], parts[1], parts[2]
    raise ValueError(f"no metric has the path {path!r}")


@dataclass(frozen=True)
class Check:
    """One line of a policy. ``metric`` has one, two or three segments."""

    metric: str
    direction: str = "higher_is_better"
    label: str | None = None
    min_value: float | None = None
    max_value: float | None = None
    max_absolute_decrease: float | None = None
    max_absolute_increase: float | None = None
    max_relative_decrease: float | None = None
    max_relative_increase: float | None = None
    severity: str = "error"
    min_samples: int = 1

    def __post_init__(self):
        parse_path(self.metric)
        if all(getattr(self, b) is None for b in BOUNDS):
            raise ValueError(f"the check of {self.metric!r} sets no bound")
        if self.severity not in ("error", "warning"):
            raise ValueError(f"unknown severity {self.severity!r}")


@dataclass(frozen=True)
class Policy:
    checks: tuple[Check, ...]
    paired: bool = True
    require_same_suite: bool = True
    min_paired_cases: int = 1
    fail_on_missing_metric: bool = True
    confidence_level: float = 0.95


# The policy that holds where none is given.
DEFAULT_POLICY = Policy(
    (
        Check("pass_rate", label="overall pass rate", max_absolute_decrease=0.02),
        Check("category.*.pass_rate", label="category pass rate", max_absolute_decrease=0.02, min_samples=10),
        Check("evaluator_type.json_valid.pass_rate", label="JSON validity", max_absolute_decrease=0.0),
        Check("evaluator_type.json_schema.pass_rate", label="JSON schema adherence", max_absolute_decrease=0.0),
        Check("latency.p95_ms", "lower_is_better", "p95 model latency", max_relative_increase=0.15, min_samples=20),
        Check("error_rate", "lower_is_better", "error rate", max_value=0.01),
        Check("evaluator.*.mean_score", label="mean evaluator score", max_absolute_decrease=0.05),
    )
)


def checks_table(spark: SparkSession, policy: Policy) -> DataFrame:
    rows = [
        (i, c.metric, *parse_path(c.metric), c.label, c.severity, c.min_samples, *(getattr(c, b) for b in BOUNDS))
        for i, c in enumerate(policy.checks)
    ]
    schema = "ord int, path string, scope string, selector string, leaf string, label string, severity string, min_samples long, "
    return spark.createDataFrame(rows, schema + ", ".join(f"{b} double" for b in BOUNDS))


def long_metrics(
    rollup: DataFrame, latency: DataFrame, categories: DataFrame, tags: DataFrame, evaluators: DataFrame
) -> DataFrame:
    """The roll-ups of any runs as one long table of metrics with their sample sizes.

    The sample of a bucket's pass rate is all its cases; that of an evaluator's
    is its denominator.
    """
    none = F.lit(None).cast("double")
    own, unknown = (F.col("ci_low"), F.col("ci_high")), (none, none)
    of_errors = wilson_interval(F.col("n_errors"), F.col("n_attempted"))
    of_passes = wilson_interval(F.col("n_passed"), F.col("n_pass_denominator"))

    def part(df: DataFrame, scope: str, key: str | None, kind: str | None, *figures: tuple) -> DataFrame:
        """A roll-up unpivoted in one pass; a figure is (column, its sample size, its interval)."""
        cells = [
            F.struct(
                F.lit(leaf).alias("leaf"), F.col(leaf).cast("double").alias("value"), F.col(n).cast("long").alias("n"),
                ci[0].alias("ci_low"), ci[1].alias("ci_high"),
            )
            for leaf, n, ci in figures
        ]
        return df.select(
            "run_id",
            F.lit(scope).alias("scope"),
            (F.col(key) if key else F.lit("")).alias("key"),
            (F.col(kind) if kind else F.lit(None).cast("string")).alias("evaluator_type"),
            F.inline(F.array(*cells)),
        )

    bucket = (("pass_rate", "n", own), ("mean_score", "n", unknown))
    return (
        part(
            rollup, "run", None, None, ("pass_rate", "n_denominator", own), ("error_rate", "n_attempted", of_errors),
            ("mean_score", "n_scored", unknown), ("median_score", "n_scored", unknown),
        )
        .unionByName(part(latency, "latency", None, None, *((leaf, "n", unknown) for leaf in LATENCY)))
        .unionByName(part(categories, "category", "category", None, *bucket))
        .unionByName(part(tags, "tag", "tag", None, *bucket))
        .unionByName(
            part(
                evaluators, "evaluator", "evaluator_id", "evaluator_type", ("pass_rate", "n_pass_denominator", of_passes),
                ("mean_score", "n", unknown),
            )
        )
    )


def grain_metrics(cases: DataFrame, evaluations: DataFrame, error_policy: str = "exclude") -> DataFrame:
    """The same long table straight from cases and evaluations: one pass over each.

    A case is expanded to the grains it counts under (its run, its category, each
    of its tags), and all figures are aggregates of one grouping. Medians and
    percentiles, which keep a count for each value, are of the run's grain only.
    """
    run = F.col("scope") == "run"
    score = F.when(~errored(), F.col("score"))
    latency = F.when(run & ~errored(), F.col("latency_ms"))
    grain = lambda scope, key: F.struct(F.lit(scope).alias("scope"), key.cast("string").alias("key"))
    grains = F.concat(
        F.array(grain("run", F.lit("")), F.when(F.col("category").isNotNull(), grain("category", F.col("category")))),
        F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: grain("tag", t)),
    )
    rows = cases.select("run_id", "status", "passed", "score", "latency_ms", F.explode(grains).alias("grain")).filter("grain is not null")
    found = rows.select("run_id", "grain.*", "status", "passed", "score", "latency_ms").groupBy("run_id", "scope", "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(errored()).alias("n_errors"),
        *aliased(rates(case_outcome(error_policy))),
        F.count(score).alias("n_scored"),
        F.avg(score).alias("mean_score"),
        F.median(F.when(run, score)).alias("median_score"),
        F.count(latency).alias("n_timed"),
        F.avg(latency).alias("mean_ms"),
        F.max(latency).alias("max_ms"),
        F.percentile(latency, F.array(*map(F.lit, (0.5, 0.9, 0.95, 0.99)))).alias("ranks"),
    )
    none = F.lit(None).cast("double")
    own, unknown = (F.col("ci_low"), F.col("ci_high")), (none, none)

    def cell(scope: str | None, leaf: str, value: Column, n: str, ci: tuple[Column, Column] = unknown) -> Column:
        return F.struct(
            (F.col("scope") if scope is None else F.lit(scope)).alias("scope"), F.lit(leaf).alias("leaf"),
            value.cast("double").alias("value"), F.col(n).cast("long").alias("n"), ci[0].alias("ci_low"), ci[1].alias("ci_high"),
        )

    error_rate = F.coalesce(F.try_divide("n_errors", "n"), F.lit(0.0))
    of_run = [
        cell(None, "pass_rate", F.col("pass_rate"), "n_denominator", own),
        cell(None, "error_rate", error_rate, "n", wilson_interval(F.col("n_errors"), F.col("n"))),
        cell(None, "mean_score", F.col("mean_score"), "n_scored"),
        cell(None, "median_score", F.col("median_score"), "n_scored"),
        cell("latency", "mean_ms", F.col("mean_ms"), "n_timed"),
        *(cell("latency", leaf, F.get("ranks", F.lit(i)), "n_timed") for i, leaf in enumerate(LATENCY[1:5])),
        cell("latency", "max_ms", F.col("max_ms"), "n_timed"),
    ]
    of_bucket = [cell(None, "pass_rate", F.col("pass_rate"), "n", own), cell(None, "mean_score", F.col("mean_score"), "n")]
    cells = F.when(run, F.array(*of_run)).otherwise(F.array(*of_bucket))
    # The scope of a cell replaces that of its grain.
    told = found.select("run_id", "key", F.inline(cells))
    of_passes = wilson_interval(F.col("n_passed"), F.col("n_pass_denominator"))
    of_evaluator = [cell("evaluator", "pass_rate", F.col("pass_rate"), "n_pass_denominator", of_passes), cell("evaluator", "mean_score", F.col("mean_score"), "n")]
    judged = by_evaluator(evaluations).select("run_id", F.col("evaluator_id").alias("key"), "evaluator_type", F.inline(F.array(*of_evaluator)))
    names = ["run_id", "scope", "key", "evaluator_type", "leaf", "value", "n", "ci_low", "ci_high"]
    return told.withColumn("evaluator_type", F.lit(None).cast("string")).select(*names).unionByName(judged.select(*names))


def expand(checks: DataFrame, metrics: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Each check bound to the figures of both runs: one row for each instance of either run.

    A check that matches nothing keeps one row, marked unavailable, and so is an
    instance that only one run has.
    """

    figures = F.struct("evaluator_type", "value", "n", "ci_low", "ci_high")
    of = lambda run: F.any_value(F.when(F.col("run_id") == run, figures), F.lit(True))
    # Both runs in one grouping: each has one row for a scope, key and leaf.
    both = metrics.filter(F.col("run_id").isin(baseline, candidate)).groupBy("scope", "key", "leaf").agg(of(baseline).alias("b"), of(candidate).alias("c"))
    both = both.select(
        F.col("scope").alias("m_scope"), "key", F.col("leaf").alias("m_leaf"),
        *(F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "bc" for c in ("evaluator_type", "value", "n", "ci_low", "ci_high")),
        F.col("b").isNotNull().alias("b_there"), F.col("c").isNotNull().alias("c_there"),
    )
    by_type = F.col("scope") == "evaluator_type"
    scope = F.when(by_type, F.lit("evaluator")).otherwise(F.col("scope"))
    b_in = F.col("b_there") & F.when(by_type & (F.col("selector") != "*"), F.col("b_evaluator_type") == F.col("selector")).otherwise(True)
    c_in = F.col("c_there") & F.when(by_type & (F.col("selector") != "*"), F.col("c_evaluator_type") == F.col("selector")).otherwise(True)
    named = by_type | F.col("selector").isin("", "*") | (F.col("key") == F.col("selector"))
    hit = (F.col("m_scope") == scope) & (F.col("m_leaf") == F.col("leaf")) & named & (F.coalesce(b_in, F.lit(False)) | F.coalesce(c_in, F.lit(False)))
    rows = checks.join(both, hit, "left")
    b_has, c_has = F.coalesce(b_in, F.lit(False)), F.coalesce(c_in, F.lit(False))
    many = ~F.col("scope").isin("run", "latency")
    target = F.when(F.col("selector") == "*", F.lit("any instance")).otherwise(F.concat(F.lit("'"), "selector", F.lit("'")))
    reason = F.when(many & ~b_has & ~c_has, F.concat(F.lit("neither run has "), target, F.lit(" under "), "scope")).when(
        many & ~(b_has & c_has), F.concat(F.lit("only the "), F.when(c_has, F.lit("candidate")).otherwise(F.lit("baseline")), F.lit(" run has it"))
    )
    metric = F.when(many & (b_has | c_has), F.concat_ws(".", scope, "key", "leaf")).otherwise(F.col("path"))
    label = (
        F.when(F.col("label").isNull(), metric)
        .when(many & (b_has | c_has), F.concat("label", F.lit(" ("), "key", F.lit(")")))
        .otherwise(F.col("label"))
    )
    values = [F.when(b_has, F.col(f"b_{x}")).alias(f"b_{x}") for x in ("value", "ci_low", "ci_high")]
    values += [F.when(c_has, F.col(f"c_{x}")).alias(f"c_{x}") for x in ("value", "ci_low", "ci_high")]
    return rows.select(
        "ord", metric.alias("metric"), label.alias("shown"), "severity", "min_samples", *BOUNDS, *values,
        F.coalesce(F.when(b_has, F.col("b_n")), F.lit(0)).alias("b_n"), F.coalesce(F.when(c_has, F.col("c_n")), F.lit(0)).alias("c_n"),
        reason.alias("unavailable"),
    )


def _below(a: Column, b: Column) -> Column:
    return (a < b) & ~is_close(a, b)


def _above(a: Column, b: Column) -> Column:
    return (a > b) & ~is_close(a, b)


def bound_states() -> Column:
    """Array of (name, threshold, delta_bound, violated) of the bounds a check sets, in order."""
    b, c = F.col("b_value"), F.col("c_value")
    delta, none = c - b, F.lit(None).cast("double")
    at = {name: F.col(name) for name in BOUNDS}
    floor, ceiling = b * (1.0 - at["max_relative_decrease"]), b * (1.0 + at["max_relative_increase"])
    states = {
        "min_value": (at["min_value"], none, _below(c, at["min_value"])),
        "max_value": (at["max_value"], none, _above(c, at["max_value"]) | is_close(c, at["max_value"])),
        "max_absolute_decrease": (b - at["max_absolute_decrease"], -at["max_absolute_decrease"], _below(delta, -at["max_absolute_decrease"])),
        "max_absolute_increase": (b + at["max_absolute_increase"], at["max_absolute_increase"], _above(delta, at["max_absolute_increase"])),
        "max_relative_decrease": (floor, floor - b, _below(c, floor)),
        "max_relative_increase": (ceiling, ceiling - b, _above(c, ceiling)),
    }

    def state(name: str) -> Column:
        threshold, move, violated = states[name]
        usable = at[name].isNotNull() & c.isNotNull() & (F.lit(name in ("min_value", "max_value")) | b.isNotNull())
        fields = F.struct(F.lit(name).alias("name"), threshold.alias("threshold"), move.alias("move"), violated.alias("violated"))
        return F.when(usable, fields)

    return F.filter(F.array(*map(state, BOUNDS)), lambda s: s.isNotNull())


#: What a reader of an outcome is told beside it.
NOTES = {
    "latency": "latency is of attempts that succeeded, without the waits before retries",
    "policies": "the runs count errors differently, so their pass rates are over different populations",
    "close": "the interval of the change reaches past the threshold, so this is a close pass",
    "unsure": "the interval of the change also covers values within the threshold, so the breach is not firm",
    "overlap": "the intervals of the two runs overlap, so the comparison is not conclusive",
}


def notes_of(open_: Column, straddles: Column, overlaps: Column, policies_differ: bool) -> Column:
    """The notes of an outcome, in order: on its population, why it was stopped, how firm it is."""
    overall = F.col("metric") == "pass_rate"
    said = [
        F.when(F.col("metric").startswith("latency."), F.lit(NOTES["latency"])),
        F.when(overall & F.lit(policies_differ), F.lit(NOTES["policies"])),
        F.col("population"),
        F.when(~open_, F.col("reason")),
        F.when(open_ & straddles, F.when(F.col("status") == "passed", F.lit(NOTES["close"])).otherwise(F.lit(NOTES["unsure"]))),
        F.when(open_ & overlaps, F.lit(NOTES["overlap"])),
    ]
    return F.filter(F.array(*said), lambda x: x.isNotNull())


def evaluate(expanded: DataFrame, policies_differ: bool = False) -> DataFrame:
    """Outcomes: the gates that stop a check, else its first violated bound; the bound is reported on a pass too.

    ``policies_differ``: the runs' pass rates were made under different error policies.
    """
    relative = F.col("max_relative_decrease").isNotNull() | F.col("max_relative_increase").isNotNull()
    moves = relative | F.col("max_absolute_decrease").isNotNull() | F.col("max_absolute_increase").isNotNull()
    b, c = F.col("b_value"), F.col("c_value")
    gate = (
        F.when(F.col("unavailable").isNotNull(), "insufficient_data")
        .when(b.isNull() & c.isNull(), "insufficient_data")
        .when(c.isNull() | (b.isNull() & moves), "missing_metric")
        .when(F.least("b_n", "c_n") < F.col("min_samples"), "insufficient_data")
        .when(relative & (b == 0), "insufficient_data")
    )
    reason = (
        F.when(F.col("unavailable").isNotNull(), F.col("unavailable"))
        .when(b.isNull() & c.isNull(), "neither run reports it")
        .when(c.isNull() | (b.isNull() & moves), "one run does not report it")
        .when(F.least("b_n", "c_n") < F.col("min_samples"), F.concat(F.lit("samples "), "b_n", F.lit(" and "), "c_n", F.lit(" of "), "min_samples"))
        .when(relative & (b == 0), "a relative bound needs a baseline other than zero")
    )
    rows = expanded.withColumn("states", bound_states()).withColumn("gate", gate).withColumn("reason", reason)
    breach = F.get(F.filter("states", lambda s: s["violated"]), F.lit(0))
    rows = rows.withColumn("breach", breach).withColumn("bound", F.coalesce("breach", F.get("states", F.lit(0))))
    status = (
        F.when(F.col("gate").isNotNull(), F.col("gate"))
        .when(F.col("breach").isNull(), "passed")
        .when(F.col("severity") == "warning", "warning")
        .otherwise("failed")
    )
    open_ = F.col("gate").isNull()
    straddles = F.exists(
        "states", lambda s: s["move"].isNotNull() & (F.col("delta_low") < s["move"]) & (s["move"] < F.col("delta_high"))
    )
    out = rows.withColumn("status", status)
    absent = {"delta_low": "double", "delta_high": "double", "mcnemar_p": "double", "population": "string", "mode": "string"}
    for column, kind in absent.items():
        if column not in out.columns:
            out = out.withColumn(column, F.lit("unpaired" if column == "mode" else None).cast(kind))
    straddles = F.coalesce(straddles, F.lit(False))
    overlaps = F.coalesce((F.col("b_ci_low") <= F.col("c_ci_high")) & (F.col("c_ci_low") <= F.col("b_ci_high")), F.lit(False))
    return out.select(
        "ord", "metric", F.col("shown").alias("label"), "severity", "status", "b_value", "c_value", "b_n", "c_n",
        (c - b).alias("delta"), F.try_divide(c - b, b).alias("relative_delta"),
        F.when(open_, F.col("bound.name")).alias("bound"), F.when(open_, F.col("bound.threshold")).alias("threshold"), "reason",
        "delta_low", "delta_high", "mcnemar_p", straddles.alias("straddles"), overlaps.alias("overlaps"),
        notes_of(open_, straddles, overlaps, policies_differ).alias("notes"), "mode",
    )


def with_paired_rates(expanded: DataFrame, table: DataFrame, min_paired: int) -> DataFrame:
    """In paired mode the run's pass rate is that of the paired cases, with the paired interval and p-value.

    The mode is a column: paired if enough cases pair. The runs' own intervals
    say nothing about a paired difference and go; the population is told where
    it isn't each run's whole one.
    """
    row = table.select(
        F.col("n_paired").alias("pairs"), "baseline_rate", "candidate_rate", F.col("ci_low").alias("pair_low"),
        F.col("ci_high").alias("pair_high"), F.col("mcnemar_p").alias("pair_p"),
    )
    # One row: the 2x2 table of the two runs.
    joined = expanded.join(F.broadcast(row), F.lit(True))
    paired = F.col("pairs") >= max(1, min_paired)
    use = paired & (F.col("metric") == "pass_rate")
    changes = {"b_value": F.col("baseline_rate"), "c_value": F.col("candidate_rate"), "b_n": F.col("pairs"), "c_n": F.col("pairs")}
    changes |= {f"{x}_ci_{end}": F.lit(None).cast("double") for x in "bc" for end in ("low", "high")}
    kept = [F.when(use, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in expanded.columns]
    smaller = use & ((F.col("pairs") != F.col("b_n")) | (F.col("pairs") != F.col("c_n")))
    population = F.format_string("over the %d cases that both runs ran unchanged and reached a verdict on, of %d and %d", "pairs", "b_n", "c_n")
    return joined.select(
        *kept, F.when(use, F.col("pair_low")).alias("delta_low"), F.when(use, F.col("pair_high")).alias("delta_high"),
        F.when(use, F.col("pair_p")).alias("mcnemar_p"), F.when(smaller, population).alias("population"),
        F.when(paired, "paired").otherwise("unpaired").alias("mode"),
    )


def verdict(outcomes: DataFrame, fail_on_missing: bool = True) -> DataFrame:
    """One row: pass, warn or fail, with the counts of outcomes; insufficient data never fails."""
    n = lambda s: F.count_if(F.col("status") == s)
    bad = (n("failed") > 0) | (F.lit(fail_on_missing) & (n("missing_metric") > 0))
    result = F.when(bad, "fail").when(n("warning") > 0, "warn").otherwise("pass")
    statuses = ("passed", "warning", "failed", "missing_metric", "insufficient_data")
    return outcomes.agg(result.alias("verdict"), *(n(s).alias(f"n_{s}") for s in statuses))


def with_exit_code(verdicts: DataFrame, fail_on_warning: bool = False) -> DataFrame:
    code = F.lit(None).cast("int")
    for name, value in EXIT_CODES.items():
        code = F.when(F.col("verdict") == name, 7 if name == "warn" and fail_on_warning else value).otherwise(code)
    return verdicts.withColumn("exit_code", code)


@dataclass
class Comparison:
    """Two runs held against a policy. The outcomes' column ``mode`` tells whether pass rates are of paired cases."""

    policy: Policy
    comparable: bool
    outcomes: DataFrame | None = None
    verdicts: DataFrame | None = None
    notes: list[str] = field(default_factory=list)


def compare_runs(
    metrics: DataFrame, table: DataFrame, policy: Policy, baseline: str, candidate: str, same_suite: bool = True, policies_differ: bool = False
) -> Comparison:
    """The report of two runs: comparability, outcomes in policy order, and the verdict."""
    spark = metrics.sparkSession
    if policy.require_same_suite and not same_suite:
        rows = spark.createDataFrame([("incomparable", 0, 0, 0, 0, 0)], "verdict string, n_passed long, n_warning long, n_failed long, n_missing_metric long, n_insufficient_data long")
        return Comparison(policy, False, verdicts=rows, notes=["the runs are of different suites"])
    bound = expand(checks_table(spark, policy), metrics, baseline, candidate)
    if policy.paired:
        bound = with_paired_rates(bound, table, policy.min_paired_cases)
    alpha = round(1 - policy.confidence_level, 10)
    outcomes = evaluate(bound, policies_differ).withColumn("significant", F.col("mcnemar_p") < alpha)
    return Comparison(policy, True, outcomes, verdict(outcomes, policy.fail_on_missing_metric))


def valid_path(path: str) -> bool:
    try:
        parse_path(path)
    except ValueError:
        return False
    return bool(re.fullmatch(r"[^\s]+", path))
