"""Roll-ups of case results by run, category and tag, and of evaluations by evaluator.

Populations differ by figure: latency and scores are over ``ok`` cases, tokens
and costs over every attempted one. All aggregates combine before they shuffle;
exact percentiles and medians are the exception and keep a count per value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.functions.stats import low_confidence_percentiles
from evalmill.operators.scoring import aliased, case_outcome, errored, is_score_only, rates

def _ok(column: str) -> Column:
    return F.when(~errored(), F.col(column))


def pass_rates(cases: DataFrame, keys: list[str], policy: str = "exclude") -> DataFrame:
    return cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aliased(rates(case_outcome(policy))))


def latency_stats(cases: DataFrame) -> DataFrame:
    """Per run over ``ok`` cases: n, mean, exact linear percentiles, maximum, and the marks of small samples."""
    x = _ok("latency_ms")
    ranks = F.percentile(x, F.array(*map(F.lit, (0.5, 0.9, 0.95, 0.99))))
    found = cases.groupBy("run_id").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean_ms"), ranks.alias("ranks"), F.max(x).alias("max_ms")
    )
    names = ("p50_ms", "p90_ms", "p95_ms", "p99_ms")
    return found.select(
        "run_id",
        "n",
        "mean_ms",
        *(F.get("ranks", F.lit(i)).alias(name) for i, name in enumerate(names)),
        "max_ms",
        F.array_join(low_confidence_percentiles(F.col("n")), ",").alias("low_confidence"),
    )


def token_totals(cases: DataFrame) -> DataFrame:
    """Per run over all cases: usage counts only where both sides are known."""
    known = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    count_in, count_out = F.when(known, F.col("input_tokens")), F.when(known, F.col("output_tokens"))
    n_known = F.count_if(known)
    return cases.groupBy("run_id").agg(
        n_known.alias("n_with_usage"),
        (F.count(F.lit(1)) - n_known).alias("n_missing"),
        F.sum(count_in).alias("input_tokens"),
        F.sum(count_out).alias("output_tokens"),
        F.sum(count_in + count_out).alias("total_tokens"),
        F.avg(count_in).alias("mean_input_tokens"),
        F.avg(count_out).alias("mean_output_tokens"),
        F.try_divide(n_known, F.count(F.lit(1))).alias("usage_coverage"),
    )


def error_breakdown(cases: DataFrame) -> DataFrame:
    """Cases that aren't ``ok`` by their error's kind, or else by how they ended."""
    kind = F.coalesce(F.col("error_kind"), F.when(F.col("status") == "error", F.lit("evaluation_error")), F.col("status"))
    return cases.filter(errored()).groupBy("run_id", kind.alias("error")).agg(F.count(F.lit(1)).alias("n"))


def error_breakdown_map(cases: DataFrame) -> DataFrame:
    """The same as one map for each run, in the order of its keys."""
    entries = F.array_sort(F.collect_list(F.struct("error", "n")))
    return error_breakdown(cases).groupBy("run_id").agg(F.map_from_entries(entries).alias("errors"))


def run_rollup(cases: DataFrame, policy: str = "exclude") -> DataFrame:
    """The headline figures of each run."""
    bad = F.count_if(errored())
    n = F.count(F.lit(1))
    return cases.groupBy("run_id").agg(
        n.alias("n_attempted"),
        F.count_if(~errored()).alias("n_completed"),
        bad.alias("n_errors"),
        F.coalesce(F.try_divide(bad, n), F.lit(0.0)).alias("error_rate"),
        *aliased(rates(case_outcome(policy))),
        F.count(_ok("score")).alias("n_scored"),
        F.avg(_ok("score")).alias("mean_score"),
        F.median(_ok("score")).alias("median_score"),
    )


def by_category(cases: DataFrame, policy: str = "exclude") -> DataFrame:
    """Cases without a category form no bucket; n counts all cases, errored ones too."""
    return cases.filter("category is not null").groupBy("run_id", "category").agg(
        F.count(F.lit(1)).alias("n"), *aliased(rates(case_outcome(policy))), F.avg(_ok("score")).alias("mean_score")
    )


def by_tag(cases: DataFrame, policy: str = "exclude") -> DataFrame:
    """Buckets overlap: a case counts under each of its tags."""
    return cases.withColumn("tag", F.explode("tags")).groupBy("run_id", "tag").agg(
        F.count(F.lit(1)).alias("n"), *aliased(rates(case_outcome(policy))), F.avg(_ok("score")).alias("mean_score")
    )


def by_evaluator(evaluations: DataFrame) -> DataFrame:
    """Evaluations of each evaluator; its type is that of its first row, and types are never blended."""
    usable = F.col("status") != "error"
    verdict = F.when(usable, F.col("passed"))
    score = F.when(usable, F.col("score"))
    first = F.min(F.struct("case_id", "ord", "evaluator_type"))["evaluator_type"]
    found = rates(verdict)
    return evaluations.groupBy("run_id", "evaluator_id").agg(
        first.alias("evaluator_type"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") == "error").alias("n_errors"),
        found["n_passed"].alias("n_passed"),
        found["n_denominator"].alias("n_pass_denominator"),
        found["pass_rate"].alias("pass_rate"),
        F.count_if(is_score_only()).alias("n_score_only"),
        F.avg(score).alias("mean_score"),
        F.median(score).alias("median_score"),
    )
