"""Pairing of two runs, their concordance, flips and largest falls of score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.functions.stats import mcnemar_exact, newcombe_interval, phi_coefficient
from evalmill.operators.scoring import case_outcome

TOP_DROPS = 5


def pair_runs(cases: DataFrame, baseline: str, candidate: str, policy: str = "exclude") -> DataFrame:
    """One row for each case of either run, by one full outer join.

    ``kind`` is paired (same content), changed, only_in_baseline or
    only_in_candidate; outcomes follow the error policy.
    """

    def side(run: str, mark: str) -> DataFrame:
        return cases.filter(F.col("run_id") == run).select(
            F.col("case_id").alias(f"{mark}_id"),
            F.col("case_hash").alias(f"{mark}_hash"),
            case_outcome(policy).alias(f"{mark}_outcome"),
            F.when(F.col("status") == "ok", F.col("score")).alias(f"{mark}_score"),
        )

    b, c = side(baseline, "b"), side(candidate, "c")
    kind = (
        F.when(F.col("c_id").isNull(), "only_in_baseline")
        .when(F.col("b_id").isNull(), "only_in_candidate")
        .when(F.col("b_hash") == F.col("c_hash"), "paired")
        .otherwise("changed")
    )
    return b.join(c, b["b_id"] == c["c_id"], "full_outer").select(
        F.coalesce("b_id", "c_id").alias("case_id"),
        kind.alias("kind"),
        "b_outcome",
        "c_outcome",
        "b_score",
        "c_score",
        (F.col("c_score") - F.col("b_score")).alias("score_delta"),
    )


def pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def concordance(pairs: DataFrame) -> DataFrame:
    """The 2x2 table of paired outcomes (both known) with its advisory statistics."""
    known = pairs.filter((F.col("kind") == "paired") & F.col("b_outcome").isNotNull() & F.col("c_outcome").isNotNull())
    b, c = F.col("b_outcome"), F.col("c_outcome")
    table = known.agg(
        F.count_if(b & c).alias("both_pass"),
        F.count_if(b & ~c).alias("baseline_only"),
        F.count_if(~b & c).alias("candidate_only"),
        F.count_if(~b & ~c).alias("neither"),
    )
    cells = [F.col(x) for x in ("both_pass", "baseline_only", "candidate_only", "neither")]
    n = sum(cells[1:], cells[0])
    low, high = newcombe_interval(*cells)
    return table.select(
        "*",
        n.alias("n_paired"),
        F.try_divide(cells[0] + cells[1], n).alias("baseline_rate"),
        F.try_divide(cells[0] + cells[2], n).alias("candidate_rate"),
        phi_coefficient(*cells).alias("phi"),
        low.alias("ci_low"),
        high.alias("ci_high"),
        mcnemar_exact(cells[1], cells[2]).alias("mcnemar_p"),
    )


def flips(pairs: DataFrame) -> DataFrame:
    """Paired cases by what became of them: newly_failing, newly_passing, still_failing."""
    b, c = F.col("b_outcome"), F.col("c_outcome")
    change = F.when(b & ~c, "newly_failing").when(~b & c, "newly_passing").when(~b & ~c, "still_failing")
    return pairs.filter("kind = 'paired'").select("case_id", change.alias("change")).filter("change is not null")


def largest_score_drops(pairs: DataFrame, most: int = TOP_DROPS) -> DataFrame:
    """The ``most`` largest falls of score among paired cases; ties by case."""
    falls = pairs.filter("kind = 'paired' and score_delta < 0").select("case_id", "b_score", "c_score", "score_delta")
    return falls.orderBy("score_delta", "case_id").limit(most)
