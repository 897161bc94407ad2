"""Price lookup and costs in exact decimals.

Prices are per million tokens. Tokens times price times a millionth is one
product of narrow decimals, so no scale is lost to a division.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Price tables up to so many entries are broadcast; larger ones join by provider.
BROADCAST_ENTRIES = 10_000


def lookup(models: DataFrame, prices: DataFrame) -> DataFrame:
    """Distinct (provider, model) with the entry that prices them, null where none does.

    An exact entry comes first, then the longest prefix, then the first regular
    expression in the order of the table; ties go to the first declared.
    """
    wanted = models.select("provider", "model").distinct()
    p = prices.select(*(F.col(c).alias(f"p_{c}") for c in prices.columns))
    small = prices.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
    fits = (
        ((F.col("p_match") == "exact") & (F.col("model") == F.col("p_model")))
        | ((F.col("p_match") == "prefix") & F.startswith(F.col("model"), F.col("p_model")))
        | ((F.col("p_match") == "regex") & F.rlike(F.col("model"), F.when(F.col("p_match") == "regex", F.col("p_model"))))
    )
    joined = wanted.join(F.broadcast(p) if small else p, (F.col("provider") == F.col("p_provider")) & fits, "left")
    rank = F.when(F.col("p_match") == "exact", 0).when(F.col("p_match") == "prefix", 1).otherwise(2)
    length = F.when(F.col("p_match") == "prefix", -F.length("p_model")).otherwise(0)
    best = Window.partitionBy("provider", "model").orderBy(rank, length, "p_ord")
    return joined.withColumn("place", F.row_number().over(best)).filter("place = 1").select(
        "provider",
        "model",
        F.col("p_ord").alias("price_ord"),
        F.col("p_match").alias("match"),
        F.col("p_input_per_mtok").alias("input_per_mtok"),
        F.col("p_output_per_mtok").alias("output_per_mtok"),
        F.col("p_cached_input_per_mtok").alias("cached_input_per_mtok"),
    )


def _amount(tokens: Column, price: Column) -> Column:
    millionth = F.lit("0.000001").cast("decimal(7,6)")
    return tokens.cast("decimal(12,0)") * price.cast("decimal(12,6)") * millionth


def case_costs(cases: DataFrame, prices: DataFrame) -> DataFrame:
    """``cases`` with priced, unpriced_reason, input_cost, output_cost and total_cost."""
    found = lookup(cases, prices).select(
        F.col("provider").alias("of_provider"),
        F.col("model").alias("of_model"),
        "price_ord",
        "input_per_mtok",
        "output_per_mtok",
        "cached_input_per_mtok",
    )
    joined = cases.join(
        found, (cases["provider"] == found["of_provider"]) & (cases["model"] == found["of_model"]), "left"
    )
    cached = F.coalesce(F.col("cached_tokens"), F.lit(0))
    split = F.col("cached_input_per_mtok").isNotNull() & (cached > 0)
    uncached = F.greatest(F.col("input_tokens") - cached, F.lit(0))
    cost_in = F.when(
        split, _amount(uncached, F.col("input_per_mtok")) + _amount(cached, F.col("cached_input_per_mtok"))
    ).otherwise(_amount(F.col("input_tokens"), F.col("input_per_mtok")))
    cost_out = _amount(F.col("output_tokens"), F.col("output_per_mtok"))
    reason = F.when(F.col("price_ord").isNull(), "no_price_entry").when(
        F.col("input_tokens").isNull() | F.col("output_tokens").isNull(), "no_token_usage"
    )
    money = "decimal(20,12)"
    out = joined.withColumn("unpriced_reason", reason).withColumn("priced", F.col("unpriced_reason").isNull())
    return out.select(
        *cases.columns,
        "priced",
        "unpriced_reason",
        F.when(F.col("priced"), cost_in).cast(money).alias("input_cost"),
        F.when(F.col("priced"), cost_out).cast(money).alias("output_cost"),
        F.when(F.col("priced"), cost_in + cost_out).cast(money).alias("total_cost"),
    )


def billable(total: str = "total_cost", judge: str = "judge_cost") -> Column:
    """What a case adds to a run's known spend: 0 unless priced, plus its judge's cost."""
    return F.coalesce(F.col(total), F.lit(0).cast("decimal(20,12)")) + F.coalesce(
        F.col(judge).cast("decimal(20,12)"), F.lit(0).cast("decimal(20,12)")
    )


def dominant_reasons(costs: DataFrame) -> DataFrame:
    """The most frequent reason why cases of a run have no price; ties go to the first by name.

    A case without a cost at all (``priced`` is null) has had no response.
    """
    reason = F.coalesce("unpriced_reason", F.when(F.col("priced").isNull(), "no_response"))
    counts = costs.withColumn("unpriced_reason", reason).filter("unpriced_reason is not null").groupBy("run_id", "unpriced_reason").agg(
        F.count(F.lit(1)).alias("n")
    )
    order = Window.partitionBy("run_id").orderBy(F.desc("n"), "unpriced_reason")
    return counts.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def per_unit(total: Column, units: Column) -> Column:
    """A total for each unit, to ten places, half to even; null without a total or units."""
    share = F.try_divide(total.cast("decimal(28,12)"), units.cast("decimal(9,0)"))
    return F.when(units > 0, F.bround(share, 10)).cast("decimal(20,10)")


def cost_rollup(costs: DataFrame) -> DataFrame:
    """Sums over priced cases with their coverage; ``priced`` only where all are."""
    n, n_priced = F.count(F.lit(1)), F.count_if("priced")
    judged = F.when(F.col("priced"), F.col("judge_cost").cast("decimal(20,12)"))
    sums = costs.groupBy("run_id").agg(
        n.alias("n_units"),
        n_priced.alias("n_priced"),
        F.sum("input_cost").cast("decimal(28,12)").alias("input_cost"),
        F.sum("output_cost").cast("decimal(28,12)").alias("output_cost"),
        F.sum("total_cost").cast("decimal(28,12)").alias("total_cost"),
        F.sum(judged).cast("decimal(28,12)").alias("judge_cost"),
    )
    main = dominant_reasons(costs).select(F.col("run_id").alias("of"), F.col("unpriced_reason").alias("main_reason"))
    full = F.col("n_priced") == F.col("n_units")
    reason = F.when(F.col("n_priced") == 0, F.coalesce("main_reason", F.lit("no_price_entry"))).when(
        ~full, F.lit("partial_coverage")
    )
    return sums.join(main, sums["run_id"] == main["of"], "left").select(
        "run_id",
        "n_units",
        "n_priced",
        "input_cost",
        "output_cost",
        "total_cost",
        "judge_cost",
        (full & (F.col("n_priced") > 0)).alias("priced"),
        reason.alias("unpriced_reason"),
        F.try_divide("n_priced", "n_units").alias("coverage"),
        per_unit(F.col("total_cost"), F.col("n_units")).alias("cost_per_case"),
    )


def running_spend(costs: DataFrame, cap: str) -> DataFrame:
    """Spend of each run up to each case, and whether the case came after the cap was passed.

    Cases follow each other by completion; a case is cancelled when the spend
    before it is above the cap. Cases without a price add nothing and are
    counted. Sums run within the hours of a run and are moved by the totals of
    the hours before, so that no task gathers a run.
    """
    money = "decimal(28,12)"
    missing = F.when(F.col("priced"), 0).otherwise(1).cast("long")
    hours = costs.withColumn("hour", F.date_trunc("hour", F.col("completed_at").cast("timestamp")))
    each = hours.groupBy("run_id", "hour").agg(F.sum(billable()).alias("spent"), F.sum(missing).alias("missing"))
    before = Window.partitionBy("run_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select(
        F.col("run_id").alias("of_run"),
        F.col("hour").alias("of_hour"),
        F.coalesce(F.sum("spent").over(before), F.lit(0)).cast(money).alias("spent_before"),
        F.coalesce(F.sum("missing").over(before), F.lit(0)).alias("missing_before"),
    )
    order = Window.partitionBy("run_id", "hour").orderBy("completed_at", "case_id")
    within = order.rowsBetween(Window.unboundedPreceding, 0)
    local = hours.withColumn("s", F.sum(billable()).over(within)).withColumn("m", F.sum(missing).over(within))
    joined = local.join(offsets, (local["run_id"] == offsets["of_run"]) & local["hour"].eqNullSafe(offsets["of_hour"]))
    spent = (F.col("s") + F.col("spent_before")).cast(money)
    limit = F.lit(cap).cast(money)
    return joined.select(
        *costs.columns,
        spent.alias("spent"),
        (F.col("m") + F.col("missing_before")).alias("n_unpriced"),
        (spent > limit).alias("exceeded"),
        (spent - billable() > limit).alias("cancelled"),
    )
