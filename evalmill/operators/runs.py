"""Retries, rate gates and stale runs as functions of their logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds that a rate limit closes the gate at most, and where it names none.
LONGEST_COOLDOWN, USUAL_COOLDOWN = 120.0, 1.0
#: Kinds of errors that another try may mend.
RETRYABLE = ("rate_limit", "timeout", "connection", "server")


def retry_delays(
    attempts: DataFrame, base: float = 0.5, factor: float = 2.0, most: float = 30.0, tries: int = 4, jitter: Column | None = None
) -> DataFrame:
    """For each failed attempt: whether it is retried, after how long, and the waits of the call so far.

    ``attempts`` has call_id, attempt (from 1), kind and retry_after (seconds or null).
    """
    retryable = F.col("kind").isin(*RETRYABLE)
    again = retryable & (F.col("attempt") < tries)
    backoff = F.least(F.lit(most), base * F.pow(F.lit(factor), F.col("attempt") - 1))
    backoff = backoff if jitter is None else backoff * jitter
    delay = F.when(again, F.greatest(backoff, F.coalesce("retry_after", F.lit(0.0))))
    so_far = Window.partitionBy("call_id").orderBy("attempt")
    return attempts.withColumn("retried", again).withColumn("delay_s", delay).withColumn(
        "waited_s", F.sum(F.coalesce(delay, F.lit(0.0))).over(so_far)
    )


@dataclass(frozen=True)
class RetryPolicy:
    """How often and how long a call is tried again. Waits double from ``base`` up to ``most``, and add up to ``total`` at most."""

    tries: int = 4
    base: float = 0.5
    most: float = 30.0
    total: float = 120.0
    jitter: str = "full"
    respect_retry_after: bool = True

    def __post_init__(self):
        if self.jitter not in ("none", "equal", "full"):
            raise ValueError(f"unknown jitter {self.jitter!r}; known: none, equal, full")
        if self.tries < 1 or min(self.base, self.most) <= 0 or self.total < 0:
            raise ValueError("a retry policy needs a try, and waits above zero")

    def wait(self, attempt: Column, retry_after: Column, draw: Column) -> Column:
        """The wait after a failed attempt (from 1); ``draw`` is uniform on [0, 1). A wait that the vendor names is the least there is."""
        full = F.least(F.lit(self.most), self.base * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0)).cast("double")))
        own = {"none": full, "equal": full / 2 + draw * full / 2, "full": draw * full}[self.jitter]
        return F.greatest(own, F.coalesce(retry_after, F.lit(0.0))) if self.respect_retry_after else own


def retry_chains(attempts: DataFrame, policy: RetryPolicy, draw: Column | None = None, seed: int = 0) -> DataFrame:
    """For each failed attempt: whether it is tried again, after what wait, and why not.

    ``attempts`` has call_id, attempt (from 1), kind and retry_after (seconds or
    null). A wait is granted only if it and those granted before stay within the
    budget, and nothing is granted after a refusal: a fold over a call's attempts
    in order. ``reason`` is null where a retry is granted, else not_retryable,
    exhausted, over_budget or not_reached. Without ``draw`` the jitter comes from
    a hash of the call, the attempt and the seed. Rows that repeat an attempt are
    one; attempts beyond the last try take no part in the fold, which so is short.
    """
    if draw is None:
        draw = F.pmod(F.xxhash64("call_id", "attempt", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    facts = F.struct("kind", F.col("retry_after").cast("double").alias("retry_after"), draw.cast("double").alias("draw"))
    once = attempts.groupBy("call_id", "attempt").agg(F.min(facts).alias("facts"))
    early = F.col("attempt") <= policy.tries
    chains = once.filter(early).groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("attempt", "facts.*"))).alias("chain"))

    def step(acc: Column, a: Column) -> Column:
        wait = policy.wait(a["attempt"], a["retry_after"], a["draw"])
        reason = (
            F.when(~acc["open"], "not_reached")
            .when(~F.coalesce(a["kind"].isin(*RETRYABLE), F.lit(False)), "not_retryable")
            .when(a["attempt"] >= policy.tries, "exhausted")
            .when(acc["waited"] + wait > policy.total, "over_budget")
        )
        granted = reason.isNull()
        waited = acc["waited"] + F.when(granted, wait).otherwise(0.0)
        row = F.struct(
            a["attempt"].alias("attempt"), a["kind"].alias("kind"), granted.alias("retried"), F.when(granted, wait).alias("delay_s"),
            waited.alias("waited_s"), reason.alias("reason"),
        )
        return F.struct(waited.alias("waited"), granted.alias("open"), F.array_append(acc["rows"], row).alias("rows"))

    kind, attempt = dict(attempts.dtypes)["kind"], dict(attempts.dtypes)["attempt"]
    none = F.array().cast(f"array<struct<attempt:{attempt},kind:{kind},retried:boolean,delay_s:double,waited_s:double,reason:string>>")
    start = F.struct(F.lit(0.0).alias("waited"), F.lit(True).alias("open"), none.alias("rows"))
    folded = chains.select("call_id", F.inline(F.aggregate("chain", start, step, lambda acc: acc["rows"])))
    late = once.filter(~early).select(
        "call_id", "attempt", "facts.kind", F.lit(False).alias("retried"), F.lit(None).cast("double").alias("delay_s"),
        F.lit(None).cast("double").alias("waited_s"), F.lit("not_reached").alias("reason"),
    )
    return folded.unionByName(late)


def gate_closings(limits: DataFrame) -> DataFrame:
    """When a provider's gate reopens after each rate limit: the latest deadline so far wins.

    A wait of zero or none is the usual one. A provider's log is split by the hour, and the latest deadline of the hours
    before is carried on: no task reads a provider's whole log.
    """
    named = F.when(F.col("retry_after") != 0, F.greatest(F.col("retry_after"), F.lit(0.0)))
    until = F.col("at") + F.least(F.coalesce(named, F.lit(USUAL_COOLDOWN)), F.lit(LONGEST_COOLDOWN))
    hour = F.floor(F.col("at") / 3600)
    rows = limits.withColumns({"gate_until": until, "gate_hour": hour})
    hours = rows.groupBy(F.col("provider").alias("of"), F.col("gate_hour").alias("in_hour")).agg(F.max("gate_until").alias("last"))
    before = Window.partitionBy("of").orderBy("in_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("of", "in_hour", F.max("last").over(before).alias("carried"))
    joined = rows.join(hours, rows["provider"].eqNullSafe(hours["of"]) & rows["gate_hour"].eqNullSafe(hours["in_hour"]))
    order = Window.partitionBy("provider", "gate_hour").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.greatest(F.max("gate_until").over(order), "carried")
    return joined.withColumn("closed_until", latest).drop("gate_until", "gate_hour", "of", "in_hour", "carried")


def sweep_stale(runs: DataFrame, before: Column) -> DataFrame:
    """Running runs without a heartbeat since ``before`` become interrupted."""
    stale = (F.col("status") == "running") & (F.col("updated_at") < before)
    return runs.withColumn("status", F.when(stale, "interrupted").otherwise(F.col("status")))


def last_events(events: DataFrame) -> DataFrame:
    """The latest event of each run."""
    latest = F.struct("at", "event_id", "case_id", "kind")
    return events.groupBy("run_id").agg(F.max(latest).alias("last"), F.count(F.lit(1)).alias("n_events")).select(
        "run_id", "n_events", F.col("last.case_id").alias("last_case"), F.col("last.kind").alias("last_kind")
    )
