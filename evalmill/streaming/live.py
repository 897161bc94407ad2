"""Runs as streams: progress counters, resumed results, budgets, and windows over events."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def progress(results: DataFrame) -> DataFrame:
    """Running counts of each run, for the update mode: attempted, ok, passed and errors."""
    return results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_attempted"),
        F.count_if(F.col("status") == "ok").alias("n_completed"),
        F.count_if(F.coalesce("passed", F.lit(False))).alias("n_passed"),
        F.count_if(F.col("status") != "ok").alias("n_errors"),
    )


def without_repeats(results: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Results of a resumed run: a case that comes again within the delay is dropped."""
    return results.withWatermark("completed_at", delay).dropDuplicatesWithinWatermark(["run_id", "case_id"])


def tumbling(events: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events by window and type; rows later than the watermark are dropped."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", size).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )


def sliding(events: DataFrame, size: str = "2 hours", slide: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", size, slide).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Each user's sessions: events that follow each other by less than the gap."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("s"), "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "user_id", "n")
    )


def budget_states(costs: DataFrame, cap: str) -> DataFrame:
    """Known spend of each run in arrival order, and whether it has passed the cap; one row for each batch of a run.

    Money is exact decimals. The state of a run is its spend and count; a run without rows for an hour is forgotten.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        spent, n = (Decimal(state.get[0]), state.get[1]) if state.exists else (Decimal(0), 0)
        for part in rows:
            spent += sum((Decimal(str(x)) for x in part["billable"] if x is not None), Decimal(0))
            n += len(part)
        state.update((str(spent), n))
        state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame({"run_id": [key[0]], "spent": [spent], "n_cases": [n], "exceeded": [spent > Decimal(cap)]})

    return costs.groupBy("run_id").applyInPandasWithState(
        step, "run_id string, spent decimal(28,12), n_cases long, exceeded boolean", "spent string, n long", "update", "ProcessingTimeTimeout"
    )


def drained(stream: DataFrame, spark: SparkSession, name: str, mode: str) -> DataFrame:
    """Run a stream over what is there, into memory; for tests and small demonstrations.

    Batches without data are off: with a processing-time timeout they would follow each other without end.
    """
    empty = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(empty)
    spark.conf.set(empty, "false")
    try:
        query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    finally:
        spark.conf.set(empty, before)
    query.awaitTermination()
    return spark.table(name)
