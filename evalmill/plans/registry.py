"""Queries over the reference operators, by name, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalmill.plans import answers, comparison, evaluation, metrics, mixed, records, serving, suites
from evalmill.plans.shared import Entry
from evalmill.session import ship_package

_ENTRIES: list[Entry] = [*metrics.ENTRIES, *comparison.ENTRIES, *evaluation.ENTRIES, *serving.ENTRIES, *records.ENTRIES, *mixed.ENTRIES, *suites.ENTRIES, *answers.ENTRIES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def run(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return entry.query(spark, sf_dir)

        return query

    return {entry.name: run(entry) for entry in _ENTRIES}


def oracle_sql() -> dict[str, str]:
    return {entry.name: entry.sql for entry in _ENTRIES if entry.sql}
