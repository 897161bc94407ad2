"""Arrow batches of bounded size for operators that read texts in Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bound_batches(spark: SparkSession, rows: int = 2000, megabytes: int = 16) -> None:
    """Let no Arrow batch hold more than so many rows or, texts being long, so many bytes."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", megabytes << 20)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def return_memory() -> None:
    """Give freed memory back to the system where the C library can, so that idle Python workers stay small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_held: dict[object, Any] = {}


def remembered(key: object, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: the tables of one operator at a time.

    Workers outlive a stage. What another operator has left goes, and its memory
    back to the system, before this one's is made.
    """
    if key not in _held:
        _held.clear()
        return_memory()
        _held[key] = make()
    return _held[key]


def small_side(staged: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A staged table of one long a row, broadcast if it has at most so many rows (some 16 MB); else Spark chooses the join."""
    return F.broadcast(staged) if staged.count() <= most else staged
