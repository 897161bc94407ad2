"""Suites of cases: defaults, hashes, selection and snapshots."""

from __future__ import annotations

import json
import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evalmill.functions.documents import canonical
from evalmill.functions.text import digest
from evalmill.session import stage


def resolve(cases: DataFrame, defaults: dict) -> DataFrame:
    """Cases with the suite's defaults merged in.

    A case's own system text wins; its evaluators replace the default ones if it
    has any; tags are joined without repeats, defaults first; metadata is merged
    key by key; an ``input`` stands for one user message.
    """
    defaults_tags = F.array(*map(F.lit, defaults.get("tags", []))).cast("array<string>")
    specs = F.from_json(F.lit(json.dumps(defaults.get("evaluators", []))), cases.schema["evaluators"].dataType)
    own = F.coalesce("evaluators", F.array().cast(cases.schema["evaluators"].dataType))
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("input").alias("content"), F.lit(None).cast("string").alias("name")))
    changes = {
        "system": F.coalesce("system", F.lit(defaults.get("system"))),
        "tags": F.array_distinct(F.concat(defaults_tags, F.coalesce("tags", F.array().cast("array<string>")))),
        "evaluators": F.when(F.size(own) > 0, own).otherwise(specs),
        "messages": F.coalesce("messages", message),
        "params": merged_json("params", defaults.get("params", {})),
        "metadata": merged_json("metadata", defaults.get("metadata", {})),
    }
    return cases.select(*(changes.get(c, F.col(c)).alias(c) for c in cases.columns if c != "input"), *(
        changes[c].alias(c) for c in ("messages",) if c not in cases.columns
    ))


def merged_json(column: str, defaults: dict):
    """JSON objects over defaults: only keys that are there override, ``extra`` is merged by key."""

    @F.pandas_udf(StringType())
    def merge(text: pd.Series) -> pd.Series:
        def one(t: str | None) -> str:
            own = json.loads(t) if t else {}
            out = {**defaults, **own}
            if isinstance(defaults.get("extra"), dict) and isinstance(own.get("extra"), dict):
                out["extra"] = {**defaults["extra"], **own["extra"]}
            return canonical(out)

        return text.map(one)

    return merge(F.col(column))


# What stands for parameters and fields of evaluators that a case leaves out.
PARAMS = {"temperature": None, "max_output_tokens": None, "top_p": None, "stop": [], "seed": None, "response_format": "text", "extra": {}}
SPEC = {"id": None, "weight": 1.0, "required": True, "on_error": "error", "params": {}}
_REAL = ("temperature", "top_p", "weight")


def filled(found: dict | None, defaults: dict) -> dict:
    """A mapping with its defaults; a null stands for a default that isn't null, and figures that may be broken are real."""
    given = {k: v for k, v in (found or {}).items() if v is not None}
    return {k: float(v) if k in _REAL and v is not None else v for k, v in {**defaults, **given}.items()}


@F.pandas_udf(StringType())
def case_canonical(text: pd.Series) -> pd.Series:
    """Canonical JSON of what a case's hash covers: its prompt, whether authored as an input or as messages, system,
    expectation, params and evaluators, with all defaults filled in, so that leaving one out changes nothing. Tags,
    category, metadata and weight are left out.
    """
    keys = ("id", "messages", "system", "expected", "params", "evaluators")

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        case = json.loads(t)
        if case.get("messages") is None and case.get("input") is not None:
            case["messages"] = [{"role": "user", "content": case["input"]}]
        messages = case.get("messages")
        case["messages"] = messages and [{"name": m.get("name"), "role": m["role"], "content": m["content"]} for m in messages]
        case["params"] = filled(case.get("params"), PARAMS)
        case["evaluators"] = [filled(spec, SPEC) for spec in case.get("evaluators") or []]
        return canonical({k: case.get(k) for k in keys})

    return text.map(one)


def resolved_bodies(cases: DataFrame) -> DataFrame:
    """Resolved cases (of :func:`resolve`) with ``body``: their content as JSON, the suite's defaults included."""
    specs = F.transform("evaluators", lambda e: F.to_json(e, {"ignoreNullFields": "false"}))

    @F.pandas_udf(StringType())
    def joined(head: pd.Series, expected: pd.Series, params: pd.Series, evaluators: pd.Series) -> pd.Series:
        def spec(text: str) -> dict:
            found = json.loads(text)
            return {**found, "params": json.loads(found["params"]) if found.get("params") else {}}

        def one(h: str, e: str | None, p: str | None, s) -> str:
            read = lambda t: None if t is None else json.loads(t)
            return canonical({**json.loads(h), "expected": read(e), "params": read(p), "evaluators": [spec(x) for x in (s if s is not None else [])]})

        return pd.Series([one(*row) for row in zip(head, expected, params, evaluators, strict=True)])

    head = F.to_json(F.struct("id", "messages", "system"), {"ignoreNullFields": "false"})
    return cases.withColumn("body", joined(head, F.col("expected"), F.col("params"), specs))


def with_case_hash(cases: DataFrame) -> DataFrame:
    """``cases`` (with a JSON column ``body``) and the hash of each one's content."""
    return cases.withColumn("case_hash", digest(case_canonical(F.col("body"))))


def suite_hashes(cases: DataFrame) -> DataFrame:
    """One hash for each suite over its cases' hashes, in any order of rows."""
    pair = F.struct(F.col("id").alias("id"), F.col("case_hash").alias("case_hash"))
    rows = cases.groupBy("suite", "version").agg(F.array_sort(F.collect_list(pair)).alias("cases"))
    # to_json keeps the order of fields, which here is that of their names: the text is canonical.
    text = F.to_json(F.struct("cases", F.col("suite").alias("name"), F.lit(1).alias("schema_version"), "version"))
    return rows.select("suite", "version", digest(text).alias("suite_hash"), F.size("cases").alias("n_cases"))


def snapshot_upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The rows to append: one for each hash that isn't stored yet."""
    return new.dropDuplicates(["suite_hash"]).join(stored.select("suite_hash"), "suite_hash", "left_anti")


def select_cases(
    cases: DataFrame, ids: list[str] | None = None, tags: list[str] | None = None, sample: int | None = None, seed: int = 0, limit: int | None = None
) -> DataFrame:
    """Cases of a suite by ids, then tags (any of them), then a seeded sample, then a limit in the suite's order.

    The sample is that of ``random.Random(seed).sample`` over the ids in their
    order, so the same suite and seed select the same cases. Only how many cases
    there are is needed to draw: the drawn ordinals, ``sample`` longs, meet the
    cases' own ordinals in a join, and no id comes to the driver.
    """
    rows = cases
    if ids:
        rows = rows.filter(F.col("id").isin(ids))
    if tags:
        rows = rows.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if sample is not None:
        numbered = with_ordinals(rows, "ord")
        there = numbered.count()
        if sample < there:
            drawn = random.Random(seed).sample(range(there), sample)
            spark = rows.sparkSession
            chosen = spark.createDataFrame([(i,) for i in drawn], "drawn long")
            found = numbered.join(chosen, numbered["ordinal"] == chosen["drawn"], "left_semi").drop("ordinal")
            return found.orderBy("id").limit(limit if limit is not None else sample)
    return rows.orderBy("ord").limit(limit) if limit is not None else rows


def with_ordinals(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``ordinal``, their place from 0 in this order; ties come in any order.

    Sorted by range and written: a row's ordinal is its place in its partition,
    after the rows of the partitions before, of which there is one count each.
    """
    placed = stage(rows.sort(*order).withColumn("tick", F.monotonically_increasing_id()), "ordinals")
    part = F.shiftright("tick", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    ordinal = F.col("start") + F.col("tick").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(starts), part == starts["part"]).select(*rows.columns, ordinal.alias("ordinal"))


def hash_sample(rows: DataFrame, key: str, sample: int, seed: int = 0) -> DataFrame:
    """A seeded sample of ``sample`` rows by the least digests of their keys."""
    return rows.orderBy(F.sha2(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")), 256), key).limit(sample)


def not_yet_done(cases: DataFrame, done: DataFrame) -> DataFrame:
    """Cases of a resumed run that have no stored result."""
    return cases.join(done.select("case_id").distinct(), "case_id", "left_anti")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
