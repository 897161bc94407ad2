"""Stored tables of runs: appends, replacements, point reads and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.functions.text import markdown_cell, neutralised, rfc3339

#: Bytes of a stored payload at most.
PAYLOAD_BYTES = 65_536
# The columns of a case export, in order.
EXPORT_COLUMNS = [
    "run_id", "case_id", "category", "tags", "status", "passed", "score", "provider", "model", "latency_ms", "input_tokens",
    "output_tokens", "total_cost", "unpriced_reason", "error_kind", "completed_at",
]

# The flat row of a stored case result, in order.
CASE_COLUMNS = [
    "run_id", "case_id", "case_hash", "status", "passed", "score", "attempts", "category", "tags", "latency_ms", "total_latency_ms",
    "input_tokens", "output_tokens", "total_tokens", "total_cost", "judge_cost", "priced", "unpriced_reason", "error_kind",
    "started_at", "completed_at",
]


def append(rows: DataFrame, path: str, *partitions: str) -> None:
    """Add rows to a table that is laid out by run, so that reads of a run read its files only."""
    rows.write.mode("append").partitionBy(*partitions or ("run_id",)).parquet(path)


def replace_runs(rows: DataFrame, path: str) -> None:
    """Replace the stored rows of just the runs that ``rows`` holds."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def of_runs(spark: SparkSession, path: str, schema: str, *run_ids: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path).filter(F.col("run_id").isin(*run_ids))


def capped_payload(payload: Column) -> Column:
    """A payload, or where it is too large a marker that says so."""
    size = F.octet_length(payload)
    marker = F.to_json(F.struct(F.lit(True).alias("_truncated"), F.lit("too large").alias("reason"), size.alias("bytes")))
    return F.when(size > PAYLOAD_BYTES, marker).otherwise(payload)


def export_rows(cases: DataFrame) -> DataFrame:
    """Flat text rows: tags joined by commas, money as text, UTC times."""
    changes = {
        "tags": F.array_join("tags", ","),
        "total_cost": F.col("total_cost").cast("string"),
        "completed_at": rfc3339(F.col("completed_at")),
    }
    return cases.select(*(changes.get(c, F.col(c)).alias(c) for c in EXPORT_COLUMNS))


def case_rows(cases: DataFrame) -> DataFrame:
    """The whole flat row of each case result: tags joined by commas, money as exact text, UTC times.

    A column that ``cases`` doesn't have is null; the total of tokens is known
    only if both parts are.
    """
    there = set(cases.columns)
    has = lambda c: F.col(c) if c in there else F.lit(None)
    changes = {
        "tags": F.coalesce(F.array_join("tags", ","), F.lit("")) if "tags" in there else F.lit(""),
        "total_tokens": F.coalesce(has("total_tokens"), (has("input_tokens") + has("output_tokens")).cast("long")),
        "total_cost": has("total_cost").cast("string"),
        "judge_cost": has("judge_cost").cast("string"),
        "started_at": rfc3339(has("started_at").cast("timestamp")),
        "completed_at": rfc3339(has("completed_at").cast("timestamp")),
    }
    return cases.select(*(changes.get(c, has(c)).alias(c) for c in CASE_COLUMNS))


def csv_rows(rows: DataFrame) -> DataFrame:
    """Cells as a CSV file has them: null is empty, and text can't start a formula."""
    kinds = dict(rows.dtypes)
    return rows.select(
        *(
            F.coalesce(neutralised(F.col(c)) if kinds[c] == "string" else F.col(c).cast("string"), F.lit("")).alias(c)
            for c in rows.columns
        )
    )


def write_csv(rows: DataFrame, path: str) -> None:
    csv_rows(rows).write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)


def export_documents(rows: DataFrame) -> DataFrame:
    """One JSON document for each case; a run's export is the lines of its files."""
    return rows.select("run_id", "case_id", F.to_json(F.struct(*rows.columns)).alias("document"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def markdown_table(rows: DataFrame, most: int = 50) -> str:
    """A Markdown table of the first rows; a report lists at most ``most`` of them and says how many more there are."""
    head = rows.select(*(markdown_cell(F.col(c).cast("string")).alias(c) for c in rows.columns)).limit(most + 1).collect()
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    lines += ["| " + " | ".join(r) + " |" for r in head[:most]]
    if len(head) > most:
        lines.append(f"\nand {rows.count() - most} more")
    return "\n".join(lines)


def read_payload(payload: Column, fields: dict[str, str]) -> Column:
    """A struct of fields (name: JSON path) of a vendor's answer; what isn't there is null."""
    return F.struct(*(F.get_json_object(payload, path).alias(name) for name, path in fields.items()))


# Where answers of five wire formats hold their fields.
PAYLOAD_FIELDS = {
    "chat": {"text": "$.choices[0].message.content", "finish": "$.choices[0].finish_reason", "input_tokens": "$.usage.prompt_tokens", "output_tokens": "$.usage.completion_tokens"},
    "responses": {"text": "$.output[0].content[0].text", "finish": "$.status", "input_tokens": "$.usage.input_tokens", "output_tokens": "$.usage.output_tokens"},
    "messages": {"text": "$.content[0].text", "finish": "$.stop_reason", "input_tokens": "$.usage.input_tokens", "output_tokens": "$.usage.output_tokens"},
    "candidates": {"text": "$.candidates[0].content.parts[0].text", "finish": "$.candidates[0].finishReason", "input_tokens": "$.usageMetadata.promptTokenCount", "output_tokens": "$.usageMetadata.candidatesTokenCount"},
    "local": {"text": "$.message.content", "finish": "$.done_reason", "input_tokens": "$.prompt_eval_count", "output_tokens": "$.eval_count"},
}
# Finish reasons of the wire formats, as one set.
FINISH_REASONS = {
    "stop": "stop", "end_turn": "stop", "STOP": "stop", "completed": "stop", "stop_sequence": "stop", "length": "length",
    "max_tokens": "length", "MAX_TOKENS": "length", "incomplete": "length", "content_filter": "content_filter",
    "SAFETY": "content_filter", "refusal": "content_filter",
}


def finish_reason(found: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in FINISH_REASONS.items() for x in pair))
    return F.coalesce(F.element_at(known, found), F.lit("unknown"))


# HTTP statuses with a kind of their own.
STATUS_KINDS = {401: "authentication", 403: "permission", 404: "not_found", 408: "timeout", 413: "context_length", 429: "rate_limit"}


def error_kind(status: Column) -> Column:
    """The kind of a failed call by its HTTP status; without one, or below 400, it is unknown."""
    known = F.create_map(*(F.lit(x) for pair in STATUS_KINDS.items() for x in pair))
    residue = F.when(status >= 500, "server").when(status >= 400, "invalid_request").otherwise("unknown")
    return F.coalesce(F.try_element_at(known, status), residue)
