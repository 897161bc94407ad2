"""Vendors' answers as one shape: text, finish reason and token counts of five wire formats, read as variants.

A wrong type is an unknown value, never an error: a count that is no whole
number is null, a text that is no text is left out. An answer without the part
that would hold it has ``there`` false and no text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalmill.sources.checks import kind, part, parts

# Finish reasons of the wire formats; any other is unknown.
FINISH = {
    "chat": {"stop": "stop", "length": "length", "content_filter": "content_filter", "tool_calls": "tool_use", "function_call": "tool_use"},
    "messages": {
        "end_turn": "stop", "stop_sequence": "stop", "max_tokens": "length", "model_context_window_exceeded": "length", "tool_use": "tool_use", "refusal": "content_filter",
    },
    "candidates": {
        "STOP": "stop", "MAX_TOKENS": "length", "SAFETY": "content_filter", "RECITATION": "content_filter", "BLOCKLIST": "content_filter", "PROHIBITED_CONTENT": "content_filter",
        "SPII": "content_filter", "IMAGE_SAFETY": "content_filter", "IMAGE_PROHIBITED_CONTENT": "content_filter", "IMAGE_RECITATION": "content_filter",
        "MALFORMED_FUNCTION_CALL": "tool_use", "UNEXPECTED_TOOL_CALL": "tool_use",
    },
    "local": {"stop": "stop", "length": "length"},
    "responses": {"max_output_tokens": "length", "content_filter": "content_filter"},
}
# Where the formats hold their counts.
COUNTS = {
    "chat": ("usage.prompt_tokens", "usage.completion_tokens", "usage.total_tokens", "usage.prompt_tokens_details.cached_tokens", "usage.completion_tokens_details.reasoning_tokens"),
    "responses": ("usage.input_tokens", "usage.output_tokens", "usage.total_tokens", "usage.input_tokens_details.cached_tokens", "usage.output_tokens_details.reasoning_tokens"),
    "messages": ("usage.input_tokens", "usage.output_tokens", None, "usage.cache_read_input_tokens", None),
    "candidates": ("usage_metadata.prompt_token_count", "usage_metadata.candidates_token_count", "usage_metadata.total_token_count", "usage_metadata.cached_content_token_count", "usage_metadata.thoughts_token_count"),
    "local": ("prompt_eval_count", "eval_count", None, None, None),
}
FIELDS = ("input_tokens", "output_tokens", "total_tokens", "cached_tokens", "reasoning_tokens")


def text_at(value: Column, path: str) -> Column:
    """A text at a path, null if something else is there."""
    return F.when(kind(part(value, path)) == "string", part(value, path, "string"))


def count_at(value: Column, path: str | None) -> Column:
    """A count at a path: whole and not negative, else null; texts and truth values are no counts."""
    if path is None:
        return F.lit(None).cast("long")
    number = part(value, path, "double")
    whole = kind(part(value, path)).isin("integer", "number") & (number >= 0) & (number == F.floor(number))
    return F.when(whole, part(value, path, "decimal(38,0)").cast("long"))


def _joined(blocks: Column, wanted) -> Column:
    texts = F.transform(F.filter(blocks, lambda b: (kind(b) == "object") & wanted(b)), lambda b: text_at(b, "text"))
    return F.array_join(F.filter(texts, lambda t: t.isNotNull()), "")


def _any_text(_: Column) -> Column:
    return F.lit(True)


def _of_type(*names: str):
    return lambda b: F.coalesce(text_at(b, "type").isin(*names), F.lit(False))


def _known(found: Column, reasons: dict[str, str]) -> Column:
    names = F.create_map(*(F.lit(x) for pair in reasons.items() for x in pair))
    return F.coalesce(F.try_element_at(names, found), F.lit("unknown"))


def read_answer(answer: Column, wire: str) -> Column:
    """A struct (there, text, finish, truncated, counts of ``FIELDS``, model) of an answer of a wire format.

    ``answer`` is a column of variants, of ``try_parse_json``: a column of its
    own, so that each answer is parsed once.
    """
    object_ = kind(answer) == "object"
    there = object_
    if wire == "chat":
        choice = part(answer, "choices[0]")
        content = part(choice, "message.content")
        there = kind(choice) == "object"
        text = F.when(kind(content) == "string", text_at(choice, "message.content")).otherwise(_joined(parts(choice, "message.content"), _any_text))
        finish = _known(text_at(choice, "finish_reason"), FINISH[wire])
    elif wire == "responses":
        items = F.filter(parts(answer, "output"), lambda i: kind(i) == "object")
        blocks = F.flatten(F.transform(items, lambda i: parts(i, "content")))
        text = _joined(blocks, _of_type("output_text"))
        refused = F.exists(blocks, lambda b: (kind(b) == "object") & _of_type("refusal")(b))
        calls = F.exists(items, lambda i: F.coalesce(text_at(i, "type").endswith("_call"), F.lit(False)))
        status = text_at(answer, "status")
        cut = _known(text_at(answer, "incomplete_details.reason"), FINISH[wire])
        done = F.when(refused, "content_filter").when(calls, "tool_use").otherwise("stop")
        finish = F.when(status == "incomplete", cut).when(status == "completed", done).otherwise("unknown")
    elif wire == "messages":
        text = _joined(parts(answer, "content"), _of_type("text"))
        finish = _known(text_at(answer, "stop_reason"), FINISH[wire])
    elif wire == "candidates":
        first = part(answer, "candidates[0]")
        there = kind(first) == "object"
        spoken = lambda b: ~F.coalesce(part(b, "thought", "boolean"), F.lit(False))
        text = _joined(parts(first, "content.parts"), spoken)
        finish = _known(text_at(first, "finish_reason"), FINISH[wire])
    elif wire == "local":
        text = F.coalesce(text_at(answer, "message.content"), F.lit(""))
        finish = _known(text_at(answer, "done_reason"), FINISH[wire])
    else:
        raise ValueError(f"unknown wire format {wire!r}; known: {', '.join(FINISH)}")
    there = F.coalesce(there, F.lit(False))
    counts = dict(zip(FIELDS, (count_at(answer, path) for path in COUNTS[wire]), strict=True))
    counts["total_tokens"] = F.coalesce(counts["total_tokens"], counts["input_tokens"] + counts["output_tokens"])
    return F.struct(
        there.alias("there"), F.when(there, text).alias("text"), F.when(there, finish).alias("finish"), F.when(there, finish == "length").alias("truncated"),
        *(c.alias(name) for name, c in counts.items()), text_at(answer, "model").alias("model"),
    )
