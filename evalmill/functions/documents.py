"""JSON functions whose meaning is that of Python's ``json`` module."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_INFO = re.compile(r"[A-Za-z0-9_+-]*[ \t]*\r?")


def unwrap(text: str) -> str:
    """The inside of the Markdown fence around a whole text, else the text; marks within the inside are part of it."""
    first, newline, rest = text.strip().partition("\n")
    if not newline or not first.startswith("```") or not _INFO.fullmatch(first[3:]) or not rest.endswith("```"):
        return text
    return rest[:-3].rstrip(" \t").removesuffix("\n").removesuffix("\r")


def canonical(value: Any) -> str:
    """JSON with sorted keys and no spare characters; refuses not-a-number and infinities."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Canonical form of JSON text; null where it isn't JSON."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else canonical(json.loads(t))
        except (ValueError, RecursionError):
            return None

    return text.map(one)


def json_kind(text: str | None, fence: bool = True) -> str | None:
    """The kind of JSON value a text holds, or null where it doesn't parse."""
    if text is None:
        return None
    try:
        value = json.loads(unwrap(text) if fence else text)
    except (ValueError, RecursionError):
        return None
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number"}
    return kinds.get(type(value), "null")


@F.pandas_udf(StringType())
def json_value_kind(text: pd.Series) -> pd.Series:
    return text.map(json_kind)
