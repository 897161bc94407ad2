"""Row-level evaluators as Column builders, with a registry that custom ones join.

An evaluator turns an output (and what was expected) into a struct of status,
passed, score, raw and error. A missing output is an error ``no_output``, a
missing expectation ``missing_expected``; both beat every other result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evalmill.functions import documents, patterns, text
from evalmill.functions.schemas import SECONDS, VIOLATION_CHARS, Schema
from evalmill.functions.stats import clip, cosine_similarity, is_close

Evaluator = Callable[[Column, Column], Column]
#: ``detail`` is a JSON object of what an evaluator saw, null where it has nothing to say.
RESULT = "struct<status:string,passed:boolean,score:double,raw:double,error:string,detail:string>"
PATTERN_CHARS, SUBJECT_CHARS = 1000, 1_000_000
#: Seconds that one pattern may take over one text.
MATCH_SECONDS = 1.0


def result(passed: Column, score: Column | None = None, raw: Column | None = None, detail: Column | None = None) -> Column:
    """A verdict; without a score a pass is 1 and a failure 0."""
    score = F.when(passed, F.lit(1.0)).otherwise(F.lit(0.0)) if score is None else score
    none = F.lit(None)
    return F.struct(
        F.when(passed, "passed").otherwise("failed").alias("status"),
        passed.cast("boolean").alias("passed"),
        score.cast("double").alias("score"),
        (none if raw is None else raw).cast("double").alias("raw"),
        none.cast("string").alias("error"),
        (none if detail is None else detail).cast("string").alias("detail"),
    ).cast(RESULT)


def as_detail(**parts: Column) -> Column:
    """A JSON object of these columns, nulls included."""
    return F.to_json(F.struct(*(c.alias(name) for name, c in parts.items())), {"ignoreNullFields": "false"})


def error(kind: str) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit("error").alias("status"), none.cast("boolean").alias("passed"), none.cast("double").alias("score"),
        none.cast("double").alias("raw"), F.lit(kind).alias("error"), none.cast("string").alias("detail"),
    ).cast(RESULT)


def guarded(found: Column, output: Column, expected: Column | None = None) -> Column:
    out = F.when(output.isNull(), error("no_output"))
    if expected is not None:
        out = out.when(expected.isNull(), error("missing_expected"))
    return out.otherwise(found)


def exact_match(strip: bool = True, normalize_whitespace: bool = False, ignore_case: bool = False) -> Evaluator:
    def build(output: Column, expected: Column) -> Column:
        a, b = (text.normalize_text(x, strip, normalize_whitespace) for x in (output, expected))
        if ignore_case:
            a, b = text.casefold(a), text.casefold(b)
        return guarded(result(a == b), output, expected)

    return build


def exact_match_ci(strip: bool = True, normalize_whitespace: bool = False) -> Evaluator:
    return exact_match(strip, normalize_whitespace, ignore_case=True)


def contains(values: list[str], mode: str = "all", case_sensitive: bool = True) -> Evaluator:
    if not values or mode not in ("all", "any"):
        raise ValueError("contains needs values and a mode of all or any")

    def build(output: Column, _: Column) -> Column:
        subject = output if case_sensitive else text.casefold(output)
        wanted = values if case_sensitive else [v.casefold() for v in values]
        absent = [F.when(~F.contains(subject, F.lit(w)), F.lit(v)) for v, w in zip(values, wanted, strict=True)]
        missing = F.filter(F.array(*absent), lambda v: v.isNotNull())
        found = len(wanted) - F.size(missing)
        passed = found == len(wanted) if mode == "all" else found > 0
        detail = as_detail(mode=F.lit(mode), n_found=found, missing=missing)
        return guarded(result(passed, found / len(wanted), found, detail), output)

    return build


def regex(
    pattern: str, must_match: bool = True, group: int | None = None, ignore_case: bool = False, multiline: bool = False,
    dotall: bool = False, fullmatch: bool = False, seconds: float = MATCH_SECONDS,
) -> Evaluator:
    """Patterns mean what Python's ``re`` says, in the JVM where :mod:`patterns` can say it there.

    A text that takes longer than ``seconds`` in Python is an error
    ``regex_timeout``. ``detail`` tells whether it matched, and with ``group``
    what that group captured.
    """
    if len(pattern) > PATTERN_CHARS:
        raise ValueError(f"the pattern is longer than {PATTERN_CHARS} characters")
    flags = re.I * ignore_case | re.M * multiline | re.S * dotall
    groups = re.compile(pattern, flags).groups
    if group is not None and not 0 <= group <= groups:
        raise ValueError(f"the pattern has {groups} groups, and no group {group}")

    def build(output: Column, _: Column) -> Column:
        found = patterns.found_in(F.substring(output, 1, SUBJECT_CHARS), pattern, flags, fullmatch, group, seconds)
        matched = found["state"] == "true"
        said = {"matched": matched} | ({"captured": found["captured"]} if group is not None else {})
        failed = F.when(found["state"] == patterns.LATE, error(patterns.LATE)).when(found["state"] == "regex_error", error("regex_error"))
        return guarded(failed.otherwise(result(matched == F.lit(must_match), detail=as_detail(**said))), output)

    return build


def numeric_tolerance(abs_tol: float = 0.0, rel_tol: float = 0.0, extract: str = "first") -> Evaluator:
    """A text without a number fails; an expectation that is no number is missing."""

    def build(output: Column, expected: Column) -> Column:
        seen, wanted = text.found_number(output, extract), text.expected_number(text.normalize_text(expected))
        close = F.coalesce(is_close(seen, wanted, rel_tol, abs_tol), F.lit(False))
        return guarded(result(close, raw=seen), output, wanted)

    return build


def json_valid(require_object: bool = False, allow_markdown_fence: bool = True) -> Evaluator:
    @F.pandas_udf("string")
    def kind(subject: pd.Series) -> pd.Series:
        return subject.map(lambda s: documents.json_kind(s, allow_markdown_fence))

    def build(output: Column, _: Column) -> Column:
        found = kind(output)
        passed = found == "object" if require_object else found.isNotNull()
        return guarded(result(F.coalesce(passed, F.lit(False))), output)

    return build


def json_schema(schema: dict, allow_markdown_fence: bool = True, seconds: float = SECONDS) -> Evaluator:
    """Score 1 / (violations + 1); a text that doesn't parse fails with score 0.

    A schema with patterns that takes longer than ``seconds`` over a text, or
    meets a longer one than it may, is an error. ``detail`` lists the violations.
    """
    checked = Schema(schema)

    def one(subject: str) -> tuple[int | None, str | None, str | None]:
        payload = documents.unwrap(subject) if allow_markdown_fence else subject
        try:
            value = json.loads(payload)
        except (ValueError, RecursionError) as e:
            return -1, None, json.dumps({"n_errors": 1, "errors": [f"$: the text is no JSON: {e}"[:VIOLATION_CHARS]]})
        if checked.patterned and len(payload) > SUBJECT_CHARS:
            return None, "schema_instance_too_large", None
        try:
            found = checked.violations(value, seconds)
        except TimeoutError:
            return None, "schema_timeout", None
        except (RecursionError, MemoryError):
            return None, "schema_error", None
        return len(found), None, json.dumps({"n_errors": len(found), "errors": found}, ensure_ascii=False)

    @F.pandas_udf("n int, error string, detail string")
    def wrong(subject: pd.Series) -> pd.DataFrame:
        # Equal texts of a batch are checked once.
        known = {t: one(t) for t in subject.dropna().unique()}
        rows = [(None, None, None) if t is None else known[t] for t in subject]
        return pd.DataFrame({"n": pd.array([r[0] for r in rows], "Int32"), "error": [r[1] for r in rows], "detail": [r[2] for r in rows]})

    def build(output: Column, _: Column) -> Column:
        seen = wrong(output)
        n, unread = seen["n"], seen["n"] < 0
        found = result(n == 0, F.when(unread, 0.0).otherwise(1.0 / (n + 1)), F.when(unread, 1).otherwise(n), seen["detail"])
        failed = F.when(seen["error"].isNotNull(), error("schema").withField("error", seen["error"]))
        return guarded(failed.otherwise(found), output)

    return build


def lexical_similarity(threshold: float = 0.6, method: str = "token_set", ngram: int = 3, normalize: bool = True) -> Evaluator:
    if method not in ("token_set", "char_ngram") or not 2 <= ngram <= 8:
        raise ValueError("unknown method, or an n-gram size outside 2 to 8")

    def build(output: Column, expected: Column) -> Column:
        if normalize and method == "char_ngram":
            score = text.comparable_ngram_similarity(output, expected, ngram)
        else:
            a, b = (text.comparable_text(x) if normalize else text.normalize_text(x) for x in (output, expected))
            score = text.token_set_similarity(a, b) if method == "token_set" else text.char_ngram_similarity(a, b, ngram)
        return guarded(result(score >= threshold, score, score), output, expected)

    return build


def semantic_similarity(threshold: float = 0.82) -> Evaluator:
    """Over vectors: the raw cosine is held against the threshold, the score is clipped to [0, 1]."""

    def build(output: Column, expected: Column) -> Column:
        cosine = cosine_similarity(output, expected)
        found = F.when(cosine.isNull(), error("degenerate_embedding")).otherwise(result(cosine >= threshold, clip(cosine), cosine))
        return guarded(found, output, expected)

    return build


_REGISTRY: dict[str, Callable[..., Evaluator]] = {}


def register(name: str, build: Callable[..., Evaluator]) -> None:
    """Add an evaluator type; a name that is taken is refused."""
    if name in _REGISTRY:
        raise ValueError(f"the evaluator type {name!r} is already registered")
    _REGISTRY[name] = build


def evaluator(name: str, **params: Any) -> Evaluator:
    if name not in _REGISTRY:
        raise ValueError(f"unknown evaluator type {name!r}; known: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name](**params)


def known_types() -> list[str]:
    return sorted(_REGISTRY)


def spec_errors(specs: list[dict]) -> list[str]:
    """Everything wrong with a list of specs (type, params), not just the first of it."""
    found = []
    for i, spec in enumerate(specs):
        try:
            evaluator(spec.get("type", ""), **spec.get("params", {}))
        except (ValueError, TypeError, re.error) as e:
            found.append(f"evaluators[{i}]: {str(e)[:120]}")
    return found


for _build in (
    exact_match, exact_match_ci, contains, regex, numeric_tolerance, json_valid, json_schema, lexical_similarity, semantic_similarity
):
    register(_build.__name__, _build)
