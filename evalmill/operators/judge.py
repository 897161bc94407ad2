"""Model-graded evaluation as data: parsing verdicts, repetitions and panels of judges."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.functions.documents import canonical, unwrap
from evalmill.functions.stats import normalized_rating

#: A reported overall score that is further from the computed one counts as a mismatch.
MISMATCH = 0.5
PARSED = "ok boolean, kind string, raw double, overall double, confidence double, per_criterion map<string,double>"


def parse_verdict(text: str | None, criteria: dict[str, float], low: float, high: float, integral: bool) -> dict:
    """Read one judge's answer against criteria (name: weight) on a scale.

    The kinds of failure, in the order they are found: ``json``, ``schema``,
    ``criteria`` (missing, unexpected or repeated ones) and ``range`` (not
    finite, off the scale, or not whole on a scale of whole numbers).
    """

    def fail(kind: str) -> dict:
        return {"ok": False, "kind": kind, "raw": None, "overall": None, "confidence": None, "per_criterion": None}

    try:
        value = json.loads(unwrap(text or ""))
    except (ValueError, RecursionError):
        return fail("json")
    if not isinstance(value, dict):
        return fail("json")
    rows = value.get("criteria")
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    shaped = isinstance(rows, list) and all(
        isinstance(r, dict) and isinstance(r.get("name"), str) and number(r.get("score")) for r in rows
    )
    if not shaped or not (value.get("overall_score") is None or number(value["overall_score"])):
        return fail("schema")
    names = [r["name"] for r in rows]
    if sorted(names) != sorted(criteria):
        return fail("criteria")
    scores = {r["name"]: float(r["score"]) for r in rows}
    overall = value.get("overall_score")
    for score in [*scores.values(), *([float(overall)] if overall is not None else [])]:
        if not math.isfinite(score) or not low <= score <= high:
            return fail("range")
    if integral and any(s != int(s) for s in scores.values()):
        return fail("range")
    total = sum(criteria.values())
    if scores and total > 0:
        raw = sum(criteria[n] * s for n, s in scores.items()) / total
    else:
        raw = None if overall is None else float(overall)
    confidence = value.get("confidence")
    return {
        "ok": True, "kind": None, "raw": raw, "overall": None if overall is None else float(overall),
        "confidence": float(confidence) if number(confidence) else None, "per_criterion": scores,
    }


def parse_verdicts(answers: DataFrame, column: str, criteria: dict[str, float], low=1.0, high=5.0, integral=True) -> DataFrame:
    """``answers`` with the struct ``verdict`` parsed from a column of judge texts."""

    @F.pandas_udf(PARSED)
    def parsed(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_verdict(t, criteria, low, high, integral) for t in text], columns=[x.split()[0] for x in PARSED.split(", ")])

    return answers.withColumn("verdict", parsed(F.col(column)))


def overall_mismatch(verdict: str = "verdict") -> Column:
    v = F.col(verdict)
    return F.abs(v["overall"] - v["raw"]) > MISMATCH


def self_preference(judges: Column, provider: Column, model: Column) -> Column:
    """Whether any judge (provider, model) is the model it judges."""
    return F.exists(judges, lambda j: (j["provider"] == provider) & (j["model"] == model))


def repetition_value(raw: Column, how: str) -> Column:
    """One judge's repetitions as one figure; the most frequent rating's ties go to the lowest."""
    return {"mean": F.avg(raw), "median": F.median(raw), "min": F.min(raw), "majority": F.mode(raw, True)}[how]


def panel_scores(ratings: DataFrame, how: str = "median", low: float = 1.0, high: float = 5.0, high_variance: float = 1.0) -> DataFrame:
    """Per case: the median over judges of their aggregates, with dispersion, agreement and flags.

    ``ratings`` holds run_id, case_id, judge and raw (null where unparsed).
    """
    own = ratings.groupBy("run_id", "case_id", "judge").agg(
        repetition_value(F.col("raw"), how).alias("value"),
        F.min("raw").alias("least"),
        F.max("raw").alias("most"),
        F.count_if(F.col("raw").isNull()).alias("unparsed"),
    )
    spread = F.max("most") - F.min("least")
    found = own.groupBy("run_id", "case_id").agg(
        F.count("value").alias("n_judges"),
        F.median("value").alias("raw_score"),
        spread.alias("dispersion"),
        (F.max("value") - F.min("value")).alias("judge_range"),
        F.sum("unparsed").alias("parse_failures"),
    )
    agreement = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("dispersion") / (high - low)))
    return found.select(
        "*",
        normalized_rating(F.col("raw_score"), F.lit(low), F.lit(high)).alias("score"),
        agreement.alias("agreement"),
        (F.col("dispersion") > high_variance).alias("high_variance"),
        F.when(F.col("n_judges") > 1, F.col("judge_range") > high_variance).alias("disagreement"),
    )


def known_sum(value: Column) -> Column:
    """A sum that is null when any part is, or there is none."""
    return F.when((F.count(value) == F.count(F.lit(1))) & (F.count(value) > 0), F.sum(value))


def rubric_digest(template: str, rubric: str, criteria: list[dict], scale: dict, use_reference: bool) -> str:
    from hashlib import sha256

    parts = {"template": template, "rubric": rubric, "criteria": criteria, "scale": scale, "use_reference": use_reference}
    return "sha256:" + sha256(canonical(parts).encode()).hexdigest()
