"""Suite, price and policy documents as DataFrames, with all their errors at once."""

from __future__ import annotations

import json
import re
from decimal import Decimal, InvalidOperation
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from evalmill.operators.evaluators import spec_errors
from evalmill.operators.policy import Check, Policy, valid_path

MOST_BYTES = 8 << 20
#: Names that a listing returns, and entries that it looks at, at most.
MOST_NAMES, MOST_ENTRIES = 500, 20_000
CASES = (
    "suite string, version string, ord int, id string, input string, messages array<struct<role:string,content:string,name:string>>, "
    "system string, expected string, category string, tags array<string>, weight double, metadata string, params string, "
    "evaluators array<struct<type:string,id:string,weight:double,required:boolean,on_error:string,params:string>>, body string"
)
PRICES = (
    "ord int, provider string, model string, match string, input_per_mtok decimal(12,6), output_per_mtok decimal(12,6), "
    "cached_input_per_mtok decimal(12,6), price_table_id string, price_table_version string"
)
_SUITE_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}")
_CASE_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._:-]{0,127}")
_CASE_KEYS = {
    "id", "input", "messages", "system", "expected", "category", "tags", "weight", "metadata", "params", "evaluators",
}


def contained(root: str, path: str) -> Path:
    """``path`` under ``root``; one that leads out of it raises ``ValueError``."""
    base = Path(root).resolve()
    found = (base / path).resolve()
    if found != base and base not in found.parents:
        raise ValueError(f"{path!r} leads out of the suite folder")
    return found


def suite_file(root: str, name: str) -> Path:
    """The file of a suite by its relative name, with or without its suffix."""
    if PurePosixPath(name).is_absolute() or "\\" in name:
        raise ValueError("a suite's name is a relative path")
    for suffix in ("", ".yaml", ".yml", ".json"):
        if (found := contained(root, name + suffix)).is_file():
            return found
    raise FileNotFoundError(name)


def suite_names(root: str) -> list[str]:
    found = []
    for i, path in enumerate(sorted(Path(root).rglob("*"))):
        if i >= MOST_ENTRIES or len(found) >= MOST_NAMES:
            break
        if path.suffix in (".yaml", ".yml", ".json") and path.is_file():
            found.append(path.relative_to(root).as_posix())
    return found


def read_document(path: str | Path) -> dict:
    """A YAML or JSON document whose top level is a mapping."""
    path = Path(path)
    raw = path.read_bytes()
    if len(raw) > MOST_BYTES:
        raise ValueError(f"{path.name} is larger than {MOST_BYTES} bytes")
    if path.suffix in (".yaml", ".yml"):
        import yaml

        value = yaml.safe_load(raw.decode())
    elif path.suffix == ".json":
        value = json.loads(raw.decode())
    else:
        raise ValueError(f"{path.name} is neither YAML nor JSON")
    if not isinstance(value, dict):
        raise ValueError(f"{path.name} holds no mapping")
    return value


def suite_errors(suite: dict, file: str = "") -> list[tuple[str, str, str, str]]:
    """All that is wrong with a suite: (file, place, case id, what)."""
    found: list[tuple[str, str, str, str]] = []
    say = lambda place, case, what: found.append((file, place, case, what))
    if not _SUITE_NAME.fullmatch(str(suite.get("name", ""))):
        say("name", "", f"not a name: {str(suite.get('name'))[:120]!r}")
    cases = suite.get("cases")
    if not isinstance(cases, list) or not cases:
        say("cases", "", "a suite needs at least one case")
        cases = []
    seen: set[str] = set()
    for i, case in enumerate(cases):
        place = f"cases[{i}]"
        if not isinstance(case, dict):
            say(place, "", "not a mapping")
            continue
        name = str(case.get("id", ""))
        if not _CASE_ID.fullmatch(name):
            say(f"{place}.id", name[:120], "missing or not an id")
        if name in seen:
            say(f"{place}.id", name, "repeated")
        seen.add(name)
        if ("input" in case) == ("messages" in case):
            say(place, name, "needs just one of input and messages")
        for key in sorted(set(case) - _CASE_KEYS):
            say(f"{place}.{key}", name, "unknown field")
        for what in spec_errors(case.get("evaluators", [])):
            say(f"{place}.{what.split(':')[0]}", name, what)
    return found


def error_rows(spark: SparkSession, errors: list[tuple[str, str, str, str]]) -> DataFrame:
    return spark.createDataFrame(errors, "file string, place string, case_id string, message string")


def suite_cases(spark: SparkSession, suite: dict) -> DataFrame:
    """The authored cases of a checked suite; JSON parts stay text."""
    text = lambda v: None if v is None else json.dumps(v, sort_keys=True)
    rows = []
    for i, c in enumerate(suite["cases"]):
        specs = [
            (e["type"], e.get("id"), float(e.get("weight", 1)), e.get("required", True), e.get("on_error", "error"), text(e.get("params", {})))
            for e in c.get("evaluators", [])
        ]
        messages = [(m["role"], m["content"], m.get("name")) for m in c["messages"]] if "messages" in c else None
        rows.append((
            suite["name"], str(suite.get("version", "1")), i, c["id"], c.get("input"), messages, c.get("system"), text(c.get("expected")),
            c.get("category"), c.get("tags"), float(c.get("weight", 1)), text(c.get("metadata")), text(c.get("params")), specs, text(c),
        ))
    return spark.createDataFrame(rows, CASES)


def price_table(spark: SparkSession, document: dict) -> DataFrame:
    """Prices as exact decimals, read through their text."""

    def money(value) -> Decimal | None:
        try:
            return None if value is None else Decimal(str(value))
        except InvalidOperation:
            raise ValueError(f"not a price: {value!r}") from None

    rows, seen = [], set()
    for i, m in enumerate(document["models"]):
        key = (m["provider"], m["model"], m.get("match", "exact"))
        if key in seen:
            raise ValueError(f"the price of {key} is given twice")
        seen.add(key)
        prices = (money(m["input_per_mtok"]), money(m["output_per_mtok"]), money(m.get("cached_input_per_mtok")))
        rows.append((i, *key, *prices, document["id"], str(document["version"])))
    return spark.createDataFrame(rows, PRICES)


def policy_of(document: dict) -> Policy:
    """A threshold policy; unknown metrics and checks without a bound raise ``ValueError``."""
    if any(c.get("require_significant") for c in document["checks"]):
        raise ValueError("require_significant is reserved and must stay false")
    bad = [c["metric"] for c in document["checks"] if not valid_path(c["metric"])]
    if bad:
        raise ValueError(f"no metric has the path {bad[0]!r}")
    checks = tuple(Check(**{k: v for k, v in c.items() if k != "require_significant"}) for c in document["checks"])
    keys = ("paired", "require_same_suite", "min_paired_cases", "fail_on_missing_metric", "confidence_level")
    return Policy(checks, **{k: document[k] for k in keys if k in document})
