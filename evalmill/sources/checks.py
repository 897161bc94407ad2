"""Suite documents checked as data: rules over raw JSON as columns, all violations of all documents in one pass.

A document is a text (file, raw). Its cases are exploded and every rule looks at
the raw value, so a wrong type is a violation with its place and case, never an
error of the job. Only documents without a violation are typed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evalmill.operators.mixed import _built

#: What names of suites and ids of cases look like.
SUITE_NAME = r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,63}\z"
CASE_ID = r"\A[A-Za-z0-9][A-Za-z0-9._:-]{0,127}\z"
SUITE_KEYS = ("schema_version", "name", "version", "description", "defaults", "cases", "metadata")
CASE_KEYS = ("id", "input", "messages", "system", "expected", "category", "tags", "weight", "metadata", "params", "evaluators")
SPEC_KEYS = ("type", "id", "weight", "required", "on_error", "params")
ROLES = ("system", "user", "assistant")
TYPED = (
    "struct<id:string,input:string,messages:array<struct<role:string,content:string,name:string>>,system:string,category:string,tags:array<string>,weight:double,"
    "evaluators:array<struct<type:string,id:string,weight:double,required:boolean,on_error:string>>>"
)

Rule = Column  # a text of what is wrong, or null
Checks = list[tuple[Column, Column]]  # (place, what is wrong or null)


def read_suites(spark: SparkSession, path: str) -> DataFrame:
    """(file, raw) of the JSON documents under a path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))


def kind(value: Column) -> Column:
    """The kind of a JSON value: object, array, string, boolean, integer, number, null; null where there is none."""
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), None)
        .when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null")
        .when(name.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$"), "integer")
        .otherwise("number")
    )


def part(value: Column, name: str, as_type: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{name}", as_type)


def parts(value: Column, name: str) -> Column:
    """The elements of an array, none where it isn't one."""
    return F.coalesce(part(value, name, "array<variant>"), F.array().cast("array<variant>"))


def keys(value: Column) -> Column:
    return F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>"))


def must_be(value: Column, *kinds: str) -> Rule:
    """Nothing is wrong with a value that isn't there, or null."""
    found = kind(value)
    said = F.concat(F.lit(f"must be {' or '.join(kinds)}, not "), found)
    return F.when(found.isNotNull() & ~found.isin(*kinds, "null", *(["integer"] if "number" in kinds else [])), said)


def between(value: Column, least: float, most: float | None = None) -> Rule:
    x = F.try_variant_get(value, "$", "double")
    numeric = kind(value).isin("integer", "number")
    out = (x < least) if most is None else (x < least) | (x > most)
    return F.when(numeric & out, F.lit(f"must be {least:g} or more" if most is None else f"must be between {least:g} and {most:g}"))


def one_of(value: Column, *names: str) -> Rule:
    x = F.try_variant_get(value, "$", "string")
    return F.when((kind(value) == "string") & ~x.isin(*names), F.lit(f"must be one of {', '.join(names)}"))


@F.pandas_udf(StringType())
def spec_problem(kinds: pd.Series, params: pd.Series) -> pd.Series:
    """What keeps an evaluator from being built, null if nothing does."""

    @lru_cache(1000)
    def one(k: str, p: str) -> str | None:
        found = _built(k, p)
        return found if isinstance(found, str) else None

    return pd.Series([None if k is None else one(k, p or "{}") for k, p in zip(kinds, params, strict=True)])


def _unknown(value: Column, known: tuple[str, ...], at: Column) -> Column:
    strange = F.filter(keys(value), lambda k: ~k.isin(*known))
    return F.transform(strange, lambda k: F.struct(F.concat(at, F.lit("."), k).alias("place"), F.lit("unknown field").alias("message")))


def _checked(at: Column, *rules: tuple[str, Rule]) -> Column:
    """(place, message) of the rules that are broken under a place."""
    said = [F.when(r.isNotNull(), F.struct(F.concat(at, F.lit(p)).alias("place"), r.alias("message"))) for p, r in rules]
    return F.filter(F.array(*said), lambda x: x.isNotNull())


def _each(values: Column, at: Column, name: str, rules: Callable[[Column, Column], Column]) -> Column:
    place = lambda i: F.concat(at, F.lit(f".{name}["), i.cast("string"), F.lit("]"))
    return F.flatten(F.transform(values, lambda v, i: rules(v, place(i))))


def _message_rules(m: Column, at: Column) -> Column:
    role, content = part(m, "role"), part(m, "content")
    needed = lambda x: F.coalesce(F.when(x.isNull() | (kind(x) == "null"), "missing"), must_be(x, "string"))
    return F.when(kind(m) != "object", _checked(at, ("", must_be(m, "object")))).otherwise(
        _checked(at, (".role", F.coalesce(needed(role), one_of(role, *ROLES))), (".content", needed(content)), (".name", must_be(part(m, "name"), "string")))
    )


def _spec_rules(s: Column, at: Column) -> Column:
    kind_of, weight, mode = part(s, "type"), part(s, "weight"), part(s, "on_error")
    named = F.coalesce(F.when(kind_of.isNull() | (kind(kind_of) == "null"), "missing"), must_be(kind_of, "string"))
    own = _checked(
        at, (".type", named), (".id", must_be(part(s, "id"), "string")), (".weight", F.coalesce(must_be(weight, "number"), between(weight, 0))),
        (".required", must_be(part(s, "required"), "boolean")), (".on_error", F.coalesce(must_be(mode, "string"), one_of(mode, "error", "fail", "skip"))),
        (".params", must_be(part(s, "params"), "object")),
    )
    return F.when(kind(s) != "object", _checked(at, ("", must_be(s, "object")))).otherwise(F.concat(own, _unknown(s, SPEC_KEYS, at)))


def _case_rules(case: Column, at: Column) -> Column:
    name, tags, weight, params = (part(case, x) for x in ("id", "tags", "weight", "params"))
    given = lambda x: part(case, x).isNotNull() & (kind(part(case, x)) != "null")
    prompts = given("input").cast("int") + given("messages").cast("int")
    text = F.try_variant_get(name, "$", "string")
    identity = F.coalesce(F.when(name.isNull() | (kind(name) == "null"), "missing"), must_be(name, "string"), F.when(~text.rlike(CASE_ID), "not an id"))
    sampling = lambda x: part(params, x)
    own = _checked(
        at, (".id", identity), ("", F.when(prompts != 1, F.when(prompts == 0, "needs an input or messages").otherwise("has both an input and messages"))),
        *((f".{x}", must_be(part(case, x), "string")) for x in ("input", "system", "category")), (".messages", must_be(part(case, "messages"), "array")),
        (".tags", must_be(tags, "array")), (".weight", F.coalesce(must_be(weight, "number"), between(weight, 0))), (".metadata", must_be(part(case, "metadata"), "object")),
        (".params", must_be(params, "object")), (".evaluators", must_be(part(case, "evaluators"), "array")),
        (".params.temperature", F.coalesce(must_be(sampling("temperature"), "number"), between(sampling("temperature"), 0, 2))),
        (".params.top_p", F.coalesce(must_be(sampling("top_p"), "number"), between(sampling("top_p"), 0, 1))),
        (".params.max_output_tokens", F.coalesce(must_be(sampling("max_output_tokens"), "integer"), between(sampling("max_output_tokens"), 1))),
    )
    lists = F.concat(
        _each(parts(case, "tags"), at, "tags", lambda t, place: _checked(place, ("", must_be(t, "string")))),
        _each(parts(case, "messages"), at, "messages", _message_rules),
        _each(parts(case, "evaluators"), at, "evaluators", _spec_rules),
    )
    return F.when(kind(case) != "object", _checked(at, ("", must_be(case, "object")))).otherwise(F.concat(own, _unknown(case, CASE_KEYS, at), lists))


def document_cases(documents: DataFrame) -> DataFrame:
    """(file, ord, case_id, case): the cases of each document, ``case`` as a variant and ``case_id`` null if it is no text."""
    read = documents.select("file", F.try_parse_json("raw").alias("doc"))
    each = read.select("file", F.posexplode(parts(F.col("doc"), "cases")).alias("ord", "case"))
    return each.select("file", "ord", part(F.col("case"), "id", "string").alias("case_id"), "case")


def violations(documents: DataFrame) -> DataFrame:
    """(file, place, case_id, message) of everything that is wrong with suite documents (file, raw)."""
    doc = F.col("doc")
    read = documents.select("file", F.try_parse_json("raw").alias("doc"))
    name, cases = part(doc, "name"), part(doc, "cases")
    text = F.try_variant_get(name, "$", "string")
    version = F.try_variant_get(part(doc, "schema_version"), "$", "long")
    suite = _checked(
        F.lit("$"), (".name", F.coalesce(F.when(name.isNull() | (kind(name) == "null"), "missing"), must_be(name, "string"), F.when(~text.rlike(SUITE_NAME), "not a name"))),
        (".schema_version", F.when(part(doc, "schema_version").isNotNull() & (F.coalesce(version, F.lit(0)) != 1), "must be 1")), (".version", must_be(part(doc, "version"), "string")),
        (".description", must_be(part(doc, "description"), "string")), (".defaults", must_be(part(doc, "defaults"), "object")), (".metadata", must_be(part(doc, "metadata"), "object")),
        (".cases", F.coalesce(F.when(cases.isNull() | (kind(cases) == "null"), "missing"), must_be(cases, "array"), F.when(F.size(parts(doc, "cases")) == 0, "a suite needs a case"))),
    )
    unread = F.array(F.struct(F.lit("$").alias("place"), F.when(doc.isNull(), "no JSON").otherwise("must be an object").alias("message")))
    of_suite = F.when(doc.isNull() | (kind(doc) != "object"), unread).otherwise(F.concat(suite, _unknown(doc, SUITE_KEYS, F.lit("$"))))
    none = F.lit(None).cast("string")
    broken = read.select("file", F.inline(of_suite), none.alias("case_id"))
    rows = document_cases(documents)
    at = F.concat(F.lit("$.cases["), F.col("ord").cast("string"), F.lit("]"))
    of_cases = rows.select("file", F.inline(_case_rules(F.col("case"), at)), "case_id")
    # Ids are compared within a file; the first of a repeated one stands.
    earlier = F.row_number().over(Window.partitionBy("file", "case_id").orderBy("ord"))
    repeated = rows.filter("case_id is not null").select("file", "ord", "case_id", earlier.alias("nth")).filter("nth > 1")
    repeats = repeated.select("file", F.concat(at, F.lit(".id")).alias("place"), F.lit("repeated").alias("message"), "case_id")
    specs = rows.select("file", "ord", "case_id", F.posexplode(parts(F.col("case"), "evaluators")).alias("n", "spec"))
    problem = spec_problem(part(F.col("spec"), "type", "string"), F.when(kind(part(F.col("spec"), "params")) == "object", F.to_json(part(F.col("spec"), "params"))))
    place = F.concat(at, F.lit(".evaluators["), F.col("n").cast("string"), F.lit("]"))
    unbuilt = specs.select("file", place.alias("place"), problem.alias("message"), "case_id").filter("message is not null")
    columns = ["file", "place", "case_id", "message"]
    return broken.select(*columns).unionByName(of_cases.select(*columns)).unionByName(repeats.select(*columns)).unionByName(unbuilt)


def typed_cases(documents: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(file, ord, and the fields of ``TYPED``; expected, params and metadata as JSON) of the documents without a violation."""
    bad = (violations(documents) if found is None else found).select("file").distinct()
    rows = document_cases(documents.join(bad, "file", "left_anti"))
    case = F.from_json(F.to_json("case"), TYPED)
    raw = [F.to_json(part(F.col("case"), x)).alias(x) for x in ("expected", "params", "metadata")]
    return rows.select("file", "ord", case.alias("c"), *raw).select("file", "ord", "c.*", "expected", "params", "metadata")
