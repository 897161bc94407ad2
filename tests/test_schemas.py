"""JSON Schemas and patterns: values that follow from the definitions of the keywords."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from evalmill.functions.schemas import MOST_VIOLATIONS, Schema
from evalmill.operators import evaluators

TREE = {"type": "object", "properties": {"kids": {"type": "array", "items": {"$ref": "#"}}, "size": {"$ref": "#/$defs/a~1b"}}, "$defs": {"a/b": {"minimum": 1}}}
CARD = {"if": {"properties": {"kind": {"const": "card"}}, "required": ["kind"]}, "then": {"required": ["number"]}, "else": {"maxProperties": 1}}
CASES = [
    (TREE, {"kids": [{"kids": [], "size": 2}]}, 0),
    (TREE, {"kids": [{"kids": 3, "size": 0}]}, 2),
    ({"$ref": "#"}, 1, 0),
    ({"$ref": "#small", "$defs": {"x": {"$anchor": "small", "maximum": 3}}}, 4, 1),
    ({"patternProperties": {"^n_": {"type": "integer"}}, "additionalProperties": False}, {"n_a": 1, "n_b": "x", "c": 1}, 2),
    ({"propertyNames": {"maxLength": 2}}, {"ab": 1, "abc": 2}, 1),
    ({"contains": {"type": "string"}, "maxContains": 1}, [1, "a"], 0),
    ({"contains": {"type": "string"}, "maxContains": 1}, ["b", "a"], 1),
    ({"contains": {"type": "string"}}, [], 1),
    ({"dependentRequired": {"a": ["b", "c"]}}, {"a": 1, "b": 1}, 1),
    ({"dependentSchemas": {"a": {"required": ["b"]}}}, {"a": 1}, 1),
    (CARD, {"kind": "card"}, 1),
    (CARD, {"x": 1, "y": 2}, 1),
    ({"uniqueItems": True}, [1, 1.0], 1),
    ({"uniqueItems": True}, [1, True, [1], {"a": 1}], 0),
    ({"const": 1}, True, 1),
    ({"enum": [{"a": [1]}]}, {"a": [1.0]}, 0),
    ({"type": "integer"}, 10**400, 0),
    ({"multipleOf": 3}, 10**400, 1),
    ({"items": {"type": "integer"}, "prefixItems": [True]}, ["x", 1, "y"], 1),
    ({"oneOf": [{"minimum": 1}, {"maximum": 3}]}, 2, 1),
    ({"not": {"type": "null"}}, None, 1),
    ({"format": "date"}, "no date", 0),
]
D7, D2019 = {"$schema": "http://json-schema.org/draft-07/schema#"}, {"$schema": "https://json-schema.org/draft/2019-09/schema"}
OPEN = {"allOf": [{"properties": {"a": {"type": "integer"}}}], "anyOf": [{"required": ["b"], "properties": {"b": True}}, {"required": ["c"], "properties": {"c": True}}]}
CLOSED = {**OPEN, "unevaluatedProperties": False}
LIST = {"prefixItems": [{"type": "string"}], "contains": {"type": "integer"}, "unevaluatedItems": {"type": "null"}}
NODE = {"$dynamicAnchor": "node", "properties": {"kids": {"items": {"$dynamicRef": "#node"}}}, "unevaluatedProperties": False}
MORE_CASES = [
    (CLOSED, {"a": 1, "b": 2}, 0),
    (CLOSED, {"a": 1, "b": 2, "c": 3}, 0),  # both alternatives fit, and both have evaluated
    (CLOSED, {"a": 1, "b": 2, "d": 3}, 1),
    (CLOSED, {"a": "x", "b": 2}, 1),
    ({"if": {"properties": {"k": {"const": 1}}, "required": ["k"]}, "then": {"properties": {"t": True}}, "unevaluatedProperties": False}, {"k": 1, "t": 2}, 0),
    ({"if": {"properties": {"k": {"const": 1}}, "required": ["k"]}, "then": {"properties": {"t": True}}, "unevaluatedProperties": False}, {"k": 2, "t": 2}, 2),
    ({"$ref": "#/$defs/x", "unevaluatedProperties": {"type": "string"}, "$defs": {"x": {"properties": {"n": {"type": "integer"}}}}}, {"n": 1, "s": "x", "o": 2}, 1),
    ({"not": {"properties": {"a": {"const": 1}}}, "unevaluatedProperties": False}, {"a": 2}, 1),  # what is excluded evaluates nothing
    ({"properties": {"in": {"properties": {"x": True}}}, "unevaluatedProperties": False}, {"in": {"x": 1, "y": 2}}, 0),
    ({"dependentSchemas": {"a": {"properties": {"b": True}}}, "properties": {"a": True}, "unevaluatedProperties": False}, {"a": 1, "b": 2}, 0),
    (LIST, ["x", 1, None, 2], 0),
    (LIST, ["x", 1, "y"], 1),
    (LIST, [1], 1),
    ({"allOf": [{"prefixItems": [True, True]}], "unevaluatedItems": False}, [1, 2], 0),
    ({"allOf": [{"prefixItems": [True, True]}], "unevaluatedItems": False}, [1, 2, 3], 1),
    ({"allOf": [{"items": True}], "unevaluatedItems": False}, [1, 2, 3], 0),
    (NODE, {"kids": [{"kids": []}, {"kids": [{}]}]}, 0),
    (NODE, {"kids": [{"kids": []}, {"kid": 1}]}, 1),
    ({**D2019, "items": [{"type": "string"}], "additionalItems": False}, ["a", 1], 1),
    ({**D2019, "$recursiveAnchor": True, "properties": {"k": {"$recursiveRef": "#"}}, "required": ["n"]}, {"n": 1, "k": {}}, 1),
    ({**D2019, "contains": {"const": 1}, "unevaluatedItems": False}, [1], 1),  # before 2020-12 contains evaluates nothing
    ({**D7, "items": [{"type": "string"}], "additionalItems": {"type": "integer"}}, ["a", 1, "b"], 1),
    ({**D7, "items": {"type": "string"}, "additionalItems": False}, ["a", "b"], 0),
    ({**D7, "dependencies": {"a": ["b"], "c": {"required": ["d"]}}}, {"a": 1, "c": 2}, 2),
    ({**D7, "$ref": "#/definitions/x", "minimum": 9, "definitions": {"x": {"type": "integer"}}}, 1, 0),
    ({**D7, "allOf": [{"$ref": "#n"}], "definitions": {"x": {"$id": "#n", "type": "string"}}}, 1, 1),
    ({**D7, "unevaluatedProperties": False, "prefixItems": [False], "dependentRequired": {"a": ["b"]}}, {"a": 1}, 0),
    ({"dependencies": {"a": ["b"]}, "additionalItems": False}, {"a": 1}, 0),  # words of older drafts assert nothing in this one
    ({"$ref": "#/$defs/tree", "$defs": {"tree": {"properties": {"l": {"$ref": "#/$defs/tree"}, "v": {"type": "integer"}}, "additionalProperties": False}}}, {"l": {"l": {"v": "x", "w": 1}}}, 2),
    ({"$ref": "#/x-parts/a", "x-parts": {"a": {"type": "string"}}}, 1, 1),
    ({"allOf": [{"$ref": "#/allOf/1"}, {"$ref": "#/allOf/0"}]}, 1, 0),
    ({"anyOf": [{"type": "string"}, {"items": {"$ref": "#"}, "type": "array"}]}, [["a"], [["b", 1]]], 1),
]


@pytest.mark.parametrize("schema, value, wrong", CASES + MORE_CASES)
def test_keywords(schema, value, wrong):
    assert len(Schema(schema).violations(value)) == wrong


@pytest.mark.parametrize(
    "schema",
    [
        {"$ref": "https://example.com/x.json"}, {"$ref": "#/$defs/none"}, {"type": "text"}, {"pattern": "("}, {"items": 3},
        {"properties": []}, {"multipleOf": 0}, {"minLength": "3"}, {"items": [{"type": "string"}]}, {"required": "a"}, {"required": [1]},
        {"unevaluatedProperties": 3}, {"$dynamicRef": "#none"}, {"$ref": 3}, {"$id": "part", "type": "string"}, {"dependentRequired": {"a": "b"}}, {"$defs": {"x": {"type": "text"}}},
        {"$ref": "#/x-parts/a", "x-parts": {"a": {"type": "strnig"}}}, {"$ref": "#/x-parts/a", "x-parts": {"a": 3}}, {"enum": 3},
        {"$schema": "http://json-schema.org/draft-04/schema#", "$ref": "#"},
    ],
)
def test_what_cannot_be_checked_is_refused(schema):
    with pytest.raises(ValueError):
        Schema({"allOf": [schema]} if "#" not in str(schema) else schema)


def test_a_pattern_that_would_not_end_is_ended():
    began = time.monotonic()
    with pytest.raises(TimeoutError):
        Schema({"pattern": "^(a+)+$"}).violations("a" * 60 + "b", seconds=0.2)
    assert time.monotonic() - began < 5


def test_errors_of_the_evaluator_tell_what_happened(spark):
    build = evaluators.json_schema({"properties": {"a": {"pattern": "^(a+)+$"}}, "unevaluatedProperties": False}, seconds=0.2)
    texts = ['{"a": "aa"}', json.dumps({"a": "a" * 60 + "b"}), json.dumps({"a": "x" * 1_000_001}), '{"b": 1}', "{"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = [r.r for r in df.select("i", build(F.col("t"), F.lit("")).alias("r")).orderBy("i").collect()]
    assert [r.error for r in rows] == [None, "schema_timeout", "schema_instance_too_large", None, None]
    assert [r.score for r in rows] == [1.0, None, None, 0.5, 0.0]
    assert json.loads(rows[3].detail) == {"n_errors": 1, "errors": ["$: has the unevaluated property 'b'"]} and json.loads(rows[4].detail)["n_errors"] == 1


def test_violations_are_sorted_by_place_and_capped():
    found = Schema({"items": {"type": "string"}}).violations(list(range(60)))
    assert len(found) == MOST_VIOLATIONS and found[2].startswith("$[2]:") and found[10].startswith("$[10]:")


def scored(spark, build, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", build(F.col("t"), F.lit("")).alias("r")).orderBy("i").collect()
    return [r["r"]["error"] or r["r"]["passed"] for r in rows]


def test_answers_against_a_schema(spark):
    build = evaluators.json_schema({"patternProperties": {"^x": {"$ref": "#/$defs/n"}}, "$defs": {"n": {"type": "number"}}})
    assert scored(spark, build, ['{"x1": 2}', '```json\n{"x1": "2"}\n```', "{", "[NaN]", None]) == [True, False, False, True, "no_output"]


def test_patterns_mean_what_python_says(spark):
    texts = ["a\rb", "a\nb", "a b", "٣", "3", None]
    assert scored(spark, evaluators.regex("a.b"), texts) == [True, False, True, False, False, "no_output"]
    assert scored(spark, evaluators.regex(r"\d"), texts) == [False, False, False, True, True, "no_output"]
    assert scored(spark, evaluators.regex("^b", multiline=True), texts) == [False, True, False, False, False, "no_output"]
    assert scored(spark, evaluators.regex("A.B", ignore_case=True, dotall=True, fullmatch=True), texts)[:2] == [True, True]


def test_a_pattern_that_backtracks_without_end_is_an_error(spark):
    assert scored(spark, evaluators.regex("(a|aa)+$", seconds=0.2), ["aab" * 2, "aa", "a" * 4000 + "b"])[:2] == [False, True]
    assert scored(spark, evaluators.regex("(?:(a+)+)+b[^c]?c", seconds=0.05), ["a" * 3000])[0] in (False, "regex_timeout")
