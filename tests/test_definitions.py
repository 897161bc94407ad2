"""Fixed cases whose values follow from the definitions, not from this library."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from evalmill.functions import documents, redaction, text
from evalmill.operators import cases, records
from evalmill.sources import tables
from evalmill.streaming import live


def values(spark, column, items, kind="string"):
    rows = [(i, x) for i, x in enumerate(items)]
    df = spark.createDataFrame(rows, f"i int, x {kind}").select("i", column.alias("y"))
    return [r["y"] for r in df.orderBy("i").collect()]


def test_counts_of_tokens_are_no_secrets(spark):
    names = ["apiKey", "x-api-key", "token", "access_token", "sessionToken", "Authorization", "n_tokens", "token_usage_coverage", "max_output_tokens", "api_key_env"]
    assert values(spark, redaction.is_secret_key(F.col("x")), names) == [True] * 6 + [False] * 4


def test_urls_keep_what_is_no_secret(spark):
    urls = [
        "postgresql://admin:hunter2@Host:5/db", "https://me@host/x", "https://h/?a=1&sslPass%77ord=x&b=2", "https://h/a@b",
        "/tmp/a@b.db", "no url", "https://[broken", None,
    ]
    assert values(spark, redaction.redact_url(F.col("x")), urls) == [
        "postgresql://admin:[redacted]@Host:5/db", "https://me@host/x", "https://h/?a=1&sslPass%77ord=***&b=2", "https://[redacted]",
        "/tmp/a@b.db", "no url", "[redacted]", None,
    ]
    said = values(spark, redaction.redact_words(F.col("x")), ["can't reach 'db://joe@h:5/x' now"])
    assert said == ["can't reach 'db://[redacted]@h:5/x' now"]


def test_messages_are_cut_with_a_mark(spark):
    found = values(spark, redaction.scrub_message(F.col("x")), ["Bearer abcdefgh1", "sk-" + "a" * 16, "sk-short", "x" * 2001])
    assert found == ["[redacted]", "[redacted]", "sk-short", "x" * 2000 + "... [truncated]"]


def test_depth_of_scrubbing(spark):
    deep = '{"a":' * 13 + "1" + "}" * 13
    assert values(spark, redaction.scrub_json(F.col("x")), [deep]) == ['{"a":' * 12 + '"[redacted]"' + "}" * 12]


def test_fences(spark):
    mark = "```"
    texts = [f"{mark}json\n{{}}\n{mark}", f' {mark}\r\n["{mark}"]\r\n {mark} ', f"{mark}\nx{mark}", f"{mark} x\ny\n{mark}", f"a {mark}\nb\n{mark}", f"{mark}\n{mark}"]
    wanted = ["{}", f'["{mark}"]', "x", texts[3], texts[4], ""]
    assert [documents.unwrap(t) for t in texts] == wanted
    assert values(spark, text.strip_fence(F.col("x")), texts) == wanted


def test_error_kinds(spark):
    kinds = values(spark, tables.error_kind(F.col("x")), [401, 403, 404, 408, 413, 429, 400, 418, 500, 504, 302, None], "int")
    assert kinds == ["authentication", "permission", "not_found", "timeout", "context_length", "rate_limit", "invalid_request", "invalid_request", "server", "server", "unknown", "unknown"]


def test_a_case_hash_covers_the_prompt(spark):
    bodies = ['{"id":"a","input":"one"}', '{"id":"a","input":"two"}', '{"id":"a","messages":[{"role":"user","content":"one"}],"tags":["x"]}']
    one, two, same = (r["case_hash"] for r in cases.with_case_hash(spark.createDataFrame([(b,) for b in bodies], "body string")).collect())
    assert one != two and one == same


def test_a_case_hash_is_that_of_the_filled_case(spark):
    alike = [
        '{"id":"a","input":"one"}', '{"id":"a","input":"one","params":null,"evaluators":[]}', '{"id":"a","input":"one","params":{"temperature":null,"stop":[]}}',
        '{"id":"a","input":"one","params":{"response_format":"text","extra":{}}}',
    ]
    specs = ['[{"type":"x"}]', '[{"type":"x","weight":1,"required":true,"on_error":"error","id":null,"params":{}}]', '[{"type":"x","weight":1.0}]']
    alike_specs = [f'{{"id":"a","input":"one","evaluators":{s}}}' for s in specs]
    others = ['{"id":"a","input":"one","params":{"temperature":0}}', '{"id":"a","input":"one","params":{"temperature":0.0}}', '{"id":"a","input":"one","evaluators":[{"type":"x","weight":2}]}']
    bodies = alike + alike_specs + others
    found = [r["case_hash"] for r in cases.with_case_hash(spark.createDataFrame([(b,) for b in bodies], "body string").coalesce(1)).collect()]
    assert len(set(found[:4])) == 1 and len(set(found[4:7])) == 1 and found[7] == found[8] and len(set(found)) == 4


def test_a_case_hash_covers_the_defaults_of_its_suite(spark):
    spec = "array<struct<type string, id string, weight double, required boolean, on_error string, params string>>"
    schema = f"id string, input string, messages array<struct<role string, content string, name string>>, system string, expected string, tags array<string>, metadata string, params string, evaluators {spec}"
    authored = spark.createDataFrame([("a", "hi", None, None, '"x"', None, None, None, [])], schema)
    found = [
        cases.with_case_hash(cases.resolved_bodies(cases.resolve(authored, defaults))).collect()[0]["case_hash"]
        for defaults in ({}, {"tags": ["t"]}, {"system": "be brief"}, {"params": {"temperature": 0}})
    ]
    assert found[0] == found[1] and len(set(found)) == 3


def test_expected_text(spark):
    found = values(spark, records.expected_as_text(F.col("x")), ['"a b"', "true", "1", "1.50", "1e5", "[1]", "{}", "null", None])
    assert found == ["a b", "true", "1", "1.5", "100000.0", None, None, None, None]


def test_budgets_of_a_stream_are_exact(spark, tmp_path):
    schema = "run_id string, billable decimal(20,12)"
    rows = [("a", Decimal("0.1"))] * 3 + [("b", None), ("b", Decimal("0.2"))]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/costs")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/costs")
    found = {r["run_id"]: r for r in live.drained(live.budget_states(stream, "0.3"), spark, "budgets", "update").collect()}
    assert found["a"]["spent"] == Decimal("0.3") and not found["a"]["exceeded"]
    assert found["b"]["spent"] == Decimal("0.2") and found["b"]["n_cases"] == 2
