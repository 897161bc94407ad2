"""Suite documents made of a table, with planted faults, and what their check finds."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmill.plans.shared import entry
from evalmill.sources import checks
from evalmill.sources.views import table

#: The case of a part, by its number modulo 11: what is wrong with it is told by ``_FAULTS``.
_CASES = {
    0: '{{"id": "c{n}", "input": "ask", "weight": "much"}}',
    1: '{{"id": "c{n}", "input": "ask", "messages": [{{"role": "user", "content": "ask"}}]}}',
    2: '{{"id": 7, "input": "ask", "colour": 1}}',
    3: '{{"id": "c{n}", "messages": [{{"role": "robot", "content": 3}}, "hello"]}}',
    4: '{{"id": "c{n}", "input": "ask", "evaluators": [{{"type": "exact_match", "weight": -1}}, {{"type": "contains", "params": {{"values": []}}}}]}}',
    5: '{{"id": "c{n}", "input": "ask", "params": {{"temperature": 3, "max_output_tokens": 1.5}}, "tags": ["a", 2]}}',
    6: '{{"id": "same", "input": "ask", "expected": [1, {{"a": null}}]}}',
}
_FINE = '{{"id": "c{n}", "input": "ask", "tags": ["a"], "weight": 2, "evaluators": [{{"type": "exact_match", "on_error": "skip"}}], "expected": {n}}}'
_FAULTS = {
    0: [(".weight", "must be number, not string")],
    1: [("", "has both an input and messages")],
    2: [(".id", "must be string, not integer"), (".colour", "unknown field")],
    3: [(".messages[0].role", "must be one of system, user, assistant"), (".messages[0].content", "must be string, not integer"), (".messages[1]", "must be object, not string")],
    4: [(".evaluators[0].weight", "must be 0 or more"), (".evaluators[1]", "contains needs values and a mode of all or any")],
    5: [(".params.temperature", "must be between 0 and 2"), (".params.max_output_tokens", "must be integer, not number"), (".tags[1]", "must be string, not integer")],
}


def _documents(spark, sf):
    """A suite for each brand and size; those of odd sizes have faults, and one in seven has no name."""
    n = F.col("p_partkey")
    fine = F.lit(_FINE.format(n="%"))
    case = F.coalesce(*(F.when((n % 11 == k) & (F.col("p_size") % 2 == 1), F.lit(c.format(n="%"))) for k, c in _CASES.items()), fine)
    text = F.replace(case, F.lit("%"), n.cast("string"))
    rows = table(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_size").alias("file"), F.col("p_size"), n.alias("n"), text.alias("text"))
    listed = rows.groupBy("file", "p_size").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("cases"))
    name = F.when(F.col("p_size") % 7 == 0, "").otherwise('"name": "suite", ')
    body = F.array_join(F.transform("cases", lambda c: c["text"]), ", ")
    whole = F.concat(F.lit("{"), name, F.lit('"cases": ['), body, F.lit("]}"))
    return listed.select("file", F.when(F.col("p_size") == 49, F.substring(whole, 1, 30)).otherwise(whole).alias("raw"))


_PARTS = """WITH p AS (SELECT p_brand || '/' || p_size AS file, p_size, p_partkey AS n, p_partkey % 11 AS k, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) - 1 AS ord FROM part),
faults AS (SELECT * FROM (VALUES {rows}) AS f(k, place, message)),
found AS (
  SELECT DISTINCT file, '$' AS place, CAST(NULL AS VARCHAR) AS case_id, 'no JSON' AS message FROM p WHERE p_size = 49
  UNION ALL SELECT DISTINCT file, '$.name', NULL, 'missing' FROM p WHERE p_size % 7 = 0 AND p_size <> 49
  UNION ALL SELECT file, '$.cases[' || ord || ']' || place, CASE WHEN p.k = 2 THEN '7' ELSE 'c' || n END, message FROM p JOIN faults USING (k) WHERE p_size % 2 = 1 AND p_size <> 49
  UNION ALL SELECT file, '$.cases[' || ord || '].id', id, 'repeated' FROM (
    SELECT *, CASE WHEN k = 2 THEN '7' ELSE 'same' END AS id, row_number() OVER (PARTITION BY file, k ORDER BY ord) AS nth FROM p WHERE k IN (2, 6) AND p_size % 2 = 1 AND p_size <> 49) WHERE nth > 1)
""".format(rows=", ".join(f"({k}, '{place}', '{message}')" for k, found in _FAULTS.items() for place, message in found))


def _typed(spark, sf):
    found = checks.typed_cases(_documents(spark, sf))
    specs = F.array_join(F.transform("evaluators", lambda e: F.concat_ws(":", e["type"], e["on_error"])), ",")
    return found.select("file", "ord", "id", "weight", F.array_join("tags", ",").alias("tags"), specs.alias("specs"), "expected")


ENTRIES = [
    entry("suite_violations", lambda s, d: checks.violations(_documents(s, d)), _PARTS + "SELECT * FROM found"),
    entry(
        "suite_typed_cases",
        _typed,
        _PARTS + """SELECT file, CAST(ord AS INTEGER) AS ord, CASE WHEN odd AND k = 6 THEN 'same' ELSE 'c' || n END AS id, CASE WHEN odd AND k = 6 THEN NULL ELSE 2.0::DOUBLE END AS weight,
        CASE WHEN odd AND k = 6 THEN NULL ELSE 'a' END AS tags, CASE WHEN odd AND k = 6 THEN NULL ELSE 'exact_match:skip' END AS specs,
        CASE WHEN odd AND k = 6 THEN '[1,{"a":null}]' ELSE CAST(n AS VARCHAR) END AS expected
        FROM (SELECT *, p_size % 2 = 1 AS odd FROM p) WHERE file NOT IN (SELECT file FROM found)""",
    ),
]
