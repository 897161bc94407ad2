"""Evaluators over text, JSON and vectors, judges, hashes and redaction, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmill.functions import redaction, stats, text
from evalmill.functions.documents import canonical_json
from evalmill.operators import cases, evaluators, judge
from evalmill.plans.shared import entry, r
from evalmill.sources.tables import csv_rows
from evalmill.sources.views import table, view


def _scored(name: str, **params):
    """An evaluator over the text pairs: status, passed, score and raw."""

    def query(spark, sf):
        pairs = view(spark, sf, "text_pairs")
        found = evaluators.evaluator(name, **params)(F.col("output_text"), F.col("expected_text"))
        return pairs.withColumn("e", found).select("conv_id", "turn", "e.status", "e.passed", "e.score", "e.raw", "e.error")

    return query


_SPACE = "[\\s]"
_TRIM = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"
_WORDS = "list_distinct(list_filter(string_split_regex({}, '\\s+'), lambda w: w <> ''))"


def _eval_sql(passed: str, score: str | None = None, raw: str = "NULL", missing: str = "expected_text IS NULL", setup: str = "SELECT * FROM v_text_pairs") -> str:
    score = score or "CASE WHEN hit THEN 1.0 ELSE 0.0 END"
    return f"""WITH base AS ({setup}), judged AS (SELECT *, {passed} AS hit FROM base),
    state AS (SELECT *, CASE WHEN output_text IS NULL THEN 'no_output' WHEN {missing} THEN 'missing_expected' END AS error FROM judged)
    SELECT conv_id, turn, CASE WHEN error IS NOT NULL THEN 'error' WHEN hit THEN 'passed' ELSE 'failed' END AS status, CASE WHEN error IS NULL THEN hit END AS passed,
      {r(f"CASE WHEN error IS NULL THEN CAST({score} AS DOUBLE) END", "score")}, {r(f"CASE WHEN error IS NULL THEN CAST({raw} AS DOUBLE) END", "raw")}, error FROM state"""


_PLAIN = "trim(regexp_replace(regexp_replace(replace(lower({}), 'ß', 'ss'), '[^\\w\\sÀ-ɏ]', ' ', 'g'), '\\s+', ' ', 'g'))"
_JACCARD = "CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"
_LEXICAL = f"SELECT *, {_PLAIN.format('output_text')} AS a, {_PLAIN.format('expected_text')} AS b FROM v_text_pairs"
_GRAMS = "CASE WHEN length({x}) = 0 THEN CAST([] AS STRING[]) WHEN length({x}) <= 3 THEN [{x}] ELSE list_distinct(list_transform(range(1, length({x}) - 1), lambda i: substr({x}, i, 3))) END"
_TOKENS_SQL = f"SELECT *, {_JACCARD.format(a=_WORDS.format('a'), b=_WORDS.format('b'))} AS j FROM ({_LEXICAL})"
_NGRAMS_SQL = f"SELECT *, {_JACCARD.format(a='ga', b='gb')} AS j FROM (SELECT *, {_GRAMS.format(x='a')} AS ga, {_GRAMS.format(x='b')} AS gb FROM ({_LEXICAL}))"

_PROPS = """CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('```json', chr(10), props, chr(10), '```') WHEN 2 THEN substr(props, 1, 6) ELSE '[1, 2]' END"""


def _payloads(spark, sf):
    return table(spark, sf, "events").select("event_id", F.expr(_PROPS.replace("chr(10)", "char(10)")).alias("output_text"))


def _json_valid(spark, sf):
    found = evaluators.json_valid(require_object=True)(F.col("output_text"), F.lit(""))
    return _payloads(spark, sf).withColumn("e", found).select("event_id", "e.status", "e.passed", "e.score")


SCHEMA = {
    "type": "object",
    "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 90}},
    "required": ["k"],
    "additionalProperties": False,
}


def _json_schema(spark, sf):
    found = evaluators.json_schema(SCHEMA)(F.col("output_text"), F.lit(""))
    return _payloads(spark, sf).withColumn("e", found).select("event_id", "e.status", "e.passed", "e.score", "e.raw")


_SCHEMA_SQL = f"""WITH p AS (SELECT event_id, event_id % 4 AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
v AS (SELECT event_id, kind, CASE WHEN kind = 2 THEN -1 WHEN kind = 3 THEN 1 WHEN k < 10 OR k > 90 THEN 1 ELSE 0 END AS wrong FROM p)
SELECT event_id, CASE WHEN wrong = 0 THEN 'passed' ELSE 'failed' END AS status, wrong = 0 AS passed,
  {r("CASE WHEN wrong < 0 THEN 0.0 ELSE 1.0 / (wrong + 1) END", "score")}, CAST(abs(wrong) AS DOUBLE) AS raw FROM v"""


TRACKED = {
    "$ref": "#/$defs/part",
    "anyOf": [{"required": ["even"], "properties": {"even": {"const": True}}}, {"required": ["k"], "properties": {"k": {"minimum": 50}}}],
    "patternProperties": {"^x_": {"type": "string"}},
    "unevaluatedProperties": False,
    "$defs": {"part": {"properties": {"n": {"type": "array", "prefixItems": [{"type": "integer"}], "unevaluatedItems": {"type": "string"}}}}},
}
_TRACKED_TEXT = """concat('{{"k": ', {json}(props, '$.k'), CASE WHEN event_id % 2 = 0 THEN ', "even": true' ELSE '' END, CASE event_id % 5 WHEN 1 THEN ', "x_1": "a"' WHEN 2 THEN ', "x_1": 1'
  WHEN 3 THEN ', "y": 1' ELSE '' END, CASE event_id % 3 WHEN 1 THEN ', "n": [1, "a"]' WHEN 2 THEN ', "n": [1, 2]' ELSE '' END, '}}')"""


def _tracked(spark, sf):
    texts = table(spark, sf, "events").select("event_id", F.expr(_TRACKED_TEXT.format(json="get_json_object")).alias("output_text"))
    found = evaluators.json_schema(TRACKED)(F.col("output_text"), F.lit(""))
    return texts.withColumn("e", found).select("event_id", "e.status", "e.passed", "e.score", "e.raw", "e.error")


# One violation each: neither alternative fits (k is then not evaluated), a number for x_1, y, k that only the even alternative leaves, the second item of n.
_TRACKED_SQL = f"""WITH p AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
f AS (SELECT event_id, event_id % 2 = 0 AS even, k >= 50 AS large FROM p),
v AS (SELECT event_id, CASE WHEN even OR large THEN 0 ELSE 1 END + CASE WHEN event_id % 5 IN (2, 3) THEN 1 ELSE 0 END
    + CASE WHEN large THEN 0 ELSE 1 END + CASE WHEN event_id % 3 = 2 THEN 1 ELSE 0 END AS wrong FROM f)
SELECT event_id, CASE WHEN wrong = 0 THEN 'passed' ELSE 'failed' END AS status, wrong = 0 AS passed, {r("1.0 / (wrong + 1)", "score")}, CAST(wrong AS DOUBLE) AS raw,
  CAST(NULL AS VARCHAR) AS error FROM v"""


def _semantic(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    after = vectors.select((F.col("vec_id") - 1).alias("before"), F.col("embedding").alias("other"))
    joined = vectors.join(after, vectors["vec_id"] == after["before"])
    found = evaluators.semantic_similarity(0.3)(F.col("embedding"), F.col("other"))
    return joined.withColumn("e", found).select("vec_id", "e.status", "e.passed", F.round("e.score", 6).alias("score"), F.round("e.raw", 6).alias("raw"))


_SEMANTIC = """WITH c AS (SELECT a.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS cosine
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, CASE WHEN cosine >= 0.3 THEN 'passed' ELSE 'failed' END AS status, cosine >= 0.3 AS passed,
  round(greatest(0.0, least(1.0, cosine)), 6) AS score, round(cosine, 6) AS raw FROM c"""

CRITERIA = {"accuracy": 2.0, "style": 1.0}
# A judge's answer made of an event: some are fenced, some off the scale, some lack a criterion, some are prose.
_ANSWER = """CASE WHEN event_id % 11 = 3 THEN 'The answer is good.'
  WHEN event_id % 11 = 5 THEN '{{"criteria": [{{"name": "accuracy", "score": 4}}]}}'
  WHEN event_id % 11 = 7 THEN '{{"criteria": "none"}}'
  ELSE concat(CASE WHEN event_id % 11 = 9 THEN concat('```', {nl}) ELSE '' END, '{{"criteria": [{{"name": "accuracy", "score": ', CAST(1 + user_id % 6 AS STRING),
    '}}, {{"name": "style", "score": ', CAST(1 + event_id % 5 AS STRING), '}}], "overall_score": 3}}', CASE WHEN event_id % 11 = 9 THEN concat({nl}, '```') ELSE '' END) END"""


def _answers(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", F.expr(_ANSWER.format(nl="char(10)")).alias("answer"))


def _judge_parse(spark, sf):
    parsed = judge.parse_verdicts(_answers(spark, sf), "answer", CRITERIA)
    return parsed.select("event_id", "verdict.ok", "verdict.kind", "verdict.raw", judge.overall_mismatch().alias("mismatch"))


_JUDGED = f"""WITH e AS (SELECT event_id, 1 + user_id % 6 AS accuracy, 1 + event_id % 5 AS style, event_id % 11 AS m FROM events),
k AS (SELECT *, CASE WHEN m = 3 THEN 'json' WHEN m = 5 THEN 'criteria' WHEN m = 7 THEN 'schema' WHEN accuracy > 5 THEN 'range' END AS kind FROM e),
w AS (SELECT *, CASE WHEN kind IS NULL THEN (2.0 * accuracy + style) / 3 END AS raw FROM k)
SELECT event_id, kind IS NULL AS ok, kind, {r("CAST(raw AS DOUBLE)", "raw")}, CASE WHEN raw IS NOT NULL THEN abs(3 - raw) > 0.5 END AS mismatch FROM w"""


def _ratings(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        F.concat(F.lit("run-"), (F.col("event_id") % 2).cast("string")).alias("run_id"), (F.col("event_id") % 500).alias("case_id"),
        F.concat(F.lit("judge"), (F.col("user_id") % 3).cast("string")).alias("judge"),
        F.when(F.col("event_id") % 17 != 0, (1 + F.floor(F.col("value")) % 5).cast("double")).alias("raw"),
    )


_PANEL = f"""WITH ratings AS (SELECT concat('run-', CAST(event_id % 2 AS STRING)) AS run_id, event_id % 500 AS case_id, concat('judge', CAST(user_id % 3 AS STRING)) AS judge,
  CASE WHEN event_id % 17 <> 0 THEN CAST(1 + floor(value) % 5 AS DOUBLE) END AS raw FROM events),
own AS (SELECT run_id, case_id, judge, {{how}} AS value, min(raw) AS least, max(raw) AS most, count(*) - count(raw) AS unparsed FROM ratings GROUP BY ALL),
p AS (SELECT run_id, case_id, count(value) AS n_judges, median(value) AS raw_score, max(most) - min(least) AS dispersion, max(value) - min(value) AS judge_range,
  CAST(sum(unparsed) AS BIGINT) AS parse_failures FROM own GROUP BY run_id, case_id)
SELECT run_id, case_id, n_judges, {r("raw_score", "raw_score")}, {r("dispersion", "dispersion")}, {r("judge_range", "judge_range")}, parse_failures,
  {r("greatest(0.0, least(1.0, (raw_score - 1) / 4))", "score")}, {r("greatest(0.0, least(1.0, 1 - dispersion / 4))", "agreement")},
  dispersion > 1 AS high_variance, CASE WHEN n_judges > 1 THEN judge_range > 1 END AS disagreement FROM p"""
_MAJORITY = "(list_sort(list_transform(map_entries(histogram(raw)), lambda m: {'n': -CAST(m.value AS BIGINT), 'x': m.key}))[1]).x"


def _self_preference(spark, sf):
    judges = F.array(
        F.struct(F.lit("acme").alias("provider"), F.lit("acme-large").alias("model")), F.struct(F.lit("initech").alias("provider"), F.lit("tps").alias("model"))
    )
    rows = view(spark, sf, "case_results")
    return rows.groupBy("run_id").agg(F.bool_or(judge.self_preference(judges, F.col("provider"), F.col("model"))).alias("self_preference"))


def _digests(spark, sf):
    """One row for each source and language, under the digest of their canonical JSON; texts take no part."""
    docs = table(spark, sf, "documents").select("doc_id", canonical_json(F.to_json(F.struct("source", "lang"))).alias("body"))
    return docs.groupBy(text.digest(F.col("body")).alias("digest")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))


def _case_copies(spark, sf):
    """One stored copy for each text, under its hash as a case; source and language are metadata, which the hash leaves out."""
    body = F.struct(
        F.col("text").alias("input"), F.struct("source", "lang").alias("metadata")
    )
    docs = table(spark, sf, "documents").select("doc_id", F.to_json(body).alias("body"))
    return cases.with_case_hash(docs).groupBy("case_hash").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))


_COPIES = """SELECT 'sha256:' || sha256('{"evaluators":[],"expected":null,"id":null,"messages":[{"content":' || CAST(to_json(text) AS VARCHAR) || ',"name":null,"role":"user"}],"params":{"extra":{},"max_output_tokens":null,"response_format":"text","seed":null,"stop":[],"temperature":null,"top_p":null},"system":null}') AS case_hash,
  min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1"""


def _suites(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_brand").alias("suite"), F.lit("1").alias("version"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("id"),
        text.digest(F.col("p_name")).alias("case_hash"),
    )
    return cases.suite_hashes(rows)


_SUITES = """SELECT p_brand AS suite, '1' AS version, 'sha256:' || sha256('{"cases":[' || string_agg('{"id":"c' || CAST(p_partkey AS STRING) || '","case_hash":"sha256:' || sha256(p_name) || '"}', ',' ORDER BY 'c' || CAST(p_partkey AS STRING))
  || '],"name":"' || p_brand || '","schema_version":1,"version":"1"}') AS suite_hash, CAST(count(*) AS INTEGER) AS n_cases FROM part GROUP BY p_brand"""


_NAMES = ("apiKey", "api_key_env", "token", "n_tokens", "token_usage_coverage", "access_token", "Authorization", "max_output_tokens")


def _redacted(spark, sf):
    message = F.concat(F.lit("call "), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" key sk-live"), F.lpad(F.col("user_id").cast("string"), 12, "0"))).otherwise(""), F.lit(" done"))
    return table(spark, sf, "events").select("event_id", redaction.scrub_message(message).alias("message"), redaction.is_secret_key(F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % len(_NAMES) + 1).cast("int"))).alias("secret"))


_REDACTED = """SELECT event_id, 'call ' || CAST(event_id AS STRING) || CASE WHEN event_id % 3 = 0 THEN ' key [redacted]' ELSE '' END || ' done' AS message, event_id % 8 IN (0, 2, 5, 6) AS secret FROM events"""


def _guarded(spark, sf):
    cell = F.concat(F.when(F.col("event_id") % 3 == 0, "=").when(F.col("event_id") % 3 == 1, "-").otherwise(""), "event_type")
    return csv_rows(table(spark, sf, "events").select("event_id", cell.alias("cell"), "value", (F.col("value") < 60).alias("flag")).drop("value"))


_GUARDED = """SELECT CAST(event_id AS STRING) AS event_id, CASE event_id % 3 WHEN 0 THEN '''=' || event_type WHEN 1 THEN '''-' || event_type ELSE event_type END AS cell,
  CAST(value < 60 AS STRING) AS flag FROM events"""

_TEXT = "text_pairs"
_NUMBERS = r"""SELECT *, TRY_CAST(regexp_extract(output_text, '[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?') AS DOUBLE) AS seen, CAST(turn * 3 AS DOUBLE) + 0.5 AS wanted FROM v_text_pairs"""


def _numeric(spark, sf):
    pairs = view(spark, sf, "text_pairs").withColumn("expected_text", F.concat((F.col("turn") * 3).cast("string"), F.lit(".5")))
    found = evaluators.numeric_tolerance(abs_tol=0.01)(F.col("output_text"), F.col("expected_text"))
    return pairs.withColumn("e", found).select("conv_id", "turn", "e.status", "e.passed", "e.score", "e.raw", "e.error")


ENTRIES = [
    entry("eval_exact", _scored("exact_match"), _eval_sql(f"{_TRIM.format('output_text')} = {_TRIM.format('expected_text')}"), _TEXT),
    entry(
        "eval_exact_ci",
        _scored("exact_match_ci"),
        _eval_sql(f"replace(lower({_TRIM.format('output_text')}), 'ß', 'ss') = replace(lower({_TRIM.format('expected_text')}), 'ß', 'ss')"),
        _TEXT,
    ),
    entry(
        "eval_contains",
        _scored("contains", values=["the", "en", "zz"], mode="any"),
        _eval_sql("n > 0", "n / 3", "n", "false", "SELECT *, contains(output_text, 'the')::INT + contains(output_text, 'en')::INT + contains(output_text, 'zz')::INT AS n FROM v_text_pairs"),
        _TEXT,
    ),
    entry("eval_regex", _scored("regex", pattern="[aeiou]n[dt] [a-z]+er"), _eval_sql("regexp_matches(output_text, '[aeiou]n[dt] [a-z]+er')", missing="false"), _TEXT),
    entry(
        "eval_regex_ci",
        _scored("regex", pattern="^the .*$", ignore_case=True, multiline=True, must_match=False),
        _eval_sql("NOT regexp_matches(output_text, '(?im)^the .*$')", missing="false"),
        _TEXT,
    ),
    entry(
        "eval_numeric",
        _numeric,
        _eval_sql("coalesce(abs(seen - wanted) <= 0.01, false)", raw="seen", missing="false", setup=_NUMBERS),
        _TEXT,
    ),
    entry("eval_lexical_token", _scored("lexical_similarity"), _eval_sql("j >= 0.6", "j", "j", setup=_TOKENS_SQL), _TEXT),
    entry("eval_lexical_ngram", _scored("lexical_similarity", method="char_ngram"), _eval_sql("j >= 0.6", "j", "j", setup=_NGRAMS_SQL), _TEXT),
    entry("eval_semantic", _semantic, _SEMANTIC),
    entry(
        "eval_json_valid",
        _json_valid,
        "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 'passed' ELSE 'failed' END AS status, event_id % 4 < 2 AS passed, CASE WHEN event_id % 4 < 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM events",
    ),
    entry("eval_json_schema", _json_schema, _SCHEMA_SQL),
    entry("eval_json_schema_tracked", _tracked, _TRACKED_SQL),
    entry("judge_parse", _judge_parse, _JUDGED),
    entry("judge_panel", lambda s, d: judge.panel_scores(_ratings(s, d)), _PANEL.format(how="median(raw)")),
    entry("judge_panel_majority", lambda s, d: judge.panel_scores(_ratings(s, d), "majority"), _PANEL.format(how=_MAJORITY)),
    entry(
        "self_preference",
        _self_preference,
        "SELECT run_id, bool_or((provider = 'acme' AND model = 'acme-large') OR (provider = 'initech' AND model = 'tps')) AS self_preference FROM v_case_results GROUP BY run_id",
        "case_results",
    ),
    entry(
        "case_hash_dedupe",
        _digests,
        """SELECT 'sha256:' || sha256('{"lang":"' || lang || '","source":"' || source || '"}') AS digest, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1""",
    ),
    entry("case_hash_copies", _case_copies, _COPIES),
    entry("suite_hashes", _suites, _SUITES),
    entry("redact_text", _redacted, _REDACTED),
    entry("csv_guard", _guarded, _GUARDED),
    entry(
        "interval_overlap",
        lambda s, d: view(s, d, "case_results").groupBy("model").agg(F.avg("score").alias("m"), F.stddev("score").alias("sd")).select(
            "model", stats.intervals_overlap(F.col("m") - F.col("sd"), F.col("m") + F.col("sd"), F.lit(0.3), F.lit(0.4)).alias("overlaps")
        ),
        "SELECT model, avg(score) - stddev(score) <= 0.4 AND 0.3 <= avg(score) + stddev(score) AS overlaps FROM v_case_results GROUP BY model",
        "case_results",
    ),
]
