"""Leaderboards, listings, exports, selections and event windows as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmill.functions import stats, text
from evalmill.operators import cases, leaderboard, pricing, rollup, runs
from evalmill.plans.metrics import _PRICED
from evalmill.plans.shared import OUTCOME, entry, r, wilson_high, wilson_low
from evalmill.sources import tables
from evalmill.sources.views import table, view
from evalmill.streaming import live


def _cases(spark, sf):
    return view(spark, sf, "case_results")


def _stored(spark, sf):
    """One stored roll-up for each run and half, so that models have several runs."""
    rows = pricing.case_costs(_cases(spark, sf), view(spark, sf, "prices")).withColumn(
        "run_id", F.concat("run_id", F.lit("-"), (F.col("case_no") % 2).cast("string"))
    )
    head = rollup.run_rollup(rows).select("run_id", "n_passed", "n_denominator", "n_completed")
    late = rollup.latency_stats(rows).select("run_id", "p95_ms")
    cost = pricing.cost_rollup(rows).select("run_id", "total_cost", "coverage")
    info = rows.groupBy("run_id", "provider", "model").agg(F.max("completed_at").alias("finished_at"))
    return info.join(head, "run_id").join(late, "run_id").join(cost, "run_id")


_STORED = f"""{_PRICED}, halves AS (SELECT * REPLACE (run_id || '-' || CAST(case_no % 2 AS STRING) AS run_id), {OUTCOME["exclude"]} AS outcome FROM costs),
stored AS (
  SELECT run_id, provider, model, max(completed_at) AS finished_at, count(*) FILTER (outcome) AS n_passed, count(outcome) AS n_denominator,
    count(*) FILTER (status = 'ok') AS n_completed, quantile_cont(latency_ms, 0.95) FILTER (status = 'ok') AS p95_ms, sum(total_cost) AS total_cost, count(*) FILTER (priced) / count(*) AS coverage
  FROM halves GROUP BY run_id, provider, model)"""
_BOARD = f"""{_STORED}, board AS (
  SELECT provider, model, count(*) AS n_runs, CAST(sum(n_passed) AS BIGINT) AS n_passed, CAST(sum(n_denominator) AS BIGINT) AS n_denominator,
    {r("CASE WHEN sum(n_denominator) > 0 THEN sum(n_passed) / sum(n_denominator) END", "pass_rate")},
    {r(wilson_low("sum(n_passed)", "sum(n_denominator)"), "ci_low")}, {r(wilson_high("sum(n_passed)", "sum(n_denominator)"), "ci_high")},
    {r("median(p95_ms)", "median_p95_ms")}, CAST(sum(total_cost) AS DECIMAL(28,12)) AS total_cost,
    {r("CASE WHEN sum(n_completed) FILTER (total_cost IS NOT NULL) > 0 THEN CAST(sum(total_cost) AS DOUBLE) / sum(n_completed) FILTER (total_cost IS NOT NULL) END", "cost_per_case")},
    {r("sum(coverage * n_completed) / sum(n_completed)", "coverage")}, max(finished_at) AS last_run_at
  FROM stored GROUP BY provider, model)"""


def _runs(spark, sf):
    return _cases(spark, sf).groupBy("run_id", "provider", "model").agg(F.min("completed_at").alias("created_at"))


def _listing(spark, sf):
    rows = _cases(spark, sf)
    verdicts = rollup.pass_rates(rows, ["run_id"])
    stored = verdicts.filter(F.col("run_id").isin("run-1", "run-3")).withColumn("pass_rate", F.when(F.col("run_id") == "run-3", F.col("pass_rate")))
    return leaderboard.list_runs(_runs(spark, sf), stored, verdicts, limit=4, offset=1, provider="acme")


_LISTING = f"""WITH v AS (SELECT run_id, provider, model, min(completed_at) AS created_at, count(*) FILTER (outcome) / count(outcome) AS rate
  FROM (SELECT *, {OUTCOME["exclude"]} AS outcome FROM v_case_results) GROUP BY ALL)
SELECT run_id, provider, model, created_at, {r("CASE WHEN run_id = 'run-1' THEN NULL ELSE rate END", "pass_rate")}, run_id IN ('run-1', 'run-3') AS has_rollup
FROM v WHERE provider = 'acme' ORDER BY v.created_at DESC, run_id LIMIT 4 OFFSET 1"""


def _page(spark, sf):
    found = leaderboard.list_cases(_cases(spark, sf), "run-2", status="ok", query="CASE-0000", tag="fast", limit=20, offset=5)
    return found.select("case_id", "category", "passed", "score")


def _exported(spark, sf):
    rows = pricing.case_costs(_cases(spark, sf), view(spark, sf, "prices"))
    return tables.export_rows(rows).drop("latency_ms")


def _catalogue(spark, sf):
    advertised = _cases(spark, sf).select("provider", "model").distinct()
    return leaderboard.model_catalogue(advertised, view(spark, sf, "prices"))


def _selected(spark, sf):
    rows = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("ord"), F.array("p_brand", "p_type").alias("tags"))
    brands = [x[0] for x in rows.select(F.get("tags", F.lit(0))).distinct().orderBy(F.get("tags", F.lit(0))).limit(3).collect()]
    return cases.select_cases(rows, tags=brands, limit=40).select("id", "ord")


def _sampled(spark, sf):
    return cases.hash_sample(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", 50, seed=7)


def _resumed(spark, sf):
    rows = _cases(spark, sf)
    todo = rows.filter("run_no = 0").select("case_id", "category")
    return cases.not_yet_done(todo, rows.filter("run_no = 1 AND status = 'ok' AND case_no % 3 = 0"))


def _snapshots(spark, sf):
    orders = table(spark, sf, "orders").select(F.concat(F.lit("s"), (F.col("o_custkey") % 300).cast("string")).alias("suite_hash"))
    stored = orders.filter("suite_hash < 's2'").distinct()
    return cases.snapshot_upsert(stored, orders)


def _duplicates(spark, sf):
    return cases.duplicates(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


def _retries(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("s"))
    attempts = rows.select(
        F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").alias("attempt"),
        F.element_at(F.array(*map(F.lit, ("rate_limit", "timeout", "auth", "server"))), (F.col("s") % 4 + 1).cast("int")).alias("kind"),
        F.when(F.col("s") % 5 == 0, F.lit(7.5)).alias("retry_after"),
    )
    return runs.retry_delays(attempts)


_TIGHT = {"full": 9.0, "equal": 4.0, "none": 3.0}


def _chains(jitter):
    def query(spark, sf):
        rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("s"), F.max("l_quantity").alias("q"))
        attempts = rows.select(
            F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").alias("attempt"),
            F.element_at(F.array(*map(F.lit, ("rate_limit", "timeout", "server", "auth", "connection", None))), (F.col("s") % 6 + 1).cast("int")).alias("kind"),
            F.when(F.col("s") % 5 == 0, F.lit(7.5)).when(F.col("s") % 7 == 0, F.lit(1.25)).alias("retry_after"), F.col("q"),
        )
        found = runs.retry_chains(attempts, runs.RetryPolicy(tries=5, total=_TIGHT[jitter], jitter=jitter), F.col("q") / 64)
        return found.select("call_id", "attempt", "kind", "retried", "delay_s", "waited_s", "reason")

    return query


def _chains_sql(jitter):
    """A step for each attempt of a call, carrying what was granted so far."""
    own = {"none": "full_s", "equal": "full_s / 2 + draw * full_s / 2", "full": "draw * full_s"}[jitter]
    why = f"""CASE WHEN NOT open THEN 'not_reached' WHEN kind IS NULL OR kind = 'auth' THEN 'not_retryable' WHEN n.attempt >= 5 THEN 'exhausted'
      WHEN waited_s + wait > {_TIGHT[jitter]} THEN 'over_budget' END"""
    return f"""WITH RECURSIVE a AS (
      SELECT l_orderkey AS call_id, l_linenumber AS attempt, ['rate_limit', 'timeout', 'server', 'auth', 'connection', NULL][max(l_suppkey) % 6 + 1] AS kind,
        CASE WHEN max(l_suppkey) % 5 = 0 THEN 7.5 WHEN max(l_suppkey) % 7 = 0 THEN 1.25 END AS retry_after, CAST(max(l_quantity) AS DOUBLE) / 64 AS draw,
        CAST(least(30.0, 0.5 * pow(2, l_linenumber - 1)) AS DOUBLE) AS full_s FROM lineitem GROUP BY l_orderkey, l_linenumber),
    n AS (SELECT *, CAST(greatest({own}, coalesce(retry_after, 0)) AS DOUBLE) AS wait, row_number() OVER (PARTITION BY call_id ORDER BY attempt) AS place FROM a WHERE attempt <= 5),
    f AS (
      SELECT call_id, CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS attempt, CAST(NULL AS VARCHAR) AS kind, true AS open, CAST(NULL AS DOUBLE) AS delay_s, 0.0::DOUBLE AS waited_s, CAST(NULL AS VARCHAR) AS reason
      FROM (SELECT DISTINCT call_id FROM n)
      UNION ALL
      SELECT n.call_id, n.place, n.attempt, n.kind, ({why}) IS NULL, CASE WHEN ({why}) IS NULL THEN wait END, waited_s + CASE WHEN ({why}) IS NULL THEN wait ELSE 0 END, {why}
      FROM f JOIN n ON n.call_id = f.call_id AND n.place = f.place + 1)
    SELECT call_id, attempt, kind, open AS retried, {r("delay_s", "delay_s")}, {r("waited_s", "waited_s")}, reason FROM f WHERE place > 0
    UNION ALL SELECT call_id, attempt, kind, false, NULL, NULL, 'not_reached' FROM a WHERE attempt > 5""".replace("NOT open", "NOT f.open").replace("WHEN kind IS", "WHEN n.kind IS").replace("OR kind =", "OR n.kind =")



_RETRIES = f"""WITH a AS (SELECT l_orderkey AS call_id, l_linenumber AS attempt, ['rate_limit', 'timeout', 'auth', 'server'][max(l_suppkey) % 4 + 1] AS kind,
  CASE WHEN max(l_suppkey) % 5 = 0 THEN 7.5::DOUBLE END AS retry_after FROM lineitem GROUP BY l_orderkey, l_linenumber),
d AS (SELECT *, kind <> 'auth' AND attempt < 4 AS retried, CASE WHEN kind <> 'auth' AND attempt < 4 THEN greatest(least(30.0, 0.5 * pow(2, attempt - 1)), coalesce(retry_after, 0)) END AS delay_s FROM a)
SELECT call_id, attempt, kind, retry_after, retried, {r("CAST(delay_s AS DOUBLE)", "delay_s")}, {r("CAST(sum(coalesce(delay_s, 0)) OVER (PARTITION BY call_id ORDER BY attempt) AS DOUBLE)", "waited_s")} FROM d"""


def _gates(spark, sf):
    limits = table(spark, sf, "events").filter("event_type = 'error'").select(
        "event_id", (F.col("user_id") % 50).alias("provider"), (F.col("event_id") * 10).cast("double").alias("at"), F.col("value").alias("retry_after")
    )
    return runs.gate_closings(limits).select("event_id", "provider", "closed_until")


_GATES = f"""SELECT event_id, user_id % 50 AS provider, {r("max(event_id * 10.0 + least(value, 120.0)) OVER (PARTITION BY user_id % 50 ORDER BY event_id ROWS UNBOUNDED PRECEDING)", "closed_until")}
FROM events WHERE event_type = 'error'"""


def _stale(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("completed").alias("status"), F.col("o_orderdate").alias("updated_at")
    )
    return runs.sweep_stale(orders, F.lit("1996-01-01").cast("timestamp_ntz")).select("run_id", "status")


def _last(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("ts").alias("at"), "event_id", F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("case_id"), F.col("event_type").alias("kind")
    )
    return runs.last_events(events)


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _as_ntz(df, *names):
    return df.select(*(F.col(c).cast("timestamp_ntz").alias(c) if c in names else F.col(c) for c in df.columns))


def _helpers(spark, sf):
    e = table(spark, sf, "events")
    found = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 3 == 1, "Mon, 01 Jan 2024 00:01:30 GMT").otherwise("soon")
    wait = text.retry_after_seconds(found, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    count = text.optional_count(F.col("value").cast("string"))
    fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" ```json\r\n"), "event_type", F.lit(" ``` \n  ``` "))).otherwise(F.col("event_type"))
    rating = stats.normalized_rating(F.col("value"), F.lit(20.0), F.lit(80.0))
    status = F.element_at(F.array(*map(F.lit, (429, 504, 401, 403, 404, 413, 422, 408, None, 302))), (F.col("event_id") % 10 + 1).cast("int"))
    return e.select(
        "event_id", wait.alias("wait_s"), count.alias("count"), text.strip_fence(fenced).alias("inside"), rating.alias("rating"),
        tables.error_kind(status).alias("kind"), text.markdown_cell(F.concat("event_type", F.lit("|x"))).alias("cell"),
    )


_HELPERS = f"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(event_id AS DOUBLE) WHEN 1 THEN 90.0 END AS wait_s,
  CASE WHEN value = floor(value) THEN CAST(value AS BIGINT) END AS count, CASE WHEN event_id % 2 = 0 THEN event_type || ' ``` ' ELSE event_type END AS inside, {r("greatest(0.0, least(1.0, (value - 20) / 60))", "rating")},
  ['rate_limit', 'server', 'authentication', 'permission', 'not_found', 'context_length', 'invalid_request', 'timeout', 'unknown', 'unknown'][event_id % 10 + 1] AS kind, event_type || chr(92) || '|x' AS cell FROM events"""


def _payloads(spark, sf):
    body = F.to_json(F.struct(
        F.array(F.struct(F.struct(F.col("event_type").alias("content")).alias("message"), F.when(F.col("event_id") % 3 == 0, "length").otherwise("stop").alias("finish_reason"))).alias("choices"),
        F.struct(F.col("user_id").alias("prompt_tokens"), F.col("event_id").alias("completion_tokens")).alias("usage"),
    ))
    read = tables.read_payload(body, tables.PAYLOAD_FIELDS["chat"])
    rows = table(spark, sf, "events").select("event_id", read.alias("p"))
    return rows.select(
        "event_id", F.col("p.text").alias("text"), tables.finish_reason(F.col("p.finish")).alias("finish"),
        text.optional_count(F.col("p.input_tokens")).alias("input_tokens"), text.optional_count(F.col("p.output_tokens")).alias("output_tokens"),
    )


ENTRIES = [
    entry("leaderboard", lambda s, d: leaderboard.leaderboard(_stored(s, d)), f"WITH {_BOARD} SELECT * FROM board", "case_results", "prices"),
    entry(
        "overview",
        lambda s, d: leaderboard.overview(leaderboard.leaderboard(_stored(s, d))),
        f"WITH {_BOARD} SELECT CAST(sum(n_runs) AS BIGINT) AS n_runs, count(*) AS n_models, CAST(sum(total_cost) AS DECIMAL(28,12)) AS total_cost, {r('median(median_p95_ms)', 'median_p95_ms')} FROM board",
        "case_results", "prices",
    ),
    entry("run_listing", _listing, _LISTING, "case_results"),
    entry(
        "case_listing_page",
        _page,
        f"""SELECT case_id, category, passed, round(score, 9) AS score FROM v_case_results WHERE run_id = 'run-2' AND status = 'ok' AND case_id ILIKE '%CASE-0000%' AND list_contains(tags, 'fast')
        ORDER BY case_id LIMIT 20 OFFSET 5""",
        "case_results",
    ),
    entry(
        "case_export",
        _exported,
        f"""WITH {_PRICED} SELECT run_id, case_id, category, array_to_string(tags, ',') AS tags, status, passed, {r("score", "score")}, provider, model, input_tokens, output_tokens,
          CAST(total_cost AS STRING) AS total_cost, unpriced_reason, error_kind, strftime(completed_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS completed_at FROM costs""",
        "case_results", "prices",
    ),
    entry(
        "model_catalog",
        _catalogue,
        """SELECT m.provider, m.model, true AS advertised, p.input_per_mtok FROM (SELECT DISTINCT provider, model FROM v_case_results) m
          LEFT JOIN v_prices p ON p.provider = m.provider AND p.model = m.model AND p.match = 'exact'
        UNION ALL SELECT p.provider, p.model, false, p.input_per_mtok FROM v_prices p
          WHERE NOT EXISTS (SELECT 1 FROM v_case_results c WHERE c.provider = p.provider AND c.model = p.model)""",
        "case_results", "prices",
    ),
    entry(
        "case_select",
        _selected,
        """SELECT 'p' || CAST(p_partkey AS STRING) AS id, p_partkey AS ord FROM part
        WHERE p_brand IN (SELECT DISTINCT p_brand FROM part ORDER BY 1 LIMIT 3) ORDER BY p_partkey LIMIT 40""",
    ),
    entry("case_sample", _sampled, "SELECT p_partkey, p_name FROM part ORDER BY sha256(CAST(p_partkey AS STRING) || '#7'), p_partkey LIMIT 50"),
    entry(
        "resume_anti_join",
        _resumed,
        """SELECT case_id, category FROM v_case_results c WHERE run_no = 0
        AND NOT EXISTS (SELECT 1 FROM v_case_results d WHERE d.case_id = c.case_id AND d.run_no = 1 AND d.status = 'ok' AND d.case_no % 3 = 0)""",
        "case_results",
    ),
    entry("suite_snapshot_upsert", _snapshots, "SELECT DISTINCT 's' || CAST(o_custkey % 300 AS STRING) AS suite_hash FROM orders WHERE 's' || CAST(o_custkey % 300 AS STRING) >= 's2'"),
    entry("duplicate_keys", _duplicates, "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"),
    entry("retry_schedule", _retries, _RETRIES),
    *(entry(f"retry_budget_{jitter}", _chains(jitter), _chains_sql(jitter)) for jitter in ("full", "equal", "none")),
    entry("rate_gate", _gates, _GATES),
    entry("stale_runs", _stale, "SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'interrupted' ELSE 'running' END ELSE 'completed' END AS status FROM orders"),
    entry(
        "last_events",
        _last,
        "SELECT user_id AS run_id, count(*) AS n_events, 'c' || CAST(arg_max(event_id, (ts, event_id)) AS STRING) AS last_case, arg_max(event_type, (ts, event_id)) AS last_kind FROM events GROUP BY user_id",
    ),
    entry(
        "events_tumbling",
        lambda s, d: _as_ntz(live.tumbling(_events(s, d)), "window_start"),
        f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, {r('sum(value)', 'total')} FROM events GROUP BY ALL",
    ),
    entry(
        "events_sliding",
        lambda s, d: _as_ntz(live.sliding(_events(s, d)), "window_start"),
        """WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS window_start FROM events)
        SELECT window_start, event_type, count(*) AS n FROM w GROUP BY ALL""",
    ),
    entry(
        "events_session",
        lambda s, d: _as_ntz(live.sessions(_events(s, d)), "session_start", "session_end"),
        """WITH s AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS starts FROM events),
        n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM s)
        SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM n GROUP BY user_id, session""",
    ),
    entry(
        "live_progress",
        lambda s, d: live.progress(_cases(s, d)),
        """SELECT run_id, count(*) AS n_attempted, count(*) FILTER (status = 'ok') AS n_completed, count(*) FILTER (passed) AS n_passed, count(*) FILTER (status <> 'ok') AS n_errors
        FROM v_case_results GROUP BY run_id""",
        "case_results",
    ),
    entry("text_helpers", _helpers, _HELPERS),
    entry(
        "vendor_payloads",
        _payloads,
        "SELECT event_id, event_type AS text, CASE WHEN event_id % 3 = 0 THEN 'length' ELSE 'stop' END AS finish, user_id AS input_tokens, event_id AS output_tokens FROM events",
    ),
    entry(
        "dry_run_estimate",
        lambda s, d: table(s, d, "conversations").filter("role = 'user'").groupBy("conv_id").agg(
            F.sum(F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long")).alias("input_tokens"), (F.count(F.lit(1)) * 256).alias("output_tokens")
        ),
        "SELECT conv_id, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS input_tokens, count(*) * 256 AS output_tokens FROM conversations WHERE role = 'user' GROUP BY conv_id",
    ),
]
