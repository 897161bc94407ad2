"""Roll-ups, statistics and costs as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmill.functions import stats
from evalmill.operators import pricing, rollup, scoring
from evalmill.plans.shared import OUTCOME, entry, r, rate_columns, wilson_high, wilson_low
from evalmill.sources.views import table, view


def _cases(spark, sf):
    return view(spark, sf, "case_results")


def _costs(spark, sf):
    return pricing.case_costs(_cases(spark, sf), view(spark, sf, "prices"))


def _labelled_rates(spark, sf):
    rows = view(spark, sf, "labelled").withColumn("status", F.lit("ok"))
    return scoring_by(rows, "tag", True)


def scoring_by(rows, key, explode):
    rows = rows.withColumn(key, F.explode("tags")) if explode else rows
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), *scoring.aliased(scoring.rates(scoring.case_outcome("exclude")))
    )


_OK = "FILTER (status = 'ok')"
_MEAN_SCORE = r(f"avg(score) {_OK}", "mean_score")

# One 2x2 table for each type of event, on users' parity: numbers enough for the paired statistics.
_TABLE = """
SELECT event_type, count(*) FILTER (value < 50 AND user_id % 2 = 0) AS a, count(*) FILTER (value < 50 AND user_id % 2 = 1) AS b,
  count(*) FILTER (value >= 50 AND user_id % 3 = 0) AS c, count(*) FILTER (value >= 50 AND user_id % 3 <> 0) AS d
FROM events GROUP BY event_type
"""


def _paired_table(spark, sf):
    v, u = F.col("value"), F.col("user_id")
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count_if((v < 50) & (u % 2 == 0)).alias("a"), F.count_if((v < 50) & (u % 2 == 1)).alias("b"),
        F.count_if((v >= 50) & (u % 3 == 0)).alias("c"), F.count_if((v >= 50) & (u % 3 != 0)).alias("d"),
    )


def _phi_newcombe(spark, sf):
    a, b, c, d = map(F.col, "abcd")
    low, high = stats.newcombe_interval(a, b, c, d)
    return _paired_table(spark, sf).select(
        "event_type", "a", "b", "c", "d", stats.phi_coefficient(a, b, c, d).alias("phi"), low.alias("ci_low"), high.alias("ci_high")
    )


def _mcnemar(spark, sf):
    return _paired_table(spark, sf).select("event_type", "b", "c", stats.mcnemar_exact(F.col("b"), F.col("c")).alias("p_value"))


_POWER = "SELECT CAST(p_size AS DOUBLE) / 100 AS p1, CAST(p_size % 10 + 1 AS DOUBLE) / 100 AS delta, count(*) AS n FROM part GROUP BY ALL"


def _power_grid(spark, sf):
    part = table(spark, sf, "part")
    return part.groupBy((F.col("p_size").cast("double") / 100).alias("p1"), ((F.col("p_size") % 10 + 1).cast("double") / 100).alias("delta")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _required_n(spark, sf):
    return _power_grid(spark, sf).select("p1", "delta", stats.required_n(F.col("delta"), F.col("p1")).alias("required_n"))


def _detectable(spark, sf):
    grid = _power_grid(spark, sf)
    return grid.select("p1", "delta", "n", stats.minimum_detectable_difference(F.col("n"), F.col("p1")).alias("detectable"))


_SPREAD = (
    "({za!r} * sqrt(2 * ((p1 + p2) / 2) * (1 - (p1 + p2) / 2)) + {zb!r} * sqrt(p1 * (1 - p1) + p2 * (1 - p2)))"
).format(za=stats.Z_95, zb=stats.Z_POWER_80)

_NEWCOMBE = f"""
WITH t AS ({_TABLE}), w AS (
  SELECT *, CAST(a + b + c + d AS DOUBLE) AS n, CAST(a + b AS DOUBLE) / (a + b + c + d) AS p1, CAST(a + c AS DOUBLE) / (a + b + c + d) AS p2,
    {wilson_low("a + b", "a + b + c + d")} AS l1, {wilson_high("a + b", "a + b + c + d")} AS u1,
    {wilson_low("a + c", "a + b + c + d")} AS l2, {wilson_high("a + c", "a + b + c + d")} AS u2,
    CASE WHEN CAST(a + b AS DOUBLE) * (c + d) * (a + c) * (b + d) > 0
      THEN (CAST(a AS DOUBLE) * d - CAST(b AS DOUBLE) * c) / sqrt(CAST(a + b AS DOUBLE) * (c + d) * (a + c) * (b + d)) ELSE 0.0 END AS phi
  FROM t)
SELECT event_type, a, b, c, d, {r("phi", "phi")},
  {r("-((p1 - p2) + sqrt(greatest(0.0, (u1 - p1) ** 2 - 2 * phi * (u1 - p1) * (p2 - l2) + (p2 - l2) ** 2)))", "ci_high_swapped")},
  {r("-((p1 - p2) - sqrt(greatest(0.0, (p1 - l1) ** 2 - 2 * phi * (p1 - l1) * (u2 - p2) + (u2 - p2) ** 2)))", "ci_low_swapped")}
FROM w
""".replace("ci_high_swapped", "ci_low").replace("ci_low_swapped", "ci_high")

# C(n, k) / 2**n in log space, summed over the smaller side.
_MCNEMAR = f"""
WITH t AS ({_TABLE})
SELECT event_type, b, c, {r('''CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1),
  lambda k: exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2))))) END''', "p_value")}
FROM t
"""

# Prices by hand: the tokens times the price times a millionth, in exact decimals.
_PRICED = """
ranked AS (
  SELECT m.provider, m.model, p.ord, p.match, p.input_per_mtok, p.output_per_mtok, p.cached_input_per_mtok,
    row_number() OVER (PARTITION BY m.provider, m.model ORDER BY CASE p.match WHEN 'exact' THEN 0 WHEN 'prefix' THEN 1 ELSE 2 END,
      CASE WHEN p.match = 'prefix' THEN -length(p.model) ELSE 0 END, p.ord) AS place
  FROM (SELECT DISTINCT provider, model FROM v_case_results) m LEFT JOIN v_prices p ON p.provider = m.provider AND (
    (p.match = 'exact' AND p.model = m.model) OR (p.match = 'prefix' AND starts_with(m.model, p.model))
    OR (p.match = 'regex' AND regexp_matches(m.model, p.model)))),
priced AS (SELECT * FROM ranked WHERE place = 1),
cost AS (
  SELECT c.*, CASE WHEN p.ord IS NULL THEN 'no_price_entry' WHEN input_tokens IS NULL OR output_tokens IS NULL THEN 'no_token_usage' END AS unpriced_reason,
    CASE WHEN p.cached_input_per_mtok IS NOT NULL AND cached_tokens > 0
      THEN CAST(greatest(input_tokens - cached_tokens, 0) AS DECIMAL(12,0)) * p.input_per_mtok * CAST(0.000001 AS DECIMAL(7,6))
        + CAST(cached_tokens AS DECIMAL(12,0)) * p.cached_input_per_mtok * CAST(0.000001 AS DECIMAL(7,6))
      ELSE CAST(input_tokens AS DECIMAL(12,0)) * p.input_per_mtok * CAST(0.000001 AS DECIMAL(7,6)) END AS c_in,
    CAST(output_tokens AS DECIMAL(12,0)) * p.output_per_mtok * CAST(0.000001 AS DECIMAL(7,6)) AS c_out
  FROM v_case_results c JOIN priced p ON p.provider = c.provider AND p.model = c.model),
costs AS (
  SELECT *, unpriced_reason IS NULL AS priced,
    CAST(CASE WHEN unpriced_reason IS NULL THEN c_in END AS DECIMAL(20,12)) AS input_cost,
    CAST(CASE WHEN unpriced_reason IS NULL THEN c_out END AS DECIMAL(20,12)) AS output_cost,
    CAST(CASE WHEN unpriced_reason IS NULL THEN c_in + c_out END AS DECIMAL(20,12)) AS total_cost
  FROM cost)
"""
_REASONS = """
reasons AS (
  SELECT run_id, unpriced_reason, count(*) AS n, row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, unpriced_reason) AS place
  FROM costs WHERE unpriced_reason IS NOT NULL GROUP BY run_id, unpriced_reason)
"""
_VIEWS = ("case_results", "prices")


def _case_cost(spark, sf):
    return _costs(spark, sf).select("run_id", "case_id", "event_id", "priced", "unpriced_reason", "input_cost", "output_cost", "total_cost")


def _running(spark, sf):
    spent = pricing.running_spend(_costs(spark, sf), "0.5")
    return spent.select("run_id", "case_id", "spent", "n_unpriced", "exceeded", "cancelled")


ENTRIES = [
    entry(
        "wilson_by_category",
        lambda s, d: rollup.pass_rates(_cases(s, d).filter("category is not null"), ["category"]),
        f"SELECT category, count(*) AS n, {rate_columns(OUTCOME['exclude'])} FROM v_case_results WHERE category IS NOT NULL GROUP BY category",
        "case_results",
    ),
    *(
        entry(
            f"pass_rate_by_run_{policy}",
            lambda s, d, policy=policy: rollup.pass_rates(_cases(s, d), ["run_id"], policy),
            f"SELECT run_id, count(*) AS n, {rate_columns(OUTCOME[policy])} FROM v_case_results GROUP BY run_id",
            "case_results",
        )
        for policy in scoring.POLICIES
    ),
    entry(
        "run_rollup",
        lambda s, d: rollup.run_rollup(_cases(s, d)),
        f"""SELECT run_id, count(*) AS n_attempted, count(*) {_OK} AS n_completed, count(*) FILTER (status <> 'ok') AS n_errors,
          {r("count(*) FILTER (status <> 'ok') / count(*)", "error_rate")}, {rate_columns(OUTCOME["exclude"])},
          count(score) {_OK} AS n_scored, {_MEAN_SCORE}, {r(f"median(score) {_OK}", "median_score")}
        FROM v_case_results GROUP BY run_id""",
        "case_results",
    ),
    entry(
        "latency_stats",
        lambda s, d: rollup.latency_stats(_cases(s, d)),
        f"""SELECT run_id, count(latency_ms) {_OK} AS n, {r(f"avg(latency_ms) {_OK}", "mean_ms")},
          {", ".join(r(f"quantile_cont(latency_ms, {p / 100}) {_OK}", f"p{p}_ms") for p in (50, 90, 95, 99))}, {r(f"max(latency_ms) {_OK}", "max_ms")},
          concat_ws(',', {", ".join(f"CASE WHEN count(latency_ms) {_OK} < {gate} THEN '{name}' END" for name, gate in stats.PERCENTILE_GATES)}) AS low_confidence
        FROM v_case_results GROUP BY run_id""",
        "case_results",
    ),
    entry(
        "token_totals",
        lambda s, d: rollup.token_totals(_cases(s, d)),
        f"""WITH u AS (SELECT *, input_tokens IS NOT NULL AND output_tokens IS NOT NULL AS known FROM v_case_results)
        SELECT run_id, count(*) FILTER (known) AS n_with_usage, count(*) FILTER (NOT known) AS n_missing,
          CAST(sum(input_tokens) FILTER (known) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) FILTER (known) AS BIGINT) AS output_tokens,
          CAST(sum(input_tokens + output_tokens) FILTER (known) AS BIGINT) AS total_tokens, {r("avg(input_tokens) FILTER (known)", "mean_input_tokens")},
          {r("avg(output_tokens) FILTER (known)", "mean_output_tokens")}, {r("count(*) FILTER (known) / count(*)", "usage_coverage")}
        FROM u GROUP BY run_id""",
        "case_results",
    ),
    entry(
        "error_breakdown",
        lambda s, d: rollup.error_breakdown(_cases(s, d)),
        """SELECT run_id, coalesce(error_kind, CASE WHEN status = 'error' THEN 'evaluation_error' END, status) AS error, count(*) AS n
        FROM v_case_results WHERE status <> 'ok' GROUP BY 1, 2""",
        "case_results",
    ),
    entry(
        "metrics_by_category",
        lambda s, d: rollup.by_category(_cases(s, d)),
        f"""SELECT run_id, category, count(*) AS n, {rate_columns(OUTCOME["exclude"])}, {_MEAN_SCORE}
        FROM v_case_results WHERE category IS NOT NULL GROUP BY run_id, category""",
        "case_results",
    ),
    entry(
        "metrics_by_tag",
        lambda s, d: rollup.by_tag(_cases(s, d)),
        f"""WITH t AS (SELECT *, unnest(tags) AS tag FROM v_case_results)
        SELECT run_id, tag, count(*) AS n, {rate_columns(OUTCOME["exclude"])}, {_MEAN_SCORE} FROM t GROUP BY run_id, tag""",
        "case_results",
    ),
    entry(
        "metrics_by_evaluator",
        lambda s, d: rollup.by_evaluator(view(s, d, "evaluations")),
        f"""WITH e AS (SELECT *, CASE WHEN status <> 'error' THEN passed END AS verdict, CASE WHEN status <> 'error' THEN score END AS usable FROM v_evaluations)
        SELECT run_id, evaluator_id, min(evaluator_type) AS evaluator_type, count(*) AS n, count(*) FILTER (status = 'error') AS n_errors,
          count(*) FILTER (verdict) AS n_passed, count(verdict) AS n_pass_denominator,
          {r("CASE WHEN count(verdict) > 0 THEN count(*) FILTER (verdict) / count(verdict) END", "pass_rate")},
          count(*) FILTER (status = 'passed' AND passed IS NULL AND score IS NOT NULL) AS n_score_only,
          {r("avg(usable)", "mean_score")}, {r("median(usable)", "median_score")}
        FROM e GROUP BY run_id, evaluator_id""",
        "evaluations",
    ),
    entry(
        "label_rates_by_tag",
        _labelled_rates,
        f"""WITH t AS (SELECT *, 'ok' AS status, unnest(tags) AS tag FROM v_labelled)
        SELECT tag, count(*) AS n, {rate_columns(OUTCOME["exclude"])} FROM t GROUP BY tag""",
        "labelled",
    ),
    entry("phi_newcombe", _phi_newcombe, _NEWCOMBE),
    entry("mcnemar_p", _mcnemar, _MCNEMAR),
    entry(
        "required_n_grid",
        _required_n,
        f"""WITH g AS ({_POWER}), q AS (SELECT *, greatest(0.0, least(1.0, p1 - delta)) AS p2 FROM g)
        SELECT {r("p1", "p1")}, {r("delta", "delta")},
          CAST(CASE WHEN delta > 0 AND delta < 1 AND delta <= p1 AND p1 <= 1 THEN ceil(pow({_SPREAD} / delta, 2)) END AS BIGINT) AS required_n FROM q""",
    ),
    entry(
        "mdd_grid",
        _detectable,
        f"""WITH RECURSIVE g AS ({_POWER}), h AS (
          SELECT p1, delta, n, 0 AS step, 1e-6::DOUBLE AS low, (1 - 1e-6)::DOUBLE AS high FROM g
          UNION ALL
          SELECT p1, delta, n, step + 1, CASE WHEN enough THEN low ELSE middle END, CASE WHEN enough THEN middle ELSE high END
          FROM (SELECT *, pow({_SPREAD} / middle, 2) <= n AS enough FROM (
            SELECT *, greatest(0.0, least(1.0, p1 - middle)) AS p2 FROM (SELECT *, (low + high) / 2 AS middle FROM h WHERE step < 20))))
        SELECT {r("p1", "p1")}, {r("delta", "delta")}, n, {r("CASE WHEN n > 0 THEN least(high, p1) END", "detectable")} FROM h WHERE step = 20""",
    ),
    entry(
        "price_lookup",
        lambda s, d: pricing.lookup(_cases(s, d), view(s, d, "prices")),
        f"WITH {_PRICED} SELECT provider, model, ord AS price_ord, match, input_per_mtok, output_per_mtok, cached_input_per_mtok FROM priced",
        *_VIEWS,
    ),
    entry(
        "case_cost",
        _case_cost,
        f"WITH {_PRICED} SELECT run_id, case_id, event_id, priced, unpriced_reason, input_cost, output_cost, total_cost FROM costs",
        *_VIEWS,
    ),
    entry(
        "dominant_unpriced_reason",
        lambda s, d: pricing.dominant_reasons(_costs(s, d)),
        f"WITH {_PRICED}, {_REASONS} SELECT run_id, unpriced_reason, n FROM reasons WHERE place = 1",
        *_VIEWS,
    ),
    entry(
        "cost_rollup",
        lambda s, d: pricing.cost_rollup(_costs(s, d)).drop("cost_per_case"),
        f"""WITH {_PRICED}, {_REASONS}, sums AS (
          SELECT run_id, count(*) AS n_units, count(*) FILTER (priced) AS n_priced, CAST(sum(input_cost) AS DECIMAL(28,12)) AS input_cost,
            CAST(sum(output_cost) AS DECIMAL(28,12)) AS output_cost, CAST(sum(total_cost) AS DECIMAL(28,12)) AS total_cost,
            CAST(sum(CAST(judge_cost AS DECIMAL(20,12))) FILTER (priced) AS DECIMAL(28,12)) AS judge_cost FROM costs GROUP BY run_id)
        SELECT s.run_id, n_units, n_priced, input_cost, output_cost, total_cost, judge_cost, n_priced = n_units AND n_priced > 0 AS priced,
          CASE WHEN n_priced = 0 THEN coalesce(q.unpriced_reason, 'no_price_entry') WHEN n_priced <> n_units THEN 'partial_coverage' END AS unpriced_reason,
          {r("n_priced / n_units", "coverage")}
        FROM sums s LEFT JOIN reasons q ON q.run_id = s.run_id AND q.place = 1""",
        *_VIEWS,
    ),
    entry(
        "per_unit_cost",
        lambda s, d: pricing.cost_rollup(_costs(s, d)).select("run_id", "cost_per_case"),
        # Half to even at ten places: the remainder of the division of whole units of 1e-12 decides.
        f"""WITH {_PRICED}, s AS (SELECT run_id, count(*) AS n, CAST(sum(total_cost) * 1000000000000 AS HUGEINT) AS units FROM costs GROUP BY run_id),
        q AS (SELECT *, units // (n * 100) AS low, units % (n * 100) AS rest FROM s)
        SELECT run_id, CAST((low + CASE WHEN 2 * rest > n * 100 OR (2 * rest = n * 100 AND low % 2 = 1) THEN 1 ELSE 0 END) AS DECIMAL(28,0))
          * CAST(0.0000000001 AS DECIMAL(10,10)) AS cost_per_case FROM q""",
        *_VIEWS,
    ),
    entry(
        "running_budget",
        _running,
        f"""WITH {_PRICED}, b AS (
          SELECT *, coalesce(total_cost, 0) + coalesce(CAST(judge_cost AS DECIMAL(20,12)), 0) AS billable FROM costs),
        w AS (SELECT run_id, case_id, billable, CAST(sum(billable) OVER before AS DECIMAL(28,12)) AS spent,
          CAST(count(*) FILTER (NOT priced) OVER before AS BIGINT) AS n_unpriced FROM b
          WINDOW before AS (PARTITION BY run_id ORDER BY completed_at, case_id ROWS UNBOUNDED PRECEDING))
        SELECT run_id, case_id, spent, n_unpriced, spent > 0.5 AS exceeded, spent - billable > 0.5 AS cancelled FROM w""",
        *_VIEWS,
    ),
]
