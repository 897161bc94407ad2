"""Answers of five wire formats, made of events, as one shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmill.plans.shared import entry
from evalmill.sources import answers
from evalmill.sources.views import table

_WIRES = ("chat", "responses", "messages", "candidates", "local")
_MADE = {
    "chat": """concat('{"model": "m", "choices": [', CASE WHEN k = 0 THEN '' ELSE concat('{"finish_reason": "', CASE WHEN k = 1 THEN 'length' WHEN k = 2 THEN 'tool_calls' ELSE 'stop' END,
      '", "message": {"content": ', CASE WHEN k = 2 THEN 'null' WHEN k = 3 THEN concat('[{"text": "', event_type, '"}, {"image": 1}, {"text": "!"}]') ELSE concat('"', event_type, '"') END, '}}') END,
      '], "usage": {"prompt_tokens": ', user_id, ', "completion_tokens": ', CASE WHEN k = 4 THEN '"7"' WHEN k = 5 THEN '7.0' WHEN k = 6 THEN '-7' ELSE '7' END, '}}')""",
    "responses": """concat('{"model": "m", "status": "', CASE WHEN k < 2 THEN 'incomplete' WHEN k = 2 THEN 'failed' ELSE 'completed' END, '", "incomplete_details": {"reason": "', CASE WHEN k = 0 THEN 'max_output_tokens' ELSE 'other' END,
      '"}, "output": [{"type": "reasoning"}, ', CASE WHEN k = 3 THEN '{"type": "function_call"}, ' ELSE '' END, '{"type": "message", "content": [{"type": "output_text", "text": "', event_type, '"}, ',
      CASE WHEN k = 4 THEN '{"type": "refusal", "text": "no"}, ' ELSE '' END, '{"type": "output_text", "text": "!"}]}], "usage": {"input_tokens": ', user_id, ', "output_tokens": 7, "total_tokens": 999, "input_tokens_details": {"cached_tokens": 3}}}')""",
    "messages": """concat('{"model": "m", "stop_reason": "', CASE WHEN k = 0 THEN 'max_tokens' WHEN k = 1 THEN 'refusal' WHEN k = 2 THEN 'pause_turn' ELSE 'end_turn' END, '", "content": [{"type": "thinking", "text": "hm"}, {"type": "text", "text": "', event_type,
      '"}, {"type": "text", "text": "!"}], "usage": {"input_tokens": ', user_id, ', "output_tokens": ', CASE WHEN k = 3 THEN 'true' ELSE '7' END, ', "cache_read_input_tokens": 3}}')""",
    "candidates": """concat('{"model": "m", "candidates": [', CASE WHEN k = 0 THEN '3' ELSE concat('{"finish_reason": "', CASE WHEN k = 1 THEN 'SAFETY' WHEN k = 2 THEN 'LANGUAGE' WHEN k = 3 THEN 'MAX_TOKENS' ELSE 'STOP' END,
      '", "content": {"parts": [{"text": "hm", "thought": true}, {"text": "', event_type, '"}, {"text": "!"}]}}') END, '], "usage_metadata": {"prompt_token_count": ', user_id, ', "candidates_token_count": 7, "thoughts_token_count": 5}}')""",
    "local": """concat('{"model": "m", "done_reason": "', CASE WHEN k = 0 THEN 'length' WHEN k = 1 THEN 'load' ELSE 'stop' END, '", "message": {"content": ', CASE WHEN k = 2 THEN '5' ELSE concat('"', event_type, '!"') END, '}, "prompt_eval_count": ', user_id,
      CASE WHEN k = 3 THEN '' ELSE ', "eval_count": 7' END, CASE WHEN k = 4 THEN '' ELSE '}' END)""",
}


def _answers(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "user_id", (F.floor(F.col("event_id") / 5) % 7).alias("k"), (F.col("event_id") % 5).alias("w"))
    made = F.coalesce(*(F.when(F.col("w") == i, F.expr(_MADE[wire])) for i, wire in enumerate(_WIRES)))
    rows = events.select("event_id", "w", F.try_parse_json(made).alias("answer"))
    read = F.coalesce(*(F.when(F.col("w") == i, answers.read_answer(F.col("answer"), wire)) for i, wire in enumerate(_WIRES)))
    return rows.withColumn("a", read).select("event_id", "a.*")


# What the planted answers say, format by format (w) and kind by kind (k).
_SAID = """WITH e AS (SELECT event_id, event_type, user_id, CAST(floor(event_id / 5) AS BIGINT) % 7 AS k, event_id % 5 AS w FROM events),
s AS (SELECT *, NOT ((w = 0 AND k = 0) OR (w = 3 AND k = 0) OR (w = 4 AND k = 4)) AS there,
  CASE w WHEN 0 THEN CASE k WHEN 2 THEN '' WHEN 3 THEN event_type || '!' ELSE event_type END WHEN 4 THEN CASE WHEN k = 2 THEN '' ELSE event_type || '!' END ELSE event_type || '!' END AS said,
  CASE w WHEN 0 THEN CASE k WHEN 1 THEN 'length' WHEN 2 THEN 'tool_use' ELSE 'stop' END
    WHEN 1 THEN CASE k WHEN 0 THEN 'length' WHEN 1 THEN 'unknown' WHEN 2 THEN 'unknown' WHEN 3 THEN 'tool_use' WHEN 4 THEN 'content_filter' ELSE 'stop' END
    WHEN 2 THEN CASE k WHEN 0 THEN 'length' WHEN 1 THEN 'content_filter' WHEN 2 THEN 'unknown' ELSE 'stop' END
    WHEN 3 THEN CASE k WHEN 1 THEN 'content_filter' WHEN 2 THEN 'unknown' WHEN 3 THEN 'length' ELSE 'stop' END
    ELSE CASE k WHEN 0 THEN 'length' WHEN 1 THEN 'unknown' ELSE 'stop' END END AS reason,
  CASE WHEN w = 4 AND k = 4 THEN NULL ELSE user_id END AS i, CASE WHEN (w = 0 AND k IN (4, 6)) OR (w = 2 AND k = 3) OR (w = 4 AND k IN (3, 4)) THEN NULL ELSE 7 END AS o FROM e)
SELECT event_id, there, CASE WHEN there THEN said END AS text, CASE WHEN there THEN reason END AS finish, CASE WHEN there THEN reason = 'length' END AS truncated, CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens,
  CAST(CASE WHEN w = 1 THEN 999 ELSE i + o END AS BIGINT) AS total_tokens, CAST(CASE WHEN w IN (1, 2) THEN 3 END AS BIGINT) AS cached_tokens, CAST(CASE WHEN w = 3 THEN 5 END AS BIGINT) AS reasoning_tokens,
  CASE WHEN w = 4 AND k = 4 THEN NULL ELSE 'm' END AS model FROM s"""

ENTRIES = [entry("vendor_answers", _answers, _SAID)]
