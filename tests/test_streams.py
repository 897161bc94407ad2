"""Streams run as streams: restarts, late rows, timers and listeners."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evalmill.streaming import live, tracking

START = datetime(2024, 1, 1)
RESULTS = "run_id string, case_id string, status string, passed boolean, completed_at timestamp"
EVENTS = "event_type string, user_id long, value double, ts timestamp"


def at(minutes):
    return START + timedelta(minutes=minutes)


class Feed:
    """A folder of files, each of which is a batch of its own."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, str(path), schema, 0

    def put(self, *rows):
        self.n += 1
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(self.path)
        time.sleep(0.05)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)


def result(run, case, minutes, status="ok", passed=True):
    return (run, case, status, passed, at(minutes))


def told(rows):
    return sorted((r.run_id, r.n_attempted, r.n_completed, r.n_passed, r.n_errors, r.heartbeat) for r in rows.collect())


def test_a_restart_goes_on_from_the_checkpoint_and_counts_once(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", RESULTS)
    kept = tracking.ProgressTable(spark, str(tmp_path / "progress"))
    follow = lambda: kept.follow(feed.stream(), str(tmp_path / "checkpoint")).awaitTermination()
    feed.put(result("a", "1", 1), result("a", "2", 2, passed=False), result("b", "1", 3, "error", None))
    feed.put(result("a", "3", 5, "timeout", None))
    follow()
    assert told(kept.current()) == [("a", 3, 2, 1, 1, at(5)), ("b", 1, 0, 0, 1, at(3))]
    feed.put(result("c", "1", 9), result("a", "4", 4))
    follow()  # another query over the same checkpoint: only the new file is read
    wanted = [("a", 4, 3, 2, 1, at(5)), ("b", 1, 0, 0, 1, at(3)), ("c", 1, 1, 1, 0, at(9))]
    assert told(kept.current()) == wanted
    follow()
    assert told(kept.current()) == wanted


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    kept = tracking.ProgressTable(spark, str(tmp_path / "progress"))
    batches = [spark.createDataFrame([result("a", str(i), i)], RESULTS) for i in range(4)]
    for number in (0, 1, 1, 2, 3, 3):
        kept.add(batches[number], number)
    assert told(kept.current()) == [("a", 4, 4, 4, 0, at(3))]
    assert kept._numbers() == [2, 3]


def test_a_failed_batch_is_run_again_from_the_checkpoint(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", RESULTS)
    kept, fails = tracking.ProgressTable(spark, str(tmp_path / "progress")), [True]

    class Failing(tracking.ProgressTable):
        def add(self, batch, number):
            super().add(batch, number)
            if number == 1 and fails and fails.pop():
                raise RuntimeError("lost after the write, before the commit")

    feed.put(result("a", "1", 1))
    feed.put(result("a", "2", 2))
    query = Failing(spark, kept.path).follow(feed.stream(), str(tmp_path / "checkpoint"))
    with pytest.raises(Exception, match="lost after the write"):
        query.awaitTermination()
    kept.follow(feed.stream(), str(tmp_path / "checkpoint")).awaitTermination()
    assert told(kept.current()) == [("a", 2, 2, 2, 0, at(2))]


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", EVENTS)
    feed.put(("view", 1, 1.0, at(5)), ("view", 1, 2.0, at(70)))
    feed.put(("view", 1, 1.0, at(71)))  # the watermark is at 60 minutes: the first window is told and forgotten
    feed.put(("view", 1, 4.0, at(58)))
    feed.put(("view", 1, 8.0, at(65)), ("view", 1, 16.0, at(300)))  # out of order, but in time
    feed.put(("view", 1, 32.0, at(301)))
    found = live.drained(live.tumbling(feed.stream()), spark, "late_windows", "append").collect()
    assert sorted((r.window_start, r.n, r.total) for r in found) == [(at(0), 1, 1.0), (at(60), 3, 11.0)]


def test_a_session_ends_by_the_watermark(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", EVENTS)
    feed.put(("view", 1, 1.0, at(0)), ("view", 1, 1.0, at(20)))
    feed.put(("view", 1, 1.0, at(45)), ("view", 2, 1.0, at(200)))
    feed.put(("view", 2, 1.0, at(201)))  # the watermark is at 190
    feed.put(("view", 1, 1.0, at(60)), ("view", 2, 1.0, at(202)))  # the session that this row would lengthen has ended
    found = live.drained(live.sessions(feed.stream()), spark, "late_sessions", "append").collect()
    assert [(r.user_id, r.session_start, r.session_end, r.n) for r in found] == [(1, at(0), at(75), 3)]


def test_a_repeat_within_the_delay_counts_once(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", RESULTS)
    feed.put(result("a", "1", 0), result("a", "2", 1), result("a", "1", 2))
    feed.put(result("a", "1", 30), result("b", "1", 30))
    feed.put(result("c", "1", 400))
    feed.put(result("c", "2", 401))  # the watermark is an hour behind: what came before it is forgotten
    feed.put(result("a", "1", 402), result("a", "9", 100))  # a case known no longer comes in; a late row doesn't
    found = live.drained(live.without_repeats(feed.stream()).select("run_id", "case_id"), spark, "no_repeats", "append").collect()
    assert sorted(map(tuple, found)) == [("a", "1"), ("a", "1"), ("a", "2"), ("b", "1"), ("c", "1"), ("c", "2")]


def test_a_run_that_falls_silent_is_interrupted_once(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "run_id string, status string, at timestamp")
    feed.put(("a", "running", at(0)), ("b", "running", at(0)), ("c", "running", at(1)))
    feed.put(("b", "running", at(8)), ("c", "completed", at(9)))
    feed.put(("d", "running", at(21)))  # the watermark is 10 minutes behind
    feed.put(("d", "running", at(25)))
    feed.put(("d", "running", at(31)))
    feed.put(("d", "running", at(33)))
    feed.put(("a", "running", at(34)))
    feed.put(("d", "running", at(60)))  # in time: the watermark is at 24, before 33 and the silence
    feed.put(("d", "running", at(61)))
    found = live.drained(tracking.silent_runs(feed.stream()), spark, "silent", "append").collect()
    assert sorted((r.run_id, r.status, r.last_heard) for r in found) == [
        ("a", "interrupted", at(0)), ("a", "interrupted", at(34)), ("b", "interrupted", at(8)),
    ]


def test_a_listener_is_told_of_its_stream(spark, tmp_path):
    feed, said = Feed(spark, tmp_path / "in", RESULTS), []

    def tell(what):
        said.append(what)
        if what["event"] == "started":
            raise ValueError("an error of the listener leaves the stream alone")

    listener = tracking.ProgressListener(tell, "followed")
    spark.streams.addListener(listener)
    try:
        feed.put(result("a", "1", 1), result("a", "2", 2))
        feed.put(result("b", "1", 3))
        kept = tracking.ProgressTable(spark, str(tmp_path / "progress"))
        kept.follow(feed.stream(), str(tmp_path / "one"), "followed").awaitTermination()
        kept.follow(feed.stream(), str(tmp_path / "two"), "other").awaitTermination()
        deadline = time.monotonic() + 20
        while not any(s["event"] == "ended" for s in said) and time.monotonic() < deadline:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert said[0] == {"event": "started", "name": "followed"} and said[-1] == {"event": "ended", "failed": False}
    assert sum(s["rows"] for s in said if s["event"] == "progress") == 3 and {s.get("name", "followed") for s in said} == {"followed"}


def test_counters_of_a_stream_and_of_a_table_are_alike(spark, tmp_path):
    rows = [result("a" if i % 3 else "b", str(i), i, "ok" if i % 4 else "error", i % 2 == 0 if i % 4 else None) for i in range(40)]
    feed = Feed(spark, tmp_path / "in", RESULTS)
    for i in range(0, 40, 10):
        feed.put(*rows[i : i + 10])
    kept = tracking.ProgressTable(spark, str(tmp_path / "progress"))
    kept.follow(feed.stream(), str(tmp_path / "checkpoint")).awaitTermination()
    whole = live.progress(spark.createDataFrame(rows, RESULTS))
    assert sorted(map(tuple, kept.current().drop("heartbeat").collect())) == sorted(map(tuple, whole.collect()))
    assert kept.current().select(F.max("heartbeat")).first()[0] == at(39)
