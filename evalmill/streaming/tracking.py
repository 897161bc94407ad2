"""Runs followed while they go on: counters and heartbeats kept in a table, runs that fall silent, and progress told to a listener."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from evalmill.session import delete_path

COUNTERS = "run_id string, n_attempted long, n_completed long, n_passed long, n_errors long, heartbeat timestamp"
#: Snapshots that are kept, the newest included: a batch that is run again needs the one before it.
KEPT = 2


class ProgressTable:
    """Counters and heartbeat of each run, as one snapshot for each batch of a stream.

    A snapshot is the one before it plus the batch's own counts, under the
    batch's number. A batch that is run again after a failure starts from the
    snapshot before it and writes the same one again, so nothing counts twice.
    A snapshot has a row for each run, not for each result.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, number: int) -> str:
        return f"{self.path}/batch={number}"

    def _numbers(self) -> list[int]:
        """Numbers of the snapshots that were written to their end."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [str(s.getPath().getName()) for s in files.listStatus(folder)]
        done = lambda n: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._place(n)}/_SUCCESS"))
        return sorted(n for n in (int(x.removeprefix("batch=")) for x in names if x.startswith("batch=")) if done(n))

    def _snapshot(self, below: int | None = None) -> DataFrame:
        numbers = [n for n in self._numbers() if below is None or n < below]
        if not numbers:
            return self.spark.createDataFrame([], COUNTERS)
        return self.spark.read.schema(COUNTERS).parquet(self._place(numbers[-1]))

    def current(self) -> DataFrame:
        """The newest snapshot."""
        return self._snapshot()

    def add(self, batch: DataFrame, number: int) -> None:
        """Count a batch of results (run_id, status, passed, completed_at) under its number."""
        ok = F.col("status") == "ok"
        counts = batch.groupBy("run_id").agg(
            F.count(F.lit(1)).alias("n_attempted"),
            F.count_if(ok).alias("n_completed"),
            F.count_if(F.coalesce("passed", F.lit(False))).alias("n_passed"),
            F.count_if(~ok).alias("n_errors"),
            F.max(F.col("completed_at").cast("timestamp")).alias("heartbeat"),
        )
        both = self._snapshot(number).unionByName(counts).groupBy("run_id").agg(
            *(F.sum(c).alias(c) for c in ("n_attempted", "n_completed", "n_passed", "n_errors")), F.max("heartbeat").alias("heartbeat")
        )
        both.write.mode("overwrite").parquet(self._place(number))
        for old in self._numbers()[:-KEPT]:
            delete_path(self.spark, self._place(old))

    def follow(self, results: DataFrame, checkpoint: str, name: str | None = None, **trigger) -> StreamingQuery:
        """Keep the table up to date with a stream of results; a restart goes on from its checkpoint."""
        writer = results.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
        return (writer.queryName(name) if name else writer).start()


def silent_runs(heartbeats: DataFrame, seconds: int = 600) -> DataFrame:
    """(run_id, status, last_heard): ``interrupted``, once, for a run of which nothing was heard for so long in the stream's time.

    The stream's time is its watermark, ``seconds`` behind the latest heartbeat:
    a run that speaks before the watermark passes its timer was never silent.
    ``heartbeats`` has run_id, status and at. A run that has ended is not waited
    for; one that speaks again after its silence is waited for anew. Each run has
    a timer of its own, which every heartbeat sets back.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "status": ["interrupted"], "last_heard": pd.to_datetime([last], unit="us")})
            return
        last, ended = (state.get[0], False) if state.exists else (-1, False)
        for part in rows:
            at = part["at"].astype("datetime64[us]").astype("int64")
            last = max(last, int(at.max()))
            ended = ended or bool((part["status"] != "running").any())
        if ended:
            if state.exists:
                state.remove()
            return
        state.update((last,))
        # A timer can't be set before the watermark; then it is due at once.
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    marked = heartbeats.withWatermark("at", f"{seconds} seconds").groupBy("run_id")
    return marked.applyInPandasWithState(step, "run_id string, status string, last_heard timestamp", "last long", "append", "EventTimeTimeout")


class ProgressListener(StreamingQueryListener):
    """Tells a function of each step of the streams with a given name (all, without one).

    The function gets a dictionary: ``event`` (started, progress, ended), and for
    progress the batch, its rows, rows a second and the stream's watermark. An
    error of the function is its own: the stream goes on.
    """

    def __init__(self, tell: Callable[[dict], None], name: str | None = None):
        self.tell, self.name = tell, name
        self._ours: set[str] = set()

    def _say(self, **what) -> None:
        try:
            self.tell(what)
        except Exception as e:  # noqa: BLE001
            print(f"progress listener: {e!r}")

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if self.name in (None, event.name):
            self._ours.add(str(event.id))
            self._say(event="started", name=event.name)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if self.name in (None, p.name):
            self._say(event="progress", name=p.name, batch=p.batchId, rows=p.numInputRows, rows_per_second=p.processedRowsPerSecond, watermark=p.eventTime.get("watermark"))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.id) in self._ours:
            self._ours.discard(str(event.id))
            self._say(event="ended", failed=event.exception is not None)
