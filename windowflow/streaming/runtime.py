"""Running an application: start, metrics, stop, and recovery from the same checkpoint."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..plans.query import Application, Query
from .lower import EVENT_TIME, lowering


class Metrics(StreamingQueryListener):
    """Rows per second and batch durations of every query that it hears of."""

    def __init__(self) -> None:
        self.lock, self.progress = threading.Lock(), []

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self.lock:
            self.progress.append((p.name, p.batchId, p.numInputRows, p.processedRowsPerSecond, p.batchDuration))

    def rows(self) -> int:
        """How many rows the batches reported so far had."""
        with self.lock:
            return sum(p[2] for p in self.progress)

    def summary(self, shares=(5, 25, 50, 75, 99)) -> dict:
        """Rows, batches that had some, mean rows per second, and percentiles of batch durations and of rows' latencies in ms.

        A row's latency is the time that its batch takes, from when it is planned to when its results are committed.
        """
        with self.lock:
            rows = [p for p in self.progress if p[2]]
        times = sorted(p[4] for p in rows)
        total, ms = sum(p[2] for p in rows), sum(times)
        pick = lambda s: times[min(len(times) - 1, len(times) * s // 100)] if times else None

        def latency(share: int):
            seen = 0
            for p in sorted(rows, key=lambda p: p[4]):
                seen += p[2]
                if 100 * seen >= share * total:
                    return p[4]

        return {
            "rows": total, "batches": len(rows), "most_rows": max((p[2] for p in rows), default=0), "rows_per_second": 1000 * total / ms if ms else None,
            "batch_ms": {s: pick(s) for s in shares}, "latency_ms": {s: latency(s) for s in shares},
        }


    def settled(self, batches: int, seconds: float = 20) -> dict:
        """The summary once that many batches with rows have been reported, or time is up: reports come a little late."""
        end = time.monotonic() + seconds
        while (said := self.summary())["batches"] < batches and time.monotonic() < end:
            time.sleep(0.1)
        return said


#: Spark keeps states of one's own behind other operators in RocksDB only.
_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.minDeltasForSnapshot": "2",  # changelogs stay until a snapshot stands for them
    "spark.sql.streaming.stateStore.maintenanceInterval": "15s",
}


#: A query starts again from the last batch; shuffles are deleted when their batch ends, and states that no recovery needs soon after.
_LEAN = {"spark.sql.streaming.minBatchesToRetain": "2", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def _stored(df: DataFrame):
    """The settings that the plan's states need, while its query starts."""
    plan = df._jdf.queryExecution().analyzed().toString()
    return Query(0, [], conf=_LEAN | (_ROCKS if "TransformWithState" in plan else {})).configured(df.sparkSession)


class Runtime:
    """Runs an application's sinks as streaming queries, each with its own folder below ``checkpoints``.

    Starting again with the same folder recovers: Spark replays what its offset log holds and doesn't
    commit again what its commit log holds, so a file sink gets every row exactly once.
    """

    def __init__(self, spark: SparkSession, app: Application, checkpoints: str, delay: str = "0 seconds", origin: int | None = None, every: str | None = None, packed: bool = False):
        self.spark, self.app, self.checkpoints = spark, app, checkpoints
        last = [q.operators[-1] for q in app.sinks()] if packed else ()
        self.using, self.every, self.running = lowering(delay, origin, last), every, []
        self.metrics = Metrics()
        spark.streams.addListener(self.metrics)

    def plans(self, inputs: dict[int, tuple[DataFrame, ...]]) -> dict[int, DataFrame]:
        return {k: df.drop(EVENT_TIME) for k, df in self.app.run(inputs, self.using).items()}

    def start(self, inputs: dict[int, tuple[DataFrame, ...]], sinks: dict[int, object]) -> list[StreamingQuery]:
        """``sinks`` has a function of (writer) to started query for every sink query, as in ``sources.sinks``.

        Without a trigger interval everything that is there is processed and the queries end.
        """
        by = {q.ident: q for q in self.app.queries}
        for ident, df in self.plans(inputs).items():
            writer = df.writeStream.queryName(f"q{ident}").outputMode("append").option("checkpointLocation", f"{self.checkpoints}/{ident}")
            writer = writer.trigger(processingTime=self.every) if self.every else writer.trigger(availableNow=True)
            with by[ident].configured(self.spark), _stored(df):
                self.running.append(sinks[ident](writer))
        return self.running

    def wait(self) -> None:
        for q in self.running:
            q.awaitTermination()

    def stop(self) -> None:
        for q in self.running:
            q.stop()
        self.running = []
        self.spark.streams.removeListener(self.metrics)
