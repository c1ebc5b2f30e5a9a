"""Draining a queue of paths with Structured Streaming.

A queue is a folder to which files with paths are added (JSON lines with ``path``). ``once`` takes what is there and ends, like a drain that
stops when the queue is empty; otherwise it goes on until stopped or until a sentinel path comes. The checkpoint
remembers what was taken, and sinks are idempotent by batch, so every path takes effect once however often a batch is repeated.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.status import FINAL
from ..operators.reports import latest


def queue_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None, schema: str = "path string") -> DataFrame:
    """Paths as they are added; ``files_per_batch`` bounds how much a batch takes on."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def offer(paths: DataFrame, folder: str, each: bool = False) -> None:
    """Adds paths to the queue; with ``each``, every path in a file of its own, so that any number can be drained."""
    paths.select("path").write.option("maxRecordsPerFile", 1 if each else 0).mode("append").json(folder)


def drain(paths: DataFrame, consume: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, interval: str = "5 seconds", sentinel: str | None = None) -> StreamingQuery:
    """Calls ``consume(batch of distinct paths, number)``. With a sentinel, the stream stops after the batch that holds it; paths of that batch are still consumed."""
    holder: dict[str, StreamingQuery] = {}
    started = threading.Event()

    def each(batch: DataFrame, number: int) -> None:
        last = sentinel is not None and not batch.where(F.col("path") == sentinel).isEmpty()
        consume((batch if sentinel is None else batch.where(F.col("path") != sentinel)).dropDuplicates(["path"]), number)
        if last:
            # the first batch may be over before ``start`` has returned the query
            threading.Thread(target=lambda: (started.wait(), holder["query"].stop()), daemon=True).start()

    writer = paths.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
    holder["query"] = query
    started.set()
    return query


def take(spark: SparkSession, folder: str, n: int | None = None) -> DataFrame:
    """The first ``n`` waiting paths of a queue, in order, or all, without taking them away; the first one for 1."""
    paths = spark.read.schema("path string").json(folder).distinct()
    return paths if n is None else paths.orderBy("path").limit(n)


def drain_some(spark: SparkSession, folder: str, checkpoint: str, consume: Callable[[DataFrame, int], None], n: int) -> StreamingQuery:
    """Drains at most ``n`` files of the queue in one go and stops; the checkpoint remembers where to go on. ``offer`` with ``each=True`` makes a file a path."""
    reader = spark.readStream.schema("path string").option("maxFilesPerTrigger", n)
    writer = reader.json(folder).writeStream.foreachBatch(lambda batch, number: consume(batch.dropDuplicates(["path"]), number)).option("checkpointLocation", checkpoint)
    query = writer.trigger(processingTime="1 day").start()
    while query.isActive and (query.status["isTriggerActive"] or not query.status["message"].startswith("Waiting for next trigger")):
        time.sleep(0.05)
    if query.exception():
        raise query.exception()
    query.stop()
    return query


def resume_stream(paths: DataFrame, reports: DataFrame) -> DataFrame:
    """A stream of paths without those that a table of reports has settled."""
    return paths.join(reports.where(F.col("code").isin(*FINAL)).select("path"), "path", "left_anti")


def latest_reports(reports: DataFrame, checkpoint: str, out: str, order: tuple[str, ...] = ("ts",)) -> StreamingQuery:
    """The last report of each path of a stream (path, code, ts, ...) in ``order``, written in full to ``out``/<batch> at each batch."""
    best = latest(reports, "path", order)
    return best.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Heartbeat(StreamingQueryListener):
    """Keeps the last progress of each query and passes it on."""

    def __init__(self, listener: Callable[[str, int, float], None] | None = None) -> None:
        self.last: dict[str, tuple[int, float]] = {}
        self.rows: dict[str, int] = {}
        self.ended: set[str] = set()
        self.listener = listener

    def onQueryStarted(self, event) -> None:
        self.rows[str(event.id)] = 0

    def onQueryProgress(self, event) -> None:
        p = event.progress
        key = str(p.id)
        self.last[key] = (p.numInputRows, p.processedRowsPerSecond or 0.0)
        self.rows[key] = self.rows.get(key, 0) + p.numInputRows
        if self.listener:
            self.listener(key, self.rows[key], self.last[key][1])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))
