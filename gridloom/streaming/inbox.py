"""The job queue as a stream: transitions, leases that run out, and bounded runs over what has arrived."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyarrow import fs
from pyspark import Accumulator
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def arrivals(spark: SparkSession, folder: str, schema: str | T.StructType, files_a_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, mode: str = "append") -> StreamingQuery:
    """A single writer over the stream: once over what has arrived, or each `every`; it resumes from its checkpoint."""
    writer = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def job_states(transitions: DataFrame, late: str = "1 hour") -> DataFrame:
    """(job_id, status, at, attempt) of each job: the newest of its transitions (job_id, status, at, seq); attempts are starts."""
    own = transitions.withWatermark("at", late) if transitions.isStreaming else transitions
    newest = F.max(F.struct("at", "seq", "status"))
    return own.groupBy("job_id").agg(newest["status"].alias("status"), newest["at"].alias("at"), F.count_if(F.col("status") == "running").alias("attempt"))


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """(start, key, n): events in tumbling windows; a stream drops what comes later than `late`."""
    own = events.withWatermark(time, late) if events.isStreaming else events
    return own.groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def drained(spark: SparkSession, folder: str, table: str, checkpoint: str, to_rows: Callable[[DataFrame], DataFrame], schema: str | T.StructType) -> DataFrame:
    """Everything that has arrived, through to_rows, appended to the table; batches that were written are not written again."""

    def each(batch: DataFrame, number: int) -> None:
        to_rows(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    start(arrivals(spark, folder, schema), each, checkpoint).awaitTermination()
    return spark.read.parquet(table)


def expired_leases(leases: DataFrame, seconds: int) -> DataFrame:
    """(job_id, last_beat, expired_at) of a stream of heartbeats (job_id, at), once none came for `seconds`; a session window holds each lease."""
    own = leases.withWatermark("at", "0 seconds") if leases.isStreaming else leases
    beat = own.groupBy("job_id", F.session_window("at", f"{seconds} seconds").alias("w")).agg(F.max("at").alias("last_beat"))
    return beat.select("job_id", "last_beat", F.col("w.end").alias("expired_at"))


def without_cancelled(batch: DataFrame, cancelled: DataFrame, key: str = "job_id") -> DataFrame:
    """A batch's rows whose job hasn't been cancelled by the time the batch starts."""
    return batch.join(cancelled.select(key).distinct(), key, "left_anti")


def at_path(path: str) -> tuple[fs.FileSystem, str]:
    """A path's store and its name there."""
    return fs.FileSystem.from_uri(path)


def exists(path: str) -> bool:
    """Whether a file or folder is there."""
    store, name = at_path(path)
    return store.get_file_info(name).type != fs.FileType.NotFound


def write_status(path: str, state: str, **more: str | int | None) -> None:
    """A small JSON file with the state; one move puts it in place of the old one, so that a reader always finds a whole file."""
    store, name = at_path(path)
    with store.open_output_stream(f"{name}.new") as out:
        out.write(json.dumps({"state": state, "updated_at": datetime.now(UTC).isoformat(), **more}, sort_keys=True).encode())
    store.move(f"{name}.new", name)


class Drained(Exception):
    """Raised in place of a batch that would begin after a worker was asked to stop."""


class Gate:
    """What a stream does with each batch, as long as nobody has asked it to stop.

    close() waits for the batch that runs. A batch that would begin later fails
    before it has done anything, so it isn't committed, and the next run has it.
    """

    def __init__(self, each: Callable[[DataFrame, int], None]) -> None:
        self.each, self.running, self.closed, self.batch = each, threading.Lock(), False, None

    def __call__(self, batch: DataFrame, number: int) -> None:
        with self.running:
            if self.closed:
                raise Drained(f"batch {number} is left to the next run")
            self.batch = number
            self.each(batch, number)

    def close(self) -> None:
        with self.running:
            self.closed = True


class Rows(StreamingQueryListener):
    """Batches and input rows of one query, as its progress reports have them."""

    def __init__(self, query: StreamingQuery) -> None:
        self.id, self.batch, self.rows = query.id, None, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if str(event.progress.id) == self.id:
            self.batch, self.rows = event.progress.batchId, self.rows + event.progress.numInputRows

    def onQueryTerminated(self, event) -> None:
        pass


def run_until_asked(query: StreamingQuery, gate: Gate, drain: str, status: str | None = None, poll: float = 1.0, done: Accumulator | None = None) -> None:
    """Lets a stream run until it ends or a file `drain` appears, then stops it after the batch that runs, however much has arrived.

    `status` is a file with the state (running, draining, stopped, failed), the last batch,
    the rows of finished batches, and what `done` has counted, also while a batch runs.
    """
    spark, rows, told = SparkSession.active(), Rows(query), None
    spark.streams.addListener(rows)

    def tell(state: str) -> None:
        nonlocal told
        now = (state, gate.batch, rows.rows, None if done is None else done.value)
        if status and now != told:
            write_status(status, state, batch=gate.batch, rows=rows.rows, done=now[3])
            told = now

    try:
        while query.isActive and not exists(drain):
            tell("running")
            time.sleep(poll)
        if query.isActive:
            tell("draining")
            gate.close()
            # a batch is done once the stream has committed it, which comes after the gate's work
            while query.isActive and gate.batch is not None and (query.lastProgress or {"batchId": -1})["batchId"] < gate.batch:
                time.sleep(poll)
            query.stop()
        try:
            query.awaitTermination()
        except StreamingQueryException as error:
            if not gate.closed or Drained.__name__ not in str(error):
                tell("failed")
                raise
        tell("stopped")
    finally:
        spark.streams.removeListener(rows)


@contextmanager
def counting(done: Accumulator, total: int, tell: Callable[[int, int], None], poll: float = 0.5) -> Iterator[None]:
    """Tells (done, total) whenever tasks have counted on, while a batch or any other action runs within, and once at its end.

    Tasks that run again count again, so what is told is held at the total.
    """
    over, last = threading.Event(), [None]

    def look() -> None:
        if (now := min(done.value, total)) != last[0]:
            last[0] = now
            tell(now, total)

    def watch() -> None:
        while not over.wait(poll):
            look()

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    finally:
        over.set()
        watcher.join()
        look()


def run_until_drained(query: StreamingQuery, drain: str, status: str | None = None, poll: float = 1.0, patience: float = 600.0) -> None:
    """Lets a stream run until it ends or a file `drain` appears; then it takes what has arrived, for `patience` seconds at most, and stops. `status` says which."""

    def tell(state: str) -> None:
        if status:
            write_status(status, state, batch=(query.lastProgress or {}).get("batchId"))

    tell("running")
    while query.isActive and not exists(drain):
        time.sleep(poll)
    if query.isActive:
        tell("draining")
        taking = threading.Thread(target=query.processAllAvailable, daemon=True)
        taking.start()
        taking.join(patience)
        query.stop()
    query.awaitTermination()
    tell("stopped")
