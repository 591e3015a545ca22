"""Jobs as keyed state: transitions fold into one state for each job, and a silent job's lease ends by a timer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .inbox import start

#: A sign of life: prolongs the lease of a running job and changes nothing else.
BEAT = "beat"
STATE = "status string, at long, seq long, attempt long, version long, timer long"
CHANGES = {"status": "string", "at": "long", "seq": "long", "attempt": "long", "version": "long", "expired": "boolean"}
CHANGE = Row("job_id", *CHANGES)
LEAST = -1 << 63
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class JobFold(StatefulProcessor):
    """The newest transition of a job by (at, seq), how often it was started, and a timer while it runs, from rows of met().

    Each call gives one row: the state after it. `version` counts a job's rows.
    Rows, not frames, pass in and out: a frame for each job costs more than its fold.
    """

    def __init__(self, lease_ms: int) -> None:
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # a job that is new has no state, which get() says as well as exists()
        status, at, seq, attempt, version, timer = self.job.get() or (None, None, None, 0, 0, None)
        for row in rows:
            attempt += row.attempts
            # a missing time comes before any other; beats have no status
            when = (LEAST if row.at is None else row.at, row.seq)
            if row.status is not None and (status is None or when > (at, seq)):
                status, (at, seq) = row.status, when
        timer = self.leased(status, timer, timerValues)
        yield self.put(key, status, at, seq, attempt, version + 1, timer, False)

    def leased(self, status: str | None, timer: int | None, timerValues) -> int | None:
        """The time of the job's timer after a batch: anew while it runs, none otherwise."""
        if timer is not None:
            self.handle.deleteTimer(timer)
        if status != "running":
            return None
        timer = timerValues.getCurrentProcessingTimeInMs() + self.lease_ms
        self.handle.registerTimer(timer)
        return timer

    def put(self, key, status, at, seq, attempt, version, timer, expired) -> Row:
        self.job.update((status, at, seq, attempt, version, timer))
        return CHANGE(*key, status, at, seq, attempt, version, expired)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, at, seq, attempt, version, timer = self.job.get()
        if status == "running" and timer == expiredTimerInfo.getExpiryTimeInMs():
            yield self.put(key, "queued", at, seq, attempt, version + 1, None, True)

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams that start within keep their state in RocksDB, as timers and state variables need it."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def newest_of_each(table: pa.Table) -> pa.Table:
    """The newest of each job's rows (job_id, at, seq, status, attempts), one without a status only if there is no other, with the sum of their attempts."""
    table = table.combine_chunks()
    jobs = table["job_id"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
    at, seq = (pc.fill_null(table[c], LEAST).to_numpy() for c in ("at", "seq"))
    order = np.lexsort((seq, at, table["status"].is_valid().to_numpy(), jobs))
    last = order[np.flatnonzero(np.diff(jobs[order], append=-1))]
    attempts = np.zeros(len(last), np.int64)
    np.add.at(attempts, jobs, table["attempts"].to_numpy())
    return table.take(pa.array(last)).set_column(4, "attempts", pa.array(attempts))


def met(rows: DataFrame, size: int = 1 << 20) -> DataFrame:
    """One row for each job of a batch, that of newest_of_each(): a job's rows meet in one task, which holds jobs and some `size` rows."""
    types = to_arrow_schema(rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, least = [], 0, size
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= least:
                held = newest_of_each(pa.Table.from_batches(held)).cast(types).to_batches()
                n = sum(map(len, held))
                least = n + size
        if n:
            yield from newest_of_each(pa.Table.from_batches(held)).cast(types).to_batches(max_chunksize=10_000)

    return rows.repartition("job_id").mapInArrow(run, rows.schema)


def job_changes(transitions: DataFrame, lease_seconds: float | None = None) -> DataFrame:
    """(job_id, status, at, seq, attempt, version, expired): the state of each job that a batch of transitions (job_id, status, at, seq) touches.

    Transitions may come in any order and in any batches: the newest by (at, seq)
    decides, and attempts are counted starts. With lease_seconds, a running
    job of which nothing comes for so long, by the clock of the stream, is
    queued again, whether or not other jobs are heard of.
    """
    own = F.when(F.col("status") != BEAT, F.col("status"))
    started = (F.col("status") == "running").cast("long")
    rows = met(transitions.select("job_id", F.unix_micros("at").alias("at"), F.col("seq").cast("long").alias("seq"), own.alias("status"), F.coalesce(started, F.lit(0).cast("long")).alias("attempts")))
    if lease_seconds is None:
        # no timers: the state is that of an aggregation
        newest = F.max(F.when(F.col("status").isNotNull(), F.struct("at", "seq", "status")))
        state = rows.groupBy("job_id").agg(newest.alias("r"), F.sum("attempts").alias("attempt"), F.count("*").alias("version"))
        return state.select("job_id", "r.status", F.timestamp_micros("r.at").alias("at"), "r.seq", "attempt", "version", F.lit(False).alias("expired"))
    out = T.StructType([rows.schema["job_id"]])
    for name, kind in CHANGES.items():
        out.add(name, kind)
    changes = rows.groupBy("job_id").transformWithState(JobFold(int(lease_seconds * 1000)), out, "Update", "ProcessingTime")
    return changes.withColumn("at", F.when(F.col("at") > -(1 << 62), F.timestamp_micros("at")))


def appending(table: str) -> Callable[[DataFrame, int], None]:
    """What a stream does with a batch: it becomes a folder of the table, and takes its own place if it runs again."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return each


def keep_states(transitions: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, lease_seconds: float | None = None, every: str | None = None) -> StreamingQuery:
    """A stream of job_changes(). Leases need a stream that goes on, `every` so often, since their timers run when nothing arrives."""
    if lease_seconds is not None and not every:
        raise ValueError("leases end by the clock: say how often to look, as in every='30 seconds'")
    with keyed_state(transitions.sparkSession):
        return start(job_changes(transitions, lease_seconds), each, checkpoint, every, "update")


def newest_states(changes: DataFrame) -> DataFrame:
    """(job_id, status, at, attempt) of each job: its last change."""
    last = F.max_by(F.struct("status", "at", "attempt"), "version")
    return changes.groupBy("job_id").agg(last.alias("last")).select("job_id", "last.*")
