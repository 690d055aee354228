"""Job states that follow a stream of events, and a log's broken entries in sliding windows."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelspark.operators.corrections import shape_of

#: From each status the ones that may follow; a job begins with queued, and a failed one may be queued again.
MOVES = {None: {"queued"}, "queued": {"processing", "cancelled"}, "processing": {"completed", "failed", "cancelled"}, "failed": {"queued"}, "completed": set(), "cancelled": set()}
STALE = "2 days"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MOVED = "id long, before string, status string, at timestamp, legal boolean, cause string"


class JobStates(StatefulProcessor):
    """Keeps a job's status: an event that may follow it moves it, another one is reported; a job that stays in processing too long fails.

    The store is asked for a job once and told once; only a job that was in processing has a timer to be taken back.
    """

    def __init__(self, stale_ms: int):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, since long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.job.get()
        status, since = held if held is not None else (None, 0)
        timer = since + self.stale_ms if status == "processing" else None
        out = []
        # nulls come last
        for r in sorted(rows, key=lambda r: (r.at is None, r.at or datetime.min, r.seq is None, r.seq or 0)):
            legal = r.status in MOVES.get(status, set())
            out.append(Row(id=key[0], before=status, status=r.status, at=r.at, legal=legal, cause="event"))
            if legal:
                status, since = r.status, _milliseconds(r.at)
        if status is not None and (status, since) != held:
            self.job.update((status, since))
        due = since + self.stale_ms if status == "processing" else None
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        self.job.update(("failed", due))
        at = datetime.fromtimestamp(due // 1000) + timedelta(milliseconds=due % 1000)
        yield Row(id=key[0], before="processing", status="failed", at=at, legal=True, cause="stale")

    def close(self) -> None:
        pass


def _milliseconds(at: datetime) -> int:
    return int(at.replace(microsecond=0).timestamp()) * 1000 + at.microsecond // 1000


def job_moves(events: DataFrame, late: str = "1 hour", stale: str = STALE) -> DataFrame:
    """A stream events(id, seq, status, at) -> id, before, status, at, legal, cause: what each event does to its job; state in RocksDB, a row a job.

    Events of a job are taken in the order of (at, seq) within a batch; a null id is a job as well.
    """
    spark = events.sparkSession
    spark.conf.set(PROVIDER, _ROCKS)
    ms = int(pd.Timedelta(stale).total_seconds() * 1000)
    timed = events.withWatermark("at", late).select(F.coalesce("id", F.lit(-1)).cast("long").alias("id"), "seq", "status", "at")
    return timed.groupBy("id").transformWithState(statefulProcessor=JobStates(ms), outputStructType=_MOVED, outputMode="Append", timeMode="EventTime")


def broken_entries(log: DataFrame, payload: Column, width: str = "30 minutes", slide: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """A stream log(at) -> start, broken, entries: in every window that slides along, how many payloads aren't lists."""
    shape = shape_of(payload)
    found = log.withColumn("_shape", shape).withWatermark("at", late).groupBy(F.window("at", width, slide)).agg(F.count(F.when(F.col("_shape") != "array", 1)).alias("broken"), F.count("*").alias("entries"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "broken", "entries")


def drained_with_state(spark: SparkSession, stream, mode: str = "append") -> DataFrame:
    """drained() for a stream with state of its own, whose store is set for this one alone."""
    from panelspark.streaming.ingest import drained

    before = spark.conf.get(PROVIDER, None)
    try:
        return drained(spark, stream(), mode)
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
