"""Job streams: progress snapshots, the list of live jobs with its ten minutes of grace, and the state machine over attempts.

Events are rows ``job_id, seq, at, kind, status, page, total_pages``; of a job's status events the one with the highest ``seq``
holds, whatever order they arrive in. Progress is a streaming aggregation. The live list and the state machine keep their own
state (RocksDB, see ``keep_state``) and use event time, so that what they emit follows from the events alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from batchloom.operators.reads import ACTIVE
from batchloom.session import ship
from batchloom.streaming.lifecycle import TRANSITIONS

EVENTS = "job_id string, seq bigint, at timestamp, kind string, status string, page int, total_pages int"
#: How long a job that has ended stays in the live list, and how often streams look for events.
GRACE_MINUTES = 10
TRIGGER = "3 seconds"
TERMINAL = ["review", "partial_review", "error", "cancelled", "archived"]
LIVE = "job_id string, live boolean, status string, seq bigint, at timestamp"
ATTEMPTS = "job_id string, seq bigint, current string, new string, accepted boolean, action string, detail string"
MADE = "job_id string, seq array<bigint>, current array<string>, new array<string>, accepted array<boolean>"


def keep_state(spark: SparkSession) -> None:
    """State in RocksDB, on the executors' disks with change logs in the checkpoint: operators with their own state need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def phase(status: Column, analyzed: Column, total: Column) -> Column:
    """What a job is doing: analysis of pages and of the whole record are told apart by the number of pages done."""
    return (
        F.when(status == "ocr_running", "ocr")
        .when(status == "analyzing", F.when((total > 0) & (analyzed >= total), "cross").otherwise("analyze"))
        .when(status.isin(TERMINAL), "done")
        .otherwise("idle")
    )


def progress(events: DataFrame) -> DataFrame:
    """A job's snapshot from its events: ``job_id, seq, status, total_pages, pages_read, pages_analyzed, findings, phase, done``.
    The same over a table and, in update mode, over a stream (a page counts once, however often it is told)."""
    pages = lambda kind: F.size(F.collect_set(F.when(F.col("kind") == kind, F.col("page")))).cast("bigint")
    at = F.when(F.col("kind") == "status", F.col("seq"))
    told = events.groupBy("job_id").agg(
        F.max("seq").alias("seq"), F.max_by("status", at).alias("status"), F.coalesce(F.max("total_pages"), F.lit(0)).alias("total_pages"),
        pages("page_read").alias("pages_read"), pages("page_analyzed").alias("pages_analyzed"), F.count_if(F.col("kind") == "finding").alias("findings"),
    )
    now = F.coalesce("status", F.lit("pending"))
    told = told.withColumn("status", now)
    return told.withColumn("phase", phase(F.col("status"), F.col("pages_analyzed"), F.col("total_pages"))).withColumn("done", F.col("status").isin(TERMINAL))


def progress_stream(events: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start a query that hands the changed snapshots of every trigger to ``send``; ``once``: of what is there, and end."""
    start = progress(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(send)
    return (start.trigger(availableNow=True) if once else start.trigger(processingTime=TRIGGER)).start()


def live_at(events: DataFrame, now: Column) -> DataFrame:
    """``job_id, status, seq, at`` of the jobs that the live list shows at a time: active ones, and those that ended within the
    minutes of grace before it and are not archived."""
    last = events.filter("kind = 'status'").groupBy("job_id").agg(F.max_by(F.struct("status", "seq", "at"), "seq").alias("x")).select("job_id", "x.*")
    recent = ~F.col("status").isin(ACTIVE) & (F.col("status") != "archived") & (F.col("at") + F.expr(f"INTERVAL {GRACE_MINUTES} MINUTES") > now)
    return last.filter(F.col("status").isin(ACTIVE) | recent)


class _Live(StatefulProcessor):
    """Last status of a job; a timer takes an ended one off the list."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, seq bigint, at timestamp")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get()
        told = pd.concat(list(rows)).sort_values("seq").iloc[-1]
        if before is not None and before[1] >= told["seq"]:
            return
        status, at = told["status"], told["at"].to_pydatetime()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((status, int(told["seq"]), at))
        shown = status in ACTIVE
        if not shown and status != "archived":
            ends = int(told["at"].timestamp() * 1000) + GRACE_MINUTES * 60_000
            shown = ends > timerValues.getCurrentWatermarkInMs()
            if shown:
                self.handle.registerTimer(ends)
        yield self.row(key, shown)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.row(key, False)

    def row(self, key: tuple, shown: bool) -> pd.DataFrame:
        status, seq, at = self.last.get()
        return pd.DataFrame({"job_id": [key[0]], "live": [shown], "status": [status], "seq": [seq], "at": [pd.Timestamp(at)]})

    def close(self) -> None:
        pass


def live_stream(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """``job_id, live, status, seq, at`` whenever a job's place in the live list changes: it has a new status, or its minutes of
    grace are over by the events' own clock, which runs ``late`` behind them. The last row of a job says how it stands."""
    keep_state(events.sparkSession)
    ship(events.sparkSession)
    told = events.filter("kind = 'status'").select("job_id", "seq", "at", "status").withWatermark("at", late)
    return told.groupBy("job_id").transformWithStateInPandas(_Live(), LIVE, "Update", "EventTime")


class _Attempts(StatefulProcessor):
    """A job's state, the next attempt's number, the attempts that came too early and when their wait ends: one value, since each
    call for state is a round trip to the JVM. What a call makes is one row of lists, which the plan spreads."""

    def __init__(self, start: str, wait_ms: int):
        self.start, self.wait_ms = start, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "state string, due bigint, seqs array<bigint>, news array<string>, timer bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, due, seqs, news, timer = self.job.get() or (self.start, 1, [], [], None)
        told, latest = dict(zip(seqs, news, strict=True)), None
        for row in rows:
            told.setdefault(row.seq, row.new)
            latest = row.at if latest is None or row.at > latest else latest
        return iter(self.fold(key, now, due, told, timer, lambda: max(int(latest.timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.wait_ms))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, due, seqs, news, _ = self.job.get()
        return iter(self.fold(key, now, due, dict(zip(seqs, news, strict=True)), None))

    def fold(self, key: tuple, now: str, due: int, told: dict[int, str], timer: int | None, until: Callable[[], int] | None = None) -> list[Row]:
        """Attempts in order, up to the first gap (``until``: how long the others wait; without it, over the gaps). One that was
        told before is nothing."""
        out, wait = [], []
        for seq in sorted(told):
            if seq < due:
                continue
            if seq > due and until:
                wait.append(seq)
                continue
            new, ok = told[seq], told[seq] in TRANSITIONS.get(now, ())
            out.append((seq, now, new, ok))
            now, due = new if ok else now, seq + 1
        if wait and timer is None:
            timer = until()
            self.handle.registerTimer(timer)
        elif not wait and timer is not None:
            self.handle.deleteTimer(timer)
            timer = None
        self.job.update((now, due, wait, [told[seq] for seq in wait], timer))
        return [Row(job_id=key[0], **dict(zip(("seq", "current", "new", "accepted"), map(list, zip(*out, strict=True)), strict=True)))] if out else []

    def close(self) -> None:
        pass


def attempts_stream(attempts: DataFrame, start: str = "pending", wait: int = 60, late: str = "1 minute") -> DataFrame:
    """``lifecycle.replay`` over a stream ``job_id, seq, at, new`` whose attempts may come in any order and again: each with the
    audit row it makes. Attempts of a job count from 1; those behind a gap wait until it is filled, or until the events' clock
    is ``wait`` seconds further; one that comes after that, or with a time that lies ``late`` behind the clock, is ignored."""
    keep_state(attempts.sparkSession)
    ship(attempts.sparkSession)
    told = attempts.select("job_id", "seq", "at", "new").withWatermark("at", late)
    made = told.groupBy("job_id").transformWithState(_Attempts(start, wait * 1000), MADE, "Append", "EventTime")
    rows = made.select("job_id", F.inline(F.arrays_zip("seq", "current", "new", "accepted")))
    legal = F.create_map(*[F.lit(x) for state, to in TRANSITIONS.items() for x in (state, ", ".join(sorted(to)))])
    said = F.concat("current", F.lit(" → "), F.coalesce("new", F.lit("None")))
    blocked = F.concat(said, F.lit(" (allowed: "), F.coalesce(F.element_at(legal, F.col("current")), F.lit("")), F.lit(")"))
    action = F.when(F.col("accepted"), "status_transition").otherwise("status_transition_blocked")
    return rows.withColumn("action", action).withColumn("detail", F.when(F.col("accepted"), said).otherwise(blocked))
