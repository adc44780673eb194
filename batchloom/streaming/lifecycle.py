"""Job lifecycle in batch: legal changes of state, recovery and last states (``streaming.live`` has the streams)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.session import ship

# Which state may follow which.
TRANSITIONS = {
    "pending": ["ocr_running", "error", "cancelling", "archived"],
    "ocr_running": ["ocr_done", "error", "cancelling"],
    "ocr_done": ["analyzing", "error", "cancelling"],
    "analyzing": ["review", "partial_review", "error", "cancelling"],
    "cancelling": ["cancelled", "error"],
    "review": ["pending", "archived"],
    "partial_review": ["pending", "archived"],
    "error": ["pending", "archived"],
    "cancelled": ["pending", "archived"],
    "archived": ["review"],
}
UNFINISHED = ["pending", "ocr_running", "ocr_done", "analyzing", "cancelling"]


def allowed(current: Column, new: Column) -> Column:
    edges = F.create_map(*[x for a, to in TRANSITIONS.items() for x in (F.lit(a), F.array(*map(F.lit, to)))])
    return F.coalesce(F.array_contains(F.element_at(edges, current), new), F.lit(False))


REPLAYED = "job_id {}, seq bigint, current string, new string, accepted boolean"


def replay(attempts: DataFrame, start: str = "pending") -> DataFrame:
    """``job_id, seq, current, new, accepted`` of every attempt (``job_id, seq, new``), refused ones included: a refused
    attempt leaves the state as it was, so a job's attempts are folded in order. Rows are dealt by job and sorted, and a task
    walks them once with one state in hand, however many attempts a job has."""
    ship(attempts.sparkSession)
    kind = attempts.schema["job_id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, now = object(), start
        for batch in batches:
            before, fine = [], []
            for one, new in zip(batch.column("job_id").to_pylist(), batch.column("new").to_pylist(), strict=True):
                job, now = one, now if one == job else start
                before.append(now)
                fine.append(new in TRANSITIONS.get(now, ()))
                now = new if fine[-1] else now
            yield pa.RecordBatch.from_arrays([batch.column("job_id"), batch.column("seq"), pa.array(before, pa.string()), batch.column("new"), pa.array(fine, pa.bool_())], ["job_id", "seq", "current", "new", "accepted"])

    rows = attempts.select("job_id", F.col("seq").cast("bigint").alias("seq"), F.col("new").cast("string").alias("new"))
    return rows.repartition("job_id").sortWithinPartitions("job_id", "seq", "new").mapInArrow(fold, REPLAYED.format(kind))


#: Jobs of a site that may be active at once.
MOST_ACTIVE = 3


def admitted(requests: DataFrame, most: int = MOST_ACTIVE) -> DataFrame:
    """``site, job_id, at, ends_at, active, accepted`` of every request: a site takes a job while fewer than ``most`` of those it
    took before are active (from ``at`` until ``ends_at``, null: without end); ``active`` is how many it met.

    Whether a job counts depends on whether it was taken, so a site's requests are walked in order (ties by job) with the ends
    of its active jobs in hand, at most ``most``.
    """
    ship(requests.sparkSession)
    names = ["site", "job_id", "at", "ends_at"]
    schema = ", ".join(f"{n} {requests.schema[n].dataType.simpleString()}" for n in names) + ", active int, accepted boolean"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        site, ends = object(), []
        for batch in batches:
            met, fine = [], []
            for one, at, end in zip(*(batch.column(c).to_pylist() for c in ("site", "at", "ends_at")), strict=True):
                site, ends = one, [x for x in ends if one == site and (x is None or x > at)]
                met.append(len(ends))
                fine.append(len(ends) < most)
                if fine[-1] and (end is None or end > at):
                    ends.append(end)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(met, pa.int32()), pa.array(fine, pa.bool_())], [*names, "active", "accepted"])

    return requests.select(*names).filter("at IS NOT NULL").repartition("site").sortWithinPartitions("site", "at", "job_id").mapInArrow(fold, schema)


def recovered(jobs: DataFrame, started_at: Column) -> DataFrame:
    """Jobs after a restart: unfinished ones from before it end in error."""
    stuck = F.col("status").isin(UNFINISHED) & (F.col("created_at") < started_at)
    return jobs.withColumn("status", F.when(stuck, "error").otherwise(F.col("status"))).withColumn("finished_at", F.when(stuck, started_at).otherwise(F.col("finished_at")))


def latest(events: DataFrame) -> DataFrame:
    """The last state of each job in an event log (``job_id, seq, status``); also over a stream in complete mode."""
    return events.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))
