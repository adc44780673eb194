"""Streams and keyed writes over the driver's tables: each runs as a streaming query or a run of writes to its end, and returns
what it left behind."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.plans.base import ORACLES, Tables, query
from batchloom.session import shared_dir
from batchloom.sources.page_table import add_pages, read_pages, update_pages
from batchloom.streaming import live
from batchloom.streaming.lifecycle import admitted

#: Users as jobs: what an event tells about one. Both dialects read this statement.
_EVENTS = """SELECT CAST(user_id AS {text}) AS job_id, CAST(event_id AS bigint) AS seq, ts AS at, CASE event_type WHEN 'view' THEN 'page_read' WHEN 'click' THEN 'page_analyzed' WHEN 'error' THEN 'finding' ELSE 'status' END AS kind,
  CASE WHEN event_type = 'purchase' THEN CASE event_id % 5 WHEN 0 THEN 'review' WHEN 1 THEN 'error' WHEN 2 THEN 'archived' ELSE 'analyzing' END WHEN event_type = 'signup' THEN 'ocr_running' END AS status,
  CAST(event_id % 9 AS int) AS page, CASE WHEN event_type = 'signup' THEN CAST(user_id % 11 AS int) END AS total_pages FROM {events}"""
_D_EVENTS = _EVENTS.format(text="varchar", events="events")
_D_PROGRESS = f"""WITH e AS ({_D_EVENTS}), p AS (SELECT job_id, max(seq) AS seq, coalesce(arg_max(status, seq) FILTER (WHERE kind = 'status'), 'pending') AS status, coalesce(max(total_pages), 0) AS total_pages,
  count(DISTINCT page) FILTER (WHERE kind = 'page_read') AS pages_read, count(DISTINCT page) FILTER (WHERE kind = 'page_analyzed') AS pages_analyzed, count(*) FILTER (WHERE kind = 'finding') AS findings FROM e GROUP BY job_id)
SELECT *, CASE status WHEN 'ocr_running' THEN 'ocr' WHEN 'analyzing' THEN CASE WHEN total_pages > 0 AND pages_analyzed >= total_pages THEN 'cross' ELSE 'analyze' END WHEN 'pending' THEN 'idle' ELSE 'done' END AS phase,
  status IN ('review', 'partial_review', 'error', 'cancelled', 'archived') AS done FROM p"""


def _events(t: Tables) -> DataFrame:
    return t.sql(_EVENTS.format(text="string", events="{events}"))


def _stream(t: Tables, name: str) -> DataFrame:
    """A table as a stream of its files."""
    table = getattr(t, name)
    return t.spark.readStream.schema(table.schema).parquet(f"{t.folder}/{name}.parquet*")


def _fresh(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/streams/{name}-{uuid.uuid4().hex}"


def _finished(start, path: str) -> None:
    """Run a stream over what is there, to its end."""
    ran = start.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    ran.awaitTermination()


@query("st1_progress", _D_PROGRESS)
def st1(t: Tables) -> DataFrame:
    return live.progress(_events(t))


@query("st1_progress_stream", ORACLES["st1_progress"])
def st1_stream(t: Tables) -> DataFrame:
    told = t.spark.createDataFrame([], live.EVENTS)
    path, stream = _fresh(t, "progress"), _stream(t, "events")
    names = ["user_id", "event_id", "ts", "event_type"]
    events = t.spark.sql(_EVENTS.format(text="string", events="{events}"), events=stream.select(*names)).select(*told.columns)
    live.progress_stream(events, lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("append").parquet(f"{path}/out"), f"{path}/checkpoint", once=True).awaitTermination()
    rows = t.spark.read.schema(live.progress(told).withColumn("batch", F.lit(0).cast("bigint")).schema).parquet(f"{path}/out")
    last = rows.groupBy("job_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "job_id"]), "batch").alias("x"))
    return last.select("job_id", "x.*").drop("batch")


@query("st2_live_stream", f"""WITH e AS ({_D_EVENTS}), c AS (SELECT max("at") - INTERVAL 1 MINUTE AS now FROM e WHERE kind = 'status'), l AS (SELECT job_id, arg_max(status, seq) AS status, max(seq) AS seq, arg_max("at", seq) AS ended FROM e WHERE kind = 'status' GROUP BY job_id)
SELECT job_id, status, seq FROM l, c WHERE status IN ('ocr_running', 'analyzing') OR status <> 'archived' AND ended + INTERVAL {live.GRACE_MINUTES} MINUTES > epoch_ms((epoch_us(now) // 1000)::BIGINT)""")
def st2(t: Tables) -> DataFrame:
    path, stream = _fresh(t, "live"), _stream(t, "events")
    events = t.spark.sql(_EVENTS.format(text="string", events="{events}"), events=stream.withColumn("ts", F.col("ts").cast("timestamp")))
    rows = live.live_stream(events).writeStream.outputMode("update").foreachBatch(lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("append").parquet(f"{path}/out"))
    kept = t.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        _finished(rows, path)
    finally:
        t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    told = t.spark.read.schema(live.LIVE + ", batch bigint").parquet(f"{path}/out")
    last = told.groupBy("job_id").agg(F.max_by(F.struct("live", "status", "seq"), "batch").alias("x"))
    return last.filter("x.live").select("job_id", "x.status", "x.seq")


@query("st5_attempts_stream", ORACLES["st5_transitions"].replace("SELECT user_id AS job_id, seq, cur AS current", "SELECT user_id::VARCHAR AS job_id, seq, cur AS current"))
def st5_stream(t: Tables) -> DataFrame:
    # attempts are numbered beforehand; the stream gets them in files dealt by their number, so each file has gaps
    new = F.expr("CASE event_type WHEN 'view' THEN 'ocr_running' WHEN 'click' THEN 'ocr_done' WHEN 'purchase' THEN 'error' WHEN 'error' THEN 'pending' ELSE 'analyzing' END")
    rows = t.sql("SELECT CAST(user_id AS string) AS job_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS bigint) AS seq, CAST(timestamp_ntz '2024-01-01 00:00:00' AS timestamp) AS at, event_type FROM {events}").withColumn("new", new).drop("event_type")
    path = _fresh(t, "attempts")
    rows.repartition(3, F.col("seq") % 3).write.parquet(f"{path}/in")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    kept = t.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        _finished(live.attempts_stream(stream).writeStream.format("parquet").option("path", f"{path}/out").outputMode("append"), path)
    finally:
        t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    return t.spark.read.schema(live.ATTEMPTS).parquet(f"{path}/out").select("job_id", "seq", "current", "new", "accepted")


@query("s11_page_upsert", """WITH k AS (SELECT user_id AS j, event_id % 7 AS p, * FROM events), a AS (SELECT j, p, min(event_type || '/' || value) AS raw FROM k WHERE event_type = 'click' GROUP BY ALL),
b AS (SELECT j, p, min(event_type || '/' || value) AS raw FROM k WHERE event_type IN ('view', 'error') GROUP BY ALL), u AS (SELECT j, p, arg_max(props, event_id) AS props FROM k WHERE event_type = 'purchase' GROUP BY ALL),
t AS (SELECT * FROM a UNION ALL SELECT * FROM b ANTI JOIN a USING (j, p))
SELECT t.j::VARCHAR AS job_id, t.p::INT AS page, t.raw AS raw_html, u.props AS structured_json FROM t LEFT JOIN u USING (j, p)""")
def s11(t: Tables) -> DataFrame:
    path = _fresh(t, "pages")
    rows = t.events.select(F.col("user_id").cast("string").alias("job_id"), (F.col("event_id") % 7).cast("int").alias("page"), F.concat("event_type", F.lit("/"), F.col("value").cast("string")).alias("raw_html"), F.col("props").alias("structured_json"), "event_id", "event_type")
    pages, said = rows.drop("structured_json"), rows.drop("raw_html").filter("event_type = 'purchase'")
    add_pages(pages.filter("event_type = 'click'"), path)
    add_pages(pages.filter("event_type IN ('view', 'error')"), path)  # late pages, and known ones with another text
    update_pages(said, path, "event_id")
    add_pages(pages.filter("event_type = 'click'"), path)  # again
    return read_pages(t.spark, path).drop("bucket")


@query("adm_admission", """WITH RECURSIVE q AS (SELECT user_id % 13 AS site, event_id, ts, ts + INTERVAL 1 HOUR * (event_id % 7) AS ends, row_number() OVER (PARTITION BY user_id % 13 ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT site, 0::BIGINT AS k, 0::BIGINT AS event_id, []::TIMESTAMP[] AS open, 0 AS active, false AS ok FROM (SELECT DISTINCT site FROM q) UNION ALL
  SELECT q.site, q.k, q.event_id, CASE WHEN len(list_filter(r.open, lambda x: x > q.ts)) < 3 AND q.ends > q.ts THEN list_append(list_filter(r.open, lambda x: x > q.ts), q.ends) ELSE list_filter(r.open, lambda x: x > q.ts) END,
    len(list_filter(r.open, lambda x: x > q.ts))::INT, len(list_filter(r.open, lambda x: x > q.ts)) < 3 FROM r JOIN q ON q.site = r.site AND q.k = r.k + 1)
SELECT site, event_id AS job_id, active, ok AS accepted FROM r WHERE k > 0""")
def admission(t: Tables) -> DataFrame:
    rows = t.events.select((F.col("user_id") % 13).alias("site"), F.col("event_id").alias("job_id"), F.col("ts").alias("at"), (F.col("ts") + F.expr("make_dt_interval(0, event_id % 7)")).alias("ends_at"))
    return admitted(rows).select("site", "job_id", "active", "accepted")
