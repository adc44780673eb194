"""Notices of jobs that have ended: their text, signed payloads, and a stream's sink that hands each on once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from batchloom.functions.signing import hmac_sha256, within_bytes
from batchloom.operators.upkeep import notices
from batchloom.schema import SEVERITIES

KEYWORD = "batchloom"
#: Bytes of a payload, what its frame takes, and what is left for a cut text.
MOST_BYTES, FRAME, CUT = 20 * 1024, 256, 512
# States that are told, the words for them and for severities.
STATES = {"review": "分析完成，已生成报告", "partial_review": "部分完成（有失败页）", "error": "处理失败"}
SEVERITY_NAMES = {"critical": "严重", "warning": "警告", "info": "提示"}
ERROR_CHARS = 500


def notice_text(filename: Column, status: Column, total_pages: Column, counts: dict[str, Column], error: Column, keyword: str = KEYWORD) -> Column:
    """The message about a job: head, file, and pages with findings (``counts`` null: none known) or the error."""
    said = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    or_ = lambda c, other: F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(other)
    head = F.concat(F.lit(f"【{keyword}】批生产记录"), F.coalesce(F.try_element_at(said, status), status), F.lit("\n文件："), or_(filename, "(未知)"))
    found = F.concat(F.lit("\n发现："), F.concat_ws(" / ", *[F.concat(F.coalesce(counts[s], F.lit(0)).cast("string"), F.lit(" " + SEVERITY_NAMES[s])) for s in SEVERITIES]))
    known = F.coalesce(*[counts[s].isNotNull() for s in SEVERITIES][:1]) if counts else F.lit(False)
    pages = F.concat(F.lit("\n页数："), F.coalesce(total_pages, F.lit(0)).cast("string"), F.lit(" 页"), F.when(known, found).otherwise(""))
    text = F.concat(head, F.when(status == "error", F.concat(F.lit("\n错误："), or_(F.left(error, F.lit(ERROR_CHARS)), "(无详细信息)"))).otherwise(pages))
    return F.when(F.octet_length(text) > MOST_BYTES - FRAME, F.concat(within_bytes(text, MOST_BYTES - CUT), F.lit("…(截断)"))).otherwise(text)


def signature(secret: Column, seconds: Column) -> Column:
    """The sender's signature: the code of nothing under time and secret, in base 64."""
    return F.base64(hmac_sha256(F.concat(seconds.cast("string"), F.lit("\n"), secret).cast("binary"), F.lit("").cast("binary")))


def payload(text: Column, secret: Column | None = None, seconds: Column | None = None) -> Column:
    """The request's JSON; signed where there is a secret."""
    body = [F.lit("text").alias("msg_type"), F.struct(text.alias("text")).alias("content")]
    if secret is None:
        return F.to_json(F.struct(*body))
    signed = F.to_json(F.struct(seconds.cast("string").alias("timestamp"), signature(secret, seconds).alias("sign"), *body))
    return F.when(F.coalesce(secret, F.lit("")) != "", signed).otherwise(F.to_json(F.struct(*body)))


def due_notices(jobs: DataFrame, findings: DataFrame, sent: DataFrame, events: list[str] | None = None) -> DataFrame:
    """``job_id, status, text`` of the jobs (``id, status, filename, total_pages, error_message``) whose state is to be told and
    was not told before (``sent``: ``job_id, status``)."""
    counts = findings.groupBy("job_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    told = jobs.filter(F.col("status").isin(list(STATES) if events is None else events)).withColumnRenamed("id", "job_id")
    rows = told.join(notices(told, sent), ["job_id", "status"]).join(counts, "job_id", "left").na.fill(0, SEVERITIES)
    text = notice_text(F.col("filename"), F.col("status"), F.col("total_pages"), {s: F.col(s) for s in SEVERITIES}, F.col("error_message"))
    return rows.select("job_id", "status", text.alias("text"))


def notice_stream(events: DataFrame, texts: Callable[[DataFrame], DataFrame], post: Callable[[list], list], told: str, checkpoint: str) -> StreamingQuery:
    """Start a query that tells each ``job_id, status`` of a stream once. ``texts`` makes ``job_id, status, text`` of a batch;
    ``post`` is called on the executors with a partition's rows and returns, for each, whether it was taken; what was told is
    kept at ``told``, also across restarts, and what was not taken is tried when it comes again."""

    def send(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(told)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        kinds = "job_id string, status string, ok boolean"
        before = spark.read.schema(kinds).parquet(told) if there else spark.createDataFrame([], kinds)
        new = texts(notices(batch, before.filter("ok")))

        def run(rows):
            import pandas as pd

            for part in rows:
                ok = post(part.to_dict("records"))
                yield pd.DataFrame({"job_id": part["job_id"], "status": part["status"], "ok": ok})

        new.select(F.col("job_id").cast("string"), "status", "text").mapInPandas(run, kinds).write.mode("append").parquet(told)

    return events.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
