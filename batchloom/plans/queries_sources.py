"""Sources and senders over the driver's tables: upload checks, schema versions and notices."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.operators import notices
from batchloom.plans.base import Tables, query
from batchloom.plans.queries_reads import D_FINDINGS, D_JOBS, findings, jobs
from batchloom.session import shared_dir
from batchloom.sources import upload_checks, versions

# A document's text inside a file of one of several kinds; both dialects read these statements.
_NAME = "concat('up/', doc_id, CASE doc_id % 7 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png' WHEN 2 THEN '.docx' WHEN 3 THEN '' ELSE '.pdf' END)"
_KIND = "doc_id % 5"


@query("s1_upload_checks", f"""WITH f AS (SELECT doc_id, {_NAME} AS path, doc_id % 7 AS e, {_KIND} AS k, doc_id % 3 AS n, strlen(coalesce(text, '')) AS n_bytes FROM documents)
SELECT path, CASE WHEN e IN (2, 3) THEN 'extension' WHEN k = 4 AND n_bytes < 5 THEN 'too small' WHEN e = 1 THEN CASE WHEN k <> 3 THEN 'no image' END WHEN k >= 3 THEN 'no document' WHEN k = 1 THEN 'encrypted' WHEN k < 3 AND n = 0 THEN 'no pages' END AS reason,
  CASE WHEN e IN (2, 3) OR (k = 4 AND n_bytes < 5) THEN NULL WHEN e = 1 THEN CASE WHEN k = 3 THEN 1 END WHEN k < 3 THEN n END::BIGINT AS pages FROM f""")
def s1_checks(t: Tables) -> DataFrame:
    tree = "concat('2 0 obj << /Type /Pages /Kids [] /Count ', doc_id % 3, ' >> endobj ')"
    content = f"""CASE {_KIND} WHEN 3 THEN concat(unhex('89504E470D0A1A0A'), CAST(text AS binary)) WHEN 4 THEN CAST(coalesce(text, '') AS binary)
      ELSE CAST(concat('%PDF-1.7 ', coalesce(text, ''), ' ', {tree}, 'trailer << /Root 1 0 R ', CASE {_KIND} WHEN 1 THEN '/Encrypt 9 0 R ' ELSE '' END, '>>') AS binary) END"""
    files = t.sql(f"SELECT {_NAME} AS path, {content} AS content FROM {{documents}}")
    return upload_checks.checked_uploads(files.withColumn("length", F.octet_length("content").cast("bigint"))).select("path", "reason", "pages")


@query("mig_findings_versions", f"""WITH f AS (SELECT id, job_id, page, type, description, severity, CASE WHEN id % 3 = 0 THEN 'rule' ELSE source END AS source, CASE WHEN id % 3 = 2 THEN 'u' || (id % 10) END AS user_rule_id FROM {D_FINDINGS})
SELECT id, job_id::VARCHAR AS job_id, page, severity, source, user_rule_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id, source, page, type, description ORDER BY id) AS nth FROM f) WHERE nth = 1""")
def migrated(t: Tables) -> DataFrame:
    path = f"{shared_dir(t.spark)}/versions/{uuid.uuid4().hex}"
    rows = findings(t).withColumn("job_id", F.col("job_id").cast("string"))
    rows.filter("id % 3 = 0").drop("source", "created_at").withColumn("page", F.col("page").cast("smallint")).write.parquet(f"{path}/version=0")
    rows.filter("id % 3 = 1").drop("created_at").write.parquet(f"{path}/version=3")
    rows.filter("id % 3 = 2").drop("created_at").withColumn("user_rule_id", F.concat(F.lit("u"), F.col("id") % 10)).write.parquet(f"{path}/version=5")
    return versions.read_findings(t.spark, path).select("id", "job_id", "page", "severity", "source", "user_rule_id")


_SAID = """'【batchloom】批生产记录' || CASE status WHEN 'review' THEN '分析完成，已生成报告' ELSE status END || chr(10) || '文件：' || filename || chr(10) || '页数：' || total_pages || ' 页' || chr(10) || '发现：' || coalesce(c, 0) || ' 严重 / ' || coalesce(w, 0) || ' 警告 / ' || coalesce(i, 0) || ' 提示'"""


@query("s16_notices", f"""WITH n AS (SELECT job_id, count(*) FILTER (WHERE severity = 'critical') AS c, count(*) FILTER (WHERE severity = 'warning') AS w, count(*) FILTER (WHERE severity = 'info') AS i FROM {D_FINDINGS} GROUP BY job_id)
SELECT j.id AS job_id, status, {_SAID} AS text, length({_SAID}) > 0 AS signed FROM {D_JOBS} j LEFT JOIN n ON n.job_id = j.id WHERE status IN ('review', 'analyzing') AND NOT (j.id % 4 = 0 AND status = 'review')""")
def s16(t: Tables) -> DataFrame:
    sent = t.orders.filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("job_id"), F.lit("review").alias("status"))
    every = jobs(t).withColumn("error_message", F.lit(None).cast("string"))
    due = notices.due_notices(every, findings(t), sent, ["review", "analyzing"])
    body = notices.payload(F.col("text"), F.concat(F.lit("secret"), F.col("job_id").cast("string")), F.col("job_id"))
    return due.select("job_id", "status", "text", (F.length(F.get_json_object(body, "$.sign")) == 44).alias("signed"))
