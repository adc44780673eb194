"""Reads, writes and lifecycle over jobs, pages and findings derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchloom.operators import reads
from batchloom.operators.report import json_report, markdown_report, report_order
from batchloom.plans.base import Tables, query
from batchloom.streaming.lifecycle import latest, recovered, replay

# Orders as jobs, events as findings; both dialects read these statements.
_JOBS = """SELECT CAST(o_orderkey AS bigint) AS id, CASE o_orderstatus WHEN 'F' THEN 'archived' WHEN 'O' THEN 'analyzing' ELSE 'review' END AS status, o_orderdate AS created_at,
  CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL '1' DAY END AS finished_at, concat(o_orderpriority, '.pdf') AS filename, CAST(o_custkey % 9 + 1 AS int) AS total_pages FROM """
_FINDINGS = """SELECT event_id AS id, user_id AS job_id, CAST(event_id % 12 AS int) AS page, event_type AS type, CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' WHEN 2 THEN 'info' ELSE 'odd' END AS severity,
  CASE event_id % 6 WHEN 0 THEN 'rule' WHEN 1 THEN 'llm_fallback' WHEN 2 THEN 'llm_page' WHEN 3 THEN 'llm_cross' WHEN 4 THEN 'user_rule' ELSE NULL END AS source, CASE event_id % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status,
  concat('d', CAST(event_id % 7 AS string)) AS description, ts AS created_at FROM """


def _duck(statement: str, table: str) -> str:
    return "(" + statement.replace("AS string)", "AS varchar)") + table + ")"


D_JOBS, D_FINDINGS = _duck(_JOBS, "orders"), _duck(_FINDINGS, "events")
_SEV = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END"
_SRC = "CASE coalesce(source, 'rule') WHEN 'rule' THEN 0 WHEN 'llm_fallback' THEN 1 WHEN 'llm_page' THEN 2 WHEN 'llm_cross' THEN 3 ELSE 4 END"


def jobs(t: Tables) -> DataFrame:
    return t.sql(_JOBS + "{orders}")


def findings(t: Tables) -> DataFrame:
    return t.sql(_FINDINGS + "{events}")


@query("p1_active_jobs", f"SELECT id, filename FROM {D_JOBS} WHERE status <> 'archived'")
def p1(t: Tables) -> DataFrame:
    return jobs(t).filter("status <> 'archived'").select("id", "filename")


@query("p3_live_jobs", f"SELECT id, status FROM {D_JOBS} WHERE status IN ('pending', 'ocr_running', 'ocr_done', 'analyzing', 'cancelling') OR (status <> 'archived' AND finished_at > TIMESTAMP '1997-06-02 00:05:00' - INTERVAL 10 MINUTE)")
def p3(t: Tables) -> DataFrame:
    return reads.live_jobs(jobs(t), F.expr("TIMESTAMP_NTZ '1997-06-02 00:05:00'")).select("id", "status")


@query("p4_findings_by_page", f"SELECT id, job_id, page, nth FROM (SELECT *, row_number() OVER (PARTITION BY job_id, page ORDER BY {_SEV}, {_SRC}, id) AS nth FROM {D_FINDINGS}) WHERE nth > 2 AND nth <= 22")
def p4(t: Tables) -> DataFrame:
    return reads.listed_by_page(findings(t), limit=20, offset=2).select("id", "job_id", "page", "nth")


@query("p14_failover", "SELECT o_orderkey, n = 0 OR total - n > greatest(2, floor(total * 0.1)) AS fails FROM (SELECT o_orderkey, o_orderkey % 40 AS n, o_custkey % 60 AS total FROM orders)")
def p14(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", reads.fails_over(F.col("o_orderkey") % 40, F.col("o_custkey") % 60).alias("fails"))


@query("g1_job_progress", f"""WITH p AS (SELECT user_id, count(*) FILTER (WHERE event_id % 3 > 0) AS r, count(*) FILTER (WHERE event_id % 3 = 1) AS a FROM events GROUP BY user_id), f AS (SELECT job_id, count(*) AS n, count(*) FILTER (WHERE status = 'pending') AS p FROM {D_FINDINGS} GROUP BY job_id)
SELECT j.id, coalesce(r, 0)::BIGINT AS pages_read, coalesce(a, 0)::BIGINT AS pages_analyzed, coalesce(n, 0)::BIGINT AS findings, coalesce(f.p, 0)::BIGINT AS pending FROM {D_JOBS} j LEFT JOIN p ON j.id = p.user_id LEFT JOIN f ON j.id = f.job_id""")
def g1(t: Tables) -> DataFrame:
    pages = t.events.select(F.col("user_id").alias("job_id"), F.when(F.col("event_id") % 3 > 0, "x").alias("raw_html"), F.when(F.col("event_id") % 3 == 1, "x").alias("structured_json"))
    return reads.job_counts(jobs(t), pages, findings(t)).select("id", "pages_read", "pages_analyzed", "findings", "pending")


@query("g2_page_severity_counts", f"SELECT job_id, page, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info, count(*) AS total FROM {D_FINDINGS} GROUP BY job_id, page")
def g2(t: Tables) -> DataFrame:
    return reads.page_counts(findings(t))


@query("g3_job_severity_counts", f"SELECT job_id, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info, count(*) AS total FROM {D_FINDINGS} GROUP BY job_id")
def g3(t: Tables) -> DataFrame:
    return reads.page_counts(findings(t), ("job_id",))


@query("g5_first_of_duplicates", f"SELECT min(id) AS id, job_id, source, page, type, description FROM {D_FINDINGS} GROUP BY job_id, source, page, type, description")
def g5(t: Tables) -> DataFrame:
    key = ["job_id", "source", "page", "type", "description"]
    return reads.first_by_key(findings(t), key).select("id", *key)


@query("g14_storage", "SELECT source, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, round(sum(strlen(text)) / 1048576.0::DOUBLE, 2) AS mb FROM documents GROUP BY source")
def g14(t: Tables) -> DataFrame:
    size = F.sum(F.octet_length("text").cast("bigint"))
    return t.documents.groupBy("source").agg(F.count("*").alias("files"), size.alias("bytes"), F.round(size / 1048576.0, 2).alias("mb"))


@query("g15_breakdown", f"SELECT severity, source, type, count(*) AS n FROM {D_FINDINGS} GROUP BY GROUPING SETS ((severity), (source), (type))")
def g15(t: Tables) -> DataFrame:
    return t.sql("SELECT severity, source, type, count(*) AS n FROM {f} GROUP BY GROUPING SETS ((severity), (source), (type))", f=findings(t))


@query("g16_overview", f"SELECT count(*) AS total, count(*) FILTER (WHERE status <> 'archived') AS active, count(*) FILTER (WHERE status = 'archived') AS archived FROM {D_JOBS}")
def g16(t: Tables) -> DataFrame:
    return reads.overview(jobs(t))


@query("j7_missing_pages", """WITH r AS (SELECT DISTINCT o_custkey AS j, (o_orderkey % 12 + 1)::INT AS p FROM orders WHERE o_orderstatus = 'F'), w AS (SELECT DISTINCT o_custkey AS j, unnest(range(1, 13))::INT AS p FROM orders)
SELECT j AS job_id, p AS page FROM w ANTI JOIN r USING (j, p)""")
def j7(t: Tables) -> DataFrame:
    every = t.orders.select(F.col("o_custkey").alias("job_id"), F.lit(12).alias("total_pages")).distinct()
    got = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("job_id"), (F.col("o_orderkey") % 12 + 1).cast("int").alias("page"))
    return reads.missing_pages(every, got).select("job_id", F.col("page").cast("int").alias("page"))


@query("j9_unanalyzed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j9(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("j10_same_content", """WITH f AS (SELECT doc_id, md5(text) AS h, doc_id % 4 = 0 AS arch FROM documents)
SELECT f.doc_id AS id, max(g.doc_id) AS same_as FROM f JOIN f g ON g.h = f.h AND g.doc_id < f.doc_id AND NOT g.arch GROUP BY f.doc_id""")
def j10(t: Tables) -> DataFrame:
    files = t.documents.select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("md5"), F.when(F.col("doc_id") % 4 == 0, "archived").otherwise("review").alias("status"))
    return reads.same_content(files).select("id", "same_as")


@query("j12_rule_hits", "SELECT s_suppkey AS id, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') AS hits FROM supplier")
def j12(t: Tables) -> DataFrame:
    found = t.lineitem.select(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")).alias("user_rule_id"))
    return reads.rule_hits(found, t.supplier.select(F.col("s_suppkey").alias("id"))).select("id", "hits")


@query("j14_delete_jobs", "SELECT count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE user_id % 3 <> 0")
def j14(t: Tables) -> DataFrame:
    gone = t.events.filter("user_id % 3 = 0").select(F.col("user_id").alias("job_id")).distinct()
    return reads.without_jobs({"findings": findings(t)}, gone)["findings"].agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("o1_review_order", f"SELECT id, row_number() OVER (PARTITION BY job_id ORDER BY page, {_SEV}, {_SRC}, id) AS place FROM {D_FINDINGS}")
def o1(t: Tables) -> DataFrame:
    order = Window.partitionBy("job_id").orderBy("page", reads.severity_rank(F.col("severity")), reads.source_rank(F.col("source")), "id")
    return findings(t).select("id", F.row_number().over(order).cast("bigint").alias("place"))


@query("o3_report_order", f"SELECT id, row_number() OVER (PARTITION BY job_id ORDER BY page, CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 END NULLS FIRST, {_SRC}, id) AS place FROM {D_FINDINGS}")
def o3(t: Tables) -> DataFrame:
    return findings(t).select("id", F.row_number().over(Window.partitionBy("job_id").orderBy(*report_order())).cast("bigint").alias("place"))


@query("o5_newest_jobs", f"SELECT id, created_at FROM {D_JOBS} WHERE status <> 'archived' ORDER BY created_at DESC, id LIMIT 25 OFFSET 50")
def o5(t: Tables) -> DataFrame:
    return reads.newest_jobs(jobs(t), page=3, page_size=25).select("id", "created_at")


@query("o10_has_more", f"SELECT job_id, count(*) AS total, 60 < count(*) AS has_more FROM {D_FINDINGS} GROUP BY job_id")
def o10(t: Tables) -> DataFrame:
    return reads.more_findings(findings(t), 50, 10, ("job_id",))


@query("o5_page_total", f"SELECT count(*) AS total_jobs, greatest(1, ceil(count(*) / 30.0))::INT AS total_pages FROM {D_JOBS} WHERE status <> 'archived'")
def o5_total(t: Tables) -> DataFrame:
    return reads.page_total(jobs(t), 30)


_Q = "chr(39)"


@query("mut_review_audit", f"""SELECT job_id, id AS finding_id, CASE WHEN id % 9 IN (0, 1, 4) THEN 'finding_update' ELSE 'finding_update_refused' END AS action,
  CASE id % 9 WHEN 0 THEN 'status: ' || status || ' → corrected; corrected: ' || {_Q} || 'c' || id || {_Q} WHEN 1 THEN 'status: ' || status || ' → pending; note: ' || {_Q} || repeat('n', 50) || {_Q}
  WHEN 2 THEN 'status' WHEN 3 THEN 'too long' WHEN 4 THEN 'note: ' || {_Q} || 'n' || id || {_Q} ELSE 'nothing' END AS detail FROM {D_FINDINGS} WHERE id % 9 < 6
UNION ALL SELECT NULL, -1 - event_id, 'finding_update_refused', 'not found' FROM events WHERE event_id % 50 = 0""")
def review_audit(t: Tables) -> DataFrame:
    change = t.sql("""SELECT event_id AS id, CASE event_id % 9 WHEN 0 THEN 'corrected' WHEN 1 THEN 'pending' WHEN 2 THEN 'nonsense' WHEN 5 THEN '' END AS status,
      CASE event_id % 9 WHEN 1 THEN repeat('n', 2000) WHEN 3 THEN repeat('n', 2001) WHEN 4 THEN concat('n', event_id) END AS reviewer_note, CASE WHEN event_id % 9 = 0 THEN concat('c', event_id) END AS corrected_text FROM {events} WHERE event_id % 9 < 6
      UNION ALL SELECT -1 - event_id, 'confirmed', NULL, NULL FROM {events} WHERE event_id % 50 = 0""")
    return reads.update_audit(reads.review_outcomes(findings(t), change), F.current_timestamp()).select("job_id", "finding_id", "action", "detail")


@query("u5_replace_pending", f"SELECT id FROM {D_FINDINGS} WHERE NOT (job_id % 2 = 0 AND status = 'pending' AND coalesce(source, '') LIKE 'llm%') UNION ALL SELECT -1 AS id")
def u5(t: Tables) -> DataFrame:
    again = t.events.filter("user_id % 2 = 0").select(F.col("user_id").alias("job_id")).distinct()
    new = t.spark.sql("SELECT CAST(-1 AS bigint) AS id")
    return reads.replace_pending(findings(t), again, new).select("id")


@query("mut_review_updates", f"""SELECT id, CASE WHEN id % 9 = 0 THEN 'corrected' WHEN id % 9 = 1 THEN 'pending' ELSE status END AS status, CASE WHEN id % 9 = 0 THEN 'c' || id END AS corrected_text, CASE WHEN id % 9 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' WHEN id % 9 = 1 THEN NULL WHEN status <> 'pending' THEN created_at END AS reviewed_at FROM {D_FINDINGS}""")
def updates(t: Tables) -> DataFrame:
    rows = findings(t).withColumn("reviewed_at", F.when(F.col("status") != "pending", F.col("created_at"))).withColumn("reviewer_note", F.lit(None).cast("string")).withColumn("corrected_text", F.lit(None).cast("string"))
    change = t.events.filter("event_id % 9 < 3").select(F.col("event_id").alias("id"), F.expr("CASE event_id % 9 WHEN 0 THEN 'corrected' WHEN 1 THEN 'pending' ELSE 'nonsense' END").alias("status"), F.lit(None).cast("string").alias("reviewer_note"), F.expr("CASE WHEN event_id % 9 = 0 THEN concat('c', event_id) END").alias("corrected_text"))
    return reads.apply_updates(rows, change, F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'")).select("id", "status", "corrected_text", "reviewed_at")


_FOUND_ONE = """'{"id":' || id || ',"page":' || page || ',"type":"' || type || '","severity":"' || severity || '","description":"' || description || '",' || CASE WHEN source IS NULL THEN '' ELSE '"source":"' || source || '",' END || '"status":"' || status || '"}'"""
_REPORT_ORDER = f"page, CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 END NULLS FIRST, {_SRC}, id"


@query("s14_json_report", f"""WITH f AS (SELECT job_id, count(*) AS n, string_agg({_FOUND_ONE}, ',' ORDER BY {_REPORT_ORDER}) AS l FROM {D_FINDINGS} GROUP BY job_id)
SELECT j.id AS job_id, '{{"job":{{"id":' || j.id || ',"filename":"' || filename || '","status":"' || status || '"}},"total":' || coalesce(n, 0) || ',"findings":[' || coalesce(l, '') || ']}}' AS report FROM {D_JOBS} j LEFT JOIN f ON f.job_id = j.id""")
def s14(t: Tables) -> DataFrame:
    return json_report(jobs(t), findings(t))


_STATE = "CASE status WHEN 'pending' THEN '⏳ 待复核' WHEN 'confirmed' THEN '✅ 已确认' WHEN 'rejected' THEN '❌ 已拒绝' END"


@query("s15_markdown_report", f"""WITH g AS (SELECT job_id, severity, count(*) AS n, string_agg('- **第' || page || '页** | `' || type || '` ' || {_STATE} || chr(10) || '  - ' || description || chr(10), chr(10) ORDER BY page, {_SRC}, id) AS l FROM {D_FINDINGS} WHERE severity <> 'odd' GROUP BY job_id, severity),
b AS (SELECT job_id, string_agg('### ' || CASE severity WHEN 'critical' THEN '🔴 严重' WHEN 'warning' THEN '🟡 警告' ELSE '🔵 提示' END || ' (' || n || ')' || chr(10) || chr(10) || l, chr(10) ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) AS body FROM g GROUP BY job_id),
c AS (SELECT job_id, count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS p FROM {D_FINDINGS} GROUP BY job_id)
SELECT j.id AS job_id, '# GMP 批生产记录合规检查报告' || chr(10) || chr(10) || '- **文件名**: ' || filename || chr(10) || '- **总页数**: ' || total_pages || chr(10) || '- **Job ID**: ' || j.id || chr(10) || '- **总 Findings**: ' || coalesce(total, 0) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Findings 列表' || chr(10) || chr(10)
  || coalesce(body, '未发现问题。' || chr(10)) || chr(10) || '---' || chr(10) || chr(10) || '## 汇总' || chr(10) || chr(10) || CASE WHEN coalesce(total, 0) = 0 THEN '✅ 未发现问题，无需人工复核。' WHEN p > 0 THEN '⚠️ **' || p || ' 条 Finding 需人工复核**，请在复核界面确认/拒绝/修正后重新导出。' ELSE '✅ 所有 Findings 已处理完毕。' END AS report
FROM {D_JOBS} j LEFT JOIN c ON c.job_id = j.id LEFT JOIN b ON b.job_id = j.id""")
def s15(t: Tables) -> DataFrame:
    blank = {c: F.lit(None).cast("string") for c in ("ocr_text", "corrected_text", "reviewer_note")}
    return markdown_report(jobs(t), findings(t).withColumns(blank))


@query("st5_transitions", """WITH RECURSIVE a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, CASE event_type WHEN 'view' THEN 'ocr_running' WHEN 'click' THEN 'ocr_done' WHEN 'purchase' THEN 'error' WHEN 'error' THEN 'pending' ELSE 'analyzing' END AS new FROM events),
e(f, t) AS (VALUES ('pending', 'ocr_running'), ('pending', 'error'), ('ocr_running', 'ocr_done'), ('ocr_running', 'error'), ('ocr_done', 'analyzing'), ('ocr_done', 'error'), ('analyzing', 'error'), ('error', 'pending')),
r AS (SELECT user_id, 0::BIGINT AS seq, 'pending' AS state, '' AS cur, '' AS new, false AS ok FROM (SELECT DISTINCT user_id FROM a)
  UNION ALL SELECT a.user_id, a.seq, CASE WHEN e.t IS NULL THEN r.state ELSE a.new END, r.state, a.new, e.t IS NOT NULL FROM r JOIN a ON a.user_id = r.user_id AND a.seq = r.seq + 1 LEFT JOIN e ON e.f = r.state AND e.t = a.new)
SELECT user_id AS job_id, seq, cur AS current, new, ok AS accepted FROM r WHERE seq > 0""")
def st5(t: Tables) -> DataFrame:
    attempts = t.sql("SELECT user_id AS job_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS bigint) AS seq, CASE event_type WHEN 'view' THEN 'ocr_running' WHEN 'click' THEN 'ocr_done' WHEN 'purchase' THEN 'error' WHEN 'error' THEN 'pending' ELSE 'analyzing' END AS new FROM {events}")
    return replay(attempts)


@query("st6_recovery", f"SELECT id, CASE WHEN status = 'analyzing' AND created_at < TIMESTAMP '1997-01-01' THEN 'error' ELSE status END AS status FROM {D_JOBS}")
def st6(t: Tables) -> DataFrame:
    return recovered(jobs(t), F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00'")).select("id", "status")


@query("w8_latest_state", "SELECT user_id AS job_id, arg_max(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY user_id")
def w8(t: Tables) -> DataFrame:
    return latest(t.events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status")))


@query("sum_summary_budget", """WITH l AS (SELECT conv_id AS job_id, turn, text AS line, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS upto, sum(length(text) + 1) OVER (PARTITION BY conv_id) - 1 AS every, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
k AS (SELECT job_id, count(*) FILTER (WHERE every <= 600 OR upto <= 600) AS k, any_value(n) AS n, string_agg(line, chr(10) ORDER BY turn) FILTER (WHERE every <= 600 OR upto <= 600) AS t FROM l GROUP BY job_id)
SELECT job_id, CASE WHEN k < n THEN concat_ws(chr(10), t, '## 内容过长已截断：仅完整展示 ' || k || '/' || n || ' 行，之后页面内容未注入，跨页分析可能缺失，需人工复核') ELSE t END AS text FROM k""")
def sums(t: Tables) -> DataFrame:
    return reads.summary(t.conversations.select(F.col("conv_id").alias("job_id"), F.col("turn").alias("ord"), F.col("text").alias("line")), 600)


@query("x8_column_matrix", "WITH c AS (SELECT user_id AS job_id, day(ts)::INT AS page, event_type AS col, min(event_id) AS f FROM events GROUP BY ALL) SELECT job_id, page, string_agg(col, ',' ORDER BY f) AS columns FROM c GROUP BY job_id, page")
def x8(t: Tables) -> DataFrame:
    cells = t.events.select(F.col("user_id").alias("job_id"), F.dayofmonth("ts").alias("page"), F.lit(0).alias("pos"), F.col("event_id").alias("row_pos"), F.lit(0).alias("cell_pos"), F.col("event_type").alias("col"))
    return reads.matrix(cells).select("job_id", "page", F.concat_ws(",", "columns").alias("columns"))
