"""Rules over batch records derived from the driver's tables, with SQL that works from the underlying values.

Orders stand for pages of a customer's record and line items for steps; their times are written in several layouts and have
to be read back. Events stand for measured values, signatures and measurement rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.operators import rules_doc, rules_spec, rules_time
from batchloom.operators.common import timed
from batchloom.operators.rules_doc import batch_groups
from batchloom.plans.audit import first_of_each
from batchloom.plans.base import Tables, query
from batchloom.schema import PAGES

_STEPS = """SELECT o_custkey AS job, o_orderkey AS page, l_linenumber AS step, min(o_orderdate) AS a, min(l_shipdate) AS b
  FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_custkey, o_orderkey, l_linenumber"""
#: The same in DuckDB; the two layouts with a time of day are precise, the others span a day.
_D_STEPS = """s AS (SELECT o_custkey AS job, o_orderkey AS page, l_linenumber AS step, min(o_orderdate) AS a, min(l_shipdate) AS b, l_linenumber % 4 IN (0, 3) AS exact
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
iv AS (SELECT *, a AS a0, CASE WHEN exact THEN a ELSE a + INTERVAL 1 DAY END AS a1, b AS b0, CASE WHEN exact THEN b ELSE b + INTERVAL 1 DAY END AS b1,
  CASE step % 4 WHEN 0 THEN strftime(a, '%Y-%m-%d %H:%M') WHEN 1 THEN strftime(a, '%Y.%m.%d') WHEN 2 THEN year(a) || '年' || month(a) || '月' || day(a) || '日' ELSE strftime(a, '%Y/%m/%d %H:%M:%S') END AS st,
  CASE step % 4 WHEN 0 THEN strftime(b, '%Y-%m-%d %H:%M') WHEN 1 THEN strftime(b, '%Y.%m.%d') WHEN 2 THEN year(b) || '年' || month(b) || '月' || day(b) || '日' ELSE strftime(b, '%Y/%m/%d %H:%M:%S') END AS bt FROM s)"""


def _written(moment: str, by: str) -> str:
    return f"""CASE {by} % 4 WHEN 0 THEN date_format({moment}, 'yyyy-MM-dd HH:mm') WHEN 1 THEN date_format({moment}, 'yyyy.MM.dd')
      WHEN 2 THEN concat(year({moment}), '年', month({moment}), '月', day({moment}), '日') ELSE date_format({moment}, 'yyyy/MM/dd HH:mm:ss') END"""


def record_steps(t: Tables) -> DataFrame:
    rows = t.sql(f"SELECT CAST(job AS string) AS job_id, CAST(page AS int) AS page, step - 1 AS pos, CAST(step AS string) AS step_no, {_written('a', 'step')} AS start_time, {_written('b', 'step')} AS end_time, '' AS operator FROM ({_STEPS})")
    return timed(rows)


def _short(found: DataFrame) -> DataFrame:
    return found.select("job_id", "page", "type", "severity", "description", "ocr_text")


@query("r1a_time_reversal_in_page", f"""WITH {_D_STEPS} SELECT job::VARCHAR AS job_id, page::INT AS page, 'time_reversal' AS type, 'critical' AS severity,
  '第' || page || '页 工序' || step || ' 开始时间(' || st || ') 晚于结束时间(' || bt || ')' AS description, st || ' → ' || bt AS ocr_text FROM iv WHERE a0 > b1 OR (a0 = b1 AND NOT exact)""")
def r1a(t: Tables) -> DataFrame:
    return _short(rules_time.reversal_in_step(record_steps(t)))


@query("r1b_time_reversal_cross_page", f"""WITH {_D_STEPS}, w AS (SELECT *, lag(page) OVER o AS lp, lag(step) OVER o AS ls, lag(bt) OVER o AS lbt, lag(b0) OVER o AS lb0 FROM iv WINDOW o AS (PARTITION BY job ORDER BY page, step)),
h AS (SELECT *, abs(year(a0) - year(lb0)) AS gap FROM w WHERE lp IS NOT NULL AND NOT CASE WHEN page <> lp THEN step <= ls ELSE step = ls END AND (a1 < lb0 OR (a1 = lb0 AND NOT exact)))
SELECT job::VARCHAR AS job_id, page::INT AS page, 'time_reversal' AS type, CASE WHEN gap > 2 THEN 'warning' ELSE 'critical' END AS severity,
  '第' || page || '页 工序' || step || ' 开始(' || st || ') 早于第' || lp || '页 工序' || ls || ' 结束(' || lbt || ')' || CASE WHEN gap > 2 THEN '，年份相差 ' || gap || ' 年，可能为 OCR/LLM 提取错误（原值 2015/2025 混淆等），请人工核对' ELSE '' END AS description,
  st || ' < ' || lbt || CASE WHEN gap > 2 THEN ' (Δ' || gap || 'y)' ELSE '' END AS ocr_text FROM h""")
def r1b(t: Tables) -> DataFrame:
    return _short(rules_time.reversal_between_steps(record_steps(t)))


@query("r1c_unreadable_times", """SELECT user_id::VARCHAR AS job_id, event_id::INT AS page, '第' || event_id || '页 工序1 ' || event_type || ' 时间格式无法解析（start=' || s || ' end=' || e || '），请人工核对时间顺序' AS description
  FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE '2024-13-' || lpad((event_id % 50)::VARCHAR, 2, '0') END AS s, CASE WHEN event_id % 5 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS e FROM events) WHERE event_id % 3 <> 0 OR event_id % 5 = 0""")
def r1c(t: Tables) -> DataFrame:
    day = "date_format(ts, 'yyyy-MM-dd')"
    rows = t.sql(f"""SELECT CAST(user_id AS string) AS job_id, CAST(event_id AS int) AS page, 0 AS pos, '1' AS step_no, event_type AS operation,
      CASE WHEN event_id % 3 = 0 THEN {day} ELSE concat('2024-13-', lpad(CAST(event_id % 50 AS string), 2, '0')) END AS start_time, CASE WHEN event_id % 5 = 0 THEN '' ELSE {day} END AS end_time FROM {{events}}""")
    return rules_time.reversal_between_steps(timed(rows)).filter("type = 'completeness'").select("job_id", "page", "description")


@query("r2_year_contradiction", """WITH y AS (SELECT o_orderkey, list_sort(list(DISTINCT year(l_shipdate))) AS ys FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)
SELECT (o_orderkey % 37)::VARCHAR AS job_id, o_orderkey::INT AS page, 'year_contradiction' AS type, 'warning' AS severity, '第' || o_orderkey || '页 production 事件内年份不一致: [' || array_to_string(ys, ', ') || ']，需人工确认' AS description, '[' || array_to_string(ys, ', ') || ']' AS ocr_text FROM y WHERE len(ys) > 1""")
def r2(t: Tables) -> DataFrame:
    pages = t.sql("SELECT CAST(o_orderkey % 37 AS string) AS job_id, CAST(o_orderkey AS int) AS page, map('production', collect_list(CAST(year(l_shipdate) AS string))) AS event_year_groups FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderkey")
    return _short(rules_time.year_contradiction(pages))


_JUDGE_INPUT = """SELECT event_id, user_id, event_type, CAST(floor(value * 100) AS bigint) AS cents, event_id % 9 AS k, CAST(user_id % 3 AS int) AS u FROM """
_SPECS = ["20-80", "≤50", "NMT 60", "≥10", "不超过40", "应澄清", "&lt;=50%", ">5", "NLT 30"]


def measured_values(t: Tables) -> DataFrame:
    """Events as parameters of a page each: the value as text with a unit, and a specification."""
    specs = F.array(*map(F.lit, _SPECS))
    rows = t.sql(_JUDGE_INPUT + "{events}")
    number = F.concat(F.floor(F.col("cents") / 100).cast("string"), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    unit = F.element_at(F.array(F.lit(""), F.lit("%"), F.lit("ppm")), F.col("u") + 1)
    return rows.select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").cast("int").alias("page"), F.lit(0).alias("pos"), F.lit("1").alias("no"), F.lit(0).alias("part"), F.lit(0).alias("a"), F.lit(0).alias("b"),
        F.col("event_type").alias("name"), F.lit("").alias("time"), F.element_at(specs, (F.col("k") + 1).cast("int")).alias("spec"), F.concat(number, unit).alias("actual"), F.lit("").alias("unit"),
        F.when(F.col("event_type") == "view", "printed").otherwise("unknown").alias("value_source"),
    )


#: Verdicts from the cents themselves; only the seventh specification has a unit (%).
_D_JUDGED = """e AS (SELECT user_id::VARCHAR AS job_id, event_id::INT AS page, event_type, event_id % 9 AS k, user_id % 3 AS u, floor(value * 100)::BIGINT / 100.0::DOUBLE AS raw, (floor(value * 100)::BIGINT // 100) || '.' || lpad((floor(value * 100)::BIGINT % 100)::VARCHAR, 2, '0') || (['', '%', 'ppm'])[(user_id % 3 + 1)::INT] AS actual FROM events),
v AS (SELECT *, CASE WHEN k = 6 AND u = 2 THEN raw * 0.0001::DOUBLE ELSE raw END AS x FROM e),
j AS (SELECT *, CASE k WHEN 0 THEN x BETWEEN 20 AND 80 WHEN 1 THEN x <= 50 WHEN 2 THEN x <= 60 WHEN 3 THEN x >= 10 WHEN 4 THEN x <= 40 WHEN 6 THEN x <= 50 WHEN 7 THEN x > 5 WHEN 8 THEN x >= 30 END AS ok,
  CASE k WHEN 0 THEN CASE WHEN x < 20 THEN 20.0 ELSE 80.0 END WHEN 1 THEN 50.0 WHEN 2 THEN 60.0 WHEN 3 THEN 10.0 WHEN 4 THEN 40.0 WHEN 6 THEN 50.0 WHEN 7 THEN 5.0 WHEN 8 THEN 30.0 END::DOUBLE AS bound FROM v)"""


@query("r3_param_out_of_spec", f"""WITH {_D_JUDGED} SELECT job_id, page, 'param_out_of_spec' AS type, CASE WHEN event_type <> 'view' AND abs(x - bound) / abs(bound) <= 0.10::DOUBLE THEN 'info' ELSE 'warning' END AS severity,
  event_type || ': spec=' || (['20-80', '≤50', 'NMT 60', '≥10', '不超过40', '应澄清', '&lt;=50%', '>5', 'NLT 30'])[k + 1] || ' value=' || actual AS ocr_text FROM j WHERE k <> 5 AND NOT ok""")
def r3(t: Tables) -> DataFrame:
    return rules_spec.out_of_spec(rules_spec.judged(measured_values(t))).select("job_id", "page", "type", "severity", "ocr_text")


@query("n4_judged_values", f"WITH {_D_JUDGED} SELECT page, CASE WHEN k = 5 THEN 'queue' WHEN ok THEN 'ok' ELSE 'out' END AS verdict, CASE WHEN k <> 5 THEN x END AS value FROM j")
def n4(t: Tables) -> DataFrame:
    return rules_spec.judged(measured_values(t)).select("page", "verdict", F.when(F.col("verdict") != "queue", F.col("moved.value")).alias("value"))


@query("fb_queue_to_review", f"""WITH {_D_JUDGED}, q AS (SELECT *, count(*) OVER (PARTITION BY job_id) AS n FROM j WHERE k = 5)
SELECT job_id, page, '第' || page || '页 参数 ' || event_type || '=' || actual || ' 规格 应澄清 无法自动判定（参数数量过多（' || n || '），超出自动判定上限，需人工确认），需人工确认' AS description FROM q WHERE n > 50
UNION ALL SELECT job_id, page, '第' || page || '页 参数 ' || event_type || '=' || actual || ' 规格 应澄清 无法自动判定（offline），需人工确认' FROM q WHERE n <= 50""")
def fb(t: Tables) -> DataFrame:
    queue = rules_spec.queue_of(rules_spec.judged(measured_values(t)))
    limit = rules_spec.QUEUE_LIMIT
    return rules_spec.flag_queue(queue.filter(F.col("n") > limit)).union(rules_spec.flag_queue(queue.filter(F.col("n") <= limit), "offline")).select("job_id", "page", "description")


@query("j4_answers_by_index", f"""WITH {_D_JUDGED}, q AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY page) AS idx FROM j WHERE k = 5)
SELECT job_id, page, CASE WHEN idx % 3 = 0 THEN 'completeness' ELSE 'param_out_of_spec' END AS type, 'llm_fallback' AS source FROM q WHERE idx % 3 <> 2 AND idx <= 40""")
def j4(t: Tables) -> DataFrame:
    queue = rules_spec.queue_of(rules_spec.judged(measured_values(t)))
    answers = t.sql("SELECT DISTINCT CAST(user_id AS string) AS job_id FROM {events}").withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(40))))
    answers = answers.withColumn("in_spec", F.when(F.col("idx") % 3 == 0, None).otherwise(F.col("idx") % 3 == 2))
    return rules_spec.answered_queue(queue, answers).select("job_id", "page", "type", "source")


@query("r4_suspicious_dates", """WITH d AS (SELECT o_custkey::VARCHAR AS job_id, o_orderkey::INT AS page, strftime(o_orderdate, '%Y-%m-%d') AS s FROM orders
  UNION SELECT o_custkey::VARCHAR, o_orderkey::INT, strftime(l_shipdate, '%Y.%m.%d') FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT job_id, page, '第' || page || '页 日期 ' || s || ' 年份 ' || s[1:4] || ' 异常（早于2000或晚于2025），需人工确认' AS description, s AS ocr_text FROM d WHERE s[1:4]::INT < 2000 OR s[1:4]::INT > 2025""")
def r4(t: Tables) -> DataFrame:
    rows = t.sql("SELECT CAST(o_custkey AS string) AS job_id, CAST(o_orderkey AS int) AS page, date_format(o_orderdate, 'yyyy-MM-dd') AS d, date_format(l_shipdate, 'yyyy.MM.dd') AS s FROM {orders} LEFT JOIN {lineitem} ON o_orderkey = l_orderkey")
    step = F.struct(F.col("s").alias("start_time"), F.lit(None).cast("string").alias("end_time"), F.lit(None).cast("array<struct<role:string,name:string,sign_time:string>>").alias("signatures"))
    pages = rows.groupBy("job_id", "page").agg(F.struct(F.first("d").alias("production_date")).alias("page_info"), F.collect_list(step).alias("steps"))
    return rules_time.suspicious_dates(pages, 2024).select("job_id", "page", "description", "ocr_text")


_SIGNERS = """SELECT user_id, CAST(ts AS date) AS day, event_id, ts, CASE event_type WHEN 'view' THEN 'operator' WHEN 'click' THEN 'reviewer' WHEN 'purchase' THEN 'QA' WHEN 'error' THEN '记录发放' ELSE 'guest' END AS role FROM """


def _signed_steps(t: Tables) -> DataFrame:
    """A page for each user and day, with its events as signatures in the order of their ids."""
    rows = t.sql(_SIGNERS + "{events}")
    sig = F.struct("event_id", "role", F.concat(F.lit("u"), "user_id").alias("name"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("sign_time"))
    pages = rows.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(sig)).alias("s"), F.max("ts").alias("t"))
    return timed(pages.select(F.col("user_id").cast("string").alias("job_id"), F.dayofmonth("day").alias("page"), F.lit(0).alias("pos"), F.lit("1").alias("step_no"), F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("start_time"), F.transform("s", lambda x: x.dropFields("event_id")).alias("signatures")))


@query("r5_signature_time_anomaly", """WITH m AS (SELECT *, date_trunc('second', ts) AS s, max(date_trunc('second', ts)) OVER (PARTITION BY user_id, ts::DATE) AS w FROM events),
r AS (SELECT *, CASE event_type WHEN 'view' THEN 'operator' WHEN 'click' THEN 'reviewer' WHEN 'purchase' THEN 'QA' WHEN 'error' THEN '记录发放' ELSE 'guest' END AS role FROM m)
SELECT user_id::VARCHAR AS job_id, day(ts)::INT AS page, '第' || day(ts) || '页 ' || role || ' u' || user_id || ' 签名时间 ' || strftime(s, '%Y-%m-%d %H:%M:%S') || ' 早于操作时间 ' || strftime(w, '%Y-%m-%d %H:%M:%S') AS description FROM r WHERE s < w""")
def r5(t: Tables) -> DataFrame:
    return rules_time.signed_before_work(_signed_steps(t)).select("job_id", "page", "description")


@query("r9a_signature_order", """WITH m AS (SELECT *, date_trunc('second', ts) AS s, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 END AS rank FROM events),
w AS (SELECT *, lag(s) OVER o AS ls FROM m WHERE rank IS NOT NULL WINDOW o AS (PARTITION BY user_id, ts::DATE ORDER BY rank, event_id))
SELECT user_id::VARCHAR AS job_id, day(ts)::INT AS page, 'u' || user_id AS operator, strftime(s, '%Y-%m-%d %H:%M:%S') AS signed, strftime(ls, '%Y-%m-%d %H:%M:%S') AS earlier FROM w WHERE s < ls""")
def r9a(t: Tables) -> DataFrame:
    time = r"=(\d[\d\- :]*\d)"
    return rules_time.signature_order(_signed_steps(t)).select("job_id", "page", "operator", F.regexp_extract("ocr_text", "> [^=]*" + time, 1).alias("signed"), F.regexp_extract("ocr_text", "^[^=]*" + time, 1).alias("earlier"))


@query("r6_completeness", """WITH d AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)), g AS (
  SELECT doc_id, lang, 'warning' AS severity, 'time' AS f FROM d WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, lang, 'warning', 'operator' FROM d WHERE doc_id % 5 <> 0 AND quality IS NULL
  UNION ALL SELECT doc_id, lang, 'info', 'reviewer' FROM d WHERE doc_id % 5 <> 0 AND quality IS DISTINCT FROM 1
  UNION ALL SELECT doc_id, lang, 'info', 'qa' FROM d WHERE doc_id % 5 <> 0 AND toxic IS DISTINCT FROM 0)
SELECT (doc_id % 29)::VARCHAR AS job_id, doc_id::INT AS page, severity, 'step_no=1 ' || f || '=空' AS ocr_text FROM g""")
def r6(t: Tables) -> DataFrame:
    rows = t.sql("""SELECT CAST(d.doc_id % 29 AS string) AS job_id, CAST(d.doc_id AS int) AS page, 0 AS pos, '1' AS step_no, lang AS operation, CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE '2024-01-01' END AS start_time,
      CASE WHEN quality IS NOT NULL THEN 'op' END AS operator, filter(array(CASE WHEN quality = 1 THEN struct('复核人' AS role, 'r' AS name, '' AS sign_time) END, CASE WHEN toxic = 0 THEN struct('QA' AS role, 'q' AS name, '' AS sign_time) END), x -> x IS NOT NULL) AS signatures
      FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""")
    return rules_doc.completeness(timed(rows)).select("job_id", "page", "severity", "ocr_text")


_BATCHES = """SELECT p_partkey % 40 AS job, CAST(p_partkey AS int) AS page, concat(CASE WHEN p_partkey % 3 = 0 THEN '1127' ELSE '22' END, CAST(p_partkey % 4 AS string), 'N') AS base, p_partkey % 6 AS k FROM """


def _batch_pages(t: Tables) -> DataFrame:
    rows = t.sql(f"""SELECT CAST(job AS string) AS job_id, page, CASE k WHEN 0 THEN concat(base, ' 250101') WHEN 1 THEN concat(base, '·25010i') WHEN 2 THEN base WHEN 3 THEN concat(base, '250101-02') WHEN 4 THEN NULL ELSE concat(base, '２５０１０１') END AS batch_no FROM ({_BATCHES}{{part}})""")
    return rows.select("job_id", "page", F.struct("batch_no").alias("page_info"))


#: Every batch number of a base comes down to the base or to the base with its date, so the base names the group.
_D_BATCHES = """b AS (SELECT (p_partkey % 40)::VARCHAR AS job_id, p_partkey::INT AS page, CASE WHEN p_partkey % 3 = 0 THEN '1127' ELSE '22' END || (p_partkey % 4) || 'N' AS base, p_partkey % 6 AS k FROM part),
g AS (SELECT job_id, base, CASE WHEN bool_or(k <> 2) THEN base || '250101' ELSE base END AS host, list_sort(list(page)) AS pages, count(DISTINCT k) AS raws FROM b WHERE k <> 4 GROUP BY job_id, base)"""


@query("j5_batch_groups", f"WITH {_D_BATCHES} SELECT job_id, host, raws::INT AS raws, len(pages)::INT AS n_pages, pages[1] AS first_page FROM g")
def j5(t: Tables) -> DataFrame:
    return batch_groups(_batch_pages(t)).select("job_id", "host", F.size("raws").alias("raws"), F.size("pages").alias("n_pages"), F.col("pages")[0].alias("first_page"))


@query("r7_batch_consistency", f"WITH {_D_BATCHES} SELECT job_id, 'critical' AS severity, count(*)::BIGINT AS n_groups, (sum(raws) - count(*))::BIGINT AS n_merged FROM g GROUP BY job_id HAVING count(*) > 1")
def r7(t: Tables) -> DataFrame:
    found = rules_doc.batch_consistency(_batch_pages(t))
    part = lambda p: F.regexp_extract("description", p, 1).cast("bigint")
    return found.select("job_id", "severity", part(r"检测到 (\d+) 组").alias("n_groups"), part(r"已归并 (\d+) 个").alias("n_merged"))


@query("r8_low_confidence", "SELECT source AS job_id, doc_id::INT AS page, 'info' AS severity, 'overall_confidence=low' AS ocr_text FROM documents WHERE doc_id % 7 = 1")
def r8(t: Tables) -> DataFrame:
    pages = t.sql("SELECT source AS job_id, CAST(doc_id AS int) AS page, CASE doc_id % 7 WHEN 1 THEN 'Low' WHEN 2 THEN NULL ELSE 'high' END AS overall_confidence FROM {documents}")
    return rules_doc.low_confidence(pages).select("job_id", "page", "severity", "ocr_text")


@query("r8b_check_consistency", """SELECT lang AS job_id, doc_id::INT AS page, CASE WHEN doc_id % 4 = 0 THEN 'warning' ELSE 'info' END AS severity, 'item=' || source || ' selected=' || CASE WHEN doc_id % 4 = 0 THEN '否' ELSE '无法识别' END AS ocr_text
  FROM documents WHERE doc_id % 4 IN (0, 1)""")
def r8b(t: Tables) -> DataFrame:
    rows = t.sql("SELECT lang AS job_id, CAST(doc_id AS int) AS page, 0 AS pos, '1' AS step_no, array(struct(source AS item, CASE doc_id % 4 WHEN 0 THEN ' 否' WHEN 1 THEN '无法识别' WHEN 2 THEN '是' ELSE '' END AS selected, '√' AS marker)) AS checks FROM {documents}")
    return rules_doc.failed_checks(timed(rows)).select("job_id", "page", "severity", "ocr_text")


@query("r9_handwritten_notes", """WITH n AS (SELECT conv_id, list(trim(text, ' ' || chr(10) || chr(9) || chr(13)) ORDER BY turn) FILTER (WHERE trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> '') AS notes FROM conversations GROUP BY conv_id)
SELECT (conv_id % 11)::VARCHAR AS job_id, conv_id::INT AS page, '第' || conv_id || '页 工序1 含 ' || len(notes) || ' 条手写内容（如「' || notes[1][1:30] || '」' || CASE WHEN len(notes) > 1 THEN ' 等 ' || (len(notes) - 1) || ' 条' ELSE '' END || '），手写体 OCR 易误读，请对照 PDF 原页人工核对' AS description, array_to_string(notes, '；')[1:200] AS ocr_text FROM n WHERE len(notes) > 0""")
def r9(t: Tables) -> DataFrame:
    rows = t.sql("SELECT CAST(conv_id % 11 AS string) AS job_id, CAST(conv_id AS int) AS page, 0 AS pos, '1' AS step_no, transform(array_sort(collect_list(struct(turn, text))), x -> x.text) AS handwritten FROM {conversations} GROUP BY conv_id")
    return rules_doc.handwritten_notes(timed(rows)).select("job_id", "page", "description", "ocr_text")


def _event_steps(t: Tables) -> DataFrame:
    """Each user is a step; a day's events are its measurement rows on that day's page, with one column each."""
    cell = F.array(F.struct(F.col("event_type").alias("col"), F.lit("").alias("spec"), F.lit("").alias("actual"), F.lit("").alias("unit"), F.lit("").alias("value_source")))
    time = F.when(F.col("event_id") % 11 == 0, "x").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    rows = t.events.withColumn("m", F.struct((F.col("event_id") * 7919 % 1000003).alias("o"), time.alias("time"), cell.alias("values")))
    pages = rows.groupBy("user_id", F.dayofmonth("ts").alias("page")).agg(F.array_sort(F.collect_list("m")).alias("ms"))
    return timed(pages.select(F.lit("j").alias("job_id"), "page", F.lit(0).alias("pos"), F.col("user_id").cast("string").alias("step_no"), F.transform("ms", lambda m: m.dropFields("o")).alias("measurements")))


@query("rm1_measurement_sequence", """WITH r AS (SELECT user_id, day(ts) AS page, event_id * 7919 % 1000003 AS o, CASE WHEN event_id % 11 <> 0 THEN date_trunc('minute', ts) END AS tm FROM events),
w AS (SELECT *, lag(tm) OVER x AS last, lag(page) OVER x AS lp FROM r WINDOW x AS (PARTITION BY user_id ORDER BY page, o))
SELECT user_id::VARCHAR AS step_no, page::INT AS page, 'warning' AS severity, strftime(last, '%Y-%m-%d %H:%M') || ' > ' || strftime(tm, '%Y-%m-%d %H:%M') AS ocr_text FROM w WHERE last > tm""")
def rm1(t: Tables) -> DataFrame:
    return rules_time.measurement_order(_event_steps(t)).select(F.regexp_extract("description", r"工序(\d+) ", 1).alias("step_no"), "page", "severity", "ocr_text")


@query("rm2_measurement_columns", """WITH p AS (SELECT user_id, day(ts) AS page, list(DISTINCT event_type) AS cols FROM events GROUP BY ALL), a AS (SELECT user_id, count(DISTINCT day(ts)) AS pages, count(*) AS n, list(DISTINCT event_type) AS every FROM events GROUP BY user_id),
m AS (SELECT p.user_id, page, list_sort(list_filter(every, lambda x: NOT list_contains(cols, x))) AS gone FROM p JOIN a USING (user_id) WHERE pages >= 2 AND n >= 2)
SELECT user_id::VARCHAR AS step_no, page::INT AS page, 'missing: ' || array_to_string(gone, '、') AS ocr_text FROM m WHERE len(gone) > 0""")
def rm2(t: Tables) -> DataFrame:
    return rules_doc.missing_columns(_event_steps(t)).select(F.regexp_extract("description", r"工序(\d+) ", 1).alias("step_no"), "page", "ocr_text")


_FOUND = """SELECT CAST(user_id AS string) AS job_id, CAST(event_id % 50 AS int) AS page, CASE WHEN event_id % 10 = 3 THEN NULL ELSE event_type END AS type, CASE event_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, concat('d', CAST(event_id % 4 AS string)) AS description, event_id FROM """


@query("pp_page_findings", f"SELECT job_id, page, type, severity, description, 'llm_page' AS source FROM ({_FOUND} events) WHERE type IS NOT NULL")
def pp(t: Tables) -> DataFrame:
    return rules_doc.page_findings(_found_pages(t)).select("job_id", "page", "type", "severity", "description", "source")


def _found_pages(t: Tables) -> DataFrame:
    f = F.struct("event_id", "type", "severity", "description", F.lit("").alias("ocr_text"), F.lit("").alias("operator"))
    rows = t.sql(_FOUND + "{events}").groupBy("job_id", "page").agg(F.array_sort(F.collect_list(f)).alias("f"))
    return rows.select("job_id", "page", F.transform("f", lambda x: x.dropFields("event_id")).alias("findings"))


@query("u3_distinct_findings", f"""SELECT job_id, page, type, description, severity FROM (SELECT *, row_number() OVER (PARTITION BY job_id, page, type, description ORDER BY event_id) AS nth FROM ({_FOUND} events) WHERE type IS NOT NULL) WHERE nth = 1""")
def u3(t: Tables) -> DataFrame:
    return first_of_each(rules_doc.page_findings(_found_pages(t))).select("job_id", "page", "type", "description", "severity")
