"""The whole audit over full pages, with the union of all rules in SQL.

A customer is a job, an order a page and its lines are steps, each with times, a parameter, a measurement row, signatures, a
check and notes that follow from the tables. The SQL works from the tables' values, rule by rule, in the order of the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.functions.numbers import EDGE_HINT
from batchloom.plans.audit import audit, first_of_each, rules_of_first
from batchloom.plans.base import Tables, query
from batchloom.plans.queries_rules import _written
from batchloom.schema import FINGERPRINT, PAGES

_LINES = "SELECT o_custkey AS job, o_orderkey AS page, l_linenumber AS step, min(o_orderdate) AS a, min(l_shipdate) AS b, CAST(min(l_quantity) AS int) AS q, min(o_orderpriority) AS item FROM {} JOIN {} ON o_orderkey = l_orderkey GROUP BY o_custkey, o_orderkey, l_linenumber"
_SPEC = "CASE step % 4 WHEN 0 THEN '10-30' WHEN 1 THEN '≤25' WHEN 2 THEN '应澄清' ELSE '≤5 kg' END"
_ACTUAL = "CASE WHEN step % 4 = 3 THEN concat(CAST(q AS {0}), ' xx') ELSE CAST(q AS {0}) END"
_FAR = "'，年份相差 ' || gap || ' 年，可能为 OCR{} 提取错误（原值 2015/2025 混淆等），请人工核对'"
_RULES = {
    "R1a": "SELECT job, page, 'time_reversal' AS type, 'critical' AS severity, '第' || page || '页 工序' || step || ' 开始时间(' || st || ') 晚于结束时间(' || bt || ')' AS said FROM iv WHERE NOT bad AND (a0 > b1 OR (a0 = b1 AND NOT exact))",
    "R1b": f"""SELECT job, page, 'time_reversal', CASE WHEN gap > 2 THEN 'warning' ELSE 'critical' END, '第' || page || '页 工序' || step || ' 开始(' || st || ') 早于第' || lp || '页 工序' || ls || ' 结束(' || lbt || ')' || CASE WHEN gap > 2 THEN {_FAR.format("/LLM")} ELSE '' END
      FROM (SELECT *, abs(year(a0) - year(lb0)) AS gap FROM w) WHERE lp IS NOT NULL AND NOT CASE WHEN page <> lp THEN step <= ls ELSE step = ls END AND (a1 < lb0 OR (a1 = lb0 AND NOT exact))
      UNION ALL SELECT job, page, 'completeness', 'info', '第' || page || '页 工序' || step || ' op 时间格式无法解析（start=' || st || ' end=' || bt || '），请人工核对时间顺序' FROM iv WHERE bad""",
    "R2": "SELECT job, page, 'year_contradiction', 'warning', '第' || page || '页 production 事件内年份不一致: [' || array_to_string(ys, ', ') || ']，需人工确认' FROM (SELECT job, page, list_sort(list(DISTINCT year(b))) AS ys FROM s GROUP BY job, page) WHERE len(ys) > 1",
    "R4": """SELECT job, page, 'suspicious_date', 'warning', '第' || page || '页 日期 ' || d || ' 年份 ' || d[1:4] || ' 异常（早于2000或晚于2025），需人工确认' FROM (SELECT job, page, st AS d FROM iv UNION SELECT job, page, bt FROM iv WHERE NOT bad
      UNION SELECT job, page, strftime(b, '%Y-%m-%d') FROM iv WHERE step % 2 = 0 UNION SELECT job, page, strftime(a, '%Y-%m-%d') FROM iv WHERE step % 2 = 0) WHERE d[1:4]::INT < 2000 OR d[1:4]::INT > 2025""",
    "R5": f"""SELECT job, page, 'signature_time_anomaly', 'warning', '第' || page || '页 operator o1 签名时间 ' || strftime(b, '%Y-%m-%d') || ' 早于操作时间 ' || st || CASE WHEN gap > 2 THEN {_FAR.format("")} ELSE '' END
      FROM (SELECT *, abs(year(a) - year(b)) AS gap FROM iv) WHERE step % 2 = 0 AND b + INTERVAL 1 DAY <= a""",
    "R9a": f"""SELECT job, page, 'signature_time_anomaly', 'warning', '第' || page || '页 qa q1 签名时间(' || strftime(a, '%Y-%m-%d') || ') 早于 operator o1(' || strftime(b, '%Y-%m-%d') || ')，复核/审批顺序异常' || CASE WHEN gap > 2 THEN {_FAR.format("")} ELSE '' END
      FROM (SELECT *, abs(year(a) - year(b)) AS gap FROM iv) WHERE step % 2 = 0 AND a + INTERVAL 1 DAY <= b""",
    "R6": """SELECT job, page, 'completeness', CASE k WHEN 0 THEN 'warning' ELSE 'info' END, '第' || page || '页 工序' || step || ' op ' || (['已记录操作时间但缺少操作人签名', '缺少复核人签名', '缺少 QA 签名'])[k + 1] FROM iv, range(0, 3) r(k) WHERE step % 2 = 1 OR k = 1""",
    "R7": """SELECT job, pages[1], 'batch_inconsistency', 'critical', '跨页批号不一致：检测到 2 组不同批号 — ' || said || '（已归并 0 个空格/分隔符/工序后缀等 OCR 变体），请核对是否装订错误或混批' FROM
      (SELECT job, string_agg(core || '(第' || array_to_string(pages, ',') || '页)', '；' ORDER BY len(pages) DESC, pages[1]) AS said, arg_min(pages, {'few': -len(pages), 'first': pages[1]}) AS pages, count(*) AS n FROM
        (SELECT job, CASE WHEN page % 9 = 0 THEN '77' ELSE '55' END || job AS core, list_sort(list(DISTINCT page)) AS pages FROM s GROUP BY ALL) GROUP BY job) WHERE n = 2""",
    "R8": "SELECT DISTINCT job, page, 'completeness', 'info', '第' || page || '页 整体识别置信度较低，建议人工核对 OCR 结果（可能存在手写体或印章干扰）' FROM s WHERE page % 8 = 0",
    "R9": "SELECT job, page, 'handwritten', 'info', '第' || page || '页 工序2 含 1 条手写内容（如「n' || page || '」），手写体 OCR 易误读，请对照 PDF 原页人工核对' FROM s WHERE step = 2 AND page % 6 = 0",
    "R8b": """SELECT job, page, 'completeness', CASE WHEN page % 5 = 0 THEN 'warning' ELSE 'info' END, '第' || page || '页 检查项「' || item || CASE WHEN page % 5 = 0 THEN '」勾选为“否”（√），需确认是否已启动偏差处理并在记录中留痕' ELSE '」勾选状态无法识别（√），请对照 PDF 原页人工核对' END FROM s WHERE step = 1 AND page % 5 < 2""",
    "RM1": """SELECT job, page, 'time_reversal', 'warning', '工序' || step || ' 测量时间跨页倒序：第' || lp || '页 ' || strftime(lb, '%Y-%m-%d %H:%M') || ' 晚于 第' || page || '页 ' || strftime(b, '%Y-%m-%d %H:%M') || ' — 可能表格缺行、行序错乱或 OCR 提取错误，请人工核对参数矩阵'
      FROM (SELECT *, lag(page) OVER o AS lp, lag(b) OVER o AS lb FROM s WINDOW o AS (PARTITION BY job, step ORDER BY page)) WHERE lb > b""",
    "RM2": """SELECT job, page, 'completeness', 'info', '工序' || step || ' 参数矩阵跨页列不一致：第' || page || '页缺列 ' || array_to_string(list_filter(cols, lambda x: x <> 'c' || (page % 3)), '、') || '（其余页均有）— 可能表格截断或提取丢失，请人工核对'
      FROM (SELECT *, list_sort(list(DISTINCT 'c' || (page % 3)) OVER (PARTITION BY job, step)) AS cols FROM s) WHERE len(cols) > 1""",
    "R3": f"""SELECT job, page, 'completeness', 'warning', '第' || page || '页 参数 q 单位不一致且无换算规则（spec=≤5 kg, actual=' || q || ' xx），需人工确认' FROM s WHERE step % 4 = 3
      UNION ALL SELECT job, page, 'param_out_of_spec', CASE WHEN near THEN 'info' ELSE 'warning' END, '第' || page || '页 参数 q=' || q || '.0 不在规格 ' || {_SPEC} || ' 内' || CASE WHEN near THEN '{EDGE_HINT}' ELSE '' END
      FROM (SELECT *, abs(q - bound) / bound <= 0.1::DOUBLE AS near FROM (SELECT *, CASE WHEN step % 4 = 1 THEN 25.0 WHEN q < 10 THEN 10.0 ELSE 30.0 END::DOUBLE AS bound FROM s WHERE (step % 4 = 0 AND (q < 10 OR q > 30)) OR (step % 4 = 1 AND q > 25)))""",
    "PP": "SELECT DISTINCT job, page, 't', 'info', 'd' || page FROM s WHERE page % 10 = 0",
    "FB": """SELECT job, page, 'completeness', 'warning', '第' || page || '页 参数 q=' || q || ' 规格 应澄清 无法自动判定（' || CASE WHEN n > 50 THEN '参数数量过多（' || n || '），超出自动判定上限，需人工确认' ELSE 'LLM 调用失败: ConnectionError' END || '），需人工确认' FROM (SELECT *, count(*) OVER (PARTITION BY job) AS n FROM s WHERE step % 4 = 2)""",
}
_D_AUDIT = f"""WITH s AS ({_LINES.format("orders", "lineitem")}),
iv AS (SELECT *, page % 7 = 0 AND step = 5 AS bad, step % 4 IN (0, 3) AS exact, a AS a0, CASE WHEN step % 4 IN (0, 3) THEN a ELSE a + INTERVAL 1 DAY END AS a1, b AS b0, CASE WHEN step % 4 IN (0, 3) THEN b ELSE b + INTERVAL 1 DAY END AS b1,
  CASE step % 4 WHEN 0 THEN strftime(a, '%Y-%m-%d %H:%M') WHEN 1 THEN strftime(a, '%Y.%m.%d') WHEN 2 THEN year(a) || '年' || month(a) || '月' || day(a) || '日' ELSE strftime(a, '%Y/%m/%d %H:%M:%S') END AS st,
  CASE WHEN page % 7 = 0 AND step = 5 THEN 'x' ELSE CASE step % 4 WHEN 0 THEN strftime(b, '%Y-%m-%d %H:%M') WHEN 1 THEN strftime(b, '%Y.%m.%d') WHEN 2 THEN year(b) || '年' || month(b) || '月' || day(b) || '日' ELSE strftime(b, '%Y/%m/%d %H:%M:%S') END END AS bt FROM s),
w AS (SELECT *, lag(page) OVER o AS lp, lag(step) OVER o AS ls, lag(bt) OVER o AS lbt, lag(b0) OVER o AS lb0 FROM iv WHERE NOT bad WINDOW o AS (PARTITION BY job ORDER BY page, step)),
f AS ({" UNION ALL ".join(f"SELECT {k} AS rule, * FROM ({sql})" for k, sql in enumerate(_RULES.values()))}),
g AS (SELECT job, page, type, said, CASE rule WHEN {list(_RULES).index("PP")} THEN 'llm_page' ELSE 'rule' END AS source, arg_min(severity, rule) AS severity, min(rule)::INT AS rule FROM f GROUP BY ALL)
SELECT job::VARCHAR AS job_id, page::INT AS page, type, severity, said AS description, source FROM g"""


def full_pages(t: Tables, parts: int) -> DataFrame:
    """Pages on which every rule finds something, dealt out by job while they are still short rows of lines."""
    sign = lambda role, name, day: f"named_struct('role', '{role}', 'name', '{name}', 'sign_time', date_format({day}, 'yyyy-MM-dd'))"
    step = f"""named_struct('step_no', CAST(step AS string), 'operation', 'op', 'start_time', {_written("a", "step")}, 'end_time', CASE WHEN page % 7 = 0 AND step = 5 THEN 'x' ELSE {_written("b", "step")} END, 'operator', '', 'reviewer', '',
      'parameters', array(named_struct('name', 'q', 'spec_range', {_SPEC}, 'value', {_ACTUAL.format("string")}, 'unit', '', 'value_source', '', 'in_spec', CAST(NULL AS boolean))),
      'measurements', array(named_struct('time', date_format(b, 'yyyy-MM-dd HH:mm'), 'values', array(named_struct('col', concat('c', page % 3), 'spec', '', 'actual', '', 'unit', '', 'value_source', '')))),
      'signatures', CASE WHEN step % 2 = 0 THEN array({sign("operator", "o1", "b")}, {sign("qa", "q1", "a")}) END,
      'checks', CASE WHEN step = 1 THEN array(named_struct('item', item, 'selected', CASE page % 5 WHEN 0 THEN '否' WHEN 1 THEN '无法识别' ELSE '是' END, 'marker', '√')) END,
      'handwritten', CASE WHEN step = 2 AND page % 6 = 0 THEN array(concat('n', page), '') END)"""
    found = "named_struct('type', 't', 'severity', 'info', 'description', concat('d', page), 'ocr_text', '', 'operator', '')"
    lines = t.sql(f"SELECT CAST(job AS string) AS job_id, page, step, a, b, q, item FROM ({_LINES.format("{orders}", "{lineitem}")})").repartition(parts, "job_id").selectExpr("*", f"{step} AS s")
    pages = lines.groupBy("job_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "s"))), lambda x: x["s"]).alias("steps"), F.collect_list(F.year("b").cast("string")).alias("years"))
    pages = pages.selectExpr(
        "job_id", "CAST(page AS int) AS page", "named_struct('title', '', 'file_code', '', 'version', '', 'batch_no', concat(CASE WHEN page % 9 = 0 THEN '77' ELSE '55' END, job_id), 'production_date', CAST(NULL AS string)) AS page_info",
        "map('production', years) AS event_year_groups", "steps", f"CASE WHEN page % 10 = 0 THEN array({found}, {found}) END AS findings", "CASE WHEN page % 8 = 0 THEN 'low' ELSE 'high' END AS overall_confidence",
    )
    kinds = {f.name: f.dataType for f in t.spark.createDataFrame([], PAGES).schema}
    return pages.select(*[(F.col(c) if c in pages.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])


def _parts(t: Tables) -> int:
    """Buckets of about 100,000 steps, which have 600,000 findings; the files' footers tell how many lines there are."""
    return max(t.spark.sparkContext.defaultParallelism, -(-t.lineitem.count() // 100_000))


@query("orch_full_audit", _D_AUDIT)
def orch(t: Tables) -> DataFrame:
    parts = _parts(t)
    found = audit(full_pages(t, parts), 2024, parts=parts).select(*FINGERPRINT, "severity", "rule", "ord")
    return first_of_each(found, placed=True).select("job_id", "page", "type", "severity", "description", "source")


@query("orch_findings_by_rule", _D_AUDIT.rsplit("SELECT job::VARCHAR", 1)[0] + "SELECT rule, count(*) AS n FROM g GROUP BY rule")
def by_rule(t: Tables) -> DataFrame:
    parts = _parts(t)
    return rules_of_first(audit(full_pages(t, parts), 2024, parts=parts), placed=True).groupBy("rule").agg(F.count("*").alias("n"))
