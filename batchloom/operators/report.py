"""Reports of a job's findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.functions.text import SEVERITY_LABELS, STATUS_LABELS, escape_markdown
from batchloom.operators.reads import severity_rank, source_rank

# Signs of severities and states.
_SIGNS = {"critical": "🔴", "warning": "🟡", "info": "🔵"}
_STATES = {"pending": "⏳", "confirmed": "✅", "rejected": "❌", "corrected": "✏️"}


def _label(c, labels: dict):
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in labels.items() for x in p]), c), c)


def report_order() -> list[Column]:
    """The report's order of a job's findings: severities without a rank come first."""
    return [F.col("page"), F.asc_nulls_first(severity_rank(F.col("severity"), None)), source_rank(F.col("source")), F.col("id")]


def report_rows(findings: DataFrame) -> DataFrame:
    """Findings in the report's order."""
    return findings.orderBy(*report_order())


def json_report(jobs: DataFrame, findings: DataFrame) -> DataFrame:
    """``job_id, report``: the job and its ordered findings as JSON text."""
    cols = [c for c in ("id", "page", "type", "severity", "description", "ocr_text", "operator", "source", "status") if c in findings.columns]
    key = F.struct(F.col("page"), F.coalesce(severity_rank(F.col("severity"), None), F.lit(-1)).alias("a"), source_rank(F.col("source")).alias("b"), F.col("id"))
    found = findings.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.struct(*cols).alias("f")))), lambda x: x["f"]).alias("findings"))
    rows = jobs.join(found, jobs.id == found.job_id, "left").withColumn("findings", F.coalesce("findings", F.array()))
    return rows.select(F.col("id").alias("job_id"), F.to_json(F.struct(F.struct("id", "filename", "status").alias("job"), F.size("findings").alias("total"), F.col("findings"))).alias("report"))


def markdown_report(jobs: DataFrame, findings: DataFrame) -> DataFrame:
    """``job_id, report`` as Markdown text, grouped by severity. Excerpts are cut before they are escaped."""
    c = F.col
    cut = lambda x: F.concat(F.lit("`"), escape_markdown(F.substring(x, 1, 100)), F.lit("`"))
    state = F.concat_ws(" ", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in _STATES.items() for x in p]), c("status")), F.lit("")), _label(c("status"), STATUS_LABELS))
    line = F.concat_ws(
        "\n", F.concat(F.lit("- **第"), c("page").cast("string"), F.lit("页** | `"), escape_markdown(c("type")), F.lit("` "), state), F.concat(F.lit("  - "), escape_markdown(c("description"))),
        F.when(c("ocr_text") != "", F.concat(F.lit("  - OCR原文: "), cut(c("ocr_text")))), F.when(c("corrected_text") != "", F.concat(F.lit("  - 修正为: "), cut(c("corrected_text")))), F.when(c("reviewer_note") != "", F.concat(F.lit("  - 审查员备注: "), escape_markdown(c("reviewer_note")))), F.lit(""),
    )
    rows = findings.withColumn("rank", severity_rank(c("severity"), None)).withColumn("line", line)
    key = F.struct("page", source_rank(c("source")).alias("s"), "id", "line")
    groups = rows.filter("rank IS NOT NULL").groupBy("job_id", "rank").agg(F.first("severity").alias("severity"), F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(key)), lambda x: x["line"]).alias("lines"))
    sign = F.element_at(F.create_map(*[F.lit(x) for p in _SIGNS.items() for x in p]), c("severity"))
    block = F.concat(F.lit("### "), sign, F.lit(" "), _label(c("severity"), SEVERITY_LABELS), F.lit(" ("), c("n").cast("string"), F.lit(")\n\n"), F.array_join("lines", "\n"))
    bodies = groups.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n").alias("body"))
    counts = findings.groupBy("job_id").agg(F.count("*").alias("total"), F.count_if(c("status") == "pending").alias("pending"))
    rows = jobs.join(counts, jobs.id == counts.job_id, "left").drop("job_id").join(bodies, jobs.id == bodies.job_id, "left").drop("job_id").na.fill(0, ["total", "pending"])
    end = F.when(c("total") == 0, "✅ 未发现问题，无需人工复核。").when(c("pending") > 0, F.concat(F.lit("⚠️ **"), c("pending").cast("string"), F.lit(" 条 Finding 需人工复核**，请在复核界面确认/拒绝/修正后重新导出。"))).otherwise("✅ 所有 Findings 已处理完毕。")
    head = F.concat(F.lit("# GMP 批生产记录合规检查报告\n\n- **文件名**: "), escape_markdown(c("filename")), F.lit("\n- **总页数**: "), c("total_pages").cast("string"), F.lit("\n- **Job ID**: "), c("id"), F.lit("\n- **总 Findings**: "), c("total").cast("string"), F.lit("\n\n---\n\n## Findings 列表\n"))
    return rows.select(c("id").alias("job_id"), F.concat_ws("\n", head, F.coalesce("body", F.lit("未发现问题。\n")), F.lit("---\n\n## 汇总\n"), end).alias("report"))
