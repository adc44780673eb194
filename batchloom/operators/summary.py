"""Summaries of a job's pages for a model: lines of pages in two widths, then whole lines up to the budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.operators.reads import summary
from batchloom.schema import PAGES

#: Characters of an operation, cells of a measurement and findings of a page: in full, and compressed.
FULL, COMPRESSED = (60, 4, 5), (24, 2, 2)


def _said(label: str, c: Column) -> Column:
    return F.when(c != "", F.concat(F.lit(label), c)).otherwise("")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def mapping_text(c: Column) -> Column:
    """A map of lists as the lines show it: ``{'review': [2015, 'x']}``; whole numbers stand without quotes."""
    item = lambda y: F.when(y.isNull(), "None").when(y.rlike(r"^-?\d+$"), y).otherwise(F.concat(F.lit("'"), y, F.lit("'")))
    entry = lambda e: F.concat(F.lit("'"), e["key"], F.lit("': ["), F.array_join(F.transform(F.coalesce(e["value"], F.array().cast("array<string>")), item), ", "), F.lit("]"))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(c), entry), ", "), F.lit("}"))


def _page_lines(width: tuple[int, int, int]) -> Column:
    """The lines of a page, in order."""
    # The labels of all lines below.
    op_len, n_cells, n_findings = width
    none = F.array().cast("array<string>")
    info = F.col("page_info")
    head = F.array(
        F.concat(F.lit("--- 第"), F.col("page").cast("string"), F.lit("页 ---")), F.when(info["title"] != "", F.concat(F.lit("  标题: "), info["title"])), F.when(info["production_date"] != "", F.concat(F.lit("  生产日期: "), info["production_date"])),
        F.when(info["batch_no"] != "", F.concat(F.lit("  批号: "), info["batch_no"])), F.when(F.size("event_year_groups") > 0, F.concat(F.lit("  事件年份分组: "), mapping_text(F.col("event_year_groups")))),
    )

    def parameter(p: Column) -> Column:
        return F.when(p["value"] != "", F.concat(F.lit(" | "), _text(p["name"]), F.lit(":"), p["value"], _text(p["unit"]))).otherwise("")

    def measured(m: Column) -> Column:
        cells = F.transform(F.slice(m["values"], 1, n_cells), lambda v: F.concat(v["col"], F.lit("="), _text(v["actual"])))
        return F.concat(F.lit("    @ "), _text(m["time"]), F.lit(" | "), F.coalesce(F.array_join(cells, ", "), F.lit("")), F.when(F.size(m["values"]) > n_cells, " ...").otherwise(""))

    def signed(s: Column) -> Column:
        return F.concat(F.lit("    签名: "), _text(s["role"]), F.lit("|"), _text(s["name"]), F.lit("|"), _text(s["sign_time"]))

    def step(s: Column) -> Column:
        line = F.concat(
            F.lit("  步骤"), F.coalesce(s["step_no"], F.lit("?")), F.lit(": "), F.substring(_text(s["operation"]), 1, op_len), _said(" | 开始:", s["start_time"]), _said(" | 结束:", s["end_time"]),
            _said(" | 操作人:", s["operator"]), _said(" | 复核人:", s["reviewer"]), F.coalesce(F.array_join(F.transform(s["parameters"], parameter), ""), F.lit("")),
        )
        return F.concat(F.array(line), F.coalesce(F.transform(s["measurements"], measured), none), F.coalesce(F.transform(s["signatures"], signed), none))

    steps = F.coalesce(F.flatten(F.transform("steps", step)), none)
    some = F.transform(F.slice("findings", 1, n_findings), lambda f: F.concat(F.lit("    - ["), _text(f["type"]), F.lit("] "), F.substring(_text(f["description"]), 1, 80)))
    found = F.when(F.size("findings") > 0, F.concat(F.array(F.concat(F.lit("  已抓 findings ("), F.size("findings").cast("string"), F.lit(" 条):"))), some)).otherwise(none)
    return F.filter(F.concat(head, steps, found), lambda x: x.isNotNull())


def _lines(pages: DataFrame, lines: Column) -> DataFrame:
    return pages.select("job_id", "page", F.posexplode(lines).alias("pos", "line")).select("job_id", F.struct("page", "pos").alias("ord"), "line")


def summary_lines(pages: DataFrame, width: tuple[int, int, int] = FULL) -> DataFrame:
    """``job_id, ord, line`` of all pages (the columns of ``schema.PAGES``); ``ord`` orders a job's lines."""
    return _lines(pages, _page_lines(width))


def page_summary(pages: DataFrame, cap: int) -> DataFrame:
    """``job_id, text``: a job's lines in full if they fit into ``cap`` characters, else compressed, else as many whole
    compressed lines as fit, with a note. Pages are read once; short lines are made only where full ones do not fit."""
    rows = pages.withColumn("full", _page_lines(FULL))
    size = F.aggregate("full", F.lit(0).cast("bigint"), lambda n, x: n + F.length(x) + 1)
    rows = rows.withColumn("size", F.sum(size).over(Window.partitionBy("job_id")) - 1)
    return summary(_lines(rows, F.when(F.col("size") <= cap, F.col("full")).otherwise(_page_lines(COMPRESSED))), cap)


__all__ = ["COMPRESSED", "FULL", "PAGES", "page_summary", "summary_lines"]
