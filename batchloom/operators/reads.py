"""Reads and writes over jobs, pages, findings and audit rows. Nothing is changed in place: an update gives a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.schema import SEVERITIES, SOURCES

ACTIVE = ["pending", "ocr_running", "ocr_done", "analyzing", "cancelling"]
FINDING_STATUSES = ["pending", "confirmed", "rejected", "corrected"]


def severity_rank(c: Column, unknown: int | None = 3) -> Column:
    """0 for critical, 1, 2; ``unknown`` for others (None: null, which sorts first)."""
    return F.when(c == SEVERITIES[0], 0).when(c == SEVERITIES[1], 1).when(c == SEVERITIES[2], 2).otherwise(F.lit(unknown).cast("int"))


def source_rank(c: Column, missing_is_rule: bool = True) -> Column:
    c = F.coalesce(c, F.lit("rule")) if missing_is_rule else F.coalesce(c, F.lit("?"))
    out = F.lit(len(SOURCES))
    for k, name in enumerate(SOURCES):
        out = F.when(c == name, k).otherwise(out)
    return out


def list_findings(findings: DataFrame, page: int | None = None, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One job's findings in review order; a page filter takes the place of a status filter."""
    limit, offset = clamped(limit, offset)
    rows = findings.filter(F.col("page") == page) if page else findings.filter(F.col("status") == status) if status else findings
    order = [*([] if page else ["page"]), *_review_order()]
    return rows.orderBy(*order).offset(offset).limit(limit)


def clamped(limit: int, offset: int) -> tuple[int, int]:
    return max(1, min(limit, 200)), max(0, offset)


def _review_order() -> list[Column | str]:
    return [severity_rank(F.col("severity")), source_rank(F.col("source")), "id"]


def listed_by_page(findings: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """``list_findings`` of every page of every job at once: the rows of each, with their place ``nth`` in review order."""
    limit, offset = clamped(limit, offset)
    nth = F.row_number().over(Window.partitionBy("job_id", "page").orderBy(*_review_order()))
    return findings.withColumn("nth", nth).filter((F.col("nth") > offset) & (F.col("nth") <= offset + limit))


def more_findings(findings: DataFrame, limit: int, offset: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """``total, has_more`` (of each job, with ``keys``): the total counts all findings of the job, whatever the filter."""
    return findings.groupBy(*keys).agg(F.count("*").alias("total")).withColumn("has_more", F.lit(offset + limit) < F.col("total"))


def page_total(jobs: DataFrame, page_size: int = 20) -> DataFrame:
    """``total_jobs, total_pages`` of the list that ``newest_jobs`` pages through; an empty list has one page."""
    size = max(1, min(page_size, 100))
    counted = jobs.filter("status <> 'archived'").agg(F.count("*").alias("total_jobs"))
    return counted.withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total_jobs") / size)).cast("int"))


def reusable(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """``job_id, read, reuse``: whether every page of a job (``total_pages``; unknown or 0: none can be reused) has been read, so
    that reading can be left out when the job goes on."""
    read = pages.filter("raw_html IS NOT NULL").groupBy("job_id").agg(F.count_distinct("page").alias("read"))
    rows = jobs.select(F.col("id").alias("job_id"), "total_pages").join(read, "job_id", "left")
    read = F.coalesce("read", F.lit(0))
    return rows.select("job_id", read.alias("read"), F.coalesce((F.col("total_pages") > 0) & (read >= F.col("total_pages")), F.lit(False)).alias("reuse"))


def told_before(audit: DataFrame, action: str, status: Column | str) -> DataFrame:
    """``job_id`` of the jobs whose audit rows say that a notice of the state was delivered."""
    status = F.lit(status) if isinstance(status, str) else status
    said = F.contains(F.col("detail"), F.concat(F.lit("status="), status, F.lit(" ok=True")))
    return audit.filter((F.col("action") == action) & said).select("job_id").distinct()


def in_page_order(findings: DataFrame) -> DataFrame:
    """A page's findings in the order in which they are shown: by source (one without a source comes last), then id; ``nth``
    counts from 1 on each page."""
    return findings.withColumn("nth", F.row_number().over(Window.partitionBy("job_id", "page").orderBy(source_rank(F.col("source"), missing_is_rule=False), "id")))


def page_counts(findings: DataFrame, keys: tuple = ("job_id", "page")) -> DataFrame:
    """Findings by severity for each page; unknown severities count in the total only."""
    return findings.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count("*").alias("total"))


def job_counts(jobs: DataFrame, pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Progress of every job from one aggregation a table."""
    done = pages.groupBy("job_id").agg(F.count_if(F.col("raw_html").isNotNull()).alias("pages_read"), F.count_if(F.col("structured_json").isNotNull() & F.coalesce(F.get_json_object("structured_json", "$._parse_error") != "true", F.lit(True))).alias("pages_analyzed"))
    found = findings.groupBy("job_id").agg(F.count("*").alias("findings"), F.count_if(F.col("status") == "pending").alias("pending"))
    rows = jobs.join(done, jobs.id == done.job_id, "left").drop("job_id").join(found, jobs.id == found.job_id, "left").drop("job_id")
    return rows.na.fill(0, ["pages_read", "pages_analyzed", "findings", "pending"])


def newest_jobs(jobs: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    """A page of jobs that are not archived, newest first (ids break ties)."""
    page, page_size = max(1, page), max(1, min(page_size, 100))
    return jobs.filter("status <> 'archived'").orderBy(F.desc("created_at"), "id").offset((page - 1) * page_size).limit(page_size)


def live_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Active jobs, and those that ended less than ten minutes ago and are not archived."""
    recent = (F.col("status") != "archived") & (F.col("finished_at") > now - F.expr("INTERVAL 10 MINUTES"))
    return jobs.filter(F.col("status").isin(ACTIVE) | F.coalesce(recent, F.lit(False)))


def overview(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count("*").alias("total"), F.count_if(F.col("status") != "archived").alias("active"), (F.count("*") - F.count_if(F.col("status") != "archived")).alias("archived"))


def first_by_key(rows: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """The row with the smallest ``order`` for each key: duplicates of a fingerprint go. Rows are combined before they are
    shuffled, so a key of many rows is one row a task."""
    rest = [c for c in rows.columns if c not in keys]
    kept = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("kept_"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"kept_.{c}").alias(c) for c in rows.columns])


#: Ids of a range in which rows of one content are ordered.
ID_RANGE = 100_000


def same_content(files: DataFrame) -> DataFrame:
    """For each file (ids are whole numbers), the newest earlier file with the same content hash that is not archived.

    Hashes that one file has drop out first. Rows of a hash are ordered inside ranges of ids; what a range takes over from those
    before it comes from a small table of ranges, so a hash of many files, like that of the empty one, is no single task.
    """
    several = files.groupBy("md5").agg(F.count("*").alias("n_")).filter("n_ > 1").drop("n_")
    live = F.when(F.col("status") != "archived", F.col("id"))
    rows = files.join(several, "md5").withColumn("range_", F.floor(F.col("id") / ID_RANGE))
    upto = rows.groupBy("md5", "range_").agg(F.max(live).alias("live_"))
    before = Window.partitionBy("md5").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    upto = upto.select("md5", "range_", F.max("live_").over(before).alias("before_"))
    inside = Window.partitionBy("md5", "range_").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own_", F.max(live).over(inside)).join(upto, ["md5", "range_"])
    return rows.withColumn("same_as", F.coalesce("own_", "before_")).filter("same_as IS NOT NULL").select(*files.columns, "same_as")


def missing_pages(jobs: DataFrame, received: DataFrame) -> DataFrame:
    """``job_id, page`` from 1 to a job's ``total_pages`` that were not received."""
    return jobs.select("job_id", F.explode(F.sequence(F.lit(1), "total_pages")).alias("page")).join(received.select("job_id", "page"), ["job_id", "page"], "left_anti")


def fails_over(pages: Column, total: Column) -> Column:
    """No pages, or more missing than two and a tenth of all."""
    return (pages == 0) | (total - pages > F.greatest(F.lit(2), F.floor(total * 0.1)))


#: Characters of a reviewer's note or correction.
NOTE_CHARS = 2000


def review_outcomes(findings: DataFrame, updates: DataFrame) -> DataFrame:
    """``id, job_id, was, status, reviewer_note, corrected_text, refused`` of every update (null fields: unchanged). ``refused``
    is null for what is done, else why not: ``status``, ``too long``, ``not found``, ``nothing``."""
    c = F.col
    long = F.coalesce(F.length("reviewer_note") > NOTE_CHARS, F.lit(False)) | F.coalesce(F.length("corrected_text") > NOTE_CHARS, F.lit(False))
    rows = updates.select("id", "status", "reviewer_note", "corrected_text").join(findings.select("id", "job_id", c("status").alias("was")), "id", "left")
    given = F.coalesce(c("status") != "", F.lit(False))
    none = ~given & c("reviewer_note").isNull() & c("corrected_text").isNull()
    refused = F.when(given & ~c("status").isin(FINDING_STATUSES), "status").when(long, "too long").when(c("was").isNull() & c("job_id").isNull(), "not found").when(none, "nothing")
    return rows.withColumn("refused", refused).withColumn("status", F.when(given, c("status"))).select("id", "job_id", "was", "status", "reviewer_note", "corrected_text", "refused")


def apply_updates(findings: DataFrame, updates: DataFrame, at: Column) -> DataFrame:
    """Findings after updates ``id, status, reviewer_note, corrected_text`` (null: unchanged), those left out that
    ``review_outcomes`` refuses. ``reviewed_at`` is set, or cleared where a finding goes back to pending."""
    new = review_outcomes(findings, updates).filter("refused IS NULL").select("id", F.col("status").alias("_s"), F.col("reviewer_note").alias("_n"), F.col("corrected_text").alias("_c"))
    rows = findings.join(new, "id", "left")
    reviewed = F.when(F.col("_s") == "pending", None).when(F.col("_s").isNotNull(), at).otherwise(F.col("reviewed_at"))
    rows = rows.withColumn("reviewed_at", reviewed).withColumn("status", F.coalesce("_s", "status")).withColumn("reviewer_note", F.coalesce("_n", "reviewer_note")).withColumn("corrected_text", F.coalesce("_c", "corrected_text"))
    return rows.drop("_s", "_n", "_c")


def update_audit(outcomes: DataFrame, at: Column) -> DataFrame:
    """``job_id, finding_id, action, detail, created_at``: an audit row of each change, and of each refused one."""
    c = F.col
    quoted = lambda label, name: F.when(c(name).isNotNull(), F.concat(F.lit(f"{label}: '"), F.left(name, F.lit(50)), F.lit("'")))
    said = F.concat_ws("; ", F.when(c("status").isNotNull(), F.concat(F.lit("status: "), F.coalesce("was", F.lit("")), F.lit(" → "), "status")), quoted("note", "reviewer_note"), quoted("corrected", "corrected_text"))
    done = c("refused").isNull()
    return outcomes.select("job_id", c("id").alias("finding_id"), F.when(done, "finding_update").otherwise("finding_update_refused").alias("action"), F.when(done, said).otherwise(c("refused")).alias("detail"), at.alias("created_at"))


def replace_pending(findings: DataFrame, job_ids: DataFrame, new: DataFrame) -> DataFrame:
    """Before an analysis runs again, a job's unreviewed model findings go; reviewed ones and the rules' own stay."""
    gone = findings.join(job_ids, "job_id", "left_semi").filter((F.col("status") == "pending") & F.col("source").startswith("llm"))
    return findings.join(gone.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def without_jobs(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of deleted jobs (``job_id``)."""
    return {name: t.join(gone.select(F.col("job_id").alias("id" if name == "jobs" else "job_id")), "id" if name == "jobs" else "job_id", "left_anti") for name, t in tables.items()}


def rule_hits(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """How often each user rule was hit (0 for none)."""
    hits = findings.filter("user_rule_id IS NOT NULL").groupBy("user_rule_id").agg(F.count("*").alias("hits"))
    return rules.join(hits, rules.id == hits.user_rule_id, "left").select(rules["*"], F.coalesce("hits", F.lit(0)).alias("hits"))


def user_rules(rows: DataFrame, limit: int = 100) -> DataFrame:
    """``id, text, active`` of the first ``limit`` rules with a text (``pos, json``), active unless they say otherwise."""
    rows = rows.filter(F.col("json").startswith("{")).select("pos", F.get_json_object("json", "$.id").alias("id"), F.trim(F.get_json_object("json", "$.text")).alias("text"), F.coalesce(F.get_json_object("json", "$.active").try_cast("boolean"), F.lit(True)).alias("active"))
    return rows.filter("text <> ''").orderBy("pos").limit(limit).drop("pos")


def matrix(cells: DataFrame) -> DataFrame:
    """Measurement columns of a page in first-seen order: ``job_id, page, columns``."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "row_pos", "cell_pos", "col")))
    return cells.groupBy("job_id", "page").agg(F.array_distinct(F.transform(ordered, lambda x: x["col"])).alias("columns"))


def summary(lines: DataFrame, cap: int) -> DataFrame:
    """``job_id, text``: whole lines (``job_id, ord, line``) up to ``cap`` characters with their breaks, then a note of what
    was left out."""
    upto = Window.partitionBy("job_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("job_id")
    rows = lines.withColumn("upto", F.sum(F.length("line") + 1).over(upto)).withColumn("all", F.sum(F.length("line") + 1).over(every) - 1).withColumn("n", F.count("*").over(every))
    kept = (F.col("all") <= cap) | (F.col("upto") <= cap)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("ord", "line")))), lambda x: x["line"]), "\n")
    jobs = rows.groupBy("job_id").agg(text.alias("text"), F.count_if(kept).alias("k"), F.first("n").alias("n"))  # one pass: lines are not made again
    note = F.concat(F.lit("## 内容过长已截断：仅完整展示 "), F.col("k").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" 行，之后页面内容未注入，跨页分析可能缺失，需人工复核"))
    return jobs.select("job_id", F.when(F.col("k") < F.col("n"), F.concat_ws("\n", F.when(F.col("k") > 0, F.col("text")), note)).otherwise(F.col("text")).alias("text"))


def summary_cap(window: int) -> int:
    """Characters of a summary for a model's context window in tokens."""
    return max(8000, int((window if window > 0 else 128_000) * 0.35 * 1.6))
