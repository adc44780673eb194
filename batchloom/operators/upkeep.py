"""What people and the pipeline do to jobs: actions and their audit rows, healing of empty pages, notices, evidence counts.

Nothing is changed in place: an action gives a table of outcomes, from which the new jobs, pages, findings and the audit rows
to append follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.functions.text import empty_page
from batchloom.operators.reads import ACTIVE
from batchloom.streaming.lifecycle import allowed

#: State that each action asks for. Archiving is refused for active jobs, whatever the transitions say.
ACTIONS = {"archive": "archived", "unarchive": "review", "retry": "pending", "cancel": "cancelling", "confirm_cancel": "cancelled"}
HEAL_SIZES = (3, 1)
AUDIT = "job_id, action, detail, created_at"


def outcomes(jobs: DataFrame, asks: DataFrame) -> DataFrame:
    """``job_id, action, was, now, done`` of every ask (``job_id, action``) about a known job; refused ones change nothing."""
    want = F.element_at(F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair]), F.col("action"))
    rows = asks.join(jobs.select(F.col("id").alias("job_id"), F.col("status").alias("was")), "job_id").withColumn("want", want)
    done = F.coalesce(allowed(F.col("was"), F.col("want")) & ~((F.col("action") == "archive") & F.col("was").isin(ACTIVE)), F.lit(False))
    return rows.select("job_id", "action", "was", "want", done.alias("done")).withColumn("now", F.when(F.col("done"), F.col("want")).otherwise(F.col("was")))


def after_actions(jobs: DataFrame, done: DataFrame, at: Column) -> DataFrame:
    """Jobs in their new states: a retry forgets error and end, a confirmed cancellation ends now."""
    new = done.filter("done").select(F.col("job_id").alias("id"), F.col("action").alias("_a"), F.col("now").alias("_s"))
    rows = jobs.join(new, "id", "left").withColumn("status", F.coalesce("_s", "status"))
    ended = F.when(F.col("_a") == "retry", None).when(F.col("_a") == "confirm_cancel", at).otherwise(F.col("finished_at"))
    rows = rows.withColumn("finished_at", ended)
    if "error_message" in jobs.columns:
        rows = rows.withColumn("error_message", F.when(F.col("_a") == "retry", None).otherwise(F.col("error_message")))
    return rows.select(*jobs.columns)


def action_audit(done: DataFrame, at: Column) -> DataFrame:
    """The audit rows of actions: made changes, refused ones, and the reset that a retry from review brings."""
    change = F.concat(F.col("was"), F.lit(" → "), F.col("want"))
    rows = done.select("job_id", F.when(F.col("done"), "status_transition").otherwise("status_transition_blocked").alias("action"), change.alias("detail"))
    reset = fresh_starts(done).select("job_id", F.lit("analysis_reset").alias("action"), F.lit("findings and structured results cleared").alias("detail"))
    return rows.union(reset).withColumn("created_at", at)


def fresh_starts(done: DataFrame) -> DataFrame:
    """Retries of finished reviews, which begin their analysis anew; other retries go on where they ended."""
    return done.filter("done AND action = 'retry' AND was = 'review'").select("job_id")


def reset_analysis(pages: DataFrame, findings: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages keep what was recognised and lose what was analysed; findings of these jobs go."""
    mark = fresh.select("job_id", F.lit(True).alias("_fresh"))
    rows = pages.join(mark, "job_id", "left")
    cleared = F.when(F.col("_fresh") & F.col("raw_html").isNotNull(), None).otherwise(F.col("structured_json"))
    return rows.withColumn("structured_json", cleared).select(*pages.columns), findings.join(fresh, "job_id", "left_anti")


def deletion_audit(jobs: DataFrame, gone: DataFrame, at: Column) -> DataFrame:
    """Audit rows that outlive the deleted jobs."""
    rows = jobs.join(gone.select(F.col("job_id").alias("id")), "id", "left_semi")
    detail = F.concat(F.lit("job_id="), F.col("id").cast("string"), F.lit(" filename="), F.col("filename"), F.lit(" status="), F.col("status"))
    return rows.select(F.lit("_system").alias("job_id"), F.lit("job_deleted").alias("action"), detail.alias("detail")).withColumn("created_at", at)


def append_audit(rows: DataFrame, path: str) -> None:
    """Append audit rows to the audit table; rows are never rewritten."""
    rows.write.mode("append").parquet(path)


def last_audit(rows: DataFrame, limit: int, newest: bool = True) -> DataFrame:
    """At most ``limit`` audit rows a job: the newest of changes, the oldest of model calls (``newest=False``)."""
    order = Window.partitionBy("job_id").orderBy(F.desc("id") if newest else F.asc("id"))
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")


def heal_batches(pages: DataFrame, again: int = 0) -> DataFrame:
    """``job_id, batch, pages``: empty pages in page order, to be read again three at a time, and in the second round (``again``
    = 1, over the pages as the first left them) one at a time."""
    size = HEAL_SIZES[again]
    nth = F.row_number().over(Window.partitionBy("job_id").orderBy("page")) - 1
    rows = pages.filter(empty_page(F.coalesce("raw_html", F.lit("")))).select("job_id", "page", F.floor(nth / size).cast("int").alias("batch"))
    return rows.groupBy("job_id", "batch").agg(F.array_sort(F.collect_list("page")).alias("pages"))


def healed(pages: DataFrame, read: DataFrame) -> DataFrame:
    """Pages after a round: what was read again (``job_id, page, html``) and is not empty replaces the text, and the analysis of
    that page goes."""
    good = read.filter(~empty_page(F.coalesce("html", F.lit("")))).select("job_id", "page", F.col("html").alias("_h"))
    rows = pages.join(good, ["job_id", "page"], "left")
    return rows.withColumn("structured_json", F.when(F.col("_h").isNull(), F.col("structured_json"))).withColumn("raw_html", F.coalesce("_h", "raw_html")).select(*pages.columns)


def notices(events: DataFrame, sent: DataFrame) -> DataFrame:
    """One notice for each job and state that none was sent for yet."""
    return events.select("job_id", "status").distinct().join(sent.select("job_id", "status"), ["job_id", "status"], "left_anti")


def value_source_coverage(pages: DataFrame) -> DataFrame:
    """How many parameters and cells of a job say where their value comes from, and how many pages carry recognition signals."""
    steps = F.coalesce("steps", F.array().cast(pages.schema["steps"].dataType))
    many = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, n: a + n)
    said = lambda c: F.coalesce(F.size(F.filter(c, lambda x: x["value_source"] != "")), F.lit(0)).cast("long")
    count = lambda c: F.when(c.isNull(), 0).otherwise(F.size(c)).cast("long")
    cells = lambda m: F.flatten(F.transform(F.filter(m, lambda x: x["values"].isNotNull()), lambda x: x["values"]))
    rows = pages.select(
        "job_id", many(F.transform(steps, lambda s: count(s["parameters"]))).alias("p"), many(F.transform(steps, lambda s: said(s["parameters"]))).alias("pv"),
        many(F.transform(steps, lambda s: count(cells(s["measurements"])))).alias("c"), many(F.transform(steps, lambda s: said(cells(s["measurements"])))).alias("cv"),
        (F.coalesce(F.size("low_conf_cols"), F.lit(0)) > 0).alias("signal"),
    )
    sums = [F.sum(a).alias(b) for a, b in (("p", "parameters"), ("pv", "parameters_with"), ("c", "cells"), ("cv", "cells_with"))]
    return rows.groupBy("job_id").agg(*sums, F.count_if("signal").alias("signal_pages"), F.count("*").alias("pages"))


def first_of_list(items: Column, n: int) -> Column:
    """The first few of a list, as notes show them (eight suspects, five errors)."""
    return F.slice(F.coalesce(items, F.array().cast("array<string>")), 1, n)


def without_private(jobs: DataFrame, columns: tuple[str, ...] = ("pdf_path",)) -> DataFrame:
    """Jobs as lists show them."""
    return jobs.drop(*columns)


# How user rules are introduced to a model.
RULES_HEAD = "<USER_RULES>\n用户自定义合规规则（必须逐条核对记录是否满足，违反时输出 type=user_rule 的 finding，按影响定级，rule_id 照抄对应规则 ID）：\n"
RULES_TAIL = "\n</USER_RULES>"
RULE_LENGTH, RULES_LENGTH = 1000, 8000


def rules_section(rules: DataFrame, key: str = "owner") -> DataFrame:
    """``owner, section, hash``: active rules with a text (``owner, pos, id, text, active``) as a section for a model, and the
    first eight digits of its MD5. An owner without such rules has an empty section and the hash ``none``."""
    good = rules.withColumn("_t", F.trim("text")).filter("coalesce(active, false) AND _t <> ''")
    line = F.concat(F.lit("- [规则ID: "), F.coalesce("id", F.lit("?")), F.lit("] "), F.col("text"))
    lines = good.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]).alias("lines"))
    rows = rules.select(key).distinct().join(lines, key, "left").withColumn("section", F.when(F.col("lines").isNull(), "").otherwise(F.concat(F.lit(RULES_HEAD), F.array_join("lines", "\n"), F.lit(RULES_TAIL))))
    return rows.select(key, "section", F.when(F.col("section") == "", "none").otherwise(F.substring(F.md5(F.col("section").cast("binary")), 1, 8)).alias("hash"))


def accepted_rules(rules: DataFrame, key: str = "owner") -> DataFrame:
    """Rules within the limits: a rule of 1,000 characters, and as many in order as stay within 8,000 together."""
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rules.filter(F.length("text") <= RULE_LENGTH).withColumn("_n", F.sum(F.length("text")).over(order)).filter(F.col("_n") <= RULES_LENGTH).drop("_n")


#: Rules that an owner may have, and characters of an audit row's detail.
MOST_RULES, DETAIL_CHARS = 100, 500


def saved_rules(rules: DataFrame, at: Column, key: str = "owner") -> tuple[DataFrame, DataFrame]:
    """What stays of rule lists that owners save whole (``owner, pos, text, active``), and an audit row for each saving:
    ``owner, action, detail, created_at``. A list with a blank or too long rule, too many rules or characters is refused whole,
    and the row says why."""
    c = F.col
    rows = rules.withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")).withColumn("n_", F.row_number().over(Window.partitionBy(key).orderBy("pos")))
    # The messages about what is wrong.
    said = F.when(c("text") == "", "内容不能为空").when(F.length("text") > RULE_LENGTH, f"内容超过 {RULE_LENGTH} 字符上限")
    error = F.when(said.isNotNull(), F.struct("n_", F.concat(F.lit("规则 #"), c("n_").cast("string"), F.lit(": "), said).alias("said")))
    fine = said.isNull()
    lists = rows.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(error)), lambda x: x["said"]).alias("errors"), F.count_if(fine).alias("n"), F.coalesce(F.sum(F.when(fine, F.length("text"))), F.lit(0)).alias("chars"), F.count_if(fine & c("active")).alias("active"),
    )
    many = F.when(c("n") > MOST_RULES, f"规则总数超过 {MOST_RULES} 条上限")
    long = F.when(c("chars") > RULES_LENGTH, F.concat(F.lit(f"规则总字数超过 {RULES_LENGTH} 字符上限（当前 "), c("chars").cast("string"), F.lit(" 字符，全部规则会注入分析提示词，过长会超出模型上下文）")))
    lists = lists.withColumn("errors", F.concat("errors", F.array_compact(F.array(many, long))))
    good = F.size("errors") == 0
    detail = F.when(good, F.concat(c("n").cast("string"), F.lit(" rules (active="), c("active").cast("string"), F.lit(")"))).otherwise(F.left(F.array_join("errors", "; "), F.lit(DETAIL_CHARS)))
    audit = lists.select(key, F.when(good, "user_rules_update").otherwise("user_rules_update_failed").alias("action"), detail.alias("detail"), at.alias("created_at"))
    return rows.join(lists.filter(good).select(key), key, "left_semi").drop("n_"), audit


def blocked_host(url: Column) -> Column:
    """Whether an address is no public http(s) one: another scheme, no host, this machine, or a private, link-local or
    unspecified number (dotted, decimal, hexadecimal or octal)."""
    url = F.lower(F.trim(url))
    host = F.regexp_replace(F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1), r"^\[|\]$", "")
    octet = lambda k: F.split_part(host, F.lit("."), F.lit(k)).try_cast("bigint")
    dotted = F.when(host.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), ((octet(1) * 256 + octet(2)) * 256 + octet(3)) * 256 + octet(4))
    number = (
        F.when(host.rlike("^0x[0-9a-f]{1,8}$"), F.conv(F.substring(host, 3, 8), 16, 10)).when(host.rlike("^0o?[0-7]{1,11}$"), F.conv(F.regexp_replace(host, "^0o?", ""), 8, 10)).when(host.rlike("^[1-9][0-9]{0,9}$"), host)
    ).try_cast("bigint")
    ip = F.coalesce(dotted, F.when(number < (1 << 32), number))
    inside = lambda a, bits: F.shiftright(ip, 32 - bits) == (a >> (32 - bits))
    # Networks that are not public.
    nets = [(0, 8), (10 << 24, 8), (127 << 24, 8), (0xA9FE0000, 16), (0xAC100000, 12), (0xC0A80000, 16), (0xC0000000, 29), (0xC00000AA, 31), (0xC0000200, 24), (0xC6120000, 15), (0xC6336400, 24), (0xCB007100, 24), (0xF0000000, 4)]
    private = F.lit(False)
    for a, bits in nets:
        private |= inside(a, bits)
    named = host.rlike(r"^(localhost|.*\.localhost)$") | host.rlike(r"^(169\.254\.|127\.|10\.|192\.168\.|0\.0\.0\.0)") | host.rlike(r"^(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)$")
    return F.coalesce(~url.rlike("^https?://") | (host == "") | named | F.coalesce(private, F.lit(False)), F.lit(True))
