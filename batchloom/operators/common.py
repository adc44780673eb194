"""What the rules share: steps with parsed times, and the shape of a finding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.functions.dates import filled, interval, settled, step_key, with_times
from batchloom.schema import CHECK, MEASUREMENT, PARAMETER, RULES, SIGNATURE

COLUMNS = ["job_id", "page", "type", "severity", "description", "ocr_text", "operator", "source", "rule_id", "rule", "ord"]


#: Columns of a step that may be missing where steps come from a flat table.
OPTIONAL = {
    "operation": "string", "operator": "string", "reviewer": "string", "start_time": "string", "end_time": "string", "date": "string",
    "parameters": f"array<{PARAMETER}>", "measurements": f"array<{MEASUREMENT}>", "signatures": f"array<{SIGNATURE}>", "checks": f"array<{CHECK}>", "handwritten": "array<string>",
}


def timed(rows: DataFrame) -> DataFrame:
    """Flat steps (``job_id, page, pos, step_no`` and what they have of the other columns) with their times parsed."""
    undated = "date" not in rows.columns
    rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in rows.columns})
    rows = rows.withColumn("dated", F.lit(False) if undated else filled(F.col("date")))
    rows = rows.withColumn("fallback", F.lit(None).cast("timestamp_ntz")) if undated else with_times(rows, fallback=(F.col("date"), None, None))
    rows = with_times(rows, **{f"{name}_at": (F.col(f"{name}_time"), F.col("fallback"), F.col("dated")) for name in ("start", "end")})
    rows = settled(rows, **{f"{name}_iv": interval(F.col(f"{name}_time"), F.col(f"{name}_at")) for name in ("start", "end")})
    return rows.withColumn("key", step_key(F.col("step_no"))).withColumn("no", F.coalesce("step_no", F.lit("?")))


def steps_of(pages: DataFrame) -> DataFrame:
    """One row a step of nested pages, with its place, its page's date and its parsed times."""
    rows = pages.select("job_id", "page", F.col("page_info")["production_date"].alias("date"), F.posexplode("steps").alias("pos", "step"))
    return timed(rows.select("job_id", "page", "date", "pos", "step.*"))


def text(*parts: Column | str) -> Column:
    """Parts joined; null parts count as empty, strings are literal."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def head(c: Column, n: int) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, n)


def place(*parts: Column) -> Column:
    """A sortable text of non-negative whole numbers."""
    return F.concat_ws(".", *[F.lpad(p.cast("string"), 9, "0") for p in parts])


def finding(rule: str, kind: Column | str, severity: Column | str, description: Column, ocr_text: Column, ord: Column, operator: Column | str = "", source: str = "rule") -> list[Column]:
    """The columns of a finding on a row with ``job_id`` and ``page``."""
    value = lambda c: F.lit(c) if isinstance(c, str) else c
    return [
        F.col("job_id"), F.col("page").cast("int").alias("page"), value(kind).alias("type"), value(severity).alias("severity"), description.alias("description"), ocr_text.alias("ocr_text"),
        F.coalesce(value(operator), F.lit("")).alias("operator"), F.lit(source).alias("source"), F.lit(None).cast("string").alias("rule_id"), F.lit(RULES.index(rule)).alias("rule"), ord.alias("ord"),
    ]


def findings(rows: DataFrame, *args: Column | str, **more: Column | str) -> DataFrame:
    """One finding a row (see ``finding``)."""
    return rows.select(*finding(*args, **more))


def findings_where(rows: DataFrame, *cases: tuple[Column, list[Column]]) -> DataFrame:
    """The findings of every case whose condition holds on a row, from one pass over the rows."""
    rows = rows.filter(F.coalesce(reduce(Column.__or__, [condition for condition, _ in cases]), F.lit(False)))  # most rows have none
    some = F.array_compact(F.array(*[F.when(condition, F.struct(*columns[1:])) for condition, columns in cases]))
    return rows.select("job_id", F.inline(some))  # the job's own column, so that rows placed by it are known to be


def float_text(c: Column) -> Column:
    """A double as the messages show it: whole numbers with ".0", never in exponent form below 10**15."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, F.concat(c.cast("bigint").cast("string"), F.lit(".0"))).otherwise(c.cast("string"))


def list_text(c: Column, quoted: bool = False) -> Column:
    """An array as the messages show it: ``[2015, 2016]``, or ``['a', 'b']``."""
    if quoted:
        return F.when(F.size(c) > 0, F.concat(F.lit("['"), F.concat_ws("', '", c), F.lit("']"))).otherwise("[]")
    return F.concat(F.lit("["), F.concat_ws(", ", F.transform(c, lambda x: x.cast("string"))), F.lit("]"))
