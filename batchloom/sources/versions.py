"""Tables that were written by several versions of the schema, read as one.

A folder holds ``version=N`` folders, each with the columns of its time. A reader gives every version the columns that came
later, with their defaults, widens types, and rebuilds what a later version made unique: of findings that share a fingerprint
the one with the smallest id stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.schema import FINGERPRINT

# Columns by the version that brought them, and what rows from before it have there.
JOBS = {
    0: "id string, filename string, status string, pdf_path string, total_pages int, error_message string, created_at timestamp, finished_at timestamp",
    1: "failed_pages string, stage1_ms bigint, stage2_ms bigint, stage3_ms bigint, ocr_progress string", 2: "ocr_backend_used string", 3: "md5 string",
}
FINDINGS = {
    0: "id bigint, job_id string, page int, type string, severity string, description string, ocr_text string, operator string, status string, reviewer_note string, corrected_text string, created_at timestamp, reviewed_at timestamp",
    1: "source string", 4: "user_rule_id string",
}
DEFAULTS = {"source": "rule"}
LATEST = 5
#: The version from which fingerprints are unique.
UNIQUE_FROM = 5


def columns(history: dict[int, str], version: int = LATEST) -> T.StructType:
    """The columns that a version has."""
    from pyspark.sql.types import _parse_datatype_string

    return T.StructType([f for v, some in history.items() if v <= version for f in _parse_datatype_string(some).fields])


def upgraded(rows: DataFrame, history: dict[int, str], version: int) -> DataFrame:
    """Rows of a version with the latest columns, in order and type. A column that its version should have and a file lacks is
    null, like the columns that came later; only those without a value from before get the default."""
    known = {c.lower() for c in rows.columns}
    own = {f.name for f in columns(history, version).fields}
    value = lambda f: F.col(f.name) if f.name in known else F.lit(None if f.name in own else DEFAULTS.get(f.name))
    return rows.select(*[value(f).cast(f.dataType).alias(f.name) for f in columns(history).fields])


def versions_of(spark: SparkSession, path: str) -> list[int]:
    """The versions that a folder holds (one small listing)."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = found.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(found):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(found)]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and n.removeprefix("version=").isdigit())


def read_versions(spark: SparkSession, path: str, history: dict[int, str]) -> DataFrame:
    """All rows of a folder with the latest columns; newer versions than this reader knows are refused."""
    found = versions_of(spark, path)
    if found and found[-1] > LATEST:
        raise ValueError(f"{path} has version {found[-1]}, this reader knows {LATEST}")
    parts = [upgraded(spark.read.option("mergeSchema", "true").parquet(f"{path}/version={v}"), history, v) for v in found]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], columns(history))


def first_of_fingerprint(findings: DataFrame) -> DataFrame:
    """One row for each fingerprint, the one with the smallest id (null parts of a fingerprint are equal); rows are combined
    before they are shuffled."""
    rest = [c for c in findings.columns if c not in FINGERPRINT]
    kept = findings.groupBy(*FINGERPRINT).agg(F.min_by(F.struct(*rest), "id").alias("kept"))
    return kept.select(*[F.col(c) if c in FINGERPRINT else F.col(f"kept.{c}").alias(c) for c in findings.columns])


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return first_of_fingerprint(read_versions(spark, path, FINDINGS))


def rewrite(spark: SparkSession, path: str, target: str, history: dict[int, str]) -> None:
    """Write a folder of several versions as one of the latest."""
    rows = read_versions(spark, path, history)
    (first_of_fingerprint(rows) if history is FINDINGS else rows).write.parquet(f"{target}/version={LATEST}")
