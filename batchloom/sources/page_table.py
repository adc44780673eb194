"""A table of pages with one row a key: rows are added unless their key is there, and fields of known keys are replaced.

The table is Parquet, partitioned by a bucket of the job's hash; a write reads and rewrites only the buckets it touches, by
Spark's dynamic overwrite of partitions. The new state of these buckets is first written aside, whole: if a write dies before
that is done, the table is as it was; if it dies later, the next write (or ``settle``) overwrites from there once more. Both
writes may be repeated at will. There is one writer at a time, as there is for a streaming query; readers call
``read_pages`` between writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

KEYS = ["job_id", "page"]
BUCKETS = 64
SCHEMA = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("raw_html", T.StringType()), T.StructField("structured_json", T.StringType())])
_ASIDE = "_pending"


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _there(spark: SparkSession, path: str) -> bool:
    found, fs = _path(spark, path)
    return fs.exists(found)


def bucketed(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int"))


def read_pages(spark: SparkSession, path: str, buckets: list[int] | None = None, schema: T.StructType = SCHEMA) -> DataFrame:
    """The table's rows with ``bucket``, of some buckets or all; none where there is no table yet."""
    whole = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    if not _there(spark, path):
        return spark.createDataFrame([], whole)
    rows = spark.read.schema(whole).parquet(path)
    return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))


def settle(spark: SparkSession, path: str) -> bool:
    """Finish a write that died after its new state was whole, and clear one that died before; whether there was one to finish."""
    aside = f"{path}/{_ASIDE}"
    if not _there(spark, aside):
        return False
    whole = _there(spark, f"{aside}/_SUCCESS")
    if whole:
        _overwrite(spark.read.parquet(aside), path)
    found, fs = _path(spark, aside)
    fs.delete(found, True)
    return whole


def _overwrite(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _merged(old: DataFrame, new: DataFrame, schema: T.StructType, replace: bool) -> DataFrame:
    """One row a key of both; where both have a field, the old one holds or (``replace``) the new one, if the key is known."""
    a, b = old.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*KEYS, "bucket"]]
    both = a.join(b, on, "left" if replace else "full")
    order = ("b", "a") if replace else ("a", "b")
    fields = [f.name for f in schema.fields if f.name not in KEYS]
    known = F.col("a.bucket").isNotNull()
    take = [F.coalesce(*[F.col(f"{x}.{f}") for x in order]) if replace else F.when(known, F.col(f"a.{f}")).otherwise(F.col(f"b.{f}")) for f in fields]
    return both.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in KEYS], *[t.alias(f) for t, f in zip(take, fields, strict=True)], F.coalesce("a.bucket", "b.bucket").alias("bucket"))


def _write(rows: DataFrame, path: str, buckets: int, schema: T.StructType, replace: bool) -> None:
    spark = rows.sparkSession
    settle(spark, path)
    rows = bucketed(rows, buckets)
    touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # at most BUCKETS numbers
    if not touched:
        return
    _merged(read_pages(spark, path, touched, schema), rows, schema, replace).write.mode("overwrite").parquet(f"{path}/{_ASIDE}")
    settle(spark, path)


def add_pages(rows: DataFrame, path: str, buckets: int = BUCKETS, schema: T.StructType = SCHEMA) -> None:
    """Add rows whose key is not there; of rows that share a new key the one whose fields sort first."""
    fields = [f.name for f in schema.fields if f.name not in KEYS]
    whole = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
    least = F.min_by(F.struct(*fields), F.struct(*[F.struct(F.col(f).isNull().alias("none"), F.col(f).alias("value")) for f in fields])).alias("x")
    _write(whole.groupBy(*KEYS).agg(least).select(*KEYS, "x.*"), path, buckets, schema, False)


def update_pages(rows: DataFrame, path: str, order: str, buckets: int = BUCKETS, schema: T.StructType = SCHEMA) -> None:
    """Replace fields of known keys by those of ``rows`` (a null leaves a field as it is); unknown keys are left out. Of rows
    that share a key each field is that of the last one by ``order`` which has it."""
    given = [f for f in schema.fields if f.name in rows.columns and f.name not in KEYS]
    last = [F.max_by(f.name, F.when(F.col(f.name).isNotNull(), F.struct(F.col(order), F.col(f.name)))).cast(f.dataType).alias(f.name) for f in given]
    one = rows.withColumns({k: F.col(k).cast(schema[k].dataType) for k in KEYS}).groupBy(*KEYS).agg(*last)
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in KEYS and f not in given]
    _write(one.select("*", *missing), path, buckets, schema, True)


def append_pages(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that adds arriving pages (``job_id, page, raw_html``) to the table, each page once: slices may come out of
    order, again, or after a restart. A batch reads only the buckets of its own jobs."""
    return stream.writeStream.foreachBatch(lambda batch, _: add_pages(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
