"""Session helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that Python operators run wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as tmp:
        shutil.copytree(home, f"{tmp}/src/{home.name}", ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(f"{tmp}/{home.name}", "zip", f"{tmp}/src")
        kept = os.path.join(tempfile.mkdtemp(), os.path.basename(archive))
        shutil.move(archive, kept)
    spark.sparkContext.addPyFile(kept)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; without it the warehouse, if that is no folder of
    each machine's own, and a temporary folder only where driver and executors are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        path = spark.conf.get("spark.sql.warehouse.dir")
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        if found.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file":
            raise RuntimeError(f"{path} may lie on each machine's own disk: set spark.checkpoint.dir to a folder that all executors share")
    if not path:
        path = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="batchloom-")
        shared_dir.own = path
    return path.rstrip("/")


def stored(df: DataFrame, name: str, part: str = "audit") -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, small plans above it, safe against lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{part}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, keys: list[str], parts: int, part: str = "audit") -> DataFrame:
    """``stored`` in ``parts`` buckets by the first key, sorted by all: what groups by that key and others later finds its rows in
    one task and shuffles nothing. The catalog knows the table only while it is written; shuffles go as soon as it is."""
    spark, label = df.sparkSession, f"{name}-{uuid.uuid4().hex}"
    table = f"spark_catalog.default.`{label.replace('-', '_')}`"
    path = f"{shared_dir(spark)}/{part}/{label}"
    key, rest = f"{keys[0]}_", keys[1:]  # another name in the file: a column of a table's own name carries the table's, and a union of two tables forgets its buckets
    rows = df.repartition(parts, keys[0]).withColumnRenamed(keys[0], key)  # not dealt out where the rows are already
    old = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        rows.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, key).sortBy(key, *rest).saveAsTable(table)
    finally:
        spark.conf.unset(_CLEANUP) if old is None else spark.conf.set(_CLEANUP, old)
    found = spark.table(table).withColumnRenamed(key, keys[0])
    spark.sql(f"DROP TABLE {table}")  # external: the files stay, and the plan of ``found`` holds them
    return found
