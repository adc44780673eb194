"""Helpers that every operator of the subpackage shares."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.session import ship
from batchloom.session import stored as keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives the loss of any executor."""
    out = keep(df, name, "llm")
    if (made := _made.get()) is not None:
        made.append(out)
    return out


#: Tables stored inside the innermost ``scratch``.
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables stored inside are deleted at its end, but for those stored through the function it gives."""
    made: list[DataFrame] = []
    before = _made.set(made)
    kept: list[DataFrame] = []

    def result(df: DataFrame, name: str) -> DataFrame:
        kept.append(keep(df, name, "llm"))
        return kept[-1]

    try:
        yield result
    finally:
        _made.reset(before)
        for df in made:
            forget(df.sparkSession, df)
        if (outer := _made.get()) is not None:
            outer += kept


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads."""
    for df in tables:
        files = df.inputFiles()
        if files:
            path = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(files[0]))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of an Arrow batch between the JVM and Python: texts can be long, and a batch is held on both sides at once.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, so that memory follows a block of texts and not ten thousand of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def give_back() -> None:
    """Return freed memory to the system: workers stay for later tasks of other operators."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (in either case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def map_texts(df: DataFrame, schema: str, start: Callable[[], Callable[[pa.RecordBatch], dict]], text: str = "text", limit: int = 1 << 20) -> DataFrame:
    """Run an Arrow function over whole texts in blocks of at most ``limit`` bytes of text (or one longer text).

    ``start`` runs once in a worker and returns the function from a batch to a dict of arrays, one for each output field.
    A null text arrives as an empty one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    small_batches(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from batchloom.llm.textkernel import blocks, buffers

        work = start()
        for batch in batches:
            _, offsets = buffers(batch.column(text))
            for lo, hi in blocks(offsets, limit):
                out = work(batch.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        del work
        give_back()

    return df.withColumn(text, text_or_empty(text)).mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], schema: str, work: Callable[[pa.Table, list[tuple[int, int]]], pa.Table]) -> DataFrame:
    """Run an Arrow function over whole groups, many groups a call: rows are dealt and sorted by ``keys``, and ``work`` gets
    a table with the limits of the groups in it. For groups of bounded size."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    small_batches(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def starts_of(rows: pa.Table) -> np.ndarray:
            new = np.zeros(rows.num_rows, bool)
            new[:1] = True
            for k in keys:
                v = rows.column(k).to_numpy()
                new[1:] |= v[1:] != v[:-1]
            return np.flatnonzero(new)

        def done(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            if rows.num_rows:
                limits = [*starts.tolist(), rows.num_rows]
                yield from work(rows, list(zip(limits, limits[1:], strict=False))).cast(arrow).to_batches()

        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            starts = starts_of(rows)
            if len(starts) > 1:
                yield from done(rows.slice(0, starts[-1]), starts[:-1])
            rest = rows.slice(starts[-1]) if len(starts) else rows
        if rest is not None:
            yield from done(rest, starts_of(rest))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


#: Keys that may count as hot at once: no more can hold over one in so many of the rows each.
HOT_KEYS = 1000
#: Rows of a key that one task may always take.
COLD_ROWS = 256


def join_hot(rows: DataFrame, dim: DataFrame, keys: list[str], n: str = "n", total: int | None = None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``dim`` (one row a key; ``n``: how many of the rows have it, dropped) without a hot task.

    Keys with more than one in ``HOT_KEYS`` of the rows are at most ``HOT_KEYS``, so that part of ``dim`` is broadcast; the
    other keys are shuffled. With ``how="left"`` rows with a null key pass without a join.
    """
    total = (dim.agg(F.sum(n)).first()[0] or 0) if total is None else total
    hot = F.col(n) > max(COLD_ROWS, total // HOT_KEYS)
    few, many = dim.filter(hot).drop(n), dim.filter(~hot).drop(n)
    out = rows.join(F.broadcast(few), keys)
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti")
    if how == "inner":
        return out.unionByName(rest.join(many, keys))
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    return out.unionByName(rest.filter(known).join(many, keys, how)).unionByName(rows.filter(~known), allowMissingColumns=True)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Component of every id that an edge names: ``id``, ``component_id`` (smallest id reachable).

    Smallest-label propagation with pointer jumping over stored tables, so that neither edges nor labels meet in one
    process; the centre of a star and the label of a large component are joined as hot keys. Self-loops are allowed; an
    empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y"))
    both = stored(both.union(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "cc-edges")
    label = stored(both.groupBy("x").agg(F.count("*").alias("n"), F.least(F.col("x"), F.min("y")).alias("l")), "cc-label")
    n_edges, n_ids = both.count(), label.count()
    while True:
        near = join_hot(both, label.withColumnRenamed("x", "y"), ["y"], total=n_edges).groupBy("x").agg(F.min("l").alias("m"))
        step = stored(label.join(near, "x").select("x", "n", F.col("l").alias("was"), F.least("l", "m").alias("l")), "cc-step")
        if step.filter("l < was").isEmpty():
            out = step.select(F.col("x").alias("id"), F.col("l").alias("component_id"))
            forget(spark, both, label)
            return out
        named = step.groupBy("l").agg(F.count("*").alias("k"))
        jump = stored(named.join(step.select(F.col("x").alias("l"), F.col("l").alias("j")), "l"), "cc-jump")
        label, old = stored(join_hot(step, jump, ["l"], "k", n_ids).select("x", "n", F.least("l", "j").alias("l")), "cc-label"), label
        forget(spark, old, step, jump)
