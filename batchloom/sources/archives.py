"""Result archives of recognisers: zip files with block lists and a whole document, read as pages.

An archive is one row of Spark's binary reader, so it may lie in any store that Spark reads, and is unpacked in its own task.
Of its members the newest form of block list is taken, else the older one; the whole document, where there is one, is what a
block list is checked against, and stands in for a list that lost most of it. What cannot be read is a row with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.session import ship
from batchloom.sources.blocks import blank_page, content_list_pages, marked_lines
from batchloom.sources.recognised import incomplete, markdown_parts

# Endings of members' names, in the order in which block lists are tried.
LISTS, DOCUMENT = ("content_list_v2.json", "content_list.json"), "full.md"
MEMBERS = "job_id string, member string, json string, md string, error string"


def _unpacked(content: bytes) -> dict[str, str | None]:
    import io
    import zipfile

    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            ends = lambda suffix: next((n for n in z.namelist() if n.endswith(suffix)), None)
            read = lambda name: None if name is None else z.read(name).decode("utf-8", "replace")
            found = next((n for n in map(ends, LISTS) if n), None)
            out = {"member": found or ends(DOCUMENT), "json": read(found), "md": read(ends(DOCUMENT))}
            return out | {"error": None if out["member"] else "no block list and no document"}
    except (zipfile.BadZipFile, EOFError, NotImplementedError, RuntimeError, OSError) as e:  # no zip, cut off, unknown method, locked
        return {"member": None, "json": None, "md": None, "error": f"not readable: {type(e).__name__}"}
    except Exception as e:  # zlib.error of a damaged member
        if type(e).__name__ != "error":
            raise
        return {"member": None, "json": None, "md": None, "error": "not readable: damaged member"}


def members(files: DataFrame) -> DataFrame:
    """``job_id, member, json, md, error`` from ``job_id, content``: the chosen member's name, the block list and the document."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job, content in zip(batch.column("job_id"), batch.column("content"), strict=True):
                row = {"job_id": job.as_py()} | _unpacked(content.as_py() or b"")
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([(f, pa.string()) for f in ("job_id", "member", "json", "md", "error")]))

    found = files.select(F.col("job_id").cast("string").alias("job_id"), F.col("content").cast("binary").alias("content")).mapInArrow(run, MEMBERS)
    broken = F.col("json").isNotNull() & ~F.coalesce(F.expr("startswith(schema_of_variant(try_parse_json(json)), 'ARRAY')"), F.lit(False))
    return found.withColumn("error", F.coalesce("error", F.when(broken, "block list is no list")))


def read_archives(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """``job_id, member, json, md, error`` of every archive of a folder; a job is named as its file, without the ending. (The
    reader has no row for a file of no bytes.)"""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return members(files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("job_id"), "content"))


def archive_pages(found: DataFrame, expected: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages ``job_id, page, text, lost, origin`` (``list`` or ``document``), and errors ``job_id, error``, of what ``members``
    gives. ``expected``: the physical pages of a job, a column of ``found`` (null: not known).

    A block list is left for the document where it has two pages fewer, has no table where the document has rows of one, or
    has neither tables nor prose. A document that does not tell several expected pages apart is an error.
    """
    sound = found.withColumn("expected", F.lit(None).cast("int") if expected is None else expected).filter("error IS NULL")
    pages = content_list_pages(sound.filter("json IS NOT NULL").select("job_id", "json"))
    counts = pages.groupBy("job_id").agg(F.count("*").cast("int").alias("n"), F.sum("tables").cast("int").alias("tables"), F.sum("paragraphs").cast("int").alias("paragraphs"))
    jobs = sound.join(counts, "job_id", "left")
    short = F.col("md").isNotNull() & (F.col("json").isNull() | F.coalesce(incomplete(F.col("md"), F.coalesce("n", F.lit(0)), F.coalesce("tables", F.lit(0)), F.coalesce("paragraphs", F.lit(0))), F.lit(False)))
    jobs = jobs.withColumn("short", short)
    one = F.size(markdown_parts(F.col("md"))) == 1
    merged = F.col("short") & one & F.coalesce(F.col("expected") > 1, F.lit(False))
    lists = pages.join(jobs.filter("NOT short").select("job_id"), "job_id", "left_semi").select("job_id", "page", "text", "lost", F.lit("list").alias("origin"))
    parts = jobs.filter(F.col("short") & ~merged).select("job_id", one.alias("one"), F.posexplode(markdown_parts(F.col("md"))).alias("k", "part"))
    part = F.regexp_replace("part", r"(?U)^\s+|\s+$", "")
    text = F.when(F.col("one"), marked_lines(F.col("part"))).when(part == "", blank_page(F.col("k") + 1)).otherwise(marked_lines(part))
    documents = parts.select("job_id", (F.col("k") + 1).alias("page"), text.alias("text"), F.lit(0).alias("lost"), F.lit("document").alias("origin"))
    errors = found.filter("error IS NOT NULL").select("job_id", "error").unionByName(jobs.filter(merged).select("job_id", F.lit("no page separator in a document of several pages").alias("error")))
    return lists.unionByName(documents), errors
