"""What is wrong with uploaded files: names, sizes, first bytes, and the structure of documents.

Names, sizes and first bytes are columns. The structure is a byte-level scan, in Arrow batches, of files that begin as a
document: an ``/Encrypt`` entry of a trailer or of a cross-reference stream locks it, and the root of the page tree counts its
pages. Where the tree lies in compressed object streams these are inflated. A file whose pages cannot be counted passes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.session import ship

# Accepted endings, first bytes by kind, and limits.
IMAGES = [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff"]
DOCUMENT = ".pdf"
MAGIC = {"jpeg": "FFD8FF", "png": "89504E470D0A1A0A", "bmp": "424D", "tiff": "49492A00", "tiff ": "4D4D002A"}
DOCUMENT_MAGIC, WEBP = "255044462D", ("52494646", "57454250")
LEAST_BYTES, MOST_BYTES = 5, 200 * 1024 * 1024
#: Bytes that an object stream is inflated to at most.
INFLATED = 1 << 26
_OBJECT_STREAM = re.compile(rb"<<(?:[^<>]|<<[^<>]*>>|<[0-9A-Fa-f\s]*>)*?/Type\s*/ObjStm\b.*?stream\r?\n", re.DOTALL)
_PAGES = re.compile(rb"<<(?=(?:(?!>>).)*?/Type\s*/Pages\b)((?:(?!/Kids).)*?(?:/Kids\s*\[[^\]]*\])?(?:(?!>>).)*?)>>", re.DOTALL)


def _bodies(content: bytes) -> Iterator[bytes]:
    """The file, and the objects in its compressed object streams."""
    yield content
    for m in _OBJECT_STREAM.finditer(content):
        try:
            yield zlib.decompressobj().decompress(content[m.end() :], INFLATED)
        except zlib.error:
            continue


def _dictionary(content: bytes, at: int) -> bytes:
    """The dictionary that begins at or after a place, with those in it; empty if it does not begin soon or does not end."""
    start = content.find(b"<<", at, at + 64)
    if start < 0:
        return b""
    depth = 0
    for m in re.compile(rb"<<|>>").finditer(content, start, start + 65536):
        depth += 1 if m[0] == b"<<" else -1
        if not depth:
            return content[start : m.end()]
    return b""


def structure(content: bytes) -> tuple[bool, int | None]:
    """Whether a document is locked, and how many pages its tree counts (null: not found)."""
    trailers = [_dictionary(content, m.end()) for m in re.finditer(rb"\btrailer\b", content)]
    for m in re.finditer(rb"/Type\s*/XRef\b", content):  # the trailer of such a file is the dictionary of this object
        begins = [x.end() for x in re.finditer(rb"\d\s+\d+\s+obj\b", content[max(0, m.start() - 4096) : m.start()])]
        if begins:
            trailers.append(_dictionary(content, max(0, m.start() - 4096) + begins[-1]))
    locked = any(re.search(rb"/Encrypt\s*(?:\d+\s+\d+\s+R|<<)", t) for t in trailers)
    counts = [int(n) for body in _bodies(content) for m in _PAGES.finditer(body) if (n := (re.search(rb"/Count\s+(\d+)", m[1]) or [None, None])[1])]
    return locked, max(counts) if counts else None


def structures(files: DataFrame) -> DataFrame:
    """``path, locked, pages`` of the documents among ``path, content``."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [structure(x.as_py()) for x in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([x for x, _ in found], pa.bool_()), pa.array([n for _, n in found], pa.int64())], ["path", "locked", "pages"])

    return files.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, "path string, locked boolean, pages bigint")


def _ending(path: Column) -> Column:
    """A name's ending as the system takes it; a name without one is that of a document."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name == "", DOCUMENT).otherwise(F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)))


def checked_uploads(files: DataFrame) -> DataFrame:
    """``path, length, md5, pages, reason`` of every file of ``path, length, content`` as Spark's binary reader gives them;
    ``reason`` is null for what is accepted, else the first of: ``extension``, ``too large``, ``too small``, ``no image``,
    ``no document``, ``encrypted``, ``no pages``."""
    start, ending = F.hex(F.substring("content", 1, 12)), _ending(F.col("path"))
    image = ending.isin(IMAGES)
    known = start.startswith(WEBP[0]) & (F.substring(start, 17, 8) == WEBP[1])
    for magic in MAGIC.values():
        known |= start.startswith(magic)
    document = start.startswith(DOCUMENT_MAGIC)
    early = (
        F.when(~image & (ending != DOCUMENT), "extension").when(F.col("length") > MOST_BYTES, "too large").when(F.col("length") < LEAST_BYTES, "too small")
        .when(image & ~known, "no image").when(~image & ~document, "no document")
    )
    rows = files.withColumn("early", early).withColumn("ending", ending)
    scanned = structures(rows.filter(F.col("early").isNull() & (F.col("ending") == DOCUMENT)))
    out = rows.select("path", "length", F.md5("content").alias("md5"), "early", image.alias("image")).join(scanned, "path", "left")
    reason = F.coalesce("early", F.when(F.col("locked"), "encrypted"), F.when(F.col("pages") == 0, "no pages"))
    return out.select("path", "length", "md5", F.when(F.col("early").isNull() & F.col("image"), F.lit(1)).otherwise(F.col("pages")).cast("bigint").alias("pages"), reason.alias("reason"))


def new_uploads(checked: DataFrame, jobs: DataFrame) -> DataFrame:
    """``checked_uploads`` with ``job_id``, the newest job that is not archived and has the same content (``id, md5, status,
    created_at``); such a file is refused as ``duplicate``."""
    newest = jobs.filter("status <> 'archived' AND md5 IS NOT NULL").groupBy("md5").agg(F.max_by("id", F.struct("created_at", "id")).alias("job_id"))
    out = checked.join(newest, "md5", "left")
    return out.select("path", "length", "md5", "pages", F.coalesce("reason", F.when(F.col("job_id").isNotNull(), "duplicate")).alias("reason"), "job_id")
