"""Operator 12: legacy ARC archives converted to WARC, with repeated payloads as revisits, and both formats read as tables.

An ARC file is a run of records, each a header line and as many bytes as the line declares. A ``filedesc:`` record begins a
part of a file; its first line names the version, and with it the fields of the header lines that follow (version 1: URL,
address, date, type, length; version 2 has result code, checksum, location, offset and file name before the length). Nothing
is searched in the payloads: a reader goes from declared length to declared length, so payloads that look like headers do no
harm. A declared length that runs past the end, or a header line without one, is an error that names file and offset.

The converter synthesises what ARC lacks: record ids (a UUID of file and offset), dates with separators (shorter ones filled
up), types (``warcinfo`` for a file description, ``response`` for HTTP messages, ``resource`` else), base-32 SHA-1 digests of
block and payload. It reads the archives twice. The first pass keeps ids, places and digests; the record with the smallest
page id of each payload (SHA-256, so that no crafted SHA-1 pair is taken for equal) is found by a partial aggregation, and a
payload that many records share is joined as a hot key. The second pass gets, for each file, the places of its revisits and
writes the WARC records; a revisit keeps its HTTP header and names the record, address and date it refers to.

Files are written by Spark's text writer (gzip) and read by its binary reader, so that any file system Spark knows will do
and lost tasks are run again. Rows given to the writer are segments of about ``SEGMENT`` bytes, ``SEGMENTS`` a file; a file
is decompressed as it is walked. A task holds a compressed file and one record.

Edge cases: a null payload is an empty one; empty payloads are equal to each other; a null page id comes last in its group
and is written as no field, and a revisit of such a record refers to null; of rows that repeat id and payload one is the
response and the others are revisits of it; texts of any length up to Spark's 2 GB for a value are kept whole; an empty table
gives archives without page records and an empty result; other columns of the input are ignored. Addresses are escaped where
a header line could not hold them (white space, control characters); a null address is written as ``-``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.common import forget, give_back, join_hot, scratch, small_batches, stored, table, text_or_empty
from batchloom.session import shared_dir, ship

#: Bytes of a segment, after which a new one begins, and segments of a file.
SEGMENT, SEGMENTS = 1 << 20, 16
#: Payloads with fewer bytes than this are never written as revisits.
LEAST_BYTES = 0
#: Fixed names of the two formats.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_ID, PAYLOAD_LENGTH = "X-Page-Id", "X-Payload-Length"

ARC_SCHEMA = "path string, offset bigint, version int, url string, date string, type string, record_id string, page_id bigint, payload_bytes bigint, payload_digest string, same binary"
WARC_SCHEMA = (
    "path string, offset bigint, record_type string, record_id string, url string, date string, page_id bigint, payload_bytes bigint, payload_digest string,"
    " refers_to_record string, refers_to_url string, refers_to_date string, intact boolean, payload binary"
)


# --- bytes of one file ---------------------------------------------------------------------------------------------


def opened(content: bytes) -> io.BufferedIOBase:
    """A file's bytes as a stream; gzip, with one or many members, is taken off."""
    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """The header of an HTTP message with its blank line, and the payload; other blocks are payload only."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = re.search(rb"\r?\n\r?\n", block)
    return (block[: end.end()], block[end.end() :]) if end else (block, b"")


def fields_of(lines: Iterator[bytes]) -> dict[str, str]:
    """Named fields; the names in lower case."""
    found = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if colon:
            found[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return found


def number(text: str | None) -> int | None:
    found = int(text) if text and re.fullmatch(r"-?\d{1,19}", text) else None
    return found if found is not None and -(1 << 63) <= found < 1 << 63 else None


def exactly(stream: io.BufferedIOBase, n: int, where: str) -> bytes:
    data = stream.read(n)
    if len(data) < n:
        raise ValueError(f"{where}: {n} bytes declared, {len(data)} left")
    return data


def arc_records(content: bytes, path: str) -> Iterator[tuple[int, int, list[bytes], bytes]]:
    """``offset, version, header fields, block`` of each record. The fields are those of the version in force."""
    stream, at, version = opened(content), 0, 1
    while line := stream.readline():
        start, at = at, at + len(line)
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        where = f"{path}, record at {start}"
        length = line.rpartition(b" ")[2]
        if not re.fullmatch(rb"\d{1,15}", length):
            raise ValueError(f"{where}: no declared length in {line[:80]!r}")
        block = exactly(stream, int(length), where)
        at += len(block)
        if line.startswith(b"filedesc:"):
            named = block[:2].strip()
            if not named.isdigit() or int(named) not in ARC_FIELDS:
                raise ValueError(f"{where}: version {named!r} is not known")
            version = int(named)
        fields = line.rsplit(b" ", len(ARC_FIELDS[version]) - 1)  # an address may hold spaces
        if len(fields) < len(ARC_FIELDS[version]):
            raise ValueError(f"{where}: {len(fields)} fields, version {version} has {len(ARC_FIELDS[version])}")
        yield start, version, fields, block


def iso_date(digits: bytes) -> str:
    """``YYYY-MM-DDThh:mm:ssZ`` from 4 to 14 digits; what is missing is the first month, the first day, and midnight."""
    d = digits.decode("latin-1")
    d = d if re.fullmatch(r"\d{4,14}", d) else "1970"
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_uuid(path: str, offset: int) -> str:
    """A record's id, the same whenever its archive is converted."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path.rpartition("/")[2]}#{offset}')}"


def warc_record(kind: str, fields: dict[str, str | int | None], block: bytes) -> bytes:
    lines = [WARC_VERSION, f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"WARC-Block-Digest: sha1:{sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def converted(path: str, offset: int, version: int, fields: list[bytes], block: bytes, refers: dict | None) -> bytes:
    """The WARC record of an ARC record; ``refers``: the record it repeats."""
    named = dict(zip(ARC_FIELDS[version], (x.decode("utf-8", "replace") for x in fields), strict=True))
    own = {"WARC-Record-ID": f"<{record_uuid(path, offset)}>", "WARC-Date": iso_date(fields[2])}
    if named["URL"].startswith("filedesc:"):
        return warc_record("warcinfo", own | {"WARC-Filename": path.rpartition("/")[2], "Content-Type": "application/warc-fields"}, f"software: batchloom\r\nformat: {WARC_VERSION}\r\ndescription: from ARC version {version}\r\n".encode())
    header, payload = split_http(block)
    own |= {"WARC-Target-URI": None if named["URL"] == "-" else named["URL"], "WARC-IP-Address": None if named["IP-address"] in ("-", "0.0.0.0") else named["IP-address"]}
    own |= {"WARC-Payload-Digest": f"sha1:{sha1(payload)}", PAYLOAD_LENGTH: len(payload), PAGE_ID: fields_of(header.split(b"\n")).get(PAGE_ID.lower())}
    kind = "response" if header else "resource"
    if refers is not None:
        own |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{refers['record_id']}>", "WARC-Refers-To-Target-URI": refers["url"], "WARC-Refers-To-Date": refers["date"]}
        kind, block = "revisit", header
    own |= {"Content-Type": "application/http;msgtype=response" if header else named["Content-type"]}
    return warc_record(kind, own, block)


def warc_records(content: bytes, path: str) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``offset, fields, block`` of each record of a WARC file."""
    stream, at = opened(content), 0
    while line := stream.readline():
        start, at = at, at + len(line)
        if not line.strip():
            continue
        where = f"{path}, record at {start}"
        if not re.fullmatch(rb"WARC/1\.[01]", line.strip()):
            raise ValueError(f"{where}: no WARC version in {line[:80]!r}")
        lines = []
        while (line := stream.readline()).strip():
            lines.append(line)
            at += len(line)
        at += len(line)
        fields = fields_of(iter(lines))
        if (length := number(fields.get("content-length"))) is None:
            raise ValueError(f"{where}: no declared length")
        block = exactly(stream, length, where)
        at += length
        yield start, fields, block


# --- tables --------------------------------------------------------------------------------------------------------


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of every file of a folder."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def over_files(files: DataFrame, schema: str, rows_of: Callable[[dict], Iterator[dict]], held: int = 1000) -> DataFrame:
    """Rows that a function makes of each row of ``files``, ``held`` of them a batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(files.sparkSession)
    small_batches(files.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                for row in rows_of({c: batch.column(c)[i].as_py() for c in batch.schema.names}):
                    found.append(row)
                    size += sum(len(v) for v in row.values() if isinstance(v, bytes))
                    if len(found) >= held or size >= 4 * SEGMENT:
                        yield pa.RecordBatch.from_pylist(found, schema=arrow)
                        found, size = [], 0
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=arrow)
        give_back()

    return files.mapInArrow(run, schema)


def segments(pieces: Iterator[bytes], first: Callable[[int], bytes]) -> Iterator[bytes]:
    """Records in segments of about ``SEGMENT`` bytes; ``first`` gives what begins the segment of a number."""
    held, size, n = [], 0, 0
    for piece in pieces:
        if not held:
            held, size = [first(n)], 0
        held.append(piece)
        size += len(piece)
        if size >= SEGMENT:
            yield b"".join(held)
            held, n = [], n + 1
    if held:
        yield b"".join(held)


def write_segments(rows: DataFrame, path: str) -> None:
    """Write a binary column of segments as files that hold its bytes, a line break after each."""
    fast = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": SEGMENTS}
    rows.select(F.col("segment").cast("string").alias("value")).write.options(**fast).text(path)


def arc_header(version: int, url: str, date: str, kind: str, length: int, name: str = "-", offset: int = 0) -> bytes:
    more = f"200 - - {offset} {name} " if version == 2 else ""
    return f"{url} 0.0.0.0 {date} {kind} {more}{length}\n".encode()


def write_arc(pages: DataFrame, path: str, date: Column | None = None) -> None:
    """Legacy archives of ``page_id, url, html``: segments of version 1 and version 2 by turns. ``date``: when a page was
    fetched (default: so many seconds after 2000-01-01 as its id says)."""
    date = F.timestamp_seconds(F.lit(946_684_800) + F.coalesce(F.pmod("page_id", F.lit(10**9)), F.lit(0))) if date is None else date
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").cast("binary").alias("html"), F.date_format(F.to_utc_timestamp(date, F.current_timezone()), "yyyyMMddHHmmss").alias("date"))
    ship(pages.sparkSession)
    small_batches(pages.sparkSession)

    def description(n: int) -> bytes:
        version = 1 + n % 2
        block = f"{version} 0 batchloom\n{' '.join(ARC_FIELDS[version])}\n".encode()
        return arc_header(version, f"filedesc://segment-{n}.arc", "20000101000000", "text/plain", len(block)) + block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0

        def records() -> Iterator[bytes]:
            for batch in batches:
                for i, url, html, day in zip(*(batch.column(c) for c in ("page_id", "url", "html", "date")), strict=True):
                    body, url = html.as_py(), url.as_py()
                    named = b"" if not i.is_valid else f"{PAGE_ID}: {i.as_py()}\r\n".encode()
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n" + f"Content-Length: {len(body)}\r\n".encode() + named + b"\r\n" + body
                    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "-"
                    yield b"\n" + arc_header(1 + n % 2, url, day.as_py(), "text/html", len(block)) + block

        for segment in segments(records(), description):
            n += 1
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.binary())], ["segment"])
        give_back()

    write_segments(rows.mapInArrow(run, "segment binary"), path)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Every page record of a folder of ARC files: its place, header fields and digests."""

    def rows_of(row: dict) -> Iterator[dict]:
        for offset, version, fields, block in arc_records(row["content"], row["path"]):
            url = fields[0].decode("utf-8", "replace")
            if url.startswith("filedesc:"):
                continue
            header, payload = split_http(block)
            yield {
                "path": row["path"], "offset": offset, "version": version, "url": None if url == "-" else url, "date": iso_date(fields[2]), "type": fields[3].decode("utf-8", "replace"), "record_id": record_uuid(row["path"], offset),
                "page_id": number(fields_of(header.split(b"\n")).get(PAGE_ID.lower())), "payload_bytes": len(payload), "payload_digest": sha1(payload), "same": hashlib.sha256(payload).digest(),
            }

    return over_files(archive_files(spark, path), ARC_SCHEMA, rows_of)


def repeats(records: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``path, offset, first`` of the records whose payload another record has first: the one with the smallest page id, and
    of those the first by file and offset."""
    rows = records.filter(F.col("payload_bytes") >= least_bytes)
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "path", "offset", "record_id", "url", "date")).alias("first")
    firsts = stored(rows.groupBy("same").agg(first, F.count("*").alias("n")).filter("n > 1"), "arc-firsts")
    both = join_hot(rows.select("same", "path", "offset"), firsts, ["same"])
    return both.filter((F.col("path") != F.col("first.path")) | (F.col("offset") != F.col("first.offset"))).select("path", "offset", "first")


def convert_archives(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write WARC files with a record for each ARC record; repeated payloads of at least ``least_bytes`` become revisits."""
    with scratch():
        records = stored(read_arc(spark, arc_path), "arc-records")
        again = repeats(records, least_bytes).groupBy("path").agg(F.collect_list(F.struct("offset", F.struct("first.record_id", "first.url", "first.date").alias("first"))).alias("again"))
        files = archive_files(spark, arc_path).join(again.hint("shuffle_hash"), "path", "left")

        def rows_of(row: dict) -> Iterator[dict]:
            refers = {x["offset"]: x["first"] for x in row["again"] or ()}
            pieces = (converted(row["path"], offset, version, fields, block, refers.get(offset)) for offset, version, fields, block in arc_records(row["content"], row["path"]))
            for segment in segments(pieces, lambda n: b""):
                yield {"segment": segment[:-1]}  # the writer puts the last line break

        write_segments(over_files(files, "segment binary", rows_of), warc_path)


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every record of a folder of WARC files; ``intact``: the block has its digest, and so has the payload it carries."""

    def rows_of(row: dict) -> Iterator[dict]:
        for offset, f, block in warc_records(row["content"], row["path"]):
            kind, bare = f.get("warc-type"), lambda k, f=f: f[k].strip("<>") if k in f else None
            header, payload = split_http(block)
            whole = kind in ("response", "resource")
            digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
            yield {
                "path": row["path"], "offset": offset, "record_type": kind, "record_id": bare("warc-record-id"), "url": f.get("warc-target-uri"), "date": f.get("warc-date"), "page_id": number(f.get(PAGE_ID.lower())),
                "payload_bytes": len(payload) if whole else number(f.get(PAYLOAD_LENGTH.lower())), "payload_digest": sha1(payload) if whole else digest,
                "refers_to_record": bare("warc-refers-to"), "refers_to_url": f.get("warc-refers-to-target-uri"), "refers_to_date": f.get("warc-refers-to-date"),
                "intact": f.get("warc-block-digest") == f"sha1:{sha1(block)}" and (not whole or digest == sha1(payload)), "payload": payload if payloads and whole else None,
            }

    return over_files(archive_files(spark, path), WARC_SCHEMA, rows_of)


def resolved(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, intact`` of page records; ``refers_to``: the page of
    the record that a revisit names."""
    pages = records.filter(F.col("record_type").isin("response", "resource", "revisit"))
    named = pages.filter("record_type = 'revisit'").groupBy("refers_to_record").agg(F.count("*").alias("n"))
    firsts = pages.filter("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"))
    dim = stored(named.join(firsts, "refers_to_record"), "warc-named")
    return join_hot(pages, dim, ["refers_to_record"], how="left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op12_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, intact`` of every page, read back from WARC files that
    were converted from ARC files of both versions."""
    with scratch() as result:
        arc, warc = (f"{shared_dir(spark)}/llm/{k}-{uuid.uuid4().hex}" for k in ("arc", "warc"))
        write_arc(table(spark, sf_dir, "pages"), arc)
        convert_archives(spark, arc, warc)
        records = stored(read_warc(spark, warc), "warc-records")
        forget(spark, archive_files(spark, arc), archive_files(spark, warc))
        return result(resolved(records), "warc-pages")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT *, first_value(page_id) OVER w AS first, row_number() OVER w AS k FROM p WINDOW w AS (PARTITION BY body ORDER BY page_id NULLS LAST)),
b AS (SELECT *, from_hex(sha1(body))::BIT::VARCHAR AS bits FROM d)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT + 1, 1)), lambda x, y: x || y) AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to, true AS intact
FROM b
"""
