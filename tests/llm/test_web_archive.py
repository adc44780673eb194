import base64
import gzip
import hashlib
import uuid

import pytest
from batchloom.llm.queries import ORACLES, QUERIES
from batchloom.llm.web_archive import arc_records, convert_archives, iso_date, op12_arc_to_warc, read_arc, read_warc, record_uuid, resolved, warc_records, write_arc
from tests.helpers import same_as_oracle

ONE = b"1 0 old\nURL IP-address Archive-date Content-type Archive-length\n"
TWO = b"2 0 new\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
TRAP = "</html>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nhttp://x/ 1.2.3.4 20010101000000 text/html 5\nfiledesc://y 0 0 text/plain 9\n1 0 z\n"


def arc(*records):
    """A file of header lines and blocks; ``%`` in a line stands for the block's length."""
    return b"\n".join(line.replace(b"%", str(len(block)).encode()) + b"\n" + block for line, block in records) + b"\n"


def http(body, more=b""):
    return b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n" + more + b"\r\n" + body


def brute(rows):
    """``page_id, bytes, digest, type, refers_to`` of ``page_id, html``."""
    out, first = [], {}
    for i, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), digest, "revisit" if body in first else "response", first.get(body)))
        first.setdefault(body, i)
    return sorted(out, key=repr)


ROWS = [
    (5, "http://a/", "same"), (2, "http://a b/\n", "same"), (9, None, "same"), (9, "", "same"), (9, "http://a/", "other"), (1, "x", None), (3, "y", ""), (None, "z", "same"), (None, "z", "alone"), (None, "z", "alone"),
    (7, "http://trap/", TRAP), (8, "http://trap/é", TRAP), (11, "u", "é😀\x00\r\n"), (12, "u", "x" * 3_000_000), (13, "u", "x" * 3_000_000), (2**62, "u", "\n"), (-4, "u", " "),
]
SCHEMA = "page_id long, url string, html string, first string, path int, record_type string"


def test_pages_and_back(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "n", 1, "m") for r in ROWS], SCHEMA)
    pages.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = op12_arc_to_warc(spark, str(tmp_path))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "string", "string", "bigint", "boolean"]
    rows = got.collect()
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == brute([(i, html) for i, _, html in ROWS]) and all(r.intact for r in rows)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert op12_arc_to_warc(spark, f"{tmp_path}/none").count() == 0


def test_payloads_and_threshold(spark, tmp_path):
    write_arc(spark.createDataFrame([(*r, "n", 1, "m") for r in ROWS], SCHEMA), f"{tmp_path}/arc")
    assert {r.version for r in read_arc(spark, f"{tmp_path}/arc").collect()} == {1, 2} or read_arc(spark, f"{tmp_path}/arc").count() == len(ROWS)
    convert_archives(spark, f"{tmp_path}/arc", f"{tmp_path}/warc", least_bytes=5)
    back = read_warc(spark, f"{tmp_path}/warc", payloads=True).collect()
    pages = [r for r in back if r.record_type != "warcinfo"]
    assert len(pages) == len(ROWS) and all(r.intact for r in back) and len({r.record_id for r in back}) == len(back)
    bodies = sorted((html or "").encode() for _, _, html in ROWS)
    small = [b for b in bodies if len(b) < 5]
    assert sorted(bytes(r.payload) for r in pages if r.record_type == "response") == sorted([*small, *{b for b in bodies if len(b) >= 5}])
    by_id = {r.record_id: r for r in pages}
    for r in pages:
        if r.record_type == "revisit":
            first = by_id[r.refers_to_record]
            assert first.record_type == "response" and first.payload_digest == r.payload_digest and first.payload_bytes == r.payload_bytes and r.refers_to_date == first.date and r.refers_to_url == first.url


def test_versions_and_kinds(spark, tmp_path):
    bad = bytes(range(256)) * 3
    content = arc(
        (b"filedesc://old.arc 0.0.0.0 19970101000000 text/plain %", ONE),
        (b"http://a/with a space 10.0.0.1 199702030405 text/html %", http(b"body one", b"X-Page-Id: 7\r\n")),
        (b"dns:a 10.0.0.1 19970203 text/dns %", b"a. 300 IN A 10.0.0.1"),
        (b"filedesc://new.arc 0.0.0.0 19990101000000 text/plain 200 - - 0 new.arc %", TWO),
        (b"http://b/ 10.0.0.2 19990101020304 text/html 200 abc - 77 new.arc %", http(b"body one", b"x-page-id:  3 \r\n")),
        (b"http://c/ - 1999 image/gif 200 - - 99 new.arc %", http(bad)),
        (b"http://d/ 10.0.0.3 19990101020304 text/html 404 - - 120 new.arc %", b"HTTP/1.0 404 Not Found"),
    )
    (tmp_path / "arc").mkdir()
    cut = content.index(b"\nfiledesc://new") + 1
    (tmp_path / "arc/a.arc").write_bytes(content)
    (tmp_path / "arc/b.arc.gz").write_bytes(gzip.compress(content[:cut]) + gzip.compress(content[cut:]))
    rows = read_arc(spark, str(tmp_path / "arc")).collect()
    one = sorted((r for r in rows if r.path.endswith("a.arc")), key=lambda r: r.offset)
    assert [(r.version, r.url, r.date, r.type, r.page_id, r.payload_bytes) for r in one] == [
        (1, "http://a/with a space", "1997-02-03T04:05:00Z", "text/html", 7, 8), (1, "dns:a", "1997-02-03T00:00:00Z", "text/dns", None, 20),
        (2, "http://b/", "1999-01-01T02:03:04Z", "text/html", 3, 8), (2, "http://c/", "1999-01-01T00:00:00Z", "image/gif", None, 768), (2, "http://d/", "1999-01-01T02:03:04Z", "text/html", None, 0),
    ]
    assert [r.offset for r in one] == [content.index(x) for x in (b"http://a/", b"dns:a", b"http://b/", b"http://c/", b"http://d/")]
    convert_archives(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    back = read_warc(spark, str(tmp_path / "warc"), payloads=True).collect()
    assert all(r.intact for r in back)
    assert sorted(r.record_type for r in back) == ["resource", "response", "response", "response", *["revisit"] * 6, *["warcinfo"] * 4]
    assert [bytes(r.payload) for r in back if r.payload_bytes == 768 and r.payload is not None] == [bad]
    assert {(r.page_id, r.refers_to) for r in resolved(read_warc(spark, str(tmp_path / "warc"))).collect() if r.payload_bytes == 8} == {(3, None), (7, 3), (3, 3)}


def test_written_records_follow_the_format(spark, tmp_path):
    write_arc(spark.createDataFrame([(1, "http://a/", "é"), (2, "http://b/", "é")], "page_id long, url string, html string").coalesce(1), f"{tmp_path}/arc")
    convert_archives(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    (file,) = (tmp_path / "warc").glob("part-*.gz")
    text = gzip.decompress(file.read_bytes())
    (offsets, fields, blocks) = zip(*warc_records(file.read_bytes(), "f"), strict=True)
    assert [text[o : o + 10] for o in offsets] == [b"WARC/1.1\r\n"] * 3 and text.endswith(b"\r\n\r\n")
    assert [f["warc-type"] for f in fields] == ["warcinfo", "response", "revisit"]
    assert fields[1]["warc-date"] == "2000-01-01T00:00:01Z" and fields[2]["warc-refers-to"] == fields[1]["warc-record-id"]
    assert uuid.UUID(fields[1]["warc-record-id"].strip("<>").removeprefix("urn:uuid:")).version == 5
    assert blocks[1] == b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: 2\r\nX-Page-Id: 1\r\n\r\n" + "é".encode()
    assert record_uuid("/x/f", 3) == record_uuid("/y/f", 3) != record_uuid("/x/f", 4)


@pytest.mark.parametrize(
    "content, said",
    [
        (b"http://a/ 1.1.1.1 2000 text/html 50\nshort", "50 bytes declared, 5 left"),
        (b"http://a/ 1.1.1.1 2000 text/html x\nbody", "no declared length"),
        (b"filedesc://a 0 2000 text/plain 6\n9 0 z\n", "not known"),
        (b"http://a/ text/html 4\nbody", "version 1 has 5"),
    ],
)
def test_damaged_archives_are_named(content, said):
    with pytest.raises(ValueError, match=said):
        list(arc_records(content, "f"))


def test_dates():
    assert [iso_date(x) for x in (b"2001", b"20010203", b"200102030405", b"20010203040506", b"x", b"")] == ["2001-01-01T00:00:00Z", "2001-02-03T00:00:00Z", "2001-02-03T04:05:00Z", "2001-02-03T04:05:06Z", "1970-01-01T00:00:00Z", "1970-01-01T00:00:00Z"]


def test_equal_to_sql(spark):
    same_as_oracle(spark, QUERIES["op12_arc_to_warc"], ORACLES["op12_arc_to_warc"])
