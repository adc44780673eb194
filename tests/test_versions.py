import zlib
from datetime import datetime

import pytest
from batchloom.sources import versions
from batchloom.sources.upload_checks import checked_uploads, new_uploads, structure


def test_three_versions_read_as_one(spark, tmp_path):
    path = str(tmp_path / "findings")
    old = "id int, job_id string, page smallint, type string, severity string, description string"
    spark.createDataFrame([(1, "j", 1, "t", "info", "d"), (2, "j", 1, "t", "info", "d"), (9, "j", None, "t", "info", "e")], old).write.parquet(f"{path}/version=0")
    spark.createDataFrame([(3, "j", 1, "t", "warning", "d", None), (4, "j", 1, "t", "info", "d", "llm_page"), (5, "j", 2, "t", "info", "d", None)], old + ", source string").write.parquet(f"{path}/version=3")
    spark.createDataFrame([(6, "j", 1, "t", "critical", "d", "rule", "u1", "extra"), (7, "j", None, "t", "info", "e", "rule", None, "extra"), (8, "j", 2, "t", "info", "d", None, "u2", "extra")], old + ", source string, user_rule_id string, other string").write.parquet(f"{path}/version=5")
    rows = versions.read_versions(spark, path, versions.FINDINGS)
    assert rows.count() == 9 and rows.schema.simpleString() == versions.columns(versions.FINDINGS).simpleString()
    got = {r.id: (r.page, r.source, r.severity, r.user_rule_id) for r in versions.read_findings(spark, path).collect()}
    assert got == {1: (1, "rule", "info", None), 3: (1, None, "warning", None), 4: (1, "llm_page", "info", None), 5: (2, None, "info", None), 7: (None, "rule", "info", None)}
    versions.rewrite(spark, path, str(tmp_path / "new"), versions.FINDINGS)
    assert {r.id for r in versions.read_versions(spark, str(tmp_path / "new"), versions.FINDINGS).collect()} == set(got)
    assert versions.read_versions(spark, str(tmp_path / "none"), versions.JOBS).count() == 0
    spark.createDataFrame([("j", "f")], "id string, filename string").write.parquet(f"{tmp_path}/jobs/version=1")
    job = versions.read_versions(spark, f"{tmp_path}/jobs", versions.JOBS).first()
    assert (job.id, job.filename, job.status, job.md5, job.stage1_ms) == ("j", "f", None, None, None)
    spark.createDataFrame([(1,)], "id int").write.parquet(f"{path}/version=6")
    with pytest.raises(ValueError, match="version 6"):
        versions.read_findings(spark, path)


def pdf(pages=2, trailer=b"", tree=None):
    tree = b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count %d >>" % pages if tree is None else tree
    return b"%PDF-1.7\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n" + tree + b"\nendobj\n3 0 obj\n<< /Type /Page /Parent 2 0 R >>\nendobj\ntrailer\n<< /Root 1 0 R " + trailer + b">>\n%%EOF"


def packed(tree, xref=b""):
    body = zlib.compress(b"2 0 " + tree)
    return b"%PDF-1.5\n5 0 obj\n<< /Type /ObjStm /N 1 /First 4 /Filter /FlateDecode /Length " + str(len(body)).encode() + b" >>\nstream\n" + body + b"\nendstream\nendobj\n6 0 obj\n<< /Type /XRef /W [1 2 1] /Root 1 0 R " + xref + b">>\nstream\n\x00\x01\nendstream\nendobj\n%%EOF"


def test_structures():
    assert structure(pdf()) == (False, 2) and structure(pdf(0)) == (False, 0)
    assert structure(pdf(trailer=b"/Encrypt 9 0 R ")) == (True, 2) and structure(pdf(trailer=b"/Encrypt << /Filter /Standard >> ")) == (True, 2)
    assert structure(pdf(tree=b"<< /Count 12 /Kids [ 3 0 R ] /Type /Pages >>")) == (False, 12)
    assert structure(pdf(tree=b"<< /Type /Pages /Kids [7 0 R 8 0 R] /Count 5 >>\nendobj\n7 0 obj\n<< /Type /Pages /Parent 2 0 R /Kids [3 0 R] /Count 3 >>")) == (False, 5)
    assert structure(packed(b"<< /Type /Pages /Kids [3 0 R] /Count 4 >>")) == (False, 4)
    assert structure(packed(b"<< /Type /Pages /Kids [] /Count 0 >>", b"/Encrypt 8 0 R ")) == (True, 0)
    assert structure(b"%PDF-1.4 nothing else, but the words /Encrypt and trailer") == (False, None) and structure(b"") == (False, None)
    assert structure(pdf() + b"\n(text about /Encrypt 1 0 R in a page)") == (False, 2)


def test_uploads(spark):
    png, webp = b"\x89PNG\r\n\x1a\n" + b"0" * 20, b"RIFF1234WEBP" + b"0" * 9
    files = {
        "a/good.pdf": (pdf(), None, 2), "a/GOOD.PDF": (pdf(3), None, 3), "a/unknown.pdf": (b"%PDF-1.4 ??", None, None), "a/locked.pdf": (pdf(trailer=b"/Encrypt 9 0 R "), "encrypted", 2), "a/empty.pdf": (pdf(0), "no pages", 0),
        "a/fake.pdf": (png, "no document", None), "a/pic.png": (png, None, 1), "a/pic.jpeg": (webp, None, 1), "a/pic.tif": (b"MM\x00*" + b"0" * 9, None, 1), "a/pic.bmp": (pdf(), "no image", None), "a/riff.webp": (b"RIFF1234WAVE0000", "no image", None),
        "a/x.docx": (pdf(), "extension", None), "a/.pdf": (pdf(), "extension", None), "a/none": (pdf(), "extension", None), "a/short.pdf": (b"%PDF", "too small", None), "a/": (pdf(), None, 2),
    }
    df = spark.createDataFrame([(k, len(v[0]), bytearray(v[0])) for k, v in files.items()] + [("a/big.pdf", 200 * 1024 * 1024 + 1, bytearray(pdf()))], "path string, length long, content binary")
    checked = checked_uploads(df)
    got = {r.path: (r.reason, r.pages) for r in checked.collect()}
    assert got == {k: v[1:] for k, v in files.items()} | {"a/big.pdf": ("too large", None)}
    sums = {r.path: r.md5 for r in checked.collect()}
    jobs = spark.createDataFrame([("j1", sums["a/good.pdf"], "review", datetime(2024, 1, 1)), ("j2", sums["a/good.pdf"], "error", datetime(2024, 1, 2)), ("j3", sums["a/GOOD.PDF"], "archived", datetime(2024, 1, 2))], "id string, md5 string, status string, created_at timestamp")
    seen = {r.path: (r.reason, r.job_id) for r in new_uploads(checked, jobs).collect()}
    assert seen["a/good.pdf"] == seen["a/"] == ("duplicate", "j2") and seen["a/GOOD.PDF"] == (None, None) and seen["a/x.docx"][0] == "extension"
