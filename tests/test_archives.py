import io
import json
import zipfile

from batchloom.sources.archives import archive_pages, members, read_archives

V2 = [[{"type": "paragraph", "text": "new form"}, {"type": "table", "table_body": "<tr/>"}], [{"type": "text", "text": "page two"}]]
V1 = [{"type": "text", "text": "old form", "page_idx": 0}, {"type": "table", "table_body": "<tr/>", "page_idx": 0}]


def archive(**names):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in names.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), body if isinstance(body, str) else json.dumps(body))
    return raw.getvalue()


def test_archives(spark, tmp_path):
    v2, v1, md = "x__a_content_list_v2_dot_json", "x__a_content_list_dot_json", "x__full_dot_md"
    whole = archive(**{v2: V2, v1: V1, md: "one\ftwo"})
    files = {
        "both": whole,
        "old": archive(**{v1: V1, md: "one"}),
        "document": archive(**{md: "first ###\f \f### third\n###"}),
        "rules": archive(**{md: "a\n---\nb"}),
        "pages": archive(**{v1: V1, md: "1\f2\f3"}),
        "near": archive(**{v1: V1, md: "1\f2"}),
        "tables": archive(**{v1: V1[:1], md: "| a |\n| b |"}),
        "noise": archive(**{v2: [[{"type": "page_number", "text": "1"}]], md: "prose"}),
        "empty": archive(**{v2: [[]], md: " "}),
        "merged": archive(**{md: "all in one"}),
        "none": archive(layout_dot_json="[]"),
        "object": archive(**{v2: "{}"}),
        "text": archive(**{v2: "no json", md: "prose"}),
        "cut": whole[: len(whole) // 2],
        "junk": b"no zip at all",
        "nothing": b"",
        "damaged": whole[:60] + b"\xff" * 40 + whole[100:],
    }
    for name, content in files.items():
        (tmp_path / f"{name}.zip").write_bytes(content)
    (tmp_path / "other.txt").write_bytes(b"x")
    found = read_archives(spark, str(tmp_path))
    assert {r.job_id: r.member and r.member.split("/")[-1] for r in found.select("job_id", "member").collect() if r.member} | {} == {
        **dict.fromkeys(("both", "noise", "empty", "object", "text"), "a_content_list_v2.json"), **dict.fromkeys(("old", "pages", "near", "tables"), "a_content_list.json"), **dict.fromkeys(("document", "rules", "merged"), "full.md"),
    }
    from pyspark.sql import functions as F

    pages, errors = archive_pages(found, F.when(F.col("job_id") == "merged", 7).when(F.col("job_id") == "rules", 2))
    got = {}
    for r in pages.collect():
        got.setdefault(r.job_id, {})[r.page] = (r.origin, r.text)
    assert got["both"] == {1: ("list", "## 第 1 页\nnew form\n\n<tr/>"), 2: ("list", "## 第 2 页\npage two")}
    assert got["old"] == got["near"] == {1: ("list", "## 第 1 页\nold form\n\n<tr/>")} and got["empty"] == {1: ("list", "## 第 1 页\n\n（此页无文本内容）")}
    assert got["document"] == {1: ("document", "first [手写内容未识别]"), 2: ("document", "## 第 2 页\n\n（此页无文本内容）"), 3: ("document", "### third\n[手写内容未识别]")}
    assert got["rules"] == {1: ("document", "a"), 2: ("document", "b")} and {k: v[1] for k, v in got["pages"].items()} == {1: "1", 2: "2", 3: "3"}
    assert got["tables"] == {1: ("document", "| a |\n| b |")} and got["noise"] == {1: ("document", "prose")}
    said = {r.job_id: r.error for r in errors.collect()}
    assert said.pop("damaged").startswith("not readable")
    assert said == {
        "merged": "no page separator in a document of several pages", "none": "no block list and no document", "object": "block list is no list", "text": "block list is no list",
        "cut": "not readable: BadZipFile", "junk": "not readable: BadZipFile",
    }
    assert set(got) | set(said) | {"damaged", "nothing"} == set(files)
    rows = members(spark.createDataFrame([("a", bytearray()), ("b", None)], "job_id string, content binary")).collect()
    assert [r.error for r in rows] == ["not readable: BadZipFile"] * 2
