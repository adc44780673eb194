import json

import pytest
from batchloom.sources import blocks

SPAN = lambda *texts: {"paragraph_content": [{"type": "text", "content": t} for t in texts]}
# a block, and the line it makes on a page of its own (None: nothing)
CASES = [
    ({"type": "text", "text": " plain "}, "plain"),
    ({"text": "no kind"}, "no kind"),
    ({"type": "paragraph", "content": SPAN("two", " spans ")}, "two spans"),
    ({"type": "paragraph", "content": {"paragraph_content": [{"type": "sup", "content": [{"type": "text", "content": "deep"}, "er"]}, "bare", 7, {"no": "content"}]}}, "deep er bare"),
    ({"type": "paragraph", "content": {"z_content": ["first"], "a_content": ["second"]}}, "first second"),
    ({"type": "paragraph", "content": "  just a string "}, "just a string"),
    ({"type": "paragraph", "content": {"level": 3}, "text": "from text"}, "from text"),
    ({"type": "title", "content": {"title_content": [{"content": "Granulation"}], "level": 1}}, "## Granulation"),
    ({"type": "title", "text": ""}, None),
    ({"type": "header", "text": "Company ###"}, "### Company ###"),
    ({"type": "page_header", "text": "0.1 6"}, None),
    ({"type": "page_footer", "text": "15.60%"}, None),
    ({"type": "page_number", "text": "第 12 页"}, None),
    ({"type": "footer", "text": "2 / 24"}, None),
    ({"type": "footer", "text": "SOP-001-R3"}, "SOP-001-R3"),
    ({"type": "image"}, "[image]"),
    ({"type": "image", "caption": " seal "}, "[image: seal]"),
    ({"type": "equation_interline", "content": {"math_content": "a+b"}}, "[equation_interline: a+b]"),
    ({"type": "aside_text", "text": "margin"}, "margin"),
    ({"type": "list", "items": ["one", {"type": "x", "bbox": ["99"], "say": "two"}, ".", "y"], "id": "b7"}, "one two"),
    ({"type": "paragraph", "note": "only here"}, None),
    ({"type": "text", "text": "sign:###"}, "sign:[手写内容未识别]"),
    ({"type": "text", "text": "a\n### b\nc###"}, "a\n### b\nc[手写内容未识别]"),
    ({"type": "table", "content": {"html": " <tr><td>1</td></tr> "}}, "\n<tr><td>1</td></tr>"),
    ({"type": "table", "content": {"table_caption": ["c"], "odd": "x<td>y"}}, "\nx<td>y"),
    ({"type": "table", "content": {"html": 5}, "markdown": "|a|"}, "\n|a|"),
    ({"type": "table", "table_body": "  ", "html": "<table/>"}, "\n<table/>"),
    ({"type": "table", "content": {"cells": ["left", "over"]}}, "\nleft over"),
    ({"type": "table"}, "\n[表格内容提取失败 — OCR 结构缺失]"),
    ({"type": "discarded", "text": "gone"}, None),
    ({"type": "text", "text": "gone", "discard": True}, None),
    ({"type": "text", "text": "kept", "discard": "yes"}, "kept"),
]


def pages(spark, *files):
    rows = [(str(i), json.dumps(x, ensure_ascii=False)) for i, x in enumerate(files)]
    return {(r.job_id, r.page): r for r in blocks.content_list_pages(spark.createDataFrame(rows, "job_id string, json string")).collect()}


def test_every_kind(spark):
    got = pages(spark, [[b] for b, _ in CASES])
    for i, (b, line) in enumerate(CASES, 1):
        assert got["0", i].text == f"## 第 {i} 页" + ("" if line is None else "\n" + line), b
        lost = b.get("type") == "discarded" or b.get("discard") is True or b == {"type": "table"}
        assert (got["0", i].lost, got["0", i].tables, got["0", i].paragraphs) == (int(lost), int(b.get("type") == "table"), int(b.get("type", "text") in ("text", "paragraph", "title"))), b


def test_paragraphs(spark):
    text = lambda s: {"type": "text", "text": s}
    page = [text("one"), text(""), {"type": "page_number", "text": "3"}, text("goes on."), text("two"), {"type": "discarded"}, text("too"), {"type": "image"}, text("three"), {"type": "table", "table_body": "T"}, text("four!"), {"type": "paragraph", "text": "own"}, text("five")]
    got = pages(spark, [page, [], ["no block"], [text("end")]], [{**text("x"), "page_idx": 2}, {**text("y"), "page_idx": 2}, {**text("z"), "page_idx": "1"}, {**text("w"), "page_idx": -1}, 5], [], [7])
    assert got["0", 1].text == "## 第 1 页\none goes on.\ntwo too\n[image]\nthree\n\nT\n\nfour!\nown\nfive" and got["0", 1].lost == 1
    assert got["0", 2].text == "## 第 2 页\n\n（此页无文本内容）" and got["0", 3].text == "## 第 3 页\n\n（此页无文本内容）" and got["0", 4].text == "## 第 4 页\nend"
    assert [got["1", k].text for k in (1, 2, 3)] == ["## 第 1 页\nz", "## 第 2 页\n\n（此页无文本内容）", "## 第 3 页\nx y"]
    assert [got[j, 1].text for j in "23"] == ["## 第 1 页\n\n（此页无文本内容）"] * 2 and len(got) == 9


def test_no_python_and_no_second_shuffle(spark):
    files = spark.createDataFrame([("a", "[[]]")], "job_id string, json string")
    plan = blocks.composed(blocks.block_rows(files).repartition("job_id", "k"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning(job_id") <= 2


@pytest.mark.parametrize("bad", ["", "no json", "{}", None])
def test_unreadable_lists_have_no_page(spark, bad):
    assert blocks.content_list_pages(spark.createDataFrame([("a", bad)], "job_id string, json string")).filter("text <> '## 第 1 页\n\n（此页无文本内容）'").count() == 0
