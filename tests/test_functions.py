import datetime as dt
import random
import re

import pytest
from batchloom.functions import batch, dates, jsonx, numbers, text
from pyspark.sql import functions as F

T = dt.datetime
TIMES = [
    ("2015.01.27 14:30", None, T(2015, 1, 27, 14, 30)), ("2015-01-27T14:30:00", None, T(2015, 1, 27, 14, 30)), ("2024-01-01", None, T(2024, 1, 1)), ("2024年05月07日 14时30分", None, T(2024, 5, 7, 14, 30)),
    ("11:04", "2025-06-01", T(2025, 6, 1, 11, 4)), ("11:04", None, None), ("11:04", "x", None), ("99:99", "2025-06-01", None), ("07-17 14:30", "2025-06-01", T(2025, 7, 17, 14, 30)), ("2022/4/202205.07", None, T(2022, 5, 7)),
    ("庞明女署2027.01.17", None, T(2027, 1, 17)), ("2022", None, T(2022, 1, 1)), ("署2027", None, None), ("2024-13-01", None, None), ("2024-01-01 10:10:60", None, None), ("２０２４-01-02", None, T(2024, 1, 2)), ("", None, None), ("　 ", None, None), (None, None, None),
]


def test_times(spark):
    df = spark.createDataFrame([(i, s, f) for i, (s, f, _) in enumerate(TIMES)], "i int, s string, f string")
    got = {r.i: r.t for r in df.select("i", dates.parse_time(F.col("s"), dates.parse_time(F.col("f")), dates.filled(F.col("f"))).alias("t")).collect()}
    assert [got[i] for i in range(len(TIMES))] == [t for _, _, t in TIMES]


def test_plain_layouts_are_read_at_once(spark):
    simple = ["2024-01-02 10:11", "2024-1-2T3:04:05", "2024.02.30", "2024/12/31", "2024年2月29日", "1999年13月1日", "2024-01-02 24:00", "2024-01-02 10:10:60"]
    other = ["2024-01-02\n", " 2024-01-02", "2024-01-02 1:1", "2024-01-02x", "２０２４-01-02", "2022/4/202205.07", "2024", "07-17 14:30", "2024年1月2日 3时04分", ""]
    df = spark.createDataFrame([(s,) for s in simple + other], "s string")
    rows = dates.with_times(df, t=(F.col("s"), None, None)).select("s", "t", dates.parse_time(F.col("s")).alias("searched"), dates._simple(F.col("s")).alias("simple"), dates.interval(F.col("s"), F.col("t")).alias("iv")).collect()
    assert {r.s for r in rows if r.simple} == set(simple) and all(r.t == r.searched for r in rows)
    assert {r.s: r.iv.precise for r in rows if r.t} == {r.s: bool(re.search(r"\d[:时]\d\d", r.s)) for r in rows if r.t}


def test_interval_order_is_one_sided(spark):
    said = ["2024-01-01", "2024-01-01 14:30", "2024-01-02", "2024-01-02 00:00", "2023-12-31 23:59"]
    one = spark.createDataFrame([(s,) for s in said], "s string").select("s", dates.interval(F.col("s"), dates.parse_time(F.col("s"))).alias("iv"))
    rows = one.alias("a").crossJoin(one.alias("b")).select(F.col("a.s").alias("a"), F.col("b.s").alias("b"), dates.after(F.col("a.iv"), F.col("b.iv")).alias("after"), dates.before(F.col("a.iv"), F.col("b.iv")).alias("before")).collect()
    found = {(r.a, r.b): (r.after, r.before) for r in rows}
    assert all(not (x and y) for x, y in found.values())
    assert all(found[a, b][0] == found[b, a][1] for a, b in found)
    assert found["2024-01-01", "2024-01-01 14:30"] == (False, False) and found["2024-01-02", "2024-01-01 14:30"][0] and found["2024-01-01", "2024-01-02"][1]


SPECS = [
    ("0.5-1.0", ("between", 0.5, 1.0)), ("1300~3200", ("between", 1300.0, 3200.0)), ("0.5–1.0 $m^{3}/h$", ("between", 0.5, 1.0)), ("&lt;0.3", ("lt", None, 0.3)), ("≤0.3", ("le", None, 0.3)), ("<=0.3MPa", ("le", None, 0.3)), ("NMT 0.5", ("le", None, 0.5)),
    ("不超过100", ("le", None, 100.0)), ("≥30%", ("ge", 30.0, None)), (">5", ("gt", 5.0, None)), ("NLT 30", ("ge", 30.0, None)), ("不少于30", ("ge", 30.0, None)), ("≤10^3cfu/g", ("le", None, 1000.0)), ("≤10³", ("le", None, 1000.0)), ("≤1.5×10^3", ("le", None, 1500.0)), ("{{5-1}}", ("between", 5.0, 1.0)), ("应澄清", None), ("", None), (None, None),
]


def test_specifications(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(SPECS)], "i int, s string").withColumn("t", numbers.spec_text(F.col("s")))
    got = {r.i: r.b and tuple(r.b) for r in df.select("i", numbers.parse_spec(F.col("t")).alias("b")).collect()}
    assert [got[i] for i in range(len(SPECS))] == [b for _, b in SPECS]


@pytest.mark.parametrize(("said", "unit", "spec", "value", "note"), [(99.0, "ppm", "≤50%", 0.0099, True), (5.0, "mg", "≤1g", 0.005, True), (2.0, "bar", "≤300kPa", 200.0, True), (2.0, "", "≤5g", 2.0, False), (2.0, "μg", "≤5g", None, True), (3.0, "bar", "≤5mg", None, True)])
def test_units(spark, said, unit, spec, value, note):
    r = spark.range(1).select(numbers.to_spec_unit(F.lit(said), F.lit(unit), F.lit(spec)).alias("r")).first().r
    assert (r.value == pytest.approx(value) if value else r.value is None) and bool(r.note) == note


def test_batch_numbers(spark):
    same = ["1127011N 250101", "1127011N·250101", "1127011N 25010i", "1127011N25０101", "1127011N.250l01-04", "&nbsp;1127011n 25O101"]
    got = spark.createDataFrame([(s,) for s in same], "s string").select(batch.batch_core(F.col("s")).alias("c")).distinct().collect()
    assert [r.c for r in got] == ["1127011N250101"]


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("r")).first().r


def test_cleaning(spark):
    said = "$\\text{a}$ <td style='x: y'> &nbsp;</td>  <td>\n b</td>\\n第 3 页\n2/24\n\n\n\nend\x07"
    assert one(spark, said, text.clean_ocr) == "a <td></td><td>\n b</td>\n\nend"
    assert one(spark, "审核:### x\n### 标题 ###", text.mark_unreadable) == "审核:[手写内容未识别] x\n### 标题 ###"
    assert one(spark, "<table><tr><td>a</td><td>b</td></tr></table><br/>&lt;x&gt;", text.readable_text) == "a | b |\n\n<x>"
    table = "<table><tr><td>" + "x" * 7000 + "</td></tr></table>"
    cut = one(spark, "t" * 9000 + table + table, text.clean_html)
    assert cut.startswith(table) and "跳过 1 个表格" in cut and "部分正文被裁剪" in cut and len(cut) <= 12_000
    assert one(spark, "p" * 15_000, text.clean_html).startswith("p" * 12_000 + "\n[HTML 已截断：原文 15000 字符")
    assert one(spark, "<table><tr><td>" + "y" * 15_000, text.clean_html).count("</table>") == 1


def test_masks(spark):
    urls = {"see https://h.x/p/a?X-Sig=1&b=2 now": "see https://h.x/p/a?<redacted> now", "with url: /zip/out.zip?X=1": "with url: /zip/out.zip?<redacted>", "https://h/plain": "https://h/plain", "no url": "no url", "https://h/" + "a" * 200: "https://h/" + "a" * 119 + "..."}
    for said, want in urls.items():
        assert one(spark, said, text.redact_urls) == want
    assert one(spark, "sk-abcdefgh1234 cli_abcdefgh1 bearer abcdefgh.1 " + "a1" * 16, text.mask_secrets) == "sk-*** cli_*** Bearer *** ***"
    assert one(spark, "short", text.mask_key) == "*****" and one(spark, "abcdefghijklmnop", text.mask_key) == "abcd****mnop"


def test_names_and_values(spark):
    page = "审核意见:[手写内容未识别]\n<table><tr><th>温度</th><th>QA/压力</th></tr><tr><td>1</td><td>手写内容未识别</td></tr></table>\n| 列1 | 列二 |\n|---|---|\n| 手写内容未识别 | x |\n2025.01.1:[手写内容未识别]"
    assert one(spark, page, text.unreadable_names) == ["审核意见", "QA", "压力", "列1"]
    assert one(spark, "plain", text.unreadable_names) == []
    for value, ok in (("0.974", True), ("12.50", True), ("0.988", False), ("25", False), ("25, 30", True), ("无", True)):
        assert one(spark, value, lambda c: text.grounded(text.page_letters(F.lit("<td>0.974</td>，12.50；250.0，30。")), c)) is ok, value


def test_json(spark):
    cases = {'```json\n{"a": 1}\n```': '{"a": 1}', 'x {"a": 2} y': '{"a": 2}', '{"a": {"b": [1, 2': '{"a": {"b": [1, 2]}, "_truncated_recovered": true}', '{"a": 1, "t": "cut he': '{"a": 1, "t": null, "_truncated_recovered": true}', '{"a": 1, "b":': '{"a": 1, "b": null, "_truncated_recovered": true}', "no": '{"_parse_error": true, "_raw": "no"}'}
    for said, want in cases.items():
        assert one(spark, said, jsonx.parse_json) == want, said


def cut_page(html, original):
    """The page limit by hand: a list of parts, tables chosen before text."""
    limit, parts, at = 12_000, [], 0
    for m in re.finditer(r"<table[\s>].*?</table>", html, re.S):
        parts += [(False, html[at : m.start()]), (True, m[0])]
        at = m.end()
    parts.append((False, html[at:]))
    room = limit - 128
    total = sum(len(p) for table, p in parts if table)
    chosen, used = set(), 0
    for k, (table, p) in enumerate(parts):
        if table and (total <= room or used + len(p) <= room):
            chosen.add(k)
            used += len(p)
    text, left = [], max(0, room - total)
    said = ""
    for k, (table, p) in enumerate(parts):
        if table:
            said += p if k in chosen else ""
        else:
            said += p if len(p) <= left else p[:left].rstrip()
            text.append(len(p) > left)
            left -= min(left, len(p))
    n = sum(table for table, _ in parts) - len(chosen)
    assert chosen
    return said + f"\n[HTML 已截断：原文 {original} 字符，超过上限 12000" + (f"，跳过 {n} 个表格" if n else "") + ("，部分正文被裁剪" if any(text) else "") + "，本页信息可能不完整]"


def test_long_pages_equal_brute_force(spark):
    rng, pages = random.Random(6), []
    for _ in range(60):
        parts = ["<table><tr><td>first</td></tr></table>"]
        for _ in range(rng.randrange(2, 7)):
            parts.append(rng.choice(["x" * rng.randrange(6000), f"<table b=1><tr><td>{'c' * rng.randrange(7000)}</td></tr></table>", "<p>text</p>"]))
        pages.append("".join(parts) + "y" * 3000)
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, s string").select("i", text.clean_html(F.col("s")).alias("r")).collect()
    for r in rows:
        assert r.r == (cut_page(pages[r.i], len(pages[r.i])) if len(pages[r.i]) > 12_000 else pages[r.i])


@pytest.mark.parametrize(("said", "want"), [("10^3", "1000"), ("10**2cfu", "100cfu"), ("5×10³", "5000"), ("1.5×1000", "1500"), ("1.25*10", "12.5"), ("2×3", "2×3"), ("2e3", "2000"), ("1.5E-3", "0.0015"), ("2e-5", "0.00002"), ("0.3×1", "0.3"), ("7e30", "7" + "0" * 30), ("10^999", "10^999"), ("x", "x"), (None, None)])
def test_powers(spark, said, want):
    assert one(spark, said, numbers.spread_powers) == want


@pytest.mark.parametrize(("said", "want"), [('[{"a": 1}, 2]', '{"a":1}'), ("[1]", None), ("[]", None), ('{"b": 2}', '{"b": 2}'), ("5", "5"), (None, None)])
def test_list_results(spark, said, want):
    assert one(spark, said, jsonx.first_object) == want
