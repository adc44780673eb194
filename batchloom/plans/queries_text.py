"""Text, markup, JSON and source operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.functions import batch, dates, jsonx, numbers, text
from batchloom.plans.base import Tables, query
from batchloom.sources import blocks, page_json, recognised


@query("d1_parse_time", """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate + INTERVAL 14 HOUR + INTERVAL 5 MINUTE WHEN 2 THEN o_orderdate WHEN 3 THEN o_orderdate + INTERVAL 9 HOUR WHEN 4 THEN NULL WHEN 5 THEN date_trunc('year', o_orderdate) WHEN 6 THEN o_orderdate + INTERVAL 11 HOUR + INTERVAL 4 MINUTE ELSE NULL END AS moment FROM orders""")
def d1(t: Tables) -> DataFrame:
    f = lambda p: F.date_format("o_orderdate", p)
    k = F.col("o_orderkey") % 8
    said = F.when(k == 0, f("yyyy/M/d")).when(k == 1, F.concat(f("yyyy-MM-dd"), F.lit("T14:05:00"))).when(k == 2, F.concat(F.lit("署"), f("yyyy.MM.dd"))).when(k == 3, F.concat(f("yyyy年M月d日"), F.lit(" 09时00分"))).when(k == 4, F.concat(f("yyyy"), F.lit("-13-01"))).when(k == 5, f("yyyy")).when(k == 6, F.lit("11:04")).otherwise(F.lit("99:99"))
    day = f("yyyy-MM-dd")
    return t.orders.select("o_orderkey", dates.parse_time(said, dates.parse_time(day), F.lit(True)).alias("moment"))


@query("d2_year", """SELECT o_orderkey, CASE WHEN o_custkey % 7 IN (4, 6) OR (o_orderkey % 5 = 4 AND o_custkey % 7 <> 2) THEN NULL ELSE year(o_orderdate) END::INT AS year FROM orders""")
def d2(t: Tables) -> DataFrame:
    # a date in one of several layouts, or none, inside words; a year beside a letter or, in most layouts, a digit is no year
    f = lambda p: F.date_format("o_orderdate", p)
    layouts = [f("yyyy.MM.dd"), f("yyyy-M-d"), f("yyyy年M月d日"), f("yyyy/MM/dd HH:mm"), F.concat(f("yyyy年"), F.lit(" "), f("M月d日")), F.concat(f("yyyy"), F.lit(" 年")), F.lit("n/a")]
    said = F.element_at(F.array(*layouts), (F.col("o_custkey") % 7 + 1).cast("int"))
    around = F.when(F.col("o_orderkey") % 5 == 4, F.concat(F.lit("批9"), said)).otherwise(F.concat(F.lit("日期 "), said, F.lit(" "), F.col("o_orderpriority")))
    return t.orders.select("o_orderkey", dates.parse_year(around).alias("year"))


@query("n1_powers", """SELECT p_partkey, p_name || ' 1' || repeat('0', p_size % 12) || ' and <=1' || repeat('0', (p_partkey % 10)::INT) || 'cfu, ' || (p_size * power(10, p_partkey % 7))::BIGINT || ' or ' || ((p_partkey % 97) * power(10, p_size % 5))::BIGINT || '; 2^' || p_size AS s FROM part""")
def n1(t: Tables) -> DataFrame:
    size, key = F.col("p_size").cast("string"), lambda n: (F.col("p_partkey") % n).cast("string")
    raised = F.translate(key(10), "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")
    small = F.concat(F.lit(" 10"), F.when(F.col("p_partkey") % 2 == 0, " ^ ").otherwise("**"), (F.col("p_size") % 12).cast("string"))
    product = F.concat(size, F.when(F.col("p_partkey") % 3 == 0, " × ").otherwise("*"), F.lit("10^"), key(7))
    said = F.concat("p_name", small, F.lit(" and <=10"), raised, F.lit("cfu, "), product, F.lit(" or "), key(97), F.when(F.col("p_partkey") % 2 == 0, "e").otherwise("E+"), (F.col("p_size") % 5).cast("string"), F.lit("; 2^"), size)
    # a small file is few tasks, and the work on a row is long: dealt out anew
    return t.part.select("p_partkey", "p_name", "p_size").repartition("p_partkey").select("p_partkey", numbers.spread_powers(said).alias("s"))


_UNITS = sorted({u for a, to in numbers.CONVERSIONS.items() for u in (a, *to)})
_D_UNITS = "[" + ", ".join(f"'{u}'" for u in _UNITS) + "]"
_N = len(_UNITS)
_D_FACTORS = ", ".join(f"('{a}', '{b}', {x!r}::DOUBLE)" for a, to in numbers.CONVERSIONS.items() for b, x in to.items())


def _unit(of: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, _UNITS)), (F.pmod(of, F.lit(_N)) + 1).cast("int"))


@query("n5_unit", f"SELECT p_partkey, CASE WHEN p_size % 6 = 5 THEN '' ELSE ({_D_UNITS})[p_partkey % {_N} + 1] END AS unit FROM part")
def n5(t: Tables) -> DataFrame:
    unit = F.when(F.col("p_size") % 2 == 0, _unit(F.col("p_partkey"))).otherwise(F.regexp_replace(F.upper(F.regexp_replace(_unit(F.col("p_partkey")), "µ", "~")), "~", "µ"))
    number = F.concat(F.lit("≤"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 3 == 0, ".25 ").otherwise(""))
    said = F.when(F.col("p_size") % 6 == 5, number).otherwise(F.concat(number, unit, F.when(F.col("p_size") % 4 == 0, F.lit(" ，备注")).otherwise("")))
    return t.part.select("p_partkey", numbers.parse_unit(said).alias("unit"))


@query("j2_unit_conversion", f"""WITH u AS (SELECT p_partkey, p_retailprice AS x, CASE WHEN p_size % 8 = 0 THEN '' ELSE ({_D_UNITS})[p_partkey % {_N} + 1] END AS a, ({_D_UNITS})[(p_partkey // {_N} + p_size) % {_N} + 1] AS b FROM part), f(a, b, k) AS (VALUES {_D_FACTORS})
SELECT p_partkey, CASE WHEN u.a IN ('', u.b) THEN x ELSE x * k END AS value, CASE WHEN u.a NOT IN ('', u.b) AND k IS NULL THEN 'unit_mismatch' ELSE '' END AS note FROM u LEFT JOIN f ON u.a = f.a AND u.b = f.b""")
def j2(t: Tables) -> DataFrame:
    unit = F.when(F.col("p_size") % 8 == 0, "").otherwise(_unit(F.col("p_partkey")))
    spec = F.concat(F.lit("≤"), F.col("p_size").cast("string"), F.lit(" "), _unit(F.expr(f"p_partkey div {_N} + p_size")))
    moved = numbers.to_spec_unit(F.col("p_retailprice"), unit, spec)
    return t.part.select("p_partkey", moved["value"].alias("value"), F.when(moved["note"] == "unit_mismatch", moved["note"]).otherwise("").alias("note"))


@query("t1_batch_number", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(translate(replace(p_name, ' ', ''), 'iIloO', '11100')) ELSE 'B250101' END AS n FROM part")
def t1(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 3
    return t.part.select("p_partkey", batch.batch_number(F.when(k == 0, F.col("p_name")).when(k == 1, "b·25010i").otherwise("Ｂ 25°01,0l")).alias("n"))


_RE_WS = r"[\s\x{00A0}\x{2000}-\x{200A}\x{3000}\x0B\x1C-\x1F\x{0085}]"


@query("t2_clean_recognised", rf"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '\$+', '', 'g'), '\\[a-zA-Z]{{2,}}', '', 'g'), '[{{}}]', '', 'g') AS s FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(s, '\n', chr(10)), '\t', chr(9)), '{_RE_WS}*style=[''"][^''"]*[''"]', '', 'g'), '{_RE_WS}*width=[''"][^''"]*[''"]', '', 'g'), '>{_RE_WS}+<', '><', 'g') AS s FROM a),
c AS (SELECT page_id, regexp_replace(s, ' {{2,}}', ' ', 'g') AS s FROM b), d AS (SELECT page_id, array_to_string(list_filter(string_split(s, chr(10)), lambda x: NOT regexp_full_match(x, '{_RE_WS}*(第{_RE_WS}*[0-9]+{_RE_WS}*页|[0-9]+{_RE_WS}*/{_RE_WS}*[0-9]+){_RE_WS}*')), chr(10)) AS s FROM c)
SELECT page_id, md5(regexp_replace(regexp_replace(s, '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_RE_WS}+|{_RE_WS}+$', '', 'g')) AS h FROM d""")
def t2(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(text.clean_ocr(F.col("html")).cast("binary")).alias("h"))


@query("t3_collapsed_html", rf"SELECT page_id, md5(regexp_replace(html, '{_RE_WS}+', ' ', 'g')) AS h FROM pages")
def t3(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(text.collapsed_html(F.col("html")).cast("binary")).alias("h"))


@query("t4_clean_html")
def t4(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.clean_html(F.col("html")).alias("html")).select("page_id", F.length("html").alias("n"), F.contains("html", F.lit("HTML 已截断")).alias("cut"), F.md5(F.col("html").cast("binary")).alias("h"))


@query("t5_plain_text", rf"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{_RE_WS}+', ' ', 'g'), '^ | $', '', 'g')) AS h FROM pages")
def t5(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(text.plain_text(F.col("html")).cast("binary")).alias("h"))


def _d_chain(column: str, *steps: tuple[str, str, str]) -> str:
    for pattern, by, flags in steps:
        column = f"regexp_replace({column}, '{pattern}', '{by}', '{flags}')"
    return column


_D_READABLE = _d_chain(
    r"replace(replace(html, '\n', chr(10)), '\t', chr(9))", (r"<br\s*/?>", "\n", "gi"), ("<img[^>]*>", "[图]", "gi"), ("</tr>", "\n", "gi"), ("</t[dh]>", " | ", "gi"), ("</p>", "\n", "gi"), ("<div[^>]*>", "\n", "gi"), ("<[^>]+>", "", "g"),
    ("&nbsp;", " ", "gi"), ("&amp;", "&", "gi"), ("&lt;", "<", "gi"), ("&gt;", ">", "gi"), ("&quot;", '"', "gi"), (r"[ \t]+", " ", "g"), (r" *\| *", " | ", "g"), (r"[ \t]+\n", "\n", "g"), (r"\n{3,}", "\n\n", "g"),
)


@query("t6_readable_text", rf"SELECT page_id, regexp_replace({_D_READABLE}, '^[\s\x{{A0}}\x{{3000}}]+|[\s\x{{A0}}\x{{3000}}]+$', '', 'g') AS text FROM pages")
def t6(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.readable_text(F.col("html")).alias("text"))


@query("t8_unreadable_marks", "SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN starts_with(x, '### ') THEN x ELSE replace(x, '###', '[手写内容未识别]') END), chr(10))) AS h FROM documents")
def t8(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.mark_unreadable(F.col("text")).cast("binary")).alias("h"))


@query("t12_redact_urls", "SELECT page_id, regexp_replace(regexp_replace(url, '[?][^#]+(#.*)?$', '?<redacted>'), '#.*$', '') AS url FROM pages")
def t12(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.redact_urls(F.col("url")).alias("url"))


@query("t13_mask_secrets", "SELECT doc_id, md5(regexp_replace(text, '(^|[^0-9a-fA-F])[0-9a-fA-F]{32}($|[^0-9a-fA-F])', '\\1***\\2', 'g')) AS h FROM documents")
def t13(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.mask_secrets(F.col("text")).cast("binary")).alias("h"))


@query("t14_escape_markdown", "SELECT page_id, md5(replace(replace(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '!', '&#33;'), '[', '&#91;'), ']', '&#93;'), '(', '&#40;'), ')', '&#41;')) AS h FROM pages")
def t14(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(text.escape_markdown(F.col("html")).cast("binary")).alias("h"))


@query("t15_page_links", "SELECT o_orderkey, '见<a href=\"/jobs/j1/review?page=' || o_custkey || '\" class=\"page-link\">第' || o_custkey || '页</a> &lt;b&gt;' AS s FROM orders")
def t15(t: Tables) -> DataFrame:
    said = F.concat(F.lit("见第"), F.col("o_custkey").cast("string"), F.lit("页 <b>"))
    return t.orders.select("o_orderkey", text.page_links(said, F.lit("j1")).alias("s"))


@query("t16_locate", r"""WITH w AS (SELECT item_id, b.text AS e, doc_id, d.text AS body FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
l AS (SELECT item_id, body, list_filter(regexp_split_to_array(e, '[\s|；;，,]+'), lambda x: length(x) >= 4 AND contains(body, x)) AS ws FROM w)
SELECT item_id, CASE WHEN len(ws) > 0 THEN ws[1] END AS token, CASE WHEN len(ws) > 0 THEN instr(body, ws[1]) - 1 END AS place FROM l""")
def t16(t: Tables) -> DataFrame:
    rows = t.benchmark.withColumnRenamed("text", "e").join(t.documents, F.col("item_id") == F.col("doc_id"))
    found = text.locate(F.col("e"), F.col("text"))
    return rows.select("item_id", found["token"].alias("token"), found["place"].cast("bigint").alias("place"))


@query("t18_value_source", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'handwritten' WHEN 1 THEN 'printed' WHEN 2 THEN 'handwritten' ELSE 'unknown' END AS s FROM part")
def t18(t: Tables) -> DataFrame:
    name = F.concat("p_name", F.element_at(F.array(F.lit("实测值"), F.lit("规格范围"), F.lit("标准记录"), F.lit("温度")), (F.col("p_partkey") % 4 + 1).cast("int")))
    return t.part.select("p_partkey", text.value_source(name).alias("s"))


@query("t19_grounded", r"""SELECT doc_id, CASE WHEN length(b) < 4 THEN true WHEN length(n_chars::VARCHAR) >= 4 THEN contains(b, n_chars::VARCHAR) ELSE regexp_matches(b, '(^|[^0-9.])' || n_chars || '($|[^0-9.])') END AS ok
  FROM (SELECT doc_id, n_chars, lower(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[\s\x{00A0}\x{3000}\x0B\x1C-\x1F\x{0085}]+', '', 'g')) AS b FROM documents)""")
def t19(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.grounded(text.page_letters(F.col("text")), F.concat(F.col("n_chars").cast("string"), F.lit(" 字"))).alias("ok"))


@query("t20_labels", "SELECT event_id, CASE event_type WHEN 'view' THEN '严重' WHEN 'click' THEN '警告' ELSE event_type END AS label FROM events")
def t20(t: Tables) -> DataFrame:
    code = F.when(F.col("event_type") == "view", "critical").when(F.col("event_type") == "click", "warning").otherwise(F.col("event_type"))
    return t.events.select("event_id", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in text.SEVERITY_LABELS.items() for x in p]), code), code).alias("label"))


@query("t21_warning_prefix", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '低质 ' || doc_id END AS warning, md5(trim(text, ' ' || chr(10) || chr(9) || chr(13) || chr(160))) AS h FROM documents")
def t21(t: Tables) -> DataFrame:
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("[OCR 警告: 低质 "), F.col("doc_id").cast("string"), F.lit("]\n"), F.col("text"))).otherwise(F.col("text"))
    cut = text.warning_of(said)
    return t.documents.select("doc_id", cut["warning"].alias("warning"), F.md5(cut["text"].cast("binary")).alias("h"))


@query("n10_mask_keys", "SELECT c_custkey, CASE WHEN length(k) <= 12 THEN repeat('*', length(k)) ELSE k[1:4] || '****' || k[-4:] END AS k FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS k FROM customer)")
def n10(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", text.mask_key(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.col("c_name"))).alias("k"))


_D_STUB = "CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN '<table><tr><td>' || page_id || '</td></tr></table>' WHEN 2 THEN repeat('<p></p>', 30) ELSE 'page ' || page_id END"


@query("p12_empty_and_sparse_pages", f"""SELECT page_id, length(h) < 100 OR length(regexp_replace(h, '<[^>]+>', '', 'g')) < 100 AS empty, CASE WHEN contains(h, '<table') THEN length(h) < 200 AND len(string_split(h, '<tr')) - 1 < 3 ELSE length(h) < 80 END AS sparse FROM (SELECT page_id, {_D_STUB} AS h FROM pages)""")
def p12(t: Tables) -> DataFrame:
    h = F.expr(_D_STUB.replace("|| page_id", "|| CAST(page_id AS string)"))
    return t.pages.select("page_id", text.empty_page(h).alias("empty"), text.sparse_page(h).alias("sparse"))


@query("x1_repaired_json", "SELECT event_id, CASE WHEN event_id % 7 = 6 THEN NULL ELSE (props->>'$.k')::INT END AS k, event_id % 7 < 6 AS ok FROM events")
def x1(t: Tables) -> DataFrame:
    p, k = F.col("props"), F.col("event_id") % 7
    said = F.when(k == 0, F.expr("substring(props, 1, length(props) - 1)")).when(k == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Result: "), p, F.lit(" done"))).when(k == 3, F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "note": "cut he'))).when(k == 4, F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "steps": [1, 2'))).when(k == 6, "no json").otherwise(p)
    made = jsonx.parse_json(said)
    return t.events.select("event_id", F.get_json_object(made, "$.k").try_cast("int").alias("k"), jsonx.parsed_ok(made).alias("ok"))


@query("n8_progress", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE (props->>'$.k')::INT END AS done, CASE event_id % 4 WHEN 0 THEN 'ocr' WHEN 1 THEN CASE WHEN (props->>'$.k')::INT >= 50 THEN 'cross' ELSE 'analyze' END WHEN 2 THEN 'done' ELSE 'idle' END AS phase FROM events")
def n8(t: Tables) -> DataFrame:
    note = F.when(F.col("event_id") % 3 == 2, F.expr("substring(props, 1, 4)")).otherwise(F.replace("props", F.lit('"k"'), F.lit('"done"')))
    status = F.element_at(F.array(*map(F.lit, ["ocr_running", "analyzing", "review", "pending"])), (F.col("event_id") % 4 + 1).cast("int"))
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select("event_id", jsonx.progress(note)["done"].alias("done"), jsonx.phase(status, k, F.lit(50)).alias("phase"))


def _page_json(t: Tables) -> DataFrame:
    """Polluted page results: elements of the wrong type among sound ones."""
    j = F.concat(F.lit('{"page_info": "x", "steps": ["foo", {"step_no": '), F.col("event_id").cast("string"), F.lit(', "operation": 123, "parameters": "oops", "measurements": [5, {"time": "10:00", "values": {"b实测": {"actual": '), F.col("value").cast("decimal(12,2)").cast("string"), F.lit(', "spec": "≤50"}, "a": "bad"}}]}, null, 7], "event_year_groups": {"draft": ["2022年", 2022, true, "2021"], "review": 5}, "overall_confidence": 5}'))
    return t.events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("page"), F.when(F.col("event_id") % 5 == 0, '{"_parse_error": true}').otherwise(j).alias("structured_json"))


@query("x4_typed_pages", "SELECT event_id::INT AS page, 1 AS n_steps, event_id::VARCHAR AS step_no, '123' AS operation, 'b实测' AS col, 'handwritten' AS value_source, '2022,2021' AS years FROM events WHERE event_id % 5 <> 0")
def x4(t: Tables) -> DataFrame:
    pages = page_json.typed_pages(_page_json(t))
    s = F.col("steps")[0]
    cell = s["measurements"][0]["values"][0]
    return pages.select("page", F.size("steps").alias("n_steps"), s["step_no"].alias("step_no"), s["operation"].alias("operation"), cell["col"].alias("col"), cell["value_source"].alias("value_source"), F.concat_ws(",", F.col("event_year_groups")["draft"]).alias("years"))


@query("x3_page_problems", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'missing field: page_info|missing field: steps' ELSE 'event_year_groups.review must be an array' END AS said FROM events")
def x3(t: Tables) -> DataFrame:
    return _page_json(t).select(F.col("page").alias("event_id"), F.array_join(page_json.problems(F.col("structured_json"), F.col("page")), "|").alias("said"))


@query("s1_uploads", "SELECT page_id, md5('%PDF-' || html) AS h, page_id % 3 = 0 AS accepted FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, md5(html), false FROM pages WHERE page_id % 3 <> 0")
def s1(t: Tables) -> DataFrame:
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("%PDF-"), F.col("html"))).otherwise(F.col("html"))
    files = t.pages.select(F.col("page_id").alias("path"), F.octet_length(body).cast("bigint").alias("length"), body.cast("binary").alias("content"))
    return recognised.uploads(files).select(F.col("path").alias("page_id"), F.col("md5").alias("h"), "accepted")


@query("s5_flat_block_list", """WITH t AS (SELECT conv_id, (turn * 3 // 2)::INT AS k, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM conversations), p AS (SELECT conv_id, unnest(range(0, max(k) + 1))::INT AS k FROM t GROUP BY conv_id)
SELECT p.conv_id AS job_id, p.k + 1 AS page, t.k IS NULL AS blank, CASE WHEN t.s = '' THEN 0 ELSE length(t.s) END AS n FROM p LEFT JOIN t USING (conv_id, k)""")
def s5(t: Tables) -> DataFrame:
    # every third page has no block
    block = F.to_json(F.struct(F.expr("turn * 3 div 2").alias("page_idx"), F.lit("paragraph").alias("type"), "text"))
    files = t.conversations.groupBy(F.col("conv_id").alias("job_id")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(block), ","), F.lit("]")).alias("json"))
    blank = F.contains("text", F.lit("（此页无文本内容）"))
    said = F.length(F.regexp_replace("text", r"^## 第 \d+ 页\n?", ""))
    return blocks.content_list_pages(files).select("job_id", "page", blank.alias("blank"), F.when(~blank, said).alias("n"))


@query("s6_markdown_pages", "WITH m AS (SELECT conv_id AS job_id, string_split(string_agg(text, chr(12) ORDER BY turn), chr(12)) AS p FROM conversations GROUP BY conv_id) SELECT job_id, k::INT AS page, length(p[k])::INT AS n FROM (SELECT job_id, p, unnest(range(1, len(p) + 1)) AS k FROM m)")
def s6(t: Tables) -> DataFrame:
    files = t.sql("SELECT conv_id AS job_id, array_join(transform(array_sort(collect_list(struct(turn, text))), x -> x.text), '\f') AS md FROM {conversations} GROUP BY conv_id")
    return recognised.markdown_pages(files).select("job_id", "page", F.length("text").alias("n"))


_D_BARS = "len(list_filter(string_split(text, chr(10)), lambda x: starts_with(ltrim(x, ' '), '|')))"


@query("s7_incomplete", f"""SELECT conv_id, turn, CASE WHEN trim(text, ' ') = '' THEN false ELSE (turn % 2 = 0 AND {_D_BARS} >= 2) OR (turn % 3 = 0 AND {_D_BARS} = 0) END AS bad FROM (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN '| a | b |' || chr(10) || ' | - | - |' || chr(10) || text ELSE text END AS text FROM conversations)""")
def s7(t: Tables) -> DataFrame:
    said = F.when(F.col("turn") % 5 == 0, F.concat(F.lit("| a | b |\n | - | - |\n"), F.col("text"))).otherwise(F.col("text"))
    one = F.size(recognised.markdown_parts(said)) - 1  # as many pages as the document has
    return t.conversations.select("conv_id", "turn", recognised.incomplete(said, one, (F.col("turn") % 2).cast("int"), (F.col("turn") % 3).cast("int")).alias("bad"))


@query("s8_result_lines", "SELECT conv_id AS job_id, count(*) FILTER (WHERE turn % 4 <> 3)::BIGINT + 4 * count(*) FILTER (WHERE turn % 4 = 3)::BIGINT AS pages FROM conversations GROUP BY conv_id")
def s8(t: Tables) -> DataFrame:
    page = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct("text").alias("markdown"))).alias("layoutParsingResults")).alias("result")))
    lines = t.conversations.select(F.col("conv_id").alias("job_id"), F.col("turn").alias("line_no"), F.when(F.col("turn") % 4 == 3, '{"cut').otherwise(page).alias("line"))
    return recognised.result_pages(lines).groupBy("job_id").agg(F.max("page").cast("bigint").alias("pages"))
