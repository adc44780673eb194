"""Further sources, predicates, joins and model checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.functions import numbers, text
from batchloom.operators import reads
from batchloom.operators.rules_doc import page_findings
from batchloom.plans.audit import new_findings
from batchloom.plans.base import Tables, query
from batchloom.plans.queries_reads import D_FINDINGS, D_JOBS, findings, jobs
from batchloom.plans.queries_rules import _FOUND, _found_pages
from batchloom.providers import semantic_findings
from batchloom.sources import archives, blocks, recognised


@query("s4_nested_block_list", """WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page, turn % 4 = 1 AS lost, turn % 4 = 2 AS tab FROM conversations)
SELECT conv_id AS job_id, page::INT AS page, lost::INT AS lost, tab::INT AS tables, (NOT lost AND NOT tab)::INT AS paragraphs FROM p""")
def s4(t: Tables) -> DataFrame:
    kind = F.when(F.col("turn") % 4 == 1, "discarded").when(F.col("turn") % 4 == 2, "table").otherwise("paragraph")
    block = F.to_json(F.struct(kind.alias("type"), F.struct(F.lit("<tr>x</tr>").alias("html")).alias("content")))
    pages = t.conversations.groupBy(F.col("conv_id").alias("job_id")).agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("p"))
    files = pages.select("job_id", F.concat(F.lit("["), F.array_join(F.transform("p", lambda x: F.concat(F.lit("["), x["b"], F.lit("]"))), ","), F.lit("]")).alias("json"))
    return blocks.content_list_pages(files).select("job_id", "page", "lost", "tables", "paragraphs")


def _packed(batches):
    """Archives of jobs (``job_id, form, texts``): forms 0 and 1 have both kinds of block list, 2 only a document, 3 a list of
    page numbers beside it, 4 is cut off."""
    import io
    import json
    import zipfile

    import pyarrow as pa

    for batch in batches:
        for row in batch.to_pylist():
            raw, texts = io.BytesIO(), row["texts"]
            with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                if row["form"] in (0, 3, 4):
                    z.writestr("r/a_content_list_v2.json", json.dumps([[{"type": "paragraph", "content": {"paragraph_content": [{"content": x}]}} if row["form"] == 0 else {"type": "page_number", "text": "7"}] for x in texts]))
                if row["form"] <= 1:
                    z.writestr("r/a_content_list.json", json.dumps([{"type": "paragraph", "page_idx": k, "text": x} for k, x in enumerate(texts)]))
                z.writestr("r/full.md", "\f".join(texts))
            content = raw.getvalue()[: 40 if row["form"] == 4 else None]
            yield pa.RecordBatch.from_pylist([{"job_id": str(row["job_id"]), "content": content}], schema=pa.schema([("job_id", pa.string()), ("content", pa.binary())]))


@query("s3_result_archives", r"""WITH p AS (SELECT conv_id, row_number() OVER w AS page, count(*) OVER (PARTITION BY conv_id) AS n, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
m AS (SELECT *, list_aggregate(list_transform(string_split(CASE WHEN n = 1 AND conv_id % 5 > 1 THEN raw ELSE t END, chr(10)), lambda x: CASE WHEN starts_with(x, '### ') THEN x ELSE replace(x, '###', '[手写内容未识别]') END), 'string_agg', chr(10)) AS body FROM p)
SELECT conv_id::VARCHAR AS job_id, page::INT AS page, CASE WHEN conv_id % 5 < 2 THEN 'list' ELSE 'document' END AS origin,
  CASE WHEN conv_id % 5 < 2 THEN '## 第 ' || page || ' 页' || CASE WHEN t = '' THEN '' ELSE chr(10) || body END WHEN t = '' AND n > 1 THEN '## 第 ' || page || ' 页' || chr(10) || chr(10) || '（此页无文本内容）' ELSE body END AS said FROM m WHERE conv_id % 5 < 4
UNION ALL SELECT DISTINCT conv_id::VARCHAR, NULL, 'error', 'not readable: BadZipFile' FROM p WHERE conv_id % 5 = 4""")
def s3(t: Tables) -> DataFrame:
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    jobs = t.conversations.groupBy(F.col("conv_id").alias("job_id")).agg(texts.alias("texts")).withColumn("form", (F.col("job_id") % 5).cast("int"))
    pages, errors = archives.archive_pages(archives.members(jobs.mapInArrow(_packed, "job_id string, content binary")))
    none = errors.select("job_id", F.lit(None).cast("int").alias("page"), F.lit("error").alias("origin"), F.col("error").alias("said"))
    return pages.select("job_id", "page", "origin", F.col("text").alias("said")).unionByName(none)


_SHORT = "[OCR 警告: 服务端表格组装失败，以下为块级文本兜底，表格结构已丢失，各行内容可能串行]"


@query("s9_short_text_fallback", f"""WITH w AS (SELECT conv_id, turn, k, string_split(text, ' ')[k] AS s FROM (SELECT conv_id, turn, text, unnest(range(1, 6)) AS k FROM conversations) WHERE k <= len(string_split(text, ' '))),
p AS (SELECT conv_id, turn, k, s FROM w UNION ALL SELECT conv_id, turn, 0, text FROM conversations WHERE text IS NOT NULL)
SELECT conv_id AS job_id, turn, k::INT AS k, md5(CASE WHEN length(trim(s, ' ')) < 20 THEN '{_SHORT}' || chr(10) || chr(10) || 'block ' || turn ELSE s END) AS h FROM p""")
def s9(t: Tables) -> DataFrame:
    # a page of each whole text, and pages of its first words, most of which are short
    words = F.concat(F.array("text"), F.slice(F.split("text", " "), 1, 5))
    rows = t.conversations.filter("text IS NOT NULL").select("conv_id", "turn", F.posexplode(words).alias("k", "s"))
    page = F.struct(F.struct(F.col("s").alias("text")).alias("markdown"), F.struct(F.array(F.struct(F.concat(F.lit("block "), "turn").alias("block_content"))).alias("parsing_res_list")).alias("prunedResult"))
    lines = rows.select(F.concat("conv_id", F.lit("/"), "turn", F.lit("/"), "k").alias("job_id"), F.lit(1).alias("line_no"), F.to_json(F.struct(F.array(page).alias("layoutParsingResults"))).alias("line"))
    got = recognised.result_pages(lines)
    part = lambda k: F.split("job_id", "/")[k].cast("bigint")
    return got.select(part(0).alias("job_id"), part(1).alias("turn"), part(2).cast("int").alias("k"), F.md5(F.col("text").cast("binary")).alias("h"))


@query("s12_new_findings", f"""WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, page, type, description ORDER BY event_id) AS nth FROM ({_FOUND} events) WHERE type IS NOT NULL) WHERE nth = 1)
SELECT job_id, page, type, description FROM f WHERE type <> 'click'""")
def s12(t: Tables) -> DataFrame:
    found = page_findings(_found_pages(t))
    return new_findings(found, found.filter("type = 'click'")).select("job_id", "page", "type", "description")


@query("s17_user_rules", "SELECT 'r' || p_partkey AS id, p_name AS text, p_partkey % 3 <> 0 AS active FROM part WHERE p_partkey % 5 > 1 ORDER BY p_partkey LIMIT 100")
def s17(t: Tables) -> DataFrame:
    rule = F.to_json(F.struct(F.concat(F.lit("r"), "p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 > 1, F.col("p_name")).otherwise(" ").alias("text"), F.when(F.col("p_partkey") % 3 == 0, False).alias("active")))
    rows = t.part.select(F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 5 == 0, "7").otherwise(rule).alias("json"))
    return reads.user_rules(rows)


@query("s18_resume", "SELECT o_custkey AS job_id, count(DISTINCT o_orderkey) FILTER (WHERE o_orderstatus <> 'F') AS read, min(o_custkey % 12) > 0 AND count(DISTINCT o_orderkey) FILTER (WHERE o_orderstatus <> 'F') >= min(o_custkey % 12) AS reuse FROM orders GROUP BY o_custkey")
def s18(t: Tables) -> DataFrame:
    pages = t.orders.select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("page"), F.when(F.col("o_orderstatus") != "F", "x").alias("raw_html"))
    jobs = t.orders.select(F.col("o_custkey").alias("id"), (F.col("o_custkey") % 12).alias("total_pages")).distinct()
    return reads.reusable(jobs, pages.union(pages))


@query("j6_matching_names", "SELECT p_partkey, contains(p_name, 'ring') OR contains('red widget no. 5', p_name) AS hit FROM part")
def j6(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.names_match(F.col("p_name"), F.array(F.lit("ring"), F.lit("red widget no. 5"), F.lit("r"))).alias("hit"))


@query("t7_unreadable_names", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '') || ',签名' WHEN 1 THEN '压力' ELSE '' END AS names FROM part")
def t7(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 3
    label = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit(":[手写内容未识别] ；签名[手写内容未识别]"))
    table = F.lit("<table><tr><th>温度</th><th>压力</th></tr><tr><td>1</td><td>[手写内容未识别]</td></tr></table>")
    return t.part.select("p_partkey", F.array_join(text.unreadable_names(F.when(k == 0, label).when(k == 1, table).otherwise(F.col("p_name"))), ",").alias("names"))


@query("t9_composed_pages", r"""WITH b AS (SELECT conv_id, turn, CASE turn % 5 WHEN 3 THEN 'title' WHEN 4 THEN 'table' ELSE 'text' END AS kind, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS s FROM conversations),
v AS (SELECT * FROM b WHERE s <> '' OR kind = 'table'), w AS (SELECT *, lag(kind) OVER o AS lk, lag(s) OVER o AS ls FROM v WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(CASE WHEN kind = 'text' AND lk = 'text' AND NOT regexp_matches(ls, '[。！？.!?;；]$') THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM w),
l AS (SELECT conv_id, p, string_agg(CASE kind WHEN 'title' THEN '## ' || s WHEN 'table' THEN chr(10) || CASE WHEN s = '' THEN '[表格内容提取失败 — OCR 结构缺失]' ELSE s END || chr(10) ELSE s END, ' ' ORDER BY turn) AS line FROM g GROUP BY conv_id, p),
t AS (SELECT conv_id, '## 第 1 页' || coalesce(chr(10) || string_agg(line, chr(10) ORDER BY p), '') AS t FROM l GROUP BY conv_id)
SELECT conv_id AS job_id, md5(regexp_replace(list_aggregate(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN starts_with(x, '### ') THEN x ELSE replace(x, '###', '[手写内容未识别]') END), 'string_agg', chr(10)), '^\s+|\s+$', '', 'g')) AS h FROM t""")
def t9(t: Tables) -> DataFrame:
    kind = F.when(F.col("turn") % 5 == 3, "title").when(F.col("turn") % 5 == 4, "table").otherwise("text")
    body = F.when(kind == "table", F.to_json(F.struct(kind.alias("type"), F.col("text").alias("table_body")))).otherwise(F.to_json(F.struct(kind.alias("type"), "text")))
    files = t.conversations.groupBy(F.col("conv_id").alias("job_id")).agg(F.concat(F.lit("[["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", body.alias("b")))), lambda x: x["b"]), ","), F.lit("]]")).alias("json"))
    return blocks.content_list_pages(files).select("job_id", F.md5(F.col("text").cast("binary")).alias("h"))


@query("t17_entities", "SELECT p_partkey, '<' || p_size || '≤' || chr(160) || p_name || '&' AS s FROM part")
def t17(t: Tables) -> DataFrame:
    # a small file is few tasks, and the work on a row is long: dealt out anew
    return t.part.select("p_partkey", "p_name", "p_size").repartition("p_partkey").select("p_partkey", numbers.unescape(F.concat(F.lit("&lt;"), F.col("p_size").cast("string"), F.lit("&le;&nbsp;"), F.col("p_name"), F.lit("&amp;"))).alias("s"))


@query("t22_hashes", "SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents")
def t22(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("m"), F.sha2("text", 256).alias("s"))


@query("t23_byte_order_mark", "SELECT doc_id, doc_id % 4 = 0 AS marked FROM documents")
def t23(t: Tables) -> DataFrame:
    body = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("﻿"), F.col("text"))).otherwise(F.col("text")).cast("binary")
    return t.documents.select("doc_id", (F.hex(F.substring(body, 1, 3)) == "EFBBBF").alias("marked"))


@query("p10_allowed_values", f"SELECT id, status IN ('confirmed', 'rejected') AS reviewed, CASE WHEN source = 'user_rule' AND job_id % 2 = 0 THEN job_id END AS rule_id FROM {D_FINDINGS}")
def p10(t: Tables) -> DataFrame:
    known = t.events.filter("user_id % 2 = 0").select(F.col("user_id").alias("rule_id")).distinct()
    rows = findings(t).withColumn("want", F.when(F.col("source") == "user_rule", F.col("job_id")))
    return rows.join(known, rows.want == known.rule_id, "left").select("id", F.col("status").isin("confirmed", "rejected").alias("reviewed"), "rule_id")


@query("p11_detail_probe", "SELECT DISTINCT o_custkey AS job_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 > 0")
def p11(t: Tables) -> DataFrame:
    ok = F.when(F.col("o_orderkey") % 3 > 0, "True").otherwise("False")
    audit = t.orders.select(F.col("o_custkey").alias("job_id"), F.lit("notify").alias("action"), F.concat(F.lit("status="), "o_orderstatus", F.lit(" ok="), ok, F.lit(" code=0")).alias("detail"))
    return reads.told_before(audit.unionByName(audit.withColumn("action", F.lit("other")).withColumn("detail", F.lit("status=F ok=True"))), "notify", "F")


@query("o6_archived_newest", f"SELECT id, created_at FROM {D_JOBS} WHERE status = 'archived' ORDER BY created_at DESC, id LIMIT 100")
def o6(t: Tables) -> DataFrame:
    return jobs(t).filter("status = 'archived'").orderBy(F.desc("created_at"), "id").limit(100).select("id", "created_at")


@query("o2_page_order_without_default", f"SELECT id, row_number() OVER (PARTITION BY job_id, page ORDER BY CASE coalesce(source, '?') WHEN 'rule' THEN 0 WHEN 'llm_fallback' THEN 1 WHEN 'llm_page' THEN 2 WHEN 'llm_cross' THEN 3 ELSE 4 END, id) AS nth FROM {D_FINDINGS}")
def o2(t: Tables) -> DataFrame:
    return reads.in_page_order(findings(t)).select("id", "nth")


@query("sem_semantic_findings", """SELECT user_id::VARCHAR AS job_id, (event_id % 30)::INT AS page, event_type AS description, CASE WHEN event_id % 4 = 0 THEN 'user_rule' ELSE 'llm_cross' END AS source, CASE WHEN event_id % 4 = 0 AND user_id % 2 = 0 THEN 'u' || user_id END AS rule_id
  FROM events WHERE event_id % 5 <> 0""")
def sem(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_id") % 4 == 0, "user_rule").otherwise("time_reversal")
    one = F.to_json(F.struct((F.col("event_id") % 30).alias("page"), kind.alias("type"), F.lit("info").alias("severity"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("description"), F.concat(F.lit("u"), "user_id").alias("rule_id")))
    answers = t.events.groupBy(F.col("user_id").cast("string").alias("job_id")).agg(F.concat(F.lit('{"findings": ["x", '), F.array_join(F.collect_list(one), ","), F.lit("]}")).alias("json"))
    rules = t.events.filter("user_id % 2 = 0").select(F.concat(F.lit("u"), "user_id").alias("id")).distinct()
    return semantic_findings(answers, rules).select("job_id", "page", "description", "source", "rule_id")
