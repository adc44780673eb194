import json
import os

from batchloom.operators import reads, upkeep
from batchloom.operators.report import json_report, markdown_report
from batchloom.providers import Offline, semantic_findings
from batchloom.sources import blocks, page_json, recognised
from batchloom.sources.page_table import append_pages, read_pages
from batchloom.streaming.lifecycle import TRANSITIONS, admitted, replay
from pyspark.sql import functions as F

ATTEMPTS = [("a", 1, "ocr_running"), ("a", 2, "review"), ("a", 3, "ocr_done"), ("b", 1, "archived"), ("b", 2, "review"), ("b", 3, "review"), ("a", 4, "analyzing"), ("a", 5, "partial_review")]
WANT = [("a", 1, "pending", "ocr_running", True), ("a", 2, "ocr_running", "review", False), ("a", 3, "ocr_running", "ocr_done", True), ("a", 4, "ocr_done", "analyzing", True), ("a", 5, "analyzing", "partial_review", True), ("b", 1, "pending", "archived", True), ("b", 2, "archived", "review", True), ("b", 3, "review", "review", False)]
SCHEMA = "job_id string, seq long, new string"


def test_transitions(spark):
    assert sum(map(len, TRANSITIONS.values())) == 25
    df = spark.createDataFrame(ATTEMPTS, SCHEMA)
    assert sorted(map(tuple, replay(df).collect())) == WANT and replay(df.filter("false")).count() == 0
    more = [("c", k, ("ocr_running", "error", "pending", "nonsense", None)[k % 5]) for k in range(50_000)] + [(None, 1, "error"), (None, 2, "pending")]
    want, now = {}, "pending"
    for _, k, new in sorted(more[:50_000]):
        want[k] = (now, new in TRANSITIONS[now])
        now = new if want[k][1] else now
    got = replay(spark.createDataFrame(more, SCHEMA).repartition(7)).collect()
    assert {r.seq: (r.current, r.accepted) for r in got if r.job_id} == want and [(r.seq, r.accepted) for r in sorted(got, key=lambda r: r.seq) if r.job_id is None] == [(1, True), (2, True)]


def test_admission_counts_only_what_was_taken(spark):
    rows = [("s", 1, 0, 10), ("s", 2, 1, 5), ("s", 3, 2, None), ("s", 4, 3, 4), ("s", 5, 5, 9), ("s", 6, 5, 9), ("s", 7, 9, 9), ("s", 8, 9, 99), ("s", 9, 10, 11), ("s", 10, 10, 11), ("t", 11, 3, 4), (None, 12, 3, 4), ("t", 13, None, 4)]
    df = spark.createDataFrame(rows, "site string, job_id int, at long, ends_at long")
    got = {r.job_id: (r.active, r.accepted) for r in admitted(df.repartition(5)).collect()}
    assert got == {1: (0, True), 2: (1, True), 3: (2, True), 4: (3, False), 5: (2, True), 6: (3, False), 7: (2, True), 8: (2, True), 9: (2, True), 10: (3, False), 11: (0, True), 12: (0, True)}
    assert admitted(df.filter("false")).count() == 0


def test_pages_arrive_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for rows in ([("j", 2, "b"), ("j", 1, "a")], [("j", 2, "b"), ("j", 3, "c")]):
        spark.createDataFrame(rows, "job_id string, page int, raw_html string").write.mode("append").json(source)
        append_pages(spark.readStream.schema("job_id string, page int, raw_html string").json(source), out, checkpoint).awaitTermination(120)
    got = read_pages(spark, out).select("job_id", "page", "raw_html")
    assert sorted(map(tuple, got.collect())) == [("j", 1, "a"), ("j", 2, "b"), ("j", 3, "c")]
    jobs = spark.createDataFrame([("j", 5)], "job_id string, total_pages int")
    assert [r.page for r in reads.missing_pages(jobs, got).orderBy("page").collect()] == [4, 5]
    assert os.path.isdir(out)


def test_reports(spark):
    jobs = spark.createDataFrame([("r", "a<b>.pdf", "review", 2), ("empty", "x", "review", 1)], "id string, filename string, status string, total_pages int")
    rows = [(1, "r", 1, "参数越界", "critical", "d![x](u)", "rule", "pending", "q" * 200, None, None), (2, "r", 1, "时间逻辑", "warning", "w", "llm_page", "confirmed", "", "c", "n"), (3, "r", 2, "完整性", "info", "i", None, "rejected", None, None, None)]
    found = spark.createDataFrame(rows, "id long, job_id string, page int, type string, severity string, description string, source string, status string, ocr_text string, corrected_text string, reviewer_note string")
    text = {r.job_id: r.report for r in markdown_report(jobs, found).collect()}
    assert "a&lt;b&gt;.pdf" in text["r"] and "### 🔴 严重 (1)" in text["r"] and "d&#33;&#91;x&#93;&#40;u&#41;" in text["r"] and "`" + "q" * 100 + "`" in text["r"] and "**1 条 Finding 需人工复核**" in text["r"]
    assert text["r"].index("🔴") < text["r"].index("🟡") < text["r"].index("🔵") and "未发现问题" in text["empty"]
    assert '"total":3' in {r.job_id: r.report for r in json_report(jobs, found).collect()}["r"]


def test_sources(spark):
    flat = [
        {"page_idx": 4, "type": "text", "text": "Mixer charged"}, {"page_idx": 4, "type": "text", "text": "at noon"}, 17,
        {"page_idx": 6, "type": "text", "text": "Yield"}, {"page_idx": 6, "type": "table", "table_body": "| kg | lot |"}, {"page_idx": None, "type": "page_number", "text": "9/9"},
    ]
    nested = [[{"type": "paragraph", "content": {"paragraph_content": [{"type": "text", "content": "Operator ###"}]}}, {"type": "page_footer", "content": "rev 3"}, {"type": "discarded"}], []]
    files = spark.createDataFrame([("flat", json.dumps(flat)), ("nested", json.dumps(nested))], "job_id string, json string")
    got = {(r.job_id, r.page): r for r in blocks.content_list_pages(files).collect()}
    assert "Mixer charged at noon" in got["flat", 5].text and "（此页无文本内容）" in got["flat", 6].text and got["flat", 7].text.endswith("Yield\n\n| kg | lot |") and got["flat", 7].tables == 1
    assert "Operator [手写内容未识别]" in got["nested", 1].text and (got["nested", 1].lost, got["nested", 1].paragraphs) == (1, 1) and ("nested", 2) in got
    long, none = {"markdown": {"text": "recognised line " * 4}}, {"markdown": {"text": ""}, "prunedResult": {"parsing_res_list": [{"block_content": "only block"}]}}
    texts = ["\ufeff" + json.dumps({"result": {"layoutParsingResults": [long]}}), "no json", json.dumps({"layoutParsingResults": [none]})]
    pages = {r.page: r.text for r in recognised.result_pages(spark.createDataFrame([("j", i + 1, x) for i, x in enumerate(texts)], "job_id string, line_no int, line string")).collect()}
    assert sorted(pages) == [1, 2, 3, 4, 5, 6] and pages[1] == long["markdown"]["text"] and pages[3] == "" and pages[6].startswith("[OCR 警告") and pages[6].endswith("only block")


def test_polluted_pages(spark):
    said = [
        "true", "[1, 2]", '{"steps": 7, "page_info": ["cover"], "findings": [null, {"type": "gap"}, 3]}',
        '{"steps": [8, {"step_no": 40, "parameters": [false, {"name": "pH", "value": 6.5}], "signatures": {"by": "x"}}]}', None,
    ]
    rows = spark.createDataFrame([("j", i, s) for i, s in enumerate(said)], "job_id string, page int, structured_json string")
    got = {r.page: r for r in page_json.typed_pages(rows).collect()}
    assert sorted(got) == [2, 3] and got[2].steps == [] and [f.type for f in got[2].findings] == ["gap"]
    step = got[3].steps[0]
    assert (step.step_no, [(p.name, p.value) for p in step.parameters], step.signatures) == ("40", [("pH", "6.5")], [])


def test_providers(spark):
    assert Offline().judge(None) is None
    answers = spark.createDataFrame([("j", '{"findings": [{"page": 1, "type": "user_rule", "severity": "info", "description": "d", "rule_id": "r1"}, {"page": 1, "type": "user_rule", "severity": "info", "description": "e", "rule_id": "fake"}, {"page": 1}, 5]}')], "job_id string, json string")
    got = semantic_findings(answers, spark.createDataFrame([("r1",)], "id string")).collect()
    assert sorted((r.description, r.source, r.rule_id) for r in got) == [("d", "user_rule", "r1"), ("e", "user_rule", None)]
    rules = spark.createDataFrame([(0, '{"id": "a", "text": " x "}'), (1, "5"), (2, '{"id": "b", "text": ""}'), (3, '{"id": "c", "text": "y", "active": false}')], "pos int, json string")
    assert [tuple(r) for r in reads.user_rules(rules).collect()] == [("a", "x", True), ("c", "y", False)]
    assert reads.summary_cap(0) == 71680 and reads.summary_cap(100) == 8000


def test_audit_rows_are_only_added(spark, tmp_path):
    jobs = spark.createDataFrame([(1, "review", "a.pdf"), (2, "analyzing", "b.pdf")], "id long, status string, filename string")
    asks = spark.createDataFrame([(1, "retry"), (2, "archive"), (9, "cancel")], "job_id long, action string")
    rows = upkeep.action_audit(upkeep.outcomes(jobs, asks), F.lit("now"))
    for _ in range(2):
        upkeep.append_audit(rows, str(tmp_path / "audit"))
    got = sorted((r.job_id, r.action) for r in spark.read.parquet(str(tmp_path / "audit")).collect())
    assert got == sorted(2 * [(1, "analysis_reset"), (1, "status_transition"), (2, "status_transition_blocked")])
    assert sorted(r.status for r in upkeep.without_private(jobs.withColumn("pdf_path", F.lit("x"))).collect()) == ["analyzing", "review"]


def test_rule_limits(spark):
    rules = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate((1000, 1001, 6999, 900, 200))], "owner int, pos int, text string")
    assert [r.pos for r in upkeep.accepted_rules(rules).orderBy("pos").collect()] == [0, 3, 4]


def test_sections_hold_every_active_rule(spark, tmp_path):
    from batchloom.registry import ORACLES, QUERIES
    from tests.helpers import same_as_oracle

    # 500 rules of 50 characters: more than a list may have when it is saved
    spark.range(1000).selectExpr("id AS p_partkey", "repeat('rule ', 10) AS p_name", "CAST(id % 2 AS int) AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    same_as_oracle(spark, QUERIES["ur_rules_section"], ORACLES["ur_rules_section"].replace("FROM part", f"FROM '{tmp_path}/part.parquet/*.parquet'"), str(tmp_path))


def test_a_folder_of_each_machine_is_refused_on_a_cluster(spark, tmp_path):
    from types import SimpleNamespace

    import pytest
    from batchloom.session import shared_dir

    def on_cluster(**conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d)), sparkContext=SimpleNamespace(master="spark://host:7077"), _jvm=spark._jvm, _jsc=spark._jsc)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(on_cluster(spark_sql_warehouse_dir=f"file:{tmp_path}"))
    assert shared_dir(on_cluster(spark_sql_warehouse_dir=f"file:{tmp_path}", spark_checkpoint_dir="file:/shared/")) == "file:/shared"


def test_reads_prune_push_and_clamp(spark, tmp_path):
    rows = [(k, k % 3, k % 5, ("critical", "info")[k % 2], "rule", "pending", "x" * 100) for k in range(300)]
    spark.createDataFrame(rows, "id long, job_id long, page int, severity string, source string, status string, ocr_text string").write.parquet(str(tmp_path / "f"))
    found = spark.read.parquet(str(tmp_path / "f"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<job_id:bigint,page:int,severity:string>" in plan(reads.page_counts(found))
    listed = reads.list_findings(found.filter("job_id = 1").drop("ocr_text"), page=3, limit=5)
    assert "EqualTo(job_id,1)" in plan(listed) and "EqualTo(page,3)" in plan(listed) and "ocr_text" not in plan(listed).split("ReadSchema")[1]
    assert [reads.clamped(*x) for x in ((0, -5), (999, 7), (-3, 0), (200, 1))] == [(1, 0), (200, 7), (1, 0), (200, 1)]
    assert reads.list_findings(found, limit=999).count() == 200 and reads.list_findings(found, limit=0, offset=-1).count() == 1
    jobs = spark.createDataFrame([(k, "review", k) for k in range(130)], "id long, status string, created_at long")
    assert [reads.newest_jobs(jobs, *x).count() for x in ((0, 1000), (2, 1000), (1, 0), (-4, 20))] == [100, 30, 1, 20]
    assert [reads.page_total(jobs.limit(n), 1000).first().total_pages for n in (0, 100, 101)] == [1, 1, 2]
    assert reads.listed_by_page(found, limit=1, offset=2).count() == 15


def test_a_provider_is_asked_again(spark):
    from batchloom.providers import asked

    queue = spark.createDataFrame([(k, f"v{k}") for k in range(8)], "idx int, name string")
    rounds, waits = [], []
    # by row: what is said in each round (None: answered, "-": left out)
    plan = {0: [None], 1: ["timeout", None], 2: ["timeout", "-", None], 3: ["HTTP 401 key=sk-abcdefghijkl"], 4: ["-", "-", "-"], 5: ["503", "503", "503 " + "x" * 300], 6: [None], 7: ["-", "Bad Request"]}

    def ask(left):
        ids = sorted(r.idx for r in left.collect())
        rounds.append(ids)
        rows = [(i, plan[i][len(rounds) - 1], i % 2 == 0) for i in ids if plan[i][len(rounds) - 1] != "-"]
        return spark.createDataFrame(rows, "idx int, error string, in_spec boolean")

    answers, audit = asked(queue, ask, ["idx"], wait=waits.append)
    assert rounds == [list(range(8)), [1, 2, 4, 5, 7], [2, 4, 5]]
    assert sorted(tuple(r) for r in answers.collect()) == [(0, True), (1, False), (2, True), (6, True)]
    got = {r.idx: (r.attempt, r.success, r.error) for r in audit.collect()}
    assert got == {0: (1, True, None), 1: (2, True, None), 2: (3, True, None), 3: (1, False, "HTTP 401 key=sk-***"), 4: (3, False, "no answer"), 5: (3, False, "503 " + "x" * 196), 6: (1, True, None), 7: (2, False, "Bad Request")}
    assert len(waits) == 2 and 1 <= waits[0] <= 3 and 2 <= waits[1] <= 6 and audit.count() == 8
    assert asked(queue.filter("false"), ask, ["idx"], wait=waits.append)[1].count() == 0
