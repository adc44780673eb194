import base64
import hashlib
import hmac
import html
import json
import random

from batchloom.functions.entities import unescape
from batchloom.functions.signing import hmac_sha256, within_bytes
from batchloom.operators.notices import due_notices, notice_stream, payload, signature
from pyspark.sql import functions as F

#: Key, message and code of the first, second, third, fourth, sixth and seventh test of RFC 4231.
RFC4231 = [
    ("0b" * 20, b"Hi There".hex(), "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"),
    (b"Jefe".hex(), b"what do ya want for nothing?".hex(), "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
    ("aa" * 20, "dd" * 50, "773ea91e36800e46854db8ebd09181a72959098b3ef8c122d9635514ced565fe"),
    ("0102030405060708090a0b0c0d0e0f10111213141516171819", "cd" * 50, "82558a389a443c0ea4cc819899f2083a85f0faa3e578f8077a2e3ff46729665b"),
    ("aa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First".hex(), "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"),
    ("aa" * 131, b"This is a test using a larger than block-size key and a larger than block-size data. The key needs to be hashed before being used by the HMAC algorithm.".hex(), "9b09ffa71b942fcb27635fbcd5b0e944bfdc63644f0713938a7f51535c3a35e2"),
]


def test_codes(spark):
    more = [("", ""), ("00" * 64, "ff"), ("ff" * 65, ""), ("7f" * 63, "00" * 200)]
    rows = [(bytearray.fromhex(k), bytearray.fromhex(m), c) for k, m, c in RFC4231] + [(bytearray.fromhex(k), bytearray.fromhex(m), hmac.new(bytes.fromhex(k), bytes.fromhex(m), hashlib.sha256).hexdigest()) for k, m in more]
    df = spark.createDataFrame(rows, "key binary, message binary, want string")
    assert df.filter(F.lower(F.hex(hmac_sha256(F.col("key"), F.col("message")))) != F.col("want")).count() == 0
    got = spark.createDataFrame([("test_secret", 1599360473)], "s string, t long").select(signature(F.col("s"), F.col("t")).alias("x")).first().x
    assert got == base64.b64encode(hmac.new(b"1599360473\ntest_secret", b"", hashlib.sha256).digest()).decode()


def test_cuts(spark):
    texts = ["", "abc", "é" * 10, "a" + "漢" * 7, "😀" * 5, "x" * 40, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 7, 16, 31):
        got = [r.x for r in df.select(within_bytes(F.col("t"), n).alias("x")).collect()]
        assert got == [None if t is None else t.encode()[:n].decode(errors="ignore") for t in texts]


def test_payloads(spark):
    jobs = spark.createDataFrame([("a", "review", "f.pdf", 3, None), ("b", "error", "", 2, "e" * 600), ("c", "review", "n" * 9000 + "漢" * 9000, 1, None), ("d", "analyzing", "x", 1, None), ("e", "partial_review", "y", None, None), ("f", "error", "z", 0, None)], "id string, status string, filename string, total_pages int, error_message string")
    found = spark.createDataFrame([("a", "critical"), ("a", "info"), ("a", "odd")], "job_id string, severity string")
    sent = spark.createDataFrame([("e", "review"), ("f", "error")], "job_id string, status string")
    due = due_notices(jobs, found, sent)
    got = {r.job_id: r.text for r in due.collect()}
    assert set(got) == {"a", "b", "c", "e"}
    assert got["a"] == "【batchloom】批生产记录分析完成，已生成报告\n文件：f.pdf\n页数：3 页\n发现：1 严重 / 0 警告 / 1 提示"
    assert got["b"] == "【batchloom】批生产记录处理失败\n文件：(未知)\n错误：" + "e" * 500
    assert got["e"].endswith("\n页数：0 页\n发现：0 严重 / 0 警告 / 0 提示")
    assert got["c"].endswith("…(截断)") and len(got["c"].encode()) <= 20 * 1024 - 512 + len("…(截断)".encode())
    made = {r.job_id: json.loads(r.p) for r in due.select("job_id", payload(F.col("text"), F.when(F.col("job_id") == "a", "s"), F.lit(17)).alias("p")).collect()}
    assert made["a"] == {"timestamp": "17", "sign": base64.b64encode(hmac.new(b"17\ns", b"", hashlib.sha256).digest()).decode(), "msg_type": "text", "content": {"text": got["a"]}}
    assert made["b"] == {"msg_type": "text", "content": {"text": got["b"]}} and all(len(json.dumps(m, ensure_ascii=False).encode()) <= 20 * 1024 for m in made.values())


def test_each_notice_is_told_once(spark, tmp_path):
    source, told = str(tmp_path / "in"), str(tmp_path / "told")

    def post(rows):
        return [r["job_id"] != "later" for r in rows]

    sizes = []
    for rows in ([("a", "review"), ("later", "error"), ("a", "review")], [("a", "review"), ("a", "error")], [("later", "error"), ("b", "review")]):
        spark.createDataFrame(rows, "job_id string, status string").coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema("job_id string, status string").json(source)
        notice_stream(stream, lambda b: b.withColumn("text", F.lit("t")), post, told, str(tmp_path / "cp")).awaitTermination(120)
        sizes.append(sorted((r.job_id, r.status, r.ok) for r in spark.read.parquet(told).collect()))
    first = [("a", "review", True), ("later", "error", False)]
    assert sizes == [first, sorted([*first, ("a", "error", True)]), sorted([*first, ("a", "error", True), ("b", "review", True), ("later", "error", False)])]


def test_references(spark):
    r = random.Random(4)
    names = list(html.entities.html5)
    texts = [f"x&{n}y" for n in names] + [f"&{n[:-1] if n.endswith(';') else n}z" for n in names[::7]]
    texts += [f"&#{n};" for n in [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x10FFFE, 0x10FFFF, 0x110000, 9999999, 10**30]]
    texts += [f"&#x{n:x}" for n in (0, 0x41, 0x80, 0x9F, 0xFFFE, 0x2FFFF, 0x10FFFF, 0x110000, 16**20)] + ["&#0000065;", "&#x00000041", "&#X41;g", "&#;", "&#x;", "&", "&&amp;&lt", "&notit;", "&notin;", "&amp;lt;", "& amp;", "&a\tb", "", "no", "&" + "x" * 40, "&ampamp;", "&copy" * 20]
    texts += ["".join(r.choice(["&", "#", ";", "x", "a", "m", "p", "lt", "not", "it", "4", "1", " ", "é", "copy", "\n"]) for _ in range(r.randrange(1, 25))) for _ in range(2000)]
    got = [row.u for row in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", unescape(F.col("t")).alias("u")).orderBy("k").collect()]
    bad = [(t, g, html.unescape(t)) for t, g in zip(texts, got, strict=True) if g != html.unescape(t)]
    assert not bad, bad[:5]
