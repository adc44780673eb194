from datetime import datetime, timedelta

import pytest
from batchloom.streaming import live
from batchloom.streaming.lifecycle import replay
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1, 12, 0, 0)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


EVENTS = [
    [("a", 1, at(0), "status", "ocr_running", None, 4), ("a", 2, at(1), "page_read", None, 1, None), ("b", 1, at(1), "status", "pending", None, None)],
    [("a", 5, at(4), "status", "analyzing", None, 2), ("a", 4, at(3), "status", "ocr_done", None, None), ("a", 2, at(1), "page_read", None, 1, None), ("c", 1, at(4), "status", "error", None, 3)],
    [("a", 6, at(5), "page_analyzed", None, 2, None), ("a", 7, at(6), "page_analyzed", None, 1, None), ("a", 7, at(6), "finding", None, 1, None), ("a", 3, at(2), "page_read", None, 2, None)],
    [("a", 9, at(8), "status", "review", None, None), ("b", 2, at(8), "status", "archived", None, None)],
    [("d", 1, at(30), "status", "ocr_running", None, None)],
    [("a", 10, at(31), "status", "pending", None, None), ("d", 2, at(60), "status", "cancelled", None, None)],
    [("e", 1, at(61), "status", "error", None, None), ("e", 2, at(61), "status", "pending", None, None)],
]


def test_snapshots_of_a_stream_equal_those_of_its_table(spark, tmp_path):
    path, seen = str(tmp_path / "in"), {}

    def send(batch, _):
        for r in batch.collect():
            seen[r.job_id] = tuple(r)

    for k, rows in enumerate(EVENTS):
        feed(spark, path, rows, live.EVENTS)
        q = live.progress_stream(source(spark, path, live.EVENTS), send, str(tmp_path / "cp"), once=True)  # each time a restart
        assert q.awaitTermination(120) and q.exception() is None
        want = {r.job_id: tuple(r) for r in live.progress(spark.read.parquet(path)).collect()}
        assert seen == want, k
    phases = {r[0]: r[7:] for r in seen.values()}
    assert phases == {"a": ("idle", False), "b": ("done", True), "c": ("done", True), "d": ("done", True), "e": ("idle", False)}
    half = spark.createDataFrame([r for part in EVENTS[:3] for r in part], live.EVENTS)
    a = live.progress(half).filter("job_id = 'a'").first()
    assert (a.status, a.total_pages, a.pages_read, a.pages_analyzed, a.findings, a.phase) == ("analyzing", 4, 2, 2, 1, "analyze")
    assert live.progress(half.filter("kind <> 'status'")).first().status == "pending"


def test_trigger_follows_the_clock(spark, tmp_path):
    path, seen = str(tmp_path / "in"), []
    feed(spark, path, EVENTS[0], live.EVENTS)
    q = live.progress_stream(source(spark, path, live.EVENTS), lambda b, _: seen.extend(r.job_id for r in b.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == ["a", "b"]


@pytest.mark.parametrize("late", ["0 seconds", "2 minutes"])
def test_the_live_list_forgets_ended_jobs_by_the_events_clock(spark, tmp_path, late):
    path, now = str(tmp_path / "in"), {}

    def send(batch, _):
        for r in batch.orderBy("seq", "live").collect() if not batch.isEmpty() else []:
            now[r.job_id] = r

    top, kept = T0, spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for k, rows in enumerate(EVENTS):
        feed(spark, path, rows, live.EVENTS)
        q = live.live_stream(source(spark, path, live.EVENTS), late).writeStream.outputMode("update").foreachBatch(send).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(180) and q.exception() is None
        top = max([top, *(r[2] for r in rows if r[3] == "status")])
        clock = top - (timedelta(0) if late.startswith("0") else timedelta(minutes=2))
        want = {r.job_id: (r.status, r.seq) for r in live.live_at(spark.read.parquet(path), F.lit(clock)).collect()}
        assert {j: (r.status, r.seq) for j, r in now.items() if r.live} == want, (k, clock)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    assert not now["c"].live and not now["b"].live and now["a"].live and now["e"].live


ATTEMPTS = "job_id string, seq bigint, at timestamp, new string"


def test_attempts_in_any_order_and_again(spark, tmp_path):
    rows = [("a", 1, "ocr_running"), ("a", 2, "review"), ("a", 3, "ocr_done"), ("a", 4, "analyzing"), ("a", 5, "partial_review"), ("b", 1, "archived"), ("b", 2, "review"), ("b", 3, "review")]
    told = [(j, s, at(k / 60), n) for k, (j, s, n) in enumerate(rows)]
    parts = [[told[3], told[1], told[6]], [told[0], told[7], told[1]], [told[5], told[4]], [told[2], told[0], told[7]]]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in parts:
        feed(spark, path, part, ATTEMPTS)
        q = live.attempts_stream(source(spark, path, ATTEMPTS)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(180) and q.exception() is None
    got = spark.read.schema(live.ATTEMPTS).parquet(out).collect()
    want = replay(spark.createDataFrame([(j, s, n) for j, s, n in rows], "job_id string, seq bigint, new string")).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(tuple(r) for r in want)
    said = {(r.job_id, r.seq): (r.action, r.detail) for r in got}
    assert said["a", 1] == ("status_transition", "pending → ocr_running") and said["a", 2] == ("status_transition_blocked", "ocr_running → review (allowed: cancelling, error, ocr_done)")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_gap_holds_attempts_for_a_while(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [[("a", 1, at(0), "ocr_running"), ("a", 3, at(0), "analyzing"), ("a", 4, at(0), "error")], [("b", 1, at(1), "error")], [("b", 2, at(9), "pending")], [("a", 2, at(10), "ocr_done"), ("a", 5, at(10), "pending")]]
    sizes = []
    for part in parts:
        feed(spark, path, part, ATTEMPTS)
        q = live.attempts_stream(source(spark, path, ATTEMPTS), wait=120, late="0 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(180) and q.exception() is None
        sizes.append(sum(r.job_id == "a" for r in spark.read.schema(live.ATTEMPTS).parquet(out).collect()))
    got = sorted((r.seq, r.current, r.new, r.accepted) for r in spark.read.schema(live.ATTEMPTS).parquet(out).filter("job_id = 'a'").collect())
    assert sizes == [1, 1, 3, 4]
    assert got == [(1, "pending", "ocr_running", True), (3, "ocr_running", "analyzing", False), (4, "ocr_running", "error", True), (5, "error", "pending", True)]
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_attempts_of_a_job_take_few_calls_for_state():
    from types import SimpleNamespace

    calls, held = [], {}

    class State:
        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name == "update":
                    held["value"] = args[0]
                return held.get("value") if name == "get" else iter(())

            return call

    p, clock = live._Attempts("pending", 60_000), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    state = State()
    p.init(SimpleNamespace(getValueState=lambda *a: state, getListState=lambda *a: state, registerTimer=state.registerTimer, deleteTimer=state.deleteTimer, listTimers=state.listTimers))
    from pyspark.sql import Row

    row = lambda seq, new: Row(seq=seq, at=at(0), new=new)
    assert list(p.handleInputRows(("a",), iter([row(2, "ocr_done"), row(4, "error")]), clock)) == []
    assert calls == ["get", "registerTimer", "update"]
    (made,) = p.handleInputRows(("a",), iter([row(1, "ocr_running")]), clock)
    assert made == Row(job_id="a", seq=[1, 2], current=["pending", "ocr_running"], new=["ocr_running", "ocr_done"], accepted=[True, True])
    (made,) = p.handleInputRows(("a",), iter([row(3, "review"), row(2, "error")]), clock)
    assert made == Row(job_id="a", seq=[3, 4], current=["ocr_done", "ocr_done"], new=["review", "error"], accepted=[False, True])
    assert calls[3:] == ["get", "update", "get", "deleteTimer", "update"]
