import os

import pytest
from batchloom.sources import page_table as P

ROWS = "job_id string, page int, raw_html string, structured_json string"


def rows(spark, path):
    return sorted((tuple(r) for r in P.read_pages(spark, path).select("job_id", "page", "raw_html", "structured_json").collect()), key=repr)


def test_added_once_and_updated(spark, tmp_path):
    path = str(tmp_path / "pages")
    assert P.read_pages(spark, path).count() == 0 and not P.settle(spark, path)
    first = spark.createDataFrame([("a", 1, "x", None), ("a", 2, None, None), ("b", 1, "y", None), ("b", 1, "x", None), (None, 1, "n", None)], ROWS)
    for _ in range(2):  # again: nothing changes
        P.add_pages(first, path)
        assert rows(spark, path) == sorted([("a", 1, "x", None), ("a", 2, None, None), ("b", 1, "x", None), (None, 1, "n", None)], key=repr)
    late = spark.createDataFrame([("a", 2, "late", None), ("c", 3, "z", '{"k": 1}')], ROWS)
    P.add_pages(late.select("page", "job_id", "raw_html", "structured_json"), path)
    answers = spark.createDataFrame([("a", 1, "one", 1), ("a", 1, "two", 2), ("a", 1, None, 3), ("a", 9, "unknown", 1), ("c", 3, None, 1), (None, 1, "of null", 1)], "job_id string, page int, structured_json string, n int")
    for _ in range(2):
        P.update_pages(answers, path, "n")
        assert rows(spark, path) == sorted([("a", 1, "x", "two"), ("a", 2, None, None), ("b", 1, "x", None), ("c", 3, "z", '{"k": 1}'), (None, 1, "n", "of null")], key=repr)
    P.add_pages(first.filter("false"), path)
    P.update_pages(answers.filter("false"), path, "n")
    assert len(rows(spark, path)) == 5


def test_a_write_touches_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "pages")
    P.add_pages(spark.createDataFrame([(f"j{k}", 1, "x", None) for k in range(200)], ROWS), path)
    files = {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    (bucket,) = {r.bucket for r in P.bucketed(spark.createDataFrame([("j7", 9, "y", None)], ROWS)).collect()}
    P.add_pages(spark.createDataFrame([("j7", 9, "y", None)], ROWS), path)
    gone = files - {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    assert gone and all(f"bucket={bucket}/" in f for f in gone) and len(rows(spark, path)) == 201
    plan = P.read_pages(spark, path, [bucket])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


@pytest.mark.parametrize("where", ["aside", "before", "during"])
def test_a_write_that_dies(spark, tmp_path, monkeypatch, where):
    """It dies while the new state is written aside, before the overwrite, or after buckets were taken away in it."""
    path = str(tmp_path / "pages")
    P.add_pages(spark.createDataFrame([(f"j{k}", 1, "x", None) for k in range(50)], ROWS), path)
    new = spark.createDataFrame([(f"j{k}", 1 + k % 2, "y", None) for k in range(60)], ROWS)

    def die(frame, to):
        if where == "during":
            import shutil

            for name in os.listdir(to):
                if name.startswith("bucket="):
                    shutil.rmtree(f"{to}/{name}")
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(P, "_overwrite", die)
        with pytest.raises(OSError):
            P.add_pages(new, path)
    if where == "aside":
        os.remove(f"{path}/_pending/_SUCCESS")
    P.add_pages(new, path)
    want = {(f"j{k}", 1): "x" for k in range(50)} | {(f"j{k}", 2): "y" for k in range(60) if k % 2} | {(f"j{k}", 1): "y" for k in range(50, 60) if not k % 2}
    assert {(r[0], r[1]): r[2] for r in rows(spark, path)} == want and len(rows(spark, path)) == len(want)
    assert not os.path.exists(f"{path}/_pending")
