import pytest
from batchloom.registry import ORACLES, QUERIES
from tests.helpers import SF, same_as_oracle


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    same_as_oracle(spark, QUERIES[name], ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    QUERIES[name](spark, SF).count()


@pytest.mark.parametrize("name", ["s14_json_report", "s15_markdown_report"])
def test_every_job_has_a_report(spark, name):
    got = QUERIES[name](spark, SF)
    want = spark.read.parquet(f"{SF}/orders.parquet").selectExpr("CAST(o_orderkey AS bigint) AS job_id")
    assert got.select("job_id").exceptAll(want).isEmpty() and want.exceptAll(got.select("job_id")).isEmpty()
    assert got.filter("report IS NULL").isEmpty()


@pytest.mark.parametrize("name", ["r1a_time_reversal_in_page", "r1b_time_reversal_cross_page"])
def test_steps_without_a_date_column_are_not_searched_for_one(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("fallback_") == 0 and plan.count("start_at_simple") > 0


@pytest.mark.parametrize("name", ["t17_entities", "n1_powers"])
def test_long_work_on_few_files_is_dealt_out(spark, name):
    assert "RepartitionByExpression" in QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_not_searched_one_by_one(spark):
    import json

    from batchloom.functions.entities import _tables

    dealt = json.loads(_tables()[0])
    assert sum(map(len, dealt)) > 2000 and max(map(len, dealt)) < 10


def test_parts_of_a_page_are_taken_once(spark):
    from batchloom.sources.page_json import problems
    from pyspark.sql import functions as F

    said = str(problems(F.col("c"), F.col("p")))
    assert [said.count(f"$.{f}'") for f in ("page_info", "steps", "findings", "event_year_groups")] == [1, 1, 1, 1]


def test_pages_of_a_summary_are_read_once(spark):
    plan = QUERIES["sum_page_summary"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # orders and their lines
