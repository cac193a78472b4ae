"""A cross-section of registered queries against their SQL twins, and plan checks."""

import pytest

import __spark_entry__ as entry
from tests.check_oracles import compare, connect

SMALL = "/root/testdata/sf0.001"
NAMES = ("a11_confidence_weighted", "a01_consensus_core", "t04_most_bullish", "c13_dump_documents", "j10_thread_assembly", "s25_extraction_outputs",
         "w01_ema", "r05_walk_forward", "m03_keyword_features", "m14_ranking_metrics", "st2_duplicate_suppression", "st3_daily_consensus", "st7_skip_done_days",
         "s24_request_jobs", "s25_relationships", "m06_engagement_features")


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    problem, _rows = compare(entry.queries()[name](spark, SMALL), con, entry.oracle_sql()[name])
    assert not problem


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stores_are_pruned_by_day(spark, tmp_path):
    from pyspark.sql import functions as F
    from tidemark.sources import consensus_store as CS, documents as S

    days = spark.range(60).selectExpr("date_add(date '2024-01-01', cast(id % 20 as int)) as date", "concat('T', id % 3) as ticker", "id as n")
    CS.write_days(days, str(tmp_path / "c"))
    store = CS.read_store(spark, str(tmp_path / "c"))
    day = CS.load_day(store, F.lit("2024-01-05").cast("date"))
    assert "PartitionFilters: [isnotnull(date" in plan_of(day) and day.count() == 3
    assert len(day.inputFiles()) == 20 and day.select("_metadata.file_path").distinct().count() == 1
    history = CS.ticker_history(store, "T1", F.lit("2024-01-03").cast("date"), F.lit("2024-01-09").cast("date"))
    assert "PushedFilters: [IsNotNull(ticker), EqualTo(ticker,T1)]" in plan_of(history) and "date#" in plan_of(history).split("PartitionFilters")[1]
    assert "ReadSchema: struct<>" in plan_of(CS.available_dates(store)) and CS.available_dates(store).count() == 20
    docs = spark.range(40).selectExpr("cast(id as string) as submission_id", "'t' as title", "concat('2024-01-', lpad(1 + id % 9, 2, '0'), ' 08:00') as date", "'s' as subreddit", "array('a') as comments")
    S.write_documents(docs, str(tmp_path / "d"), F.col("date"))
    back = S.read_documents(spark, str(tmp_path / "d"))
    found = S.in_date_range(back, "20240103", "20240104")
    assert found.count() == docs.where("date like '2024-01-03%' or date like '2024-01-04%'").count()
    assert "day#" in plan_of(found).split("PartitionFilters")[1].split("PushedFilters")[0]


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ("a01_consensus_core", "r05_walk_forward", "c13_dump_documents", "m11_stratified_split"))
def test_plans_have_no_cross_join(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
