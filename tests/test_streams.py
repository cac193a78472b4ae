"""Incremental jobs against one pass over everything, and what they read."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import conflicts as X, consensus as C
from tidemark.streaming import consensus_state as CS, jobs as J, key_index as K

OPINION = """date date, submission_id long, pos long, ticker string, confidence int, sentiment_intensity int, is_implicit boolean, sentiment string,
 position string, conviction string, time_horizon string, source string, extraction_refusal boolean"""


def opinions(spark, seed, n, days):
    rng = random.Random(seed)
    from datetime import date, timedelta

    rows = [(date(2024, 1, 1) + timedelta(days=rng.choice(days)), rng.randrange(6), seed * 1000 + i, rng.choice("AAB"), rng.randrange(4, 11), rng.randrange(2, 11),
             rng.random() < 0.3, rng.choice(("bullish", "bearish", "neutral")), "shares", rng.choice(("yolo", "high", "low")), "day", "both", rng.random() < 0.1)
            for i in range(n)]
    return spark.createDataFrame(rows, OPINION)


def comparable(df):
    flat = df.select("date", "ticker", "total_mentions", "first_seen", "dominant_sentiment", F.round("avg_confidence", 9).alias("c"),
                     F.round("conviction_weighted_bullish_score", 9).alias("b"), F.col("sentiment_distribution").cast("string").alias("d"))
    return sorted(map(tuple, flat.collect()))


def test_consensus_of_batches_equals_one_pass(spark, tmp_path):
    """Late rows change groups that exist, add submissions to a day, and come on new days; a batch is repeated."""
    batches = [opinions(spark, 1, 300, range(8)), opinions(spark, 2, 40, [3]), opinions(spark, 3, 60, [2, 9]), opinions(spark, 4, 0, [1])]
    handle = CS.keep_consensus(str(tmp_path / "s"))
    for i, rows in enumerate(batches):
        handle(rows, i)
        if i == 1:
            handle(rows, i)
    whole = batches[0].unionByName(batches[1]).unionByName(batches[2])
    want = C.daily_consensus(X.resolved_opinions(X.judge_conflicts(whole)))
    assert comparable(CS.current_consensus(spark, str(tmp_path / "s"))) == comparable(want)


def test_late_row_writes_its_day_only(spark, tmp_path):
    handle = CS.keep_consensus(str(tmp_path / "s"))
    handle(opinions(spark, 1, 300, range(20)), 0)
    handle(opinions(spark, 2, 5, [7]).withColumn("ticker", F.lit("A")), 1)
    for log in ("opinions", "daily"):
        late = spark.read.parquet(str(tmp_path / "s" / log / "batch=1"))
        assert {str(r.date) for r in late.select("date").distinct().collect()} == {"2024-01-08"}
    assert {r.ticker for r in spark.read.parquet(str(tmp_path / "s" / "daily" / "batch=1")).collect()} == {"A"}


def test_merged_days_equal_one_pass(spark, tmp_path):
    rows = spark.range(500).selectExpr("date_add(date '2024-01-01', cast(id % 7 as int)) as day", "id % 3 as k", "id as v", "id % 2 as late")
    def cells(df):
        return df.groupBy("day", "k").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    def merge(df):
        return df.groupBy("day", "k").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    handle = J.merge_days(str(tmp_path / "c"), str(tmp_path / "d"), cells, merge)
    handle(rows.where("late = 0"), 0)
    files = set(glob.glob(str(tmp_path / "d" / "*" / "*.parquet")))
    handle(rows.where("late = 1 and day = date '2024-01-03'"), 1)
    kept = files & set(glob.glob(str(tmp_path / "d" / "*" / "*.parquet")))
    assert {os.path.basename(os.path.dirname(f)) for f in files - kept} == {"day=2024-01-03"}
    handle(rows.where("late = 1 and day <> date '2024-01-03'"), 2)
    key = ("day", "k", "n", "v")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "d")).select(*key).collect())) == sorted(map(tuple, cells(rows).select(*key).collect()))


def test_batches_open_only_files_that_may_hold_their_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    handle = K.new_only(path, ["id"])
    for batch in range(6):
        handle(spark.range(batch * 1000, batch * 1000 + 1000).withColumn("v", F.lit(batch)), batch)
    written = len(glob.glob(f"{path}-index/keys/*/*/*.parquet"))
    assert written == 6 * K.BUCKETS
    again = spark.createDataFrame([(2500,), (99_999,)], "id long")
    opened = K.files_to_open(again, path, ["id"], 6)
    at = K.with_hash(again, ["id"], K.BUCKETS).where("id = 2500").first().bucket
    assert (2, at) in opened and len(opened) <= 3
    assert {f.split("batch=")[1].split("/")[0] for f in K.known_keys(again.where("id = 2500"), path, ["id"], 6).inputFiles()} == {"2"}
    assert K.known_keys(spark.createDataFrame([(10**12,)], "id long"), path, ["id"], 6) is None


def test_repeats_of_any_age_go(spark, tmp_path):
    path = str(tmp_path / "t")
    handle = K.new_only(path, ["a", "b"])
    rows = spark.range(400).selectExpr("id % 50 as a", "if(id % 7 = 0, null, cast(id % 3 as string)) as b", "id")
    handle(rows.where("id < 200"), 0)
    handle(rows, 1)
    handle(rows, 1)  # a repeated batch
    handle(rows.where("id % 5 = 0"), 2)
    got = spark.read.parquet(path).select("a", "b")
    assert got.count() == got.distinct().count() == rows.select("a", "b").distinct().count()


@pytest.mark.parametrize("n", (0, 1, 5000))
def test_sketch_never_misses(n):
    import numpy as np

    rng = np.random.default_rng(n)
    keys = rng.integers(-2**63, 2**63 - 1, n)
    sketch = K.make_sketch(keys)
    assert n == 0 or K.may_hold(sketch, keys).all()
    others = rng.integers(-2**63, 2**63 - 1, 20000)
    assert K.may_hold(sketch, others).mean() < 0.002
