"""Consensus table: one partition per date, sorted by ticker inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def write_days(consensus: DataFrame, path: str) -> None:
    """Replace the days present in ``consensus`` and leave all others untouched."""
    (
        consensus.repartition("date")
        .sortWithinPartitions("date", "ticker")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_day(store: DataFrame, date) -> DataFrame:
    return store.where(F.col("date") == date)


def ticker_history(store: DataFrame, ticker: str, start, end) -> DataFrame:
    return store.where((F.col("ticker") == ticker) & F.col("date").between(start, end))


def available_dates(store: DataFrame) -> DataFrame:
    return store.select("date").distinct()


def date_range(store: DataFrame) -> DataFrame:
    return store.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def store_stats(store: DataFrame) -> DataFrame:
    """Dates, tickers and average tickers per day.

    Both counts shrink by partial aggregation before they meet, so no task holds the table.
    """
    pairs = store.groupBy("date", "ticker").agg(F.lit(1).alias("one"))
    days = pairs.groupBy("date").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("total_dates"), F.avg("n").alias("avg_tickers_per_day"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )
    tickers = pairs.groupBy("ticker").agg(F.lit(1).alias("one")).agg(F.count("*").alias("total_tickers"))
    long = days.select("*", F.lit(None).cast("bigint").alias("total_tickers")).unionByName(
        tickers, allowMissingColumns=True
    )
    return long.agg(*[F.max(c).alias(c) for c in long.columns])


def stored_bytes(store: DataFrame) -> DataFrame:
    """Bytes on disk, from file metadata only."""
    files = store.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("b"))
    return files.groupBy("p").agg(F.max("b").alias("b")).agg(F.sum("b").alias("bytes"))


def two_stores(recent: DataFrame, archive: DataFrame) -> DataFrame:
    """Recent rows first, archive rows only for (ticker, date) pairs the recent store lacks."""
    missing = archive.join(recent.select("ticker", "date"), ["ticker", "date"], "left_anti")
    return recent.unionByName(missing)


def all_dates(recent: DataFrame, archive: DataFrame) -> DataFrame:
    return recent.select("date").union(archive.select("date")).distinct()


def retained(store: DataFrame, today: Column, days: int) -> DataFrame:
    """Rows young enough to stay in the recent store; a partition predicate."""
    return store.where(F.col("date") >= F.date_sub(today, days))


def drop_old_days(spark: SparkSession, path: str, cutoff: str) -> int:
    """Delete the date folders before ``cutoff`` (yyyy-MM-dd); one call per old day, data unread."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    dropped = 0
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("date=") and name[5:] < cutoff:
            fs.delete(status.getPath(), True)
            dropped += 1
    return dropped
