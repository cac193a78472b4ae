"""Incremental daily processing as Structured Streaming jobs.

Every job runs with ``availableNow``: it handles what is new since its checkpoint and stops. Batch
writers overwrite their own ``batch`` partition, so a repeated batch leaves no duplicates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def new_files(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet", glob: str | None = None,
              files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def finish(writer) -> None:
    """Run until all present input is handled."""
    running = writer.trigger(availableNow=True).start()
    try:
        running.awaitTermination()
    finally:
        running.stop()


def append_to(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> None:
    """Exactly-once append into a parquet table."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    finish(writer.partitionBy(*partition_by) if partition_by else writer)


def in_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    finish(stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle))


def stored(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame | None:
    """What earlier batches wrote; None before the first one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return None


def daily_totals(stream: DataFrame, keys: list[str], aggs: list[Column], ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """One row per (day, keys); in append mode a day appears once it is final."""
    day = F.window(ts, "1 day")
    grouped = stream.withWatermark(ts, delay).groupBy(day.alias("day"), *keys).agg(*aggs)
    return grouped.select(F.to_date("day.start").alias("day"), *keys, *[c for c in grouped.columns if c != "day" and c not in keys])


def write_batch(df: DataFrame, path: str, batch: int, partition_by: list[str] = []) -> None:
    """Replace what this batch wrote before; rows meet by their folder first, so a folder gets few files."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    (
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch", *partition_by).parquet(path)
    )


def folders_of(df: DataFrame, column: str) -> list:
    """Values of a partition column, from the folders alone."""
    return [r[0] for r in df.select(column).distinct().collect()]


def merge_days(cells_path: str, daily_path: str, summarise: Callable[[DataFrame], DataFrame],
               merge: Callable[[DataFrame], DataFrame], day: str = "day"):
    """Batch handler: a batch becomes cells, and the days it touches are merged again from their cells.

    ``summarise`` turns rows into cells, ``merge`` cells of any number of batches into a day's result. What
    came before is read as cells of the touched days only, never as rows.
    """

    def handle(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        write_batch(summarise(rows), cells_path, batch, [day])
        cells = spark.read.parquet(cells_path)
        touched = folders_of(cells.where(F.col("batch") == batch), day)
        if not touched:
            return
        fresh = merge(cells.where(F.col(day).isin(touched)).drop("batch"))
        fresh.hint("rebalance", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(daily_path)

    return handle


def submission_states(attempts: DataFrame, key: str = "submission_id", ts: str = "ts") -> DataFrame:
    """Latest status and number of attempts per submission, kept in the state store (update mode)."""
    return attempts.groupBy(key).agg(
        F.max_by("status", F.col(ts)).alias("status"), F.max(ts).alias(ts), F.count("*").alias("attempts"),
        F.count(F.when(F.col("status") == "failed", 1)).alias("failures"),
    )


def current_states(spark: SparkSession, path: str, key: str = "submission_id") -> DataFrame:
    """Newest snapshot row per submission over all batches."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, "r.*")


def skipping_done(log_path: str, handle: Callable[[DataFrame, int], None], run: str, day: str = "day"):
    """Batch handler: days that an earlier run has finished are left out; this run's days stay open.

    A run notes the days it begins and counts as finished only after ``close_run``, so a day may come in
    many batches of one run, and the days of a run that broke off are taken up again.
    """

    def step(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        begun = stored(spark, f"{log_path}/begun", StructType([rows.schema[day]]).add("run", "string").add("batch", "integer"))
        closed = stored(spark, f"{log_path}/closed", "run string")
        if begun is not None and closed is not None:
            done = begun.join(closed.where(F.col("run") != run), "run", "left_semi").select(day)
            rows = rows.join(done, day, "left_anti")
        handle(rows, batch)
        write_batch(rows.select(day).distinct().withColumn("run", F.lit(run)), f"{log_path}/begun", batch)

    return step


def close_run(spark: SparkSession, log_path: str, run: str) -> None:
    """Mark the days that ``run`` began as finished; call it when the stream has ended well."""
    spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("append").parquet(f"{log_path}/closed")
