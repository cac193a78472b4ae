"""Hot keys dealt over slices: lookups and running totals in which no task sees a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.session import cut_lineage


def slice_count(spark: SparkSession) -> int:
    """Slices a hot key is dealt over: as many as shuffle partitions, so a slice stays a task's share."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slice_of(columns: list[Column], count: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("slice"), *columns), F.lit(count)).cast("int")


def running_total(df: DataFrame, group: list[str], order: list[str], weight: Column, out: str,
                  together: int | None = None) -> DataFrame:
    """Exclusive running total of ``weight`` inside each group, in an order fixed by ``order``.

    Slice totals first, then sums inside a slice, so no task sees a whole group. Rows that agree in the
    first ``together`` order columns are neighbours. Group and order columns must not be null.
    """
    spark = df.sparkSession
    rows = df.withColumn("_rt_w", weight.cast("long")).withColumn(
        "_rt_slice", slice_of([F.col(c) for c in order[:together]], slice_count(spark)))
    before = Window.partitionBy(*group).orderBy("_rt_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*group, "_rt_slice").agg(F.sum("_rt_w").alias("_rt_n")).select(
        *group, "_rt_slice", F.coalesce(F.sum("_rt_n").over(before), F.lit(0)).alias("_rt_off"))
    inside = Window.partitionBy(*group, "_rt_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(offsets, [*group, "_rt_slice"])
        .withColumn(out, F.col("_rt_off") + F.coalesce(F.sum("_rt_w").over(inside), F.lit(0)))
        .drop("_rt_w", "_rt_slice", "_rt_off")
    )


def spread_lookup(rows: DataFrame, keys: list[str], table: DataFrame, spread: str) -> DataFrame:
    """Left join of ``rows`` with one row per key of ``table``; hot keys are dealt over slices of ``spread``.

    The table first joins the distinct (key, slice) pairs, so neither join meets a whole hot key.
    """
    dealt = rows.withColumn("_sl", slice_of([F.col(spread)], slice_count(rows.sparkSession)))
    pairs = dealt.select(*keys, "_sl").distinct().join(table, keys)
    return dealt.join(pairs, [*keys, "_sl"], "left").drop("_sl")


def in_order(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Rows with exclusive running totals of ``sums`` inside each group, in the order of ``order``.

    A range sort on (group, order) deals a group of any size over tasks; totals run inside a partition, and
    partitions pass on one row per group. Rows that agree in ``order`` come in an arbitrary, fixed order.
    """
    parts = slice_count(df.sparkSession)
    rows = df.withColumns({f"_{c}": w.cast("long") for c, w in sums.items()}).repartitionByRange(parts, *group, *order)
    rows = rows.sortWithinPartitions(*group, *order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    rows = cut_lineage(rows)
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group, "_part").agg(*[F.sum(f"_{c}").alias(f"_n_{c}") for c in sums])
    starts = totals.select(*group, "_part", *[F.coalesce(F.sum(f"_n_{c}").over(ahead), F.lit(0)).alias(f"_off_{c}") for c in sums])
    inside = Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.join(starts, [*group, "_part"])
    return found.withColumns({c: F.col(f"_off_{c}") + F.coalesce(F.sum(f"_{c}").over(inside), F.lit(0)) for c in sums}).drop(
        "_part", "_at", *[f"_{c}" for c in sums], *[f"_off_{c}" for c in sums])
