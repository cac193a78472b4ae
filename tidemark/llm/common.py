"""Helpers shared by the corpus operators; slices of hot keys come from the core."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.operators.spread import running_total, slice_count, slice_of, spread_lookup
from tidemark.session import cut_lineage, scratch_path

__all__ = ["WHITE", "landed", "ranked", "running_total", "slice_count", "slice_of", "spread_lookup", "without_rows"]

WHITE = "[\\x20\\x09-\\x0D]+"  # the white space of the query contracts
MOST_GONE = 1_000_000  # row numbers or digests of rows that go are broadcast up to this many; more are joined by shuffle


def landed(df: DataFrame, tag: str) -> DataFrame:
    """Write once to the shared folder and read back: one pass, short lineage, fixed row ids."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without_rows(rows: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """``rows`` but those whose ``key`` (a row number or a digest) is in the one column of ``gone``; null keys stay.

    ``gone`` is written and counted first: where it is short, the rows, with their texts, are not shuffled.
    """
    gone = cut_lineage(gone.toDF("_gone"))
    table = F.broadcast(gone) if gone.count() <= MOST_GONE else gone.hint("shuffle_merge")
    return rows.join(table, key == F.col("_gone"), "left_anti")


def ranked(df: DataFrame, group: list[str], order: list[str], out: str, tag: str) -> DataFrame:
    """Rows with their gapless position from 0 inside ``group`` by ``order``, written once.

    A range sort on (group, order) deals a group of any size over tasks. Positions are counted inside a
    partition as it streams by; only a partition's first group can have rows before it, so what is added
    afterwards is at most one number per partition. Group columns must not be null.
    """
    spark = df.sparkSession
    parts = slice_count(spark)
    schema = T.StructType([*df.schema.fields, T.StructField("_rk_part", T.IntegerType()), T.StructField("_rk_at", T.LongType())])

    def count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, seen = None, 0
        for batch in batches:
            keys = list(zip(*[batch.column(batch.schema.get_field_index(g)).to_pylist() for g in group]))
            at = []
            for key in keys:
                seen = seen + 1 if key == before else 0
                before = key
                at.append(seen)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "_rk_at"])

    sort = [*group, *order]
    dealt = df.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).withColumn("_rk_part", F.spark_partition_id())
    rows = landed(dealt.mapInArrow(count_runs, schema), tag)
    earlier = Window.partitionBy(*group).orderBy("_rk_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy(*group, "_rk_part").agg(F.count("*").alias("_rk_n"))
    carried = runs.select(*group, "_rk_part", F.sum("_rk_n").over(earlier).alias("_rk_off")).where("_rk_off > 0")
    return (
        rows.join(F.broadcast(carried), [*group, "_rk_part"], "left")  # one row per partition at most
        .withColumn(out, F.col("_rk_at") + F.coalesce("_rk_off", F.lit(0)))
        .drop("_rk_part", "_rk_at", "_rk_off")
    )
