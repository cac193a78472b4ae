"""Streaming jobs run to completion over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.q_opinions import core_columns
from tidemark.plans.registry import ORACLES, query
from tidemark.session import scratch_path
from tidemark.streaming import consensus_state as CS, jobs as J, key_index as K

DAY = "cast(cast(ts as date) as varchar)"


def events(t):
    stream = J.new_files(t.spark, t.folder, t.events.schema, glob="events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("st1_incremental_ingest", "select event_type, count(*) as n, count(distinct event_id) as n_ids from events group by event_type")
def _(t):
    out, mark = scratch_path(t.spark, "ingest"), scratch_path(t.spark, "mark")
    for _run in range(2):  # the second run finds nothing new
        J.append_to(events(t), out, mark)
    return t.spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"))


@query("st2_duplicate_suppression", "select event_type, count(*) as n, count(distinct event_id) as n_ids, sum(event_id)::bigint as ids from events group by event_type")
def _(t):
    """Repeats come within a batch, in later batches and in later runs; a third of the ids come days late."""
    source, out, mark = (scratch_path(t.spark, n) for n in ("source", "unique", "mark"))
    rows = t.events.withColumn("third", F.col("event_id") % 3)
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    for wanted in ("third = 2", "third <> 0", "third is not null"):  # newest ids are stored before older ones arrive
        twice.where(wanted).repartition(2).write.mode("append").parquet(source)
        J.in_batches(J.new_files(t.spark, source, rows.schema, files_per_batch=1), K.new_only(out, ["event_id"]), mark)
    return t.spark.read.parquet(out).groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"), F.sum("event_id").alias("ids"))


@query("st3_daily_consensus", ORACLES["a01_consensus_core"])
def _(t):
    """Opinions arrive in two runs; what the second one changes is resolved again from stored cells."""
    arrived, source, state, mark = (scratch_path(t.spark, n) for n in ("arrived", "source", "state", "mark"))
    rows = t.sentiments
    rows.withColumn("late", F.pmod("submission_id", F.lit(2))).write.partitionBy("late").parquet(arrived)
    for late in (0, 1):
        t.spark.read.schema(rows.schema).parquet(f"{arrived}/late={late}").write.mode("append").parquet(source)
        J.in_batches(J.new_files(t.spark, source, rows.schema), CS.keep_consensus(state), mark)
    return core_columns(CS.current_consensus(t.spark, state))


@query("st4_late_rows_reopen_days", f"select {DAY} as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def _(t):
    source, cells, daily, mark = (scratch_path(t.spark, n) for n in ("source", "cells", "daily", "mark"))
    rows = t.events.withColumn("day", F.col("ts").cast("date"))
    schema = rows.schema

    def summarise(df):
        return df.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    def merge(cells):
        return cells.groupBy("day", "event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

    for late in (0, 1):  # odd rows arrive after the days were summarised once
        rows.where(F.col("event_id") % 2 == late).write.mode("append").parquet(source)
        J.in_batches(J.new_files(t.spark, source, schema), J.merge_days(cells, daily, summarise, merge), mark)
    out = t.spark.read.parquet(daily)
    return out.select(F.col("day").cast("string").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("st5_submission_states", """select o_custkey as submission_id, arg_max(case o_orderstatus when 'F' then 'failed' else 'processed' end, (o_orderdate, o_orderkey)) as status,
 count(*) as attempts, count(case when o_orderstatus = 'F' then 1 end) as failures from orders group by 1""")
def _(t):
    source, out, mark = (scratch_path(t.spark, n) for n in ("source", "states", "mark"))
    attempts = t.orders.select(
        F.col("o_custkey").alias("submission_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("processed").alias("status"),
        F.struct("o_orderdate", "o_orderkey").alias("ts"))
    attempts.repartition(3).write.parquet(source)
    stream = J.new_files(t.spark, source, attempts.schema, files_per_batch=1)
    J.in_batches(J.submission_states(stream), lambda rows, batch: J.write_batch(rows, out, batch), mark, mode="update")
    return J.current_states(t.spark, out).select("submission_id", "status", "attempts", "failures")


@query("st6_final_days", f"""select {DAY} as day, count(*) as n, round(sum(value), 4) as total from events where cast(ts as date) + 1 <= (select max(ts) - interval 2 day from events) group by 1""")
def _(t):
    out, mark = scratch_path(t.spark, "final"), scratch_path(t.spark, "mark")
    J.append_to(J.daily_totals(events(t), [], [F.count("*").alias("n"), F.sum("value").alias("total")], delay="2 days"), out, mark)
    return t.spark.read.parquet(out).select(F.col("day").cast("string").alias("day"), "n", F.round("total", 4).alias("total"))


@query("st7_skip_done_days", f"""select {DAY} as day, count(*) as n from events where event_id % 2 = 0 group by 1
 union all select {DAY}, count(*) from events where cast(ts as date) not in (select cast(ts as date) from events where event_id % 2 = 0) group by 1""")
def _(t):
    source, out, log, mark = (scratch_path(t.spark, n) for n in ("source", "kept", "log", "mark"))
    rows = t.events.select("event_id", F.col("ts").cast("date").alias("day"))
    for late in (0, 1):  # days of the first run are done when the second one comes; each run takes a day in several batches
        rows.where(F.col("event_id") % 2 == late).repartition(3).write.mode("append").parquet(source)
        handler = J.skipping_done(log, lambda df, batch: J.write_batch(df, out, batch), run=f"run{late}")
        J.in_batches(J.new_files(t.spark, source, rows.schema, files_per_batch=1), handler, mark)
        J.close_run(t.spark, log, f"run{late}")
    return t.spark.read.parquet(out).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))
