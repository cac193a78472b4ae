"""Per-submission results and the processing log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def latest(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """The newest row per key by partial aggregation; no window over repeated versions."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(ts)).alias("r")).select(*keys, "r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    return latest(old.unionByName(new, allowMissingColumns=True), keys, ts)


def result_totals(results: DataFrame) -> DataFrame:
    """Submissions and extractions per date."""
    return results.groupBy("date").agg(
        F.count("*").alias("total_submissions"), F.sum("extraction_count").alias("total_extractions")
    )


def error_free(results: DataFrame) -> DataFrame:
    return results.where(F.col("error").isNull() | (F.col("error") == ""))


def consolidation_totals(results: DataFrame) -> DataFrame:
    """Per date: good and failed results and the extractions of the good ones."""
    ok = F.col("error").isNull() | (F.col("error") == "")
    return results.groupBy("date").agg(
        F.count(F.when(ok, 1)).alias("successful_results"),
        F.count(F.when(~ok, 1)).alias("failed_results"),
        F.count("*").alias("total_results"),
        F.coalesce(F.sum(F.when(ok, F.col("extraction_count"))), F.lit(0)).alias("total_extractions"),
    )


def find(docs: DataFrame, ids: DataFrame, key: str = "submission_id") -> tuple[DataFrame, DataFrame]:
    """Rows of the wanted ids, and the ids that matched nothing.

    Join sides are left to runtime sizes; nothing is broadcast by hint.
    """
    return docs.join(ids, key, "left_semi"), ids.join(docs.select(key), key, "left_anti")


def inventory(incremental: DataFrame, consolidated: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Per date which stores hold something; one tagged union instead of two outer joins."""
    def tag(df, name):
        return df.select("date", F.lit(name).alias("store"))

    tagged = tag(incremental, "i").unionByName(tag(consolidated, "c")).unionByName(tag(checkpoints, "p"))

    def n(name):
        return F.count(F.when(F.col("store") == name, 1))

    return tagged.groupBy("date").agg(
        (n("i") > 0).alias("has_incremental"), n("i").alias("incremental_count"),
        (n("c") > 0).alias("has_consolidated"), (n("p") > 0).alias("has_checkpoint"),
    )


def inventory_totals(inv: DataFrame) -> DataFrame:
    return inv.agg(
        F.count("*").alias("total_dates"), F.sum("incremental_count").alias("total_incremental"),
        F.count(F.when(F.col("has_consolidated"), 1)).alias("consolidated_dates"),
        F.count(F.when(F.col("has_checkpoint"), 1)).alias("checkpoint_dates"),
    )


# ------------------------------------------------------------ processing log

def states(log: DataFrame) -> DataFrame:
    """The newest log row per submission; of equal times a processed one, then the later session."""
    order = F.struct("ts", (F.col("status") == "processed").alias("ok"), "session_id")
    return log.groupBy("submission_id").agg(F.max_by(F.struct("status", "session_id", "ts"), order).alias("r")).select("submission_id", "r.*")


def to_do(available: DataFrame, log: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Submissions without a final state; failed ones come back only on retry."""
    done = F.col("status") == "processed"
    if not retry_failed:
        done = done | (F.col("status") == "failed")
    handled = states(log).where(done).select("submission_id")
    return available.join(handled, "submission_id", "left_anti")


def retry_subset(log: DataFrame, requested: DataFrame) -> DataFrame:
    return states(log).where("status = 'failed'").join(requested, "submission_id", "left_semi")


def progress(available: DataFrame, log: DataFrame) -> DataFrame:
    """Per date: available, processed, failed, skipped, remaining and the two rates."""
    state = available.select("date", "submission_id").join(
        states(log).select("submission_id", "status"), "submission_id", "left"
    )

    def n(status):
        return F.count(F.when(F.col("status") == status, 1))

    out = state.groupBy("date").agg(
        F.count("*").alias("total_found"), n("processed").alias("processed"), n("failed").alias("failed"),
        n("skipped").alias("skipped"),
    )
    handled = F.col("processed") + F.col("failed")
    remaining = F.greatest(F.col("total_found") - handled - F.col("skipped"), F.lit(0))
    return out.select(
        "*", remaining.alias("remaining"),
        (handled / F.col("total_found")).alias("completion_rate"),
        F.coalesce(F.try_divide("processed", handled), F.lit(0.0)).alias("success_rate"),
        (remaining == 0).alias("is_complete"),
    )


def sessions(log: DataFrame) -> DataFrame:
    return log.groupBy("session_id").agg(
        F.count(F.when(F.col("status") == "processed", 1)).alias("processed_count"),
        F.count(F.when(F.col("status") == "failed", 1)).alias("failed_count"),
        F.max("ts").alias("last_activity"),
    )


def run_summary(runs: DataFrame) -> DataFrame:
    """Per subreddit: processed, skipped, failed, mean seconds of processed runs, comments."""
    ok = F.col("success") & ~F.col("skipped")
    return runs.groupBy("subreddit").agg(
        F.count(F.when(ok, 1)).alias("processed"),
        F.count(F.when(F.col("skipped"), 1)).alias("skipped_runs"),
        F.count(F.when(~F.col("success"), 1)).alias("failed"),
        F.coalesce(F.avg(F.when(ok, F.col("seconds"))), F.lit(0.0)).alias("avg_seconds"),
        F.sum(F.when(ok, F.col("n_comments")).otherwise(0)).alias("total_comments"),
    )


def split_known(ids: DataFrame, known: DataFrame, key: str = "submission_id") -> DataFrame:
    """Adds ``exists``: whether the id is already in ``known``."""
    marks = known.select(key).distinct().withColumn("_known", F.lit(True))
    return ids.join(marks, key, "left").withColumn("exists", F.coalesce("_known", F.lit(False))).drop("_known")


def require(condition: Column, value: Column, message: str) -> Column:
    """``value`` where the condition holds, else a failing row."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)).cast("int"))
