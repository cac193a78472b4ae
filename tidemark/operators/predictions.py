"""Relevance filters and summaries over prediction rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F



def relevant(predictions: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    return predictions.where(
        (F.col("predicted_label") == 1) & (F.col("confidence") >= min_confidence) & F.col("error").isNull()
    )


def above_threshold(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    return predictions.where(F.col("error").isNull() & (F.col("probability_relevant") >= threshold))


def prediction_summary(predictions: DataFrame) -> DataFrame:
    ok = F.col("error").isNull()
    hit = F.col("predicted_label") == 1
    return predictions.agg(
        F.count("*").alias("total_predictions"),
        F.count(F.when(ok, 1)).alias("successful"), F.count(F.when(~ok, 1)).alias("failed"),
        F.count(F.when(hit, 1)).alias("relevant_count"), F.count(F.when(~hit, 1)).alias("irrelevant_count"),
        F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("relevance_rate"),
        F.avg("confidence").alias("avg_confidence"), F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
        F.min("date_folder").alias("first_date"), F.max("date_folder").alias("last_date"),
    )


def daily_prediction_stats(predictions: DataFrame, digits: int = 3) -> DataFrame:
    return predictions.groupBy("date_folder").agg(
        F.count("submission_id").alias("total_submissions"),
        F.sum("predicted_label").cast("bigint").alias("relevant_count"),
        F.round(F.avg("predicted_label"), digits).alias("relevance_rate"),
        F.round(F.avg("confidence"), digits).alias("avg_confidence"),
        F.count("error").alias("error_count"),
    )


def scoring_summary(scores: DataFrame) -> DataFrame:
    """Totals of a scoring batch; only error-free rows count as relevant or irrelevant."""
    ok = F.col("error").isNull()
    hit = F.col("predicted_label") == 1
    return scores.agg(
        F.count("*").alias("total"), F.count(F.when(ok, 1)).alias("successful"),
        F.count(F.when(~ok, 1)).alias("failed"), F.count(F.when(ok & hit, 1)).alias("relevant"),
        F.count(F.when(ok & ~hit, 1)).alias("irrelevant"),
        F.coalesce(F.avg(F.when(ok, F.col("confidence"))), F.lit(0.0)).alias("avg_confidence"),
    )


def export_relevant(predictions: DataFrame, min_confidence: float = 0.8) -> DataFrame:
    path = F.concat("date_folder", F.lit("/"), F.col("submission_id").cast("string"), F.lit(".json"))
    return relevant(predictions, min_confidence).select("submission_id", "date_folder", "confidence", path.alias("file_path"))
