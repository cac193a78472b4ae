"""Dump rows to submission documents: filters, orphans, comment caps, document build, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.ids import iso_or_raw, parse_created, submission_id_from_link
from tidemark.functions.text import clean_dump_text, scored_line, strip
from tidemark.operators.spread import slice_count, slice_of
from tidemark.schemas import REMOVED_MARKERS



def year_ok(column: str, min_year: int | None, max_year: int | None) -> Column:
    """NULL dates fail, unreadable dates pass, readable ones must lie in the range."""
    ts = parse_created(column)
    inside = F.lit(True)
    if min_year:
        inside = inside & (F.year(ts) >= min_year)
    if max_year:
        inside = inside & (F.year(ts) <= max_year)
    if not min_year and not max_year:
        return F.lit(True)
    return F.col(column).isNotNull() & (ts.isNull() | inside)


def filter_years(df: DataFrame, column: str = "created", min_year: int | None = 2020,
                 max_year: int | None = None) -> DataFrame:
    return df.where(year_ok(column, min_year, max_year))


def not_removed(*columns: str) -> Column:
    keep = F.lit(True)
    for c in columns:
        keep = keep & ~F.coalesce(F.col(c), F.lit("")).isin(*REMOVED_MARKERS)
    return keep


def drop_removed(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose text equals a removed marker go; NULL text becomes empty."""
    kept = df.where(not_removed(*columns))
    return kept.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in columns})


def with_submission_id(df: DataFrame) -> DataFrame:
    return df.withColumn("submission_id", submission_id_from_link("link"))


def drop_orphans(comments: DataFrame, submissions: DataFrame) -> DataFrame:
    """Comments whose submission survived; a semi join, nothing is collected."""
    ids = with_submission_id(submissions).where("submission_id is not null").select("submission_id")
    return with_submission_id(comments).join(ids, "submission_id", "left_semi")


def cap_comments(comments: DataFrame, cap: int | None = None) -> DataFrame:
    """All comments in file order; with ``cap``, the best by score where a submission has more.

    Adds ``place``. Ranks are taken in slices first, so of a submission of any size at most
    ``cap + 1`` rows per slice meet in one task. Without a cap no rows meet at all.
    """
    if cap is None:
        return comments.withColumn("place", F.col("file_pos"))
    best = [F.col("score").desc_nulls_last(), F.col("file_pos")]
    salt = slice_of([F.col("file_pos")], slice_count(comments.sparkSession))
    sliced = Window.partitionBy("submission_id", salt).orderBy(*best)
    df = comments.withColumn("_r", F.row_number().over(sliced)).where(F.col("_r") <= cap + 1).drop("_r")
    group = Window.partitionBy("submission_id")
    df = df.withColumn("_r", F.row_number().over(group.orderBy(*best))).where(F.col("_r") <= cap + 1)
    over = F.max("_r").over(group) > cap
    in_file_order = F.row_number().over(group.orderBy("file_pos"))
    df = df.withColumns({"_over": over, "_p": in_file_order}).where(F.col("_r") <= cap)
    return df.withColumn("place", F.when(F.col("_over"), F.col("_r")).otherwise(F.col("_p"))).drop(
        "_r", "_p", "_over"
    )


def group_comments(comments: DataFrame) -> DataFrame:
    """Comments as one ordered list per submission, the output value of a document.

    A submission's list must fit in a row; ``cap_comments`` gives the same comments row by row.
    """
    entry = F.struct("place", "score", "body", "link", clean_dump_text("body").alias("clean"))
    return comments.groupBy("submission_id").agg(F.sort_array(F.collect_list(entry)).alias("raw"))


def build_documents(
    submissions: DataFrame,
    comments: DataFrame,
    *,
    cap: int | None = None,
    include_body: bool = True,
    with_scores: bool = True,
    year_filtered: bool = True,
) -> DataFrame:
    """Submission documents from cleaned rows; submissions without any content are left out."""
    raw = group_comments(cap_comments(comments, cap))
    joined = with_submission_id(submissions).where("submission_id is not null").join(
        raw, "submission_id", "left"
    )
    raw_list = F.coalesce("raw", F.array().cast(raw.schema["raw"].dataType))
    told = F.filter(raw_list, lambda c: (c["clean"] != "") & ~c["clean"].isin(*REMOVED_MARKERS))
    comment_lines = F.transform(
        told, lambda c: scored_line(c["clean"], c["score"], "Top level comment", with_scores)
    )
    joined = joined.withColumn("_body", clean_dump_text(strip(F.coalesce("text", F.lit("")))))
    body = F.col("_body")
    body_line = F.when(body != "", F.array(scored_line(body, F.col("score"), "Submission body", with_scores)))
    entries = comment_lines
    if include_body:
        entries = F.concat(F.coalesce(body_line, F.array().cast("array<string>")), comment_lines)
    n = F.size(raw_list)
    empty = F.size(F.filter(raw_list, lambda c: strip(F.coalesce(c["body"], F.lit(""))).isin(
        "", "nan", *REMOVED_MARKERS)))
    rate = F.when(n == 0, 100.0).otherwise(F.round((n - empty) / n * 100, 2))
    metadata = F.struct(
        F.col("score").cast("bigint").alias("original_score"),
        F.coalesce("author", F.lit("")).alias("author"),
        F.col("link").alias("original_link"),
        n.cast("bigint").alias("comment_count"),
        F.size("entries").cast("bigint").alias("valid_comment_count"),
        F.lit("csv_dump").alias("conversion_source"),
        F.col("url").alias("url"),
        F.lit(True).alias("cleaning_applied"),
        F.lit(year_filtered).alias("year_filtering_applied"),
        F.struct(
            (n - empty).cast("bigint").alias("top_level_comments"),
            F.lit(0).cast("bigint").alias("total_replies"),
            empty.cast("bigint").alias("empty_comments"),
            F.lit(0).cast("bigint").alias("threads_with_replies"),
        ).alias("comment_breakdown"),
        F.struct(
            F.size(F.filter(raw_list, lambda c: c["score"].isNotNull())).cast("bigint").alias("comments_with_scores"),
            empty.cast("bigint").alias("deleted_comments"),
            rate.alias("processing_success_rate"),
        ).alias("data_quality"),
    )
    return (
        joined.withColumn("entries", entries)
        .where(F.size("entries") > 0)
        .select(
            "submission_id",
            clean_dump_text("title").alias("title"),
            iso_or_raw(F.col("created")).alias("date"),
            "subreddit",
            F.col("entries").alias("comments"),
            metadata.alias("metadata"),
            "created",
        )
    )


def conversion_report(submissions: DataFrame, comments: DataFrame, min_year: int | None = 2020,
                      max_year: int | None = None) -> DataFrame:
    """Rows per stage, per table: one conditional aggregate over each flagged table."""
    flagged = with_submission_id(submissions).select(
        F.when(~year_ok("created", min_year, max_year), "filtered_by_year")
        .when(~not_removed("title", "text"), "removed")
        .when(F.col("submission_id").isNull(), "without_id")
        .otherwise("kept").alias("stage"),
        parse_created("created").isNull().alias("bad_date"), "submission_id",
    )
    ids = flagged.where("stage = 'kept'").select("submission_id").distinct().withColumn("known", F.lit(True))
    sorted_comments = (
        with_submission_id(comments)
        .select(
            F.when(~year_ok("created", min_year, max_year), "filtered_by_year")
            .when(~not_removed("body"), "removed").alias("early"), "submission_id",
        )
        .join(ids, "submission_id", "left")
        .select(F.coalesce("early", F.when(F.col("known"), "kept").otherwise("orphan")).alias("stage"))
    )

    def rates(df, table, bad_dates):
        counts = [F.count(F.when(F.col("stage") == s, 1)).alias(s)
                  for s in ("filtered_by_year", "removed", "orphan", "kept")]
        out = df.agg(F.count("*").alias("rows_in"), *counts, bad_dates.alias("date_parse_errors"))

        def pct(part, *others):
            total = F.greatest(sum((F.col(o) for o in others), F.col(part)), F.lit(1))
            return F.col(part) / total * 100

        return out.select(
            F.lit(table).alias("table"), "*", pct("removed", "kept").alias("removal_rate"),
            pct("orphan", "kept", "removed").alias("orphan_rate"),
            pct("filtered_by_year", "kept").alias("year_filter_rate"),
        )

    kept_bad = F.count(F.when(F.col("bad_date") & (F.col("stage") == "kept"), 1))
    return rates(flagged, "submissions", kept_bad).unionByName(
        rates(sorted_comments, "comments", F.lit(0).cast("bigint"))
    )
