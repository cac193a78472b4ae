"""Submission documents: partitioned sink, scan, content projection and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.ids import day_or_unknown, json_array_size
from tidemark.functions.text import safe_path_value
from tidemark.schemas import DOCUMENT


def write_documents(docs: DataFrame, path: str, created: Column, fmt: str = "parquet",
                    by_subreddit: bool = True, mode: str = "append") -> None:
    """``[subreddit=../]day=YYYYMMDD/`` folders; rows without a readable date go to unknown_date.

    The write is rebalanced by the partition columns: a busy day is split by its size at run time, small
    days share a task.
    """
    parts = (["sub"] if by_subreddit else []) + ["day"]
    out = docs.withColumn("day", day_or_unknown(created))
    if by_subreddit:
        out = out.withColumn("sub", safe_path_value("subreddit"))
    out.hint("rebalance", *parts).write.mode(mode).partitionBy(*parts).format(fmt).save(path)


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.option("basePath", path)
    return reader.schema(DOCUMENT.add("sub", "string").add("day", "string")).format(fmt).load(path)


def content(docs: DataFrame, max_comments: int | None = None) -> DataFrame:
    """Title, body (own text or first entry) and the first comments in file order."""
    rest = F.slice("comments", F.lit(2), F.size("comments") if max_comments is None else F.lit(max_comments))
    first = F.try_element_at("comments", F.lit(1))
    body = F.coalesce(F.nullif(F.col("selftext"), F.lit("")), first) if "selftext" in docs.columns else first
    return docs.select(
        *[c for c in docs.columns if c not in ("comments", "selftext")],
        body.alias("submission_body"), rest.alias("comments"),
    )


def available_dates(docs: DataFrame, column: str = "day") -> DataFrame:
    return docs.where(F.col(column).rlike(r"^\d{8}$")).select(column).distinct()


def ids_of_date(docs: DataFrame, day: str, column: str = "day") -> DataFrame:
    return docs.where(F.col(column) == day).select("submission_id")


def in_date_range(df: DataFrame, start: str | None, end: str | None, resume_from: str | None = None,
                  column: str = "day") -> DataFrame:
    """Closed range on the partition column, so the scan is pruned."""
    if start is not None:
        df = df.where(F.col(column) >= start)
    if end is not None:
        df = df.where(F.col(column) <= end)
    if resume_from is not None:
        df = df.where(F.col(column) >= resume_from)
    return df


def look_back(df: DataFrame, reference: Column, hours: int, limit: int | None = None,
              ts: str = "ts", oldest_first: bool = False, key: str = "submission_id") -> DataFrame:
    """Rows of the last hours, newest first, at most ``limit`` of them; ``key`` decides ties."""
    df = df.where(F.col(ts) >= reference - F.make_dt_interval(hours=F.lit(hours)))
    if limit is not None:
        df = df.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(limit)
    return df.orderBy(F.col(ts).asc() if oldest_first else F.col(ts).desc())


def comment_counts(docs: DataFrame, raw_json: bool = False) -> DataFrame:
    """Submissions and comments per (date, subreddit)."""
    size = json_array_size(F.col("comments")) if raw_json else F.coalesce(F.size("comments"), F.lit(0))
    return (
        docs.where(F.col("subreddit") != "")
        .groupBy("date", "subreddit")
        .agg(F.count("*").alias("n_submission"), F.sum(size).cast("bigint").alias("n_comments"))
    )


REQUIRED_FIELDS = ("submission_id", "title", "date", "subreddit", "comments")


def validate(docs: DataFrame) -> DataFrame:
    """Adds ``issues``, ``warnings``, ``is_valid`` and ``is_clean``; absent fields count as missing."""
    def has(name):
        return F.col(name) if name in docs.columns else F.lit(None).cast("string")

    issues, warnings = [], []
    for name in REQUIRED_FIELDS:
        value = has(name)
        issues.append(F.when(value.isNull(), f"Missing required field: {name}"))
        if name == "comments":
            issues.append(F.when(F.size("comments") == 0, "Empty required field: comments"))
        elif name != "title":
            warnings.append(F.when(value == "", f"Empty field: {name}"))
    comments = F.coalesce(F.col("comments"), F.array().cast("array<string>"))
    first = F.try_element_at(comments, F.lit(1))
    issues += [
        F.when(F.size(comments) == 0, "Comments list is empty"),
        F.when(~first.startswith("Submission body:"), "First comment entry should be submission body"),
    ]
    malformed = F.size(F.filter(F.slice(comments, F.lit(2), F.size(comments)),
                                lambda c: ~c.startswith("Top level comment:")))
    warnings.append(
        F.when(malformed > 0, F.concat(malformed.cast("string"),
                                       F.lit(" comment threads don't follow expected format")))
    )
    date = F.coalesce(has("date"), F.lit(""))
    readable = date.rlike(r"^\d{4}-\d{2}-\d{2}") & F.try_to_timestamp(date).isNotNull()
    issues.append(F.when(~readable, F.concat(F.lit("Invalid date format: "), date)))
    sid = F.coalesce(has("submission_id"), F.lit(""))
    odd = (sid != "") & ((F.length(sid) < 5) | (F.length(sid) > 10))
    warnings.append(F.when(odd, F.concat(F.lit("Unusual submission ID length: "), sid)))
    out = docs.withColumns({
        "issues": F.array_compact(F.array(*issues)), "warnings": F.array_compact(F.array(*warnings))
    })
    return out.withColumns({
        "is_valid": F.size("issues") == 0,
        "is_clean": (F.size("issues") == 0) & (F.size("warnings") == 0),
    })


def missing_fields(docs: DataFrame, required: list[str]) -> DataFrame:
    """Which of the required top-level fields a raw JSON document (column ``value``) lacks."""
    keys = F.json_object_keys("value")
    readable = keys.isNotNull()
    missing = F.array_except(F.array(*[F.lit(r) for r in required]), F.coalesce(keys, F.array().cast("array<string>")))
    return docs.select(
        "*", readable.alias("is_readable"), missing.alias("missing_fields"),
        (readable & (F.size(missing) == 0)).alias("is_valid"),
    )
