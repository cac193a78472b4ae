"""Dump scans: compressed NDJSON lines and per-subreddit CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.schemas import CSV_COMMENT, CSV_SUBMISSION, DUMP_LINE

SITE = "https://www.reddit.com"


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON (``.zst``, ``.gz`` or plain) with a fixed schema; bad lines land in ``_corrupt_record``.

    A compressed file is one task, so large dumps should come as many files.
    """
    return spark.read.schema(DUMP_LINE).option("mode", "PERMISSIVE").json(path)


def read_zst_dump(spark: SparkSession, paths: list[str], lines_per_batch: int = 20_000) -> DataFrame:
    """The same rows from zstd files whose long windows the built-in reader refuses.

    One task streams one file in constant memory; parsing runs in the JVM on the spread lines.
    """
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths), "path")

    def stream(batches):
        import io

        import pandas as pd
        import zstandard
        from pyarrow import fs

        for batch in batches:
            for path in batch["path"]:
                store, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                with store.open_input_stream(inner, compression=None) as raw:
                    reader = zstandard.ZstdDecompressor(max_window_size=2**31).stream_reader(raw, read_across_frames=True)
                    held = []
                    for line in io.TextIOWrapper(reader, encoding="utf-8", errors="replace", newline="\n"):
                        held.append(line.rstrip("\n"))
                        if len(held) == lines_per_batch:
                            yield pd.DataFrame({"value": held})
                            held = []
                    if held:
                        yield pd.DataFrame({"value": held})

    lines = files.mapInPandas(stream, "value string").where("value <> ''")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return lines.select(F.from_json("value", DUMP_LINE, options).alias("r")).select("r.*")


def count_bad_lines(lines: DataFrame) -> DataFrame:
    bad = F.col("_corrupt_record").isNotNull()
    # id keeps the parsed columns in the scan, which the reader needs to recognise a bad line
    return lines.select(bad.alias("bad"), "id").agg(
        F.count("*").alias("lines"), F.count(F.when(F.col("bad"), 1)).alias("bad_lines"),
        F.count("id").alias("with_id"),
    )


def project_dump(lines: DataFrame, kind: str) -> DataFrame:
    """The CSV columns of a dump line; ``created`` is in UTC."""
    fallback = F.concat(
        F.lit(f"{SITE}/r/"), "subreddit", F.lit("/comments/"), F.expr("substring(link_id, 4)"),
        F.lit("/_/"), "id", F.lit("/"),
    )
    link = F.coalesce(F.concat(F.lit(SITE), "permalink"), fallback).alias("link")
    author = F.concat(F.lit("u/"), "author").alias("author")
    created = F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM-dd HH:mm").alias("created")
    if kind == "submission":
        text = F.coalesce("selftext", F.lit("")).alias("text")
        return lines.select(author, "title", "score", created, link, text, "url")
    return lines.select(author, "score", created, link, "body")


def read_csv_dump(spark: SparkSession, paths: str | list[str], kind: str) -> DataFrame:
    """``<subreddit>_submissions.csv`` or ``<subreddit>_comments.csv``; the name gives the subreddit."""
    schema, ending = (
        (CSV_SUBMISSION, "submissions") if kind == "submission" else (CSV_COMMENT, "comments")
    )
    df = (
        spark.read.schema(schema)
        .options(header=True, multiLine=True, quote='"', escape='"')
        .csv(paths)
    )
    # a folder of parts carries the name too
    name = F.regexp_extract("_metadata.file_path", rf"(?:^|[/=])([^/=]+)_{ending}(?:\.csv)?(?:/|$)", 1)
    return df.withColumn("subreddit", name)
