"""Extraction requests and outputs: build, pack into jobs, run a user extractor, parse."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.ids import parse_request_id, request_id
from tidemark.functions.text import normalise_ticker, prompt
from tidemark.operators.spread import in_order, slice_count
from tidemark.schemas import CONVICTIONS, EXTRACTION, HORIZONS, POSITIONS, SENTIMENTS, SOURCES
from tidemark.session import cut_lineage

def build_requests(docs: DataFrame, template: str, model: str, system: str = "") -> DataFrame:
    """One request per (submission, comment); a submission without comments still gets one."""
    rows = docs.select("day", "submission_id", "title", "submission_body", F.posexplode_outer("comments").alias("i", "comment"))
    index = F.coalesce("i", F.lit(0))
    user = prompt(template, F.col("title"), F.col("submission_body"), F.col("comment"))
    made = rows.select(
        "day", F.col("submission_id").cast("string").alias("submission_id"), index.alias("i"),
        request_id(F.col("day"), F.col("submission_id").cast("string"), index).alias("custom_id"),
        user.alias("prompt"),
    )
    message = F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))
    first = F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.lit(0).alias("temperature"), F.array(first, message).alias("messages"))
    line = F.to_json(F.struct("custom_id", F.lit("POST").alias("method"),
                              F.lit("/v1/chat/completions").alias("url"), body.alias("body")))
    return made.withColumn("line", line)


def pack_requests(requests: DataFrame, max_requests: int = 40_000, max_bytes: int = 180 * 1024 * 1024,
                  per_day: bool = True, order: tuple = ("submission_id", "i")) -> DataFrame:
    """Adds ``bytes``, ``job`` and ``oversized``: the jobs that filling one after the other in order gives.

    Requests follow (day, ``order``). A job ends before the request that would break a limit; one above the
    byte limit is a job of its own, marked oversized. With ``per_day`` off, jobs run on over the end of a day.
    ``job`` is the day, if jobs are per day, and a number from 0.

    Where a job that began at a request would end follows from running totals of counts and bytes alone.
    These pointers are doubled: each round knows the jobs of twice as many steps from the first, so the
    rounds grow with the logarithm of the jobs in a day. Only positions and sizes move in the rounds; the
    texts are written once and meet their job by row number, so repeated ids stay apart.
    """
    spark = requests.sparkSession
    span = F.col("day").cast("string") if per_day else F.lit("all")
    lines = cut_lineage(requests.withColumns({"bytes": F.octet_length("line").cast("bigint"), "_row": F.monotonically_increasing_id()}))
    keys = ["day", *[c for c in order if c in requests.columns], "_row"]
    placed = cut_lineage(in_order(
        lines.select(span.alias("span"), *keys, "bytes").fillna("", ["span"]), ["span"], keys, {"p": F.lit(1), "b": F.col("bytes")}
    ).select("span", "p", "b", "bytes", "_row"))
    starts = _job_starts(placed, max_requests, max_bytes, max(1, max_bytes // slice_count(spark))).withColumn("starts", F.lit(1))
    marked = placed.join(starts, ["span", "p"], "left")
    numbered = in_order(marked, ["span"], ["p"], {"job": F.coalesce("starts", F.lit(0))})
    number = (F.col("job") + F.coalesce("starts", F.lit(0)) - 1).cast("string")  # jobs begun up to here
    name = F.concat_ws("-", "span", number) if per_day else number
    return lines.join(numbered.select("_row", name.alias("job")), "_row").drop("_row").withColumn("oversized", F.col("bytes") > max_bytes)


def _job_starts(placed: DataFrame, max_requests: int, max_bytes: int, width: int) -> DataFrame:
    """(span, p) of the requests that begin a job; ``placed`` has position p and bytes before it, b, per span."""
    # the request that a job begun at p has no room for: as many requests end within b + max_bytes
    ends = placed.select("span", (F.col("b") + F.col("bytes")).alias("v"), F.lit(0).alias("kind"), (F.col("p") + 1).alias("q"), F.lit(None).cast("long").alias("p"))
    points = placed.select("span", (F.col("b") + max_bytes).alias("v"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("q"), "p")
    both = ends.unionByName(points).withColumn("bin", F.floor(F.col("v") / width))
    upto = Window.partitionBy("span", "bin").orderBy("v", "kind").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("span").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = both.groupBy("span", "bin").agg(F.max("q").alias("q"), F.max("p").alias("p"))
    carried = bins.select("span", "bin", F.max("q").over(earlier).alias("before"), (F.max("q").over(Window.partitionBy("span"))).alias("n"))
    found = both.withColumn("q", F.max("q").over(upto)).where("kind = 1").join(carried, ["span", "bin"])
    stop = F.greatest(F.least(F.coalesce("q", "before", F.lit(0)), F.col("p") + max_requests), F.col("p") + 1)
    jumps = cut_lineage(found.select("span", "p", stop.alias("to"), "n").where("to < n").drop("n"))
    reached = placed.where("p = 0").select("span", "p")
    while True:
        moved = cut_lineage(reached.join(jumps, ["span", "p"]).select("span", F.col("to").alias("p")))
        if not moved.head(1):
            return reached
        reached = cut_lineage(reached.unionByName(moved))
        jumps = cut_lineage(jumps.join(jumps.select("span", F.col("p").alias("to"), F.col("to").alias("further")), ["span", "to"]).select(
            "span", "p", F.col("further").alias("to")))


def run_extractor(requests: DataFrame, extract: Callable[[Iterator], Iterator]) -> DataFrame:
    """User hook: ``extract`` maps batches (custom_id, prompt) to (custom_id, arguments, error).

    The user reports a failed row in ``error``; a failing batch fails its task and is retried.
    """
    return requests.select("custom_id", "prompt").mapInPandas(
        extract, "custom_id string, arguments string, error string"
    )


def guarded(one: Callable[[str], str]):
    """Turn a per-prompt function into a batch extractor with an error column."""

    def batches(it):
        import pandas as pd

        for batch in it:
            answers, errors = [], []
            for text in batch["prompt"]:
                try:
                    answers.append(one(text))
                    errors.append(None)
                except Exception as exc:  # one bad row must not stop the batch
                    answers.append(None)
                    errors.append(str(exc))
            yield pd.DataFrame({"custom_id": batch["custom_id"], "arguments": answers, "error": errors})

    return batches


def extraction_counts(answers: DataFrame) -> DataFrame:
    """Good and failed extractions per (date, submission)."""
    date, sid = parse_request_id(F.col("custom_id"))
    return answers.groupBy(date.alias("date"), sid.alias("submission_id")).agg(
        F.count(F.when(F.col("error").isNull(), 1)).alias("extraction_count"),
        F.count("error").alias("failed_count"),
    )


OUTPUT_LINE = """custom_id string, response struct<body: struct<error: string, choices: array<struct<message:
 struct<tool_calls: array<struct<function: struct<arguments: string>>>>>>>>"""


def parse_outputs(lines: DataFrame) -> DataFrame:
    """Output lines (column ``value``) to one row per extraction; bad ids, errors and bad JSON go."""
    line = lines.select(F.from_json("value", OUTPUT_LINE).alias("r")).select(
        "r.custom_id", F.col("r.response.body").alias("body")
    )
    calls = F.try_element_at("body.choices", F.lit(1))["message"]["tool_calls"]
    arguments = F.try_element_at(calls, F.lit(1))["function"]["arguments"]
    return parse_arguments(line.select("custom_id", F.when(F.col("body.error").isNull(), arguments).alias("arguments")))


def parse_arguments(answers: DataFrame) -> DataFrame:
    """One row per readable extraction.

    Bad rows fall out in a generator. A filter would be pushed below the parser and parse again.
    """
    date, sid = parse_request_id(F.col("custom_id"))
    parsed = answers.select("custom_id", F.from_json("arguments", EXTRACTION).alias("e")).select(
        date.alias("date"), sid.alias("submission_id"),
        F.regexp_extract("custom_id", r"_c(\d+)$", 1).try_cast("bigint").alias("extraction_pos"), "e",
    )
    ok = F.col("date").isNotNull() & F.col("e.sentiments").isNotNull() & F.forall("e.sentiments", valid_sentiment)
    names = ("date", "submission_id", "extraction_pos", "e.primary_ticker", "e.sentiments", "e.ticker_relationships")
    return parsed.select(F.inline(F.when(ok, F.array(F.struct(*names)))))


def flatten_relationships(extractions: DataFrame) -> DataFrame:
    """One row per ticker relationship; a pair is written in alphabetical order unless one side acts on the other."""
    rows = extractions.select("date", "submission_id", F.explode("ticker_relationships").alias("r"))
    one, two = normalise_ticker("r.ticker1"), normalise_ticker("r.ticker2")
    turn = (one > two) & (F.col("r.relationship_type") != "causal")
    return rows.select(
        "date", "submission_id", F.when(turn, two).otherwise(one).alias("ticker1"), F.when(turn, one).otherwise(two).alias("ticker2"),
        "r.relationship_type", "r.description", "r.confidence")


def relationship_counts(relationships: DataFrame) -> DataFrame:
    """Mentions, submissions and mean confidence per date, pair and kind; merged per submission first."""
    pair = ["date", "ticker1", "ticker2", "relationship_type"]
    per_submission = relationships.groupBy(*pair, "submission_id").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"), F.count("confidence").alias("k"))
    return per_submission.groupBy(*pair).agg(
        F.sum("n").alias("mentions"), F.count("*").alias("submissions"), F.try_divide(F.sum("c"), F.sum("k")).alias("avg_confidence"))


def valid_sentiment(s: Column) -> Column:
    """Domain checks of one opinion record; one bad record voids its extraction."""
    return F.coalesce(
        s["confidence"].between(1, 10) & s["sentiment_intensity"].between(1, 10)
        & s["sentiment"].isin(*SENTIMENTS) & s["position"].isin(*POSITIONS)
        & s["conviction"].isin(*CONVICTIONS) & s["time_horizon"].isin(*HORIZONS)
        & s["source"].isin(*SOURCES) & s["is_implicit"].isNotNull(),
        F.lit(False),
    )


def flatten_opinions(extractions: DataFrame) -> DataFrame:
    """One row per opinion with ``pos``, the order of appearance inside its submission."""
    rows = extractions.select("date", "submission_id", "extraction_pos", F.posexplode("sentiments").alias("i", "s"))
    return rows.select(
        "date", "submission_id", (F.shiftleft("extraction_pos", 32) + F.col("i")).alias("pos"),
        normalise_ticker("s.ticker").alias("ticker"), *[F.col(f"s.{n}").alias(n) for n in (
            "confidence", "sentiment_intensity", "is_implicit", "sentiment", "position", "conviction",
            "time_horizon", "source", "explanation")],
        F.coalesce("s.extraction_refusal", F.lit(False)).alias("extraction_refusal"),
    )
