"""Token and cost estimates, and metrics over a request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import cut_lineage

# --- fixed values: prices per million tokens and planning constants ----------
INPUT_RATES = {"gpt-4.1": 2.00, "gpt-4.1-mini": 0.40, "gpt-4.1-nano": 0.10, "gpt-4o": 2.50, "gpt-4o-mini": 0.15}
OUTPUT_RATES = {"gpt-4.1": 8.00, "gpt-4.1-mini": 1.60, "gpt-4.1-nano": 0.40, "gpt-4o": 10.00, "gpt-4o-mini": 0.6}
DEFAULT_RATE = 1.00
OUTPUT_TOKENS = 300
PAST_INPUT_TOKENS = 1000
EXTRACTIONS_PER_MINUTE, EXTRACTIONS_PER_HOUR = 8, 480


def default_token_count(text: Column) -> Column:
    """Four characters per token, rounded up. Pass a ``pandas_udf('int')`` for an exact count."""
    return F.ceil(F.length(text) / 4)


def rate(model: Column, rates: dict) -> Column:
    """The price of the longest name found in the model name."""
    out = F
    for name in sorted(rates, key=len, reverse=True):
        out = out.when(model.contains(name), rates[name])
    return out.otherwise(DEFAULT_RATE)


def cost_of(tokens_in: Column, tokens_out: Column, model: Column) -> dict[str, Column]:
    cost_in = tokens_in / 1_000_000 * rate(model, INPUT_RATES)
    cost_out = tokens_out / 1_000_000 * rate(model, OUTPUT_RATES)
    return {"input_cost": cost_in, "output_cost": cost_out, "total_cost": cost_in + cost_out}


def submission_tokens(requests: DataFrame, system_tokens: int, count=default_token_count) -> DataFrame:
    """Tokens per (day, submission) over its requests."""
    tokens = count(F.col("prompt")) + system_tokens
    return requests.withColumn("t", tokens).groupBy("day", "submission_id").agg(
        F.count("*").alias("num_extractions"), F.sum("t").alias("total_input_tokens"),
        F.avg("t").alias("avg_tokens"), F.max("t").alias("max_tokens"), F.min("t").alias("min_tokens"),
    )


def with_cost(tokens: DataFrame, model: str) -> DataFrame:
    out_tokens = F.col("num_extractions") * OUTPUT_TOKENS
    df = tokens.withColumn("estimated_output_tokens", out_tokens)
    return df.withColumns(cost_of(F.col("total_input_tokens"), out_tokens, F.lit(model)))


def day_costs(tokens: DataFrame, model: str) -> DataFrame:
    """Cost per day, with averages and the planned minutes."""
    daily = tokens.groupBy("day").agg(
        F.count("*").alias("num_submissions"), F.sum("num_extractions").alias("num_extractions"),
        F.sum("total_input_tokens").alias("total_input_tokens"),
    )
    out = with_cost(daily, model)
    return out.withColumns({
        "avg_cost_per_submission": F.col("total_cost") / F.col("num_submissions"),
        "avg_cost_per_extraction": F.col("total_cost") / F.col("num_extractions"),
        "estimated_minutes": F.col("num_extractions") / EXTRACTIONS_PER_MINUTE,
    })


def sampled_days(days: DataFrame, sample: int | None) -> DataFrame:
    """Evenly spaced days; the window runs over calendar days only, a few thousand rows at most."""
    order = Window.orderBy("day")
    numbered = days.select("day").distinct().select(
        "day", (F.row_number().over(order) - 1).alias("i"),
        F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_days"),
    )
    if not sample:
        return numbered.select("day", "n_days")
    step = F.floor(F.col("n_days") / sample)
    picked = (F.col("i") % step == 0) & (F.floor(F.col("i") / step) < sample)
    return numbered.where((F.lit(sample) >= F.col("n_days")) | picked).select("day", "n_days")


def range_cost(daily: DataFrame, sample: int | None = None) -> DataFrame:
    """Cost of a date range, extrapolated from the sampled days when there are fewer of them."""
    daily = cut_lineage(daily)  # a row per calendar day, read twice below
    chosen = daily.join(sampled_days(daily, sample), "day")
    sums = chosen.agg(
        F.max("n_days").alias("total_dates"), F.count("*").alias("dates_sampled"),
        F.sum("num_submissions").alias("submissions"), F.sum("num_extractions").alias("extractions"),
        F.sum("total_cost").alias("cost"),
    )
    scale = F.col("total_dates") / F.col("dates_sampled")
    return sums.select(
        "total_dates", "dates_sampled", (F.col("dates_sampled") < F.col("total_dates")).alias("is_sampled"),
        F.bround(F.col("submissions") * scale).cast("bigint").alias("estimated_submissions"),
        F.bround(F.col("extractions") * scale).cast("bigint").alias("estimated_extractions"),
        (F.col("cost") * scale).alias("estimated_cost"),
        (F.col("extractions") * scale / EXTRACTIONS_PER_HOUR).alias("estimated_hours"),
    )


def past_costs(totals: DataFrame, model: str) -> DataFrame:
    """Cost of processed days from extraction counts and mean token sizes."""
    tokens_in = F.col("total_extractions") * PAST_INPUT_TOKENS
    tokens_out = F.col("total_extractions") * OUTPUT_TOKENS
    costs = cost_of(tokens_in, tokens_out, F.lit(model))
    df = totals.withColumns({"estimated_input_tokens": tokens_in, "estimated_output_tokens": tokens_out, **costs})
    return df.withColumns({
        "cost_per_submission": F.try_divide("total_cost", "total_submissions"),
        "cost_per_extraction": F.try_divide("total_cost", "total_extractions"),
    })


def run_metrics(log: DataFrame, keys: list[str] = ["model"]) -> DataFrame:
    """Done, errors, success rate, tokens, rows per second and cost per key."""
    ok = ~F.col("failed")
    sums = log.groupBy(*keys).agg(
        F.count(F.when(ok, 1)).alias("total_extractions"), F.count(F.when(~ok, 1)).alias("total_errors"),
        F.sum(F.when(ok, F.col("input_tokens")).otherwise(0)).alias("total_input_tokens"),
        F.sum(F.when(ok, F.col("output_tokens")).otherwise(0)).alias("total_output_tokens"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    seconds = F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))
    tokens = F.col("total_input_tokens") + F.col("total_output_tokens")
    costs = cost_of(F.col("total_input_tokens"), F.col("total_output_tokens"), F.col("model"))
    n = F.col("total_extractions")
    return sums.withColumns({
        "success_rate": F.try_divide(n, n + F.col("total_errors")),
        "total_tokens": tokens,
        "avg_tokens": F.coalesce(F.try_divide(tokens, n), F.lit(0.0)),
        "extractions_per_second": F.coalesce(F.try_divide(n * 1_000_000, seconds), F.lit(0.0)),
        "total_cost": costs["total_cost"],
    })


def trailing_usage(log: DataFrame, key: str, seconds: int = 60, rpm: int = 500, tpm: int = 200_000,
                   buffer: float = 0.9) -> DataFrame:
    """Requests and tokens of the last minute before every request, against the buffered limits.

    A frame never reaches back more than one bucket, so each row also visits the next bucket and
    windows run per (key, bucket): one busy key spreads over time instead of filling one task.
    """
    width = seconds * 1_000_000
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = log.withColumn("at", micros).withColumn("bucket", F.floor(F.col("at") / width))
    both = rows.withColumn("step", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({
        "bucket": F.col("bucket") + F.col("step"), "own": F.col("step") == 0
    })
    frame = Window.partitionBy(key, "bucket").orderBy("at").rangeBetween(-width, 0)
    used = both.withColumns({
        "current_rpm": F.count("*").over(frame),
        "current_tpm": F.sum(F.col("input_tokens") + F.col("output_tokens")).over(frame),
    }).where("own")
    return used.withColumns({
        "rpm_utilization": F.col("current_rpm") / (rpm * buffer),
        "tpm_utilization": F.col("current_tpm") / (tpm * buffer),
        "rpm_remaining": F.greatest(F.lit(int(rpm * buffer)) - F.col("current_rpm"), F.lit(0)),
        "tpm_remaining": F.greatest(F.lit(int(tpm * buffer)) - F.col("current_tpm"), F.lit(0)),
    }).drop("step", "own", "bucket", "at")
