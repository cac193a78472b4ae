"""Daily series per ticker: panel, moving averages, returns, volatility, drawdown.

A ticker's series is as long as the calendar, so windows per ticker stay small however many rows
fed it. The panel shuffles once, on ticker; everything after it keeps that partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.finance import net_conviction, signed_log

PRICE_COLUMNS = ("open", "high", "low", "close", "volume")
BLOCK = 256  # rows of a block of running averages, less where a decay would overflow
LARGEST = 250  # decimal digits that a scaled value may gain inside a block


def ticker_window(*keys: str) -> Window:
    return Window.partitionBy(*(keys or ("ticker",))).orderBy("date")


def sentiment_features(consensus: DataFrame) -> DataFrame:
    """What the panel needs from a consensus row."""
    def n(side):
        return F.try_element_at("sentiment_distribution", F.lit(side))

    bull, bear = n("bullish"), n("bearish")
    return consensus.select(
        "ticker", "date",
        net_conviction(F.col("conviction_weighted_bullish_score"), bull,
                       F.col("conviction_weighted_bearish_score"), bear).alias("net_conviction"),
        (F.coalesce(bull, F.lit(0)) + F.coalesce(bear, F.lit(0))).alias("total_mentions"),
        "avg_confidence", "avg_sentiment_intensity", "unique_submissions",
    )


def stock_panel(sentiment: DataFrame, prices: DataFrame, start: str, end: str,
                log_transform: bool = False) -> DataFrame:
    """Every day of the range for tickers with sentiment and prices.

    Missing sentiment is 0, missing prices stay NULL. Sentiment and price rows are stacked, sent to
    their ticker once and merged there; gaps are filled from each row up to the next one.
    """
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    measures = [c for c in sentiment.columns if c not in ("ticker", "date")]
    have_prices = [c for c in PRICE_COLUMNS if c in prices.columns]
    stacked = (
        sentiment.withColumn("told", F.lit(True))
        .unionByName(prices.select("ticker", "date", *have_prices).withColumn("priced", F.lit(True)),
                     allowMissingColumns=True)
        .where(F.col("date").between(lo, hi))
        .repartition(int(prices.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("ticker"))
    )
    merged = stacked.groupBy("ticker", "date").agg(
        *[F.max(c).alias(c) for c in [*measures, *have_prices, "told", "priced"]]
    )
    w = ticker_window()
    whole = Window.partitionBy("ticker")
    days = F.sequence(
        F.when(F.lag("date").over(w).isNull(), lo).otherwise(F.col("date")),
        F.coalesce(F.date_sub(F.lead("date").over(w), 1), hi),
    )
    dense = (
        merged.withColumns({
            "days": days,
            "usable": F.max(F.coalesce("told", F.lit(False))).over(whole)
            & F.max(F.coalesce("priced", F.lit(False))).over(whole),
        })
        .where("usable")
        .withColumn("day", F.explode("days"))
    )
    own = F.col("day") == F.col("date")
    panel = dense.select(
        "ticker", F.col("day").alias("date"),
        *[F.coalesce(F.when(own, F.col(c)), F.lit(0)).alias(c) for c in measures],
        *[F.when(own, F.col(c)).alias(c) for c in have_prices],
    )
    score = signed_log(F.col("net_conviction")) if log_transform else F.col("net_conviction")
    return panel.withColumns({"predictor": score, "idx": F.datediff("date", lo)})


def from_first_trade(panel: DataFrame) -> DataFrame:
    """Rows from the first tradable day on, with ``idx`` counted from it and ``n_rows``."""
    whole = Window.partitionBy("ticker")
    tradable = F.col("close").isNotNull() & (F.coalesce("volume", F.lit(0)) > 0)
    first = F.min(F.when(tradable, F.col("date"))).over(whole)
    kept = panel.withColumn("first_trade", first).where("date >= first_trade")
    return kept.withColumns({
        "idx": F.datediff("date", "first_trade"),
        "n_rows": F.count("*").over(whole),
    }).drop("first_trade")


def fill_forward(df: DataFrame, columns=PRICE_COLUMNS, keys: tuple = ("ticker",)) -> DataFrame:
    w = ticker_window(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns if c in df.columns})


def ema(df: DataFrame, spans, value: str = "predictor", prefix: str = "ema_", idx: str = "idx",
        key: str = "ticker") -> DataFrame:
    """Exponential moving averages with full weights from the first row, all spans in one pass.

    ``idx`` counts rows from 0 without gaps. With decay r a row's weighted sum is r^offset times (a running
    sum of x / r^offset inside its block, plus what the blocks before left behind). All spans share the
    blocks, so the three windows below read the rows once, in one order, however many spans there are; a
    block is short enough for the fastest decay never to overflow.
    """
    decays = {span: (span - 1) / (span + 1) for span in spans}
    fading = {span: r for span, r in decays.items() if r > 0}
    flat = {f"{prefix}{s}": F.col(value).cast("double") for s in spans if s not in fading}
    if not fading:
        return df.withColumns(flat)
    size = max(1, min(BLOCK, math.floor(LARGEST / -math.log10(min(fading.values())))))
    offset = F.col(idx) % size
    inside = Window.partitionBy(key, "_b").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_b", idx).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"_b": F.floor(F.col(idx) / size), **{
        f"_u{s}": F.col(value) * F.pow(F.lit(1 / r), offset) for s, r in fading.items()}})
    df = df.withColumns({f"_u{s}": F.coalesce(F.sum(f"_u{s}").over(inside), F.lit(0.0)) for s in fading})
    ends = F.when(offset == size - 1, F.struct(*[F.col(f"_u{s}").alias(f"s{s}") for s in fading]))
    df = df.withColumn("_past", F.when(offset == 0, F.collect_list(ends).over(before)))

    def left_behind(s: int, r: float) -> Column:
        return F.aggregate("_past", F.lit(0.0), lambda acc, x: (acc + x[f"s{s}"]) * r**size)

    df = df.withColumns({f"_c{s}": left_behind(s, r) for s, r in fading.items()})
    df = df.withColumns({f"_c{s}": F.first(f"_c{s}").over(inside) for s in fading})
    averages = {f"{prefix}{s}": F.pow(F.lit(r), offset) * (F.col(f"_u{s}") + F.col(f"_c{s}"))
                * (1 - r) / (1 - F.pow(F.lit(r), F.col(idx) + 1)) for s, r in fading.items()}
    every = {**flat, **averages}
    return df.withColumns({f"{prefix}{s}": every[f"{prefix}{s}"] for s in spans}).drop(
        "_b", "_past", *[f"_{c}{s}" for s in fading for c in "uc"])


def forward_returns(df: DataFrame, horizons, price: str = "close", prefix: str = "fwd_",
                    keys: tuple = ("ticker",)) -> DataFrame:
    """Return in percent over the next h rows; NULL where either price is missing."""
    w = ticker_window(*keys)
    return df.withColumns({
        f"{prefix}{h}": F.try_divide(F.lead(price, h).over(w) - F.col(price), F.col(price)) * 100
        for h in horizons
    })


def realised_volatility(df: DataFrame, rows: int = 20, back_fill: bool = True,
                        keys: tuple = ("ticker",)) -> DataFrame:
    """Population deviation of daily changes over ``rows`` rows in percent.

    ``back_fill`` gives the first rows the first known value, which looks ahead.
    """
    w = ticker_window(*keys)
    before = F.lag("close").over(w)
    df = df.withColumn("change", F.try_divide(F.col("close") - before, before))
    frame = w.rowsBetween(-(rows - 1), 0)
    full = F.count("change").over(frame) == rows
    df = df.withColumn("vol", F.when(full, F.stddev_pop("change").over(frame) * 100))
    if back_fill:
        df = df.withColumn("vol", F.first("vol", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return df


def drawdown(df: DataFrame, value: str, keys: tuple = ("ticker",)) -> DataFrame:
    w = ticker_window(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("drawdown", F.col(value) / F.max(value).over(w) - 1)


def max_drawdown(df: DataFrame, value: str, keys: tuple = ("ticker",)) -> DataFrame:
    return drawdown(df, value, keys).groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))


def compounded(df: DataFrame, returns: Column, capital: float = 1.0, name: str = "equity",
               keys: tuple = ("ticker",)) -> DataFrame:
    """Capital after each row's fractional return."""
    w = ticker_window(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, capital * F.product(1 + returns).over(w))


def buy_and_hold(df: DataFrame, capital: float = 1.0, keys: tuple = ("ticker",)) -> DataFrame:
    first = F.first("close").over(ticker_window(*keys))
    return df.withColumn("buy_hold", F.col("close") / first * capital)


def age_weights(n_after: Column, half_life: float, mentions: Column) -> Column:
    """Weight of a row with ``n_after`` younger valid rows in its window."""
    return F.exp(-math.log(2) / half_life * n_after) * F.sqrt(1 + mentions)


def normalised_weights(df: DataFrame, half_life: float, keys: tuple = ("ticker",)) -> DataFrame:
    """Age weights of each row in its series, scaled to sum 1."""
    w = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    raw = age_weights(F.row_number().over(w) - 1, half_life, F.col("total_mentions"))
    df = df.withColumn("weight", raw)
    return df.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy(*keys)))


def realised_return(df: DataFrame, horizons, calendar: bool = True) -> DataFrame:
    """Return over each row's active horizon.

    ``calendar`` looks ahead on the calendar; otherwise only among rows that share the horizon.
    """
    keys = ("ticker",) if calendar else ("ticker", "active_horizon")
    w = ticker_window(*keys)
    later = F
    for h in horizons:
        later = later.when(F.col("active_horizon") == h, F.lead("close", h).over(w))
    ahead = later.otherwise(F.lit(None))
    return df.withColumn("realised_return", F.try_divide(ahead - F.col("close"), F.col("close")) * 100)


def information_metrics(df: DataFrame, min_pairs: int = 20) -> DataFrame:
    """Correlation of predicted and realised returns per ticker, and the ratio derived from it."""
    both = df.where("predicted_return is not null and realised_return is not null")
    ic = F.when(F.col("n") >= min_pairs, F.col("c"))
    return both.groupBy("ticker").agg(
        F.count("*").alias("n"), F.corr("predicted_return", "realised_return").alias("c")
    ).select("ticker", "n", ic.alias("ic"), (ic / F.sqrt(F.greatest(1 - ic * ic, F.lit(1e-12)))).alias("ir"))


def as_of(points: DataFrame, series: DataFrame, values: list[str], at: str = "date",
          key: str = "ticker") -> DataFrame:
    """For each point the last series row at or before it; NULL when the point comes first.

    Points and series are stacked and read in order once per month, instead of a range join; what a month
    starts with is carried over from the last marks of the months before, a few rows per key.
    """
    packed = F.struct(*values).alias("v")
    rows = points.select(F.struct(*points.columns).alias("p"), F.col(key), F.col(at).alias("_at"), F.lit(1).alias("_kind"))
    marks = series.select(key, F.col("date").alias("_at"), F.lit(0).alias("_kind"), packed)
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_month", F.date_format("_at", "yyyy-MM"))
    w = Window.partitionBy(key, "_month").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy(key, "_month").agg(F.max_by("v", F.when(F.col("_kind") == 0, F.col("_at"))).alias("_end"))
    carried = ends.select(key, "_month", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    found = both.withColumn("v", F.last("v", ignorenulls=True).over(w)).where("p is not null").join(carried, [key, "_month"], "left")
    v = F.coalesce("v", "_before")
    return found.select("p.*", *[v[c].alias(f"{c}_at_{at}") for c in values])


def ticker_coverage(consensus: DataFrame, prices: DataFrame, top: int | None = None) -> DataFrame:
    """Days with sentiment per ticker that has prices, most covered first."""
    days = (
        consensus.join(prices.select("ticker"), "ticker", "left_semi")
        .groupBy("ticker", "date").agg(F.lit(1).alias("one"))
        .groupBy("ticker").agg(F.count("*").alias("n_days"))
    )
    return days.orderBy(F.col("n_days").desc(), "ticker").limit(top) if top else days


def pnl_on_calendar(prices: DataFrame, trades: DataFrame) -> DataFrame:
    """Net returns on their exit dates, 0 on all other days."""
    exits = trades.groupBy("ticker", F.col("exit_date").alias("date")).agg(F.sum("net_return").alias("r"))
    return prices.join(exits, ["ticker", "date"], "left").withColumn("daily_return", F.coalesce("r", F.lit(0.0))).drop("r")
