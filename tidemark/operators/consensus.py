"""Daily per-ticker consensus and the rankings over it.

The whole consensus row comes from one grouping on (date, ticker): all counters are plain numbers,
so partial aggregation runs before the only shuffle and a ticker that dominates a day stays cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.text import normalise_ticker
from tidemark.operators.conflicts import weight_of
from tidemark.schemas import (
    CONSENSUS_WEIGHTS, CONVICTIONS, HORIZONS, POSITIONS, RANKING_WEIGHTS, SENTIMENTS, SOURCES,
)

# --- fixed values: thresholds of the consensus ------------------------------
CONTROVERSY_LIMIT = 0.6
CLEAR_SHARE, CLEAR_OPPOSITE = 60, 20

DISTRIBUTIONS = {
    "sentiment": SENTIMENTS, "position": POSITIONS, "conviction": CONVICTIONS,
    "time_horizon": HORIZONS, "source": SOURCES,
}


def _sum_if(condition: Column, value) -> Column:
    return F.sum(F.when(condition, value).otherwise(0))


def _count_map(prefix: str, domain) -> Column:
    pairs = [c for v in domain for c in (F.lit(v), F.col(f"{prefix}_{v}"))]
    return F.map_filter(F.create_map(*pairs), lambda _, n: n > 0)


def daily_consensus(resolved: DataFrame, primary: DataFrame | None = None,
                    weights: dict = CONSENSUS_WEIGHTS) -> DataFrame:
    """Consensus per (date, ticker) from opinions that are unique per (submission, ticker)."""
    level = weight_of(F.col("conviction"), weights, 1.0)
    rows = resolved.where(~F.col("extraction_refusal")).select(
        "date", normalise_ticker("ticker", strip_dollar=False).alias("ticker"), "submission_id",
        "confidence", "sentiment_intensity", "is_implicit", *DISTRIBUTIONS, F.lit(0).alias("as_primary"),
    )
    if primary is not None:
        # primary marks travel as extra rows, which saves a join on the same key
        rows = rows.unionByName(
            primary.where("primary_ticker is not null").select(
                "date", normalise_ticker("primary_ticker", strip_dollar=False).alias("ticker"),
                F.lit(1).alias("as_primary"),
            ),
            allowMissingColumns=True,
        )
    told = F.col("sentiment").isNotNull()
    side = {s: F.col("sentiment") == s for s in SENTIMENTS}
    score = F.col("confidence") * F.col("sentiment_intensity") * level
    aggs = [
        _sum_if(told, 1).alias("total_mentions"),
        F.sum("as_primary").alias("submissions_as_primary"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("sentiment_intensity").alias("avg_sentiment_intensity"),
        F.try_divide(
            F.sum(F.col("confidence") * F.col("sentiment_intensity")), F.sum("confidence")
        ).alias("confidence_weighted_intensity"),
        _sum_if(~F.col("is_implicit"), 1).alias("explicit_mentions"),
        _sum_if(F.col("is_implicit"), 1).alias("implicit_mentions"),
        F.min("submission_id").alias("first_seen"),
    ]
    for s in ("bullish", "bearish"):
        aggs += [
            F.sum(F.when(side[s], score).otherwise(0.0)).alias(f"conviction_weighted_{s}_score"),
            F.coalesce(F.avg(F.when(side[s], level)), F.lit(0.0)).alias(f"avg_{s}_conviction"),
        ]
    for s in SENTIMENTS:
        aggs += [
            F.avg(F.when(side[s], F.col("confidence"))).alias(f"conf_{s}"),
            F.min(F.when(side[s], F.col("submission_id"))).alias(f"first_{s}"),
        ]
    for name, domain in DISTRIBUTIONS.items():
        aggs += [_sum_if(F.col(name) == v, 1).alias(f"{name}_{v}") for v in domain]
    counted = rows.groupBy("date", "ticker").agg(*aggs).where("total_mentions > 0")

    n, bull, bear = F.col("total_mentions"), F.col("sentiment_bullish"), F.col("sentiment_bearish")
    polar = F.least(
        bull / n * (bear / n) * 4 * (1 - F.col("sentiment_neutral") / n * 0.5), F.lit(1.0)
    )
    both_sides = (bull > 0) & (bear > 0)
    controversy = F.when(
        both_sides,
        F.least(
            F.least(bull, bear) / F.greatest(bull, bear)
            * ((F.col("avg_bullish_conviction") + F.col("avg_bearish_conviction")) / 6.0)
            * ((bull + bear) / n),
            F.lit(1.0),
        ),
    ).otherwise(0.0)
    seen = [(s, F.col(f"sentiment_{s}"), F.col(f"first_{s}")) for s in SENTIMENTS]
    top = F.greatest(*[count for _, count, _ in seen])
    earliest = F.least(*[F.when(count == top, first) for _, count, first in seen])
    dominant = F
    for name, count, first in seen:
        dominant = dominant.when((count == top) & (first == earliest), name)
    confidence_map = F.map_filter(
        F.create_map(*[c for s in SENTIMENTS for c in (F.lit(s), F.col(f"conf_{s}"))]),
        lambda _, v: v.isNotNull(),
    )
    return counted.select(
        "date", "ticker", "total_mentions",
        *[_count_map(name, domain).alias(f"{name}_distribution") for name, domain in DISTRIBUTIONS.items()],
        "avg_confidence", "avg_sentiment_intensity", "confidence_weighted_intensity",
        n.alias("unique_submissions"), "submissions_as_primary", "explicit_mentions",
        "implicit_mentions", confidence_map.alias("avg_confidence_by_sentiment"),
        (top / n).alias("sentiment_consensus_strength"), dominant.alias("dominant_sentiment"),
        (top / n * 100).alias("dominant_sentiment_percentage"),
        polar.alias("sentiment_polarization"), controversy.alias("sentiment_controversy_score"),
        (controversy > CONTROVERSY_LIMIT).alias("is_controversial"),
        "conviction_weighted_bullish_score", "conviction_weighted_bearish_score",
        "avg_bullish_conviction", "avg_bearish_conviction", "first_seen",
    )


def submissions_per_ticker(opinions: DataFrame) -> DataFrame:
    """Distinct submissions per (date, ticker) when opinions may repeat inside a submission."""
    return (
        opinions.where(~F.col("extraction_refusal"))
        .withColumn("ticker", normalise_ticker("ticker", strip_dollar=False))
        .where("ticker <> ''")
        .groupBy("date", "ticker")
        .agg(F.countDistinct("submission_id").alias("unique_submissions"))
    )


def day_totals(opinions: DataFrame) -> DataFrame:
    """Header of a day; refused and ticker-less opinions count as processed too."""
    ticker = normalise_ticker("ticker", strip_dollar=False)
    counts = F.when(~F.col("extraction_refusal") & (ticker != ""), ticker)
    return opinions.groupBy("date").agg(
        F.countDistinct("submission_id").alias("total_submissions_processed"),
        F.count("*").alias("total_sentiments_processed"),
        F.countDistinct(counts).alias("unique_tickers"),
    )


def sentiment_overview(consensus: DataFrame) -> DataFrame:
    """Sentiment counts of a day across all tickers."""
    return (
        consensus.select("date", F.explode("sentiment_distribution").alias("sentiment", "n"))
        .groupBy("date", "sentiment")
        .agg(F.sum("n").alias("n"))
    )


# ---------------------------------------------------------------- rankings

def share(side: str) -> Column:
    return votes(side) / F.col("total_mentions") * 100


def votes(side: str) -> Column:
    return F.coalesce(F.try_element_at("sentiment_distribution", F.lit(side)), F.lit(0))


def top_per_day(df: DataFrame, *metrics: str, limit: int = 10) -> DataFrame:
    """The best rows of every day; ties go to the ticker seen first."""
    order = [F.col(m).desc() for m in metrics] + [F.col("first_seen"), F.col("ticker")]
    return (
        df.withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy(*order)))
        .where(F.col("rank") <= limit)
        .drop("first_seen")
    )


def top_of_day(df: DataFrame, date, *metrics: str, limit: int = 10) -> DataFrame:
    """The same for one day: a pruned scan and a top-k, no window."""
    order = [F.col(m).desc() for m in metrics] + [F.col("first_seen"), F.col("ticker")]
    return df.where(F.col("date") == date).orderBy(*order).limit(limit).drop("first_seen")


def most_mentioned(consensus: DataFrame) -> DataFrame:
    return consensus.select("date", "ticker", "total_mentions", "first_seen")


def conviction_weighted(consensus: DataFrame, side: str, min_mentions: int = 2) -> DataFrame:
    return consensus.where((F.col("total_mentions") >= min_mentions) & (votes(side) > 0)).select(
        "date", "ticker", F.col(f"conviction_weighted_{side}_score").alias("score"),
        share(side).alias("pct"), votes(side).alias("votes"), "total_mentions",
        F.col(f"avg_{side}_conviction").alias("avg_conviction"), "first_seen",
    )


def most_of(consensus: DataFrame, side: str, min_mentions: int = 2,
            exclude_controversial: bool = False) -> DataFrame:
    df = consensus.where(F.col("total_mentions") >= min_mentions)
    if exclude_controversial:
        df = df.where(~F.col("is_controversial"))
    return df.select(
        "date", "ticker", share(side).alias("pct"), votes(side).alias("votes"), "total_mentions",
        F.col("sentiment_controversy_score").alias("controversy"), "first_seen",
    )


def most_controversial(consensus: DataFrame, min_mentions: int = 3) -> DataFrame:
    return consensus.where(F.col("total_mentions") >= min_mentions).select(
        "date", "ticker", F.col("sentiment_controversy_score").alias("controversy"),
        share("bullish").alias("bullish_pct"), share("bearish").alias("bearish_pct"),
        "total_mentions", "first_seen",
    )


def clear_sentiment(consensus: DataFrame, side: str, min_mentions: int = 2) -> DataFrame:
    other = "bearish" if side == "bullish" else "bullish"
    keep = (share(side) > CLEAR_SHARE) & (share(other) < CLEAR_OPPOSITE)
    return consensus.where((F.col("total_mentions") >= min_mentions) & keep).select(
        "date", "ticker", share(side).alias("pct"), votes(side).alias("votes"), "total_mentions",
        share(other).alias("other_pct"), "first_seen",
    )


def highest_conviction(consensus: DataFrame, min_mentions: int = 2) -> DataFrame:
    total = F.aggregate(
        F.map_entries("conviction_distribution"),
        F.lit(0.0),
        lambda acc, e: acc + e["value"] * weight_of(e["key"], RANKING_WEIGHTS, 1),
    )
    return consensus.where(F.col("total_mentions") >= min_mentions).select(
        "date", "ticker", (total / F.col("total_mentions")).alias("conviction"), "total_mentions",
        "first_seen",
    )


def most_active_ticker(consensus: DataFrame) -> DataFrame:
    return top_per_day(most_mentioned(consensus), "total_mentions", limit=1).drop("rank")


def ticker_card(consensus: DataFrame) -> DataFrame:
    return consensus.select(
        "date", "ticker", "total_mentions", "unique_submissions",
        F.col("submissions_as_primary").alias("primary_ticker_count"),
        F.col("sentiment_distribution").alias("sentiment_breakdown"),
        F.concat("dominant_sentiment", F.lit(" ("),
                 F.round("dominant_sentiment_percentage", 1).cast("string"), F.lit("%)")).alias("dominant_sentiment"),
        F.col("sentiment_consensus_strength").alias("consensus_strength"), "avg_confidence",
        F.col("conviction_distribution").alias("conviction_breakdown"),
        F.col("position_distribution").alias("position_breakdown"),
        F.concat_ws("/", F.col("explicit_mentions").cast("string"),
                    F.col("implicit_mentions").cast("string")).alias("explicit_vs_implicit"),
        "is_controversial", F.col("sentiment_controversy_score").alias("controversy_score"),
        F.col("sentiment_polarization").alias("polarization"),
    )


def rank_mentioned() -> tuple:
    """Which consensus rows a list ranks, and by what; the rankings below say the same as columns."""
    return F.lit(True), F.col("total_mentions")


def rank_side(side: str, min_mentions: int = 2) -> tuple:
    return F.col("total_mentions") >= min_mentions, share(side), votes(side)


def rank_controversial(min_mentions: int = 3) -> tuple:
    return F.col("total_mentions") >= min_mentions, F.col("sentiment_controversy_score")


def day_summary(consensus: DataFrame, lists: dict[str, tuple], limit: int = 5) -> DataFrame:
    """Named top lists of each day, nested; every list holds at most ``limit`` entries.

    ``lists`` maps a list name to (which rows, metric, further metrics for ties). The consensus is read once:
    each row becomes a candidate of every list it belongs to, and each task keeps the best ``limit`` of a day
    and list before they meet, so a shuffle moves a handful of rows per task, day and list.
    """
    width = max(len(metrics) for _keep, *metrics in lists.values())
    candidates = F.array(*[
        F.struct(F.lit(name).alias("list"), keep.alias("keep"), *[
            (metrics[i] if i < len(metrics) else F.lit(0)).cast("double").alias(f"m{i}") for i in range(width)])
        for name, (keep, *metrics) in lists.items()])
    rows = consensus.select("date", "ticker", "first_seen", F.inline(F.filter(candidates, lambda c: c["keep"])))
    best = Window.partitionBy("date", "list").orderBy(*[F.col(f"m{i}").desc() for i in range(width)], "first_seen", "ticker")
    ranked = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    entry = F.struct("rank", "ticker", F.col("m0").alias("value"))
    return ranked.groupBy("date").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("list") == name, entry))).alias(name) for name in lists]
    )
