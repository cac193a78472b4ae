"""One opinion per (date, submission, ticker) out of many extracted ones.

Opinions fall into a small number of categories, so raw rows are first pre-aggregated into
category cells before the shuffle. A submission holding a third of all rows reaches the merge step
as at most a few thousand cells. Every later step shares one partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import normalise_ticker
from tidemark.operators.spread import spread_lookup
from tidemark.schemas import CONVICTIONS, HORIZONS, POSITIONS, RESOLUTION_WEIGHTS, SOURCES

KEYS = ["date", "submission_id", "ticker"]
STRATEGIES = (
    "highest_confidence", "confidence_weighted", "majority_vote", "intensity_weighted",
    "conviction_weighted",
)
# a cell's standing inside its group: explicit beats implicit, failing and refused rows only count
EXPLICIT, IMPLICIT, FAILING, REFUSED = 3, 2, 1, 0


@dataclass(frozen=True)
class ConflictRules:
    strategy: str = "confidence_weighted"
    min_confidence: int = 5
    min_intensity: int = 3
    exclude_refusals: bool = True
    prefer_explicit: bool = True
    primary_by: str = "most_frequent"
    weights: dict = field(default_factory=lambda: dict(RESOLUTION_WEIGHTS))

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy}")


def weight_of(level: Column, weights: dict, default) -> Column:
    """Conviction level to number."""
    out = F
    for name, value in weights.items():
        out = out.when(level == name, F.lit(value))
    return out.otherwise(F.lit(default))


def passes_quality(rules: ConflictRules) -> Column:
    ok = (F.col("confidence") >= rules.min_confidence) & (
        F.col("sentiment_intensity") >= rules.min_intensity
    )
    return ok & ~F.col("extraction_refusal") if rules.exclude_refusals else ok


def usable_opinions(df: DataFrame, exclude_refusals: bool = True) -> DataFrame:
    """Normalised tickers; rows without a ticker and, if wanted, refused rows dropped."""
    df = df.withColumn("ticker", normalise_ticker("ticker")).where(F.col("ticker") != "")
    return df.where(~F.col("extraction_refusal")) if exclude_refusals else df


def quality_opinions(df: DataFrame, rules: ConflictRules = ConflictRules()) -> DataFrame:
    return usable_opinions(df, rules.exclude_refusals).where(passes_quality(rules))


def opinion_cells(df: DataFrame, rules: ConflictRules = ConflictRules()) -> DataFrame:
    """Opinions counted by category per (date, submission, ticker); cells of several batches may be stacked."""
    explicit = ~F.col("is_implicit") if rules.prefer_explicit else F.lit(True)
    tier = (
        F.when(F.col("extraction_refusal") & F.lit(rules.exclude_refusals), REFUSED)
        .when(~passes_quality(rules), FAILING)
        .when(explicit, EXPLICIT)
        .otherwise(IMPLICIT)
    )
    aggs = [
        F.count("*").alias("n"),
        F.min("pos").alias("first_pos"),
        F.sum("confidence").alias("conf"),
        F.sum("sentiment_intensity").alias("intensity"),
        F.sum(F.col("confidence") * F.col("sentiment_intensity")).alias("conf_intensity"),
        F.min("confidence").alias("conf_min"),
        F.max("confidence").alias("conf_max"),
    ]
    said = "explanation" in df.columns
    note = F.col("explanation") if said else F.lit(None).cast("string")
    if rules.strategy == "highest_confidence":
        aggs.append(
            F.max(F.struct("confidence", (-F.col("pos")).alias("back"), "sentiment_intensity",
                           note.alias("note"))).alias("best")
        )
    if said:
        aggs.append(
            F.max(F.when(F.trim(note) != "", F.struct(F.length(note).alias("size"),
                                                     (-F.col("pos")).alias("back"),
                                                     note.alias("note")))).alias("longest")
        )
    return (
        df.withColumn("ticker", normalise_ticker("ticker"))
        .where(F.col("ticker") != "")
        .withColumn("tier", tier)
        .groupBy(*KEYS, "tier", "sentiment", "is_implicit", "position", "conviction",
                 "time_horizon", "source", "extraction_refusal")
        .agg(*aggs)
    )


def _mode_of(column: str, domain) -> tuple[list[Column], Column]:
    """Aggregates and the expression on them for the most frequent value, first seen on ties."""
    aggs, choices = [], []
    for i, value in enumerate(domain):
        here = F.col(column) == value
        aggs += [
            F.sum(F.when(here, F.col("n"))).alias(f"_{column}_{i}_n"),
            F.min(F.when(here, F.col("first_pos"))).alias(f"_{column}_{i}_at"),
        ]
        choices.append(
            F.struct(F.col(f"_{column}_{i}_n").alias("n"), (-F.col(f"_{column}_{i}_at")).alias("back"),
                     F.lit(value).alias("value"))
        )
    return aggs, F.array_max(F.array(*choices)).getField("value")


def judge_conflicts(df: DataFrame, rules: ConflictRules = ConflictRules(), dealt: bool = False) -> DataFrame:
    """Per (date, submission, ticker): counts of every kind of row and the ``winner`` opinion.

    ``winner`` is NULL when no row passes the quality bar. Ties go to the opinion seen first. With ``dealt``
    the rows are taken as dealt by submission already, and nothing is shuffled for the judgement where they are.
    """
    return judge_cells(opinion_cells(df, rules), rules, dealt)


def judge_cells(cells: DataFrame, rules: ConflictRules = ConflictRules(), dealt: bool = False) -> DataFrame:
    """The same from cells; a cell may come in any number of parts."""
    said = "longest" in cells.columns
    best_wins = rules.strategy == "highest_confidence"
    spread = cells if dealt else cells.repartition(*[F.col(k) for k in KEYS])

    aggs = [
        F.sum("n").alias("n"),
        F.min("first_pos").alias("first_pos"),
        F.sum("conf").alias("conf"),
        F.sum("intensity").alias("intensity"),
        F.sum("conf_intensity").alias("conf_intensity"),
        F.min("conf_min").alias("conf_min"),
        F.max("conf_max").alias("conf_max"),
        F.sum(F.col("n") * weight_of(F.col("conviction"), rules.weights, 1)).alias("conviction_sum"),
        F.sum(F.when(F.col("is_implicit"), F.col("n")).otherwise(0)).alias("n_implicit"),
        F.sum(F.when(~F.col("is_implicit") & ~F.col("extraction_refusal"), F.col("n")).otherwise(0))
        .alias("n_explicit_told"),
        F.sum(F.when(F.col("is_implicit") & ~F.col("extraction_refusal"), F.col("n")).otherwise(0))
        .alias("n_implicit_told"),
        # a struct among the aggregates makes Spark sort here: one sort that spills serves both groupings, where
        # hash tables would hold every row at the width of all counters, twice
        F.max(F.struct("first_pos", "extraction_refusal")).alias("alone"),
        F.bit_or(_flag("source", SOURCES)).alias("source_bits"),
        F.bit_or(_flag("conviction", CONVICTIONS)).alias("conviction_bits"),
    ]
    modes = {}
    for column, domain in (("position", POSITIONS), ("conviction", CONVICTIONS),
                           ("time_horizon", HORIZONS)):
        more, modes[column] = _mode_of(column, domain)
        aggs += more
    if best_wins:
        aggs.append(
            F.max(F.struct("best", "is_implicit", "position", "conviction", "time_horizon")).alias("best")
        )
    if said:
        aggs.append(F.max("longest").alias("longest"))
    by_view = spread.groupBy(*KEYS, "tier", "sentiment").agg(*aggs)

    lone_source = F
    for i, name in enumerate(SOURCES):
        lone_source = lone_source.when(F.col("source_bits") == (1 << i), name)
    merged = F.struct(
        "sentiment",
        "n",
        F.bround(F.col("conf") / F.col("n")).cast("int").alias("confidence"),
        F.bround(F.try_divide("conf_intensity", "conf")).cast("int").alias("sentiment_intensity"),
        (F.col("n_implicit") == F.col("n")).alias("is_implicit"),
        modes["position"].alias("position"),
        modes["conviction"].alias("conviction"),
        modes["time_horizon"].alias("time_horizon"),
        lone_source.otherwise("both").alias("source"),
        F.when(F.col("n") == 1, F.col("alone.extraction_refusal")).otherwise(False).alias("extraction_refusal"),
        *([F.col("best")] if best_wins else []),
        *([F.col("longest")] if said else []),
    )
    score = {
        "confidence_weighted": F.col("conf"),
        "majority_vote": F.col("n"),
        "intensity_weighted": F.col("intensity"),
        "conviction_weighted": F.col("conviction_sum"),
    }
    if best_wins:
        order = F.struct("tier", F.col("best.best.confidence"), F.col("best.best.back"))
    else:
        order = F.struct("tier", score[rules.strategy], (-F.col("first_pos")).alias("back"))

    def in_tier(tier, column):
        return F.when(F.col("tier") == tier, column)

    told = F.col("tier") >= FAILING
    per_tier = [
        agg(in_tier(tier, column)).alias(f"{name}_{tier}")
        for tier in (EXPLICIT, IMPLICIT)
        for name, agg, column in (
            ("n", F.sum, F.col("n")),
            ("kinds", F.count, F.lit(1)),
            ("conf_min", F.min, F.col("conf_min")),
            ("conf_max", F.max, F.col("conf_max")),
            ("conviction_bits", F.bit_or, F.col("conviction_bits")),
        )
    ]
    judged = by_view.groupBy(*KEYS).agg(
        F.max_by(F.when(F.col("tier") >= IMPLICIT, merged), order).alias("winner"),
        F.sum(F.when(F.col("tier") == REFUSED, F.col("n")).otherwise(0)).alias("n_refused"),
        F.sum(F.when(F.col("tier") == FAILING, F.col("n")).otherwise(0)).alias("n_failing"),
        F.sum(F.when(told, F.col("n")).otherwise(0)).alias("n_told"),
        F.sum(F.when(told, F.col("n_implicit")).otherwise(0)).alias("n_implicit"),
        F.min(F.when(told, F.col("first_pos"))).alias("first_seen"),
        F.sum(F.col("n_explicit_told") * 1.5 + F.col("n_implicit_told")).alias("mention_weight"),
        *per_tier,
    )

    def of_winner(name):
        return F.coalesce(f"{name}_{EXPLICIT}", f"{name}_{IMPLICIT}")

    count_kinds = F.when(F.col(f"n_{EXPLICIT}").isNotNull(), F.col(f"kinds_{EXPLICIT}"))
    judged = judged.select(
        *KEYS, "winner", "n_refused", "n_failing", "n_told", "n_implicit", "first_seen",
        "mention_weight",
        F.coalesce(of_winner("n"), F.lit(0)).alias("n_candidates"),
        count_kinds.otherwise(F.col(f"kinds_{IMPLICIT}")).alias("n_kinds"),
        (of_winner("conf_max") - of_winner("conf_min")).alias("confidence_spread"),
        of_winner("conviction_bits").alias("conviction_bits"),
    )
    return judged.withColumn("winner", _final_opinion(rules, best_wins, said))


def _flag(column: str, domain) -> Column:
    out = F
    for i, value in enumerate(domain):
        out = out.when(F.col(column) == value, F.lit(1 << i))
    return out.otherwise(F.lit(1 << len(domain)))


def _final_opinion(rules: ConflictRules, best_wins: bool, said: bool) -> Column:
    w = F.col("winner")
    names = ["confidence", "sentiment_intensity", "is_implicit", "sentiment", "position",
             "conviction", "time_horizon", "source", "extraction_refusal"]
    values = {n: w[n] for n in names}
    conflict = F.col("n_kinds") > 1
    if said:
        how = F.when(conflict, rules.strategy).otherwise("same_sentiment_merge")
        note = w["longest"]["note"]
        members = w["n"].cast("string")
        values["explanation"] = (
            F.when(w["n"] == 1, note)
            .when(note.isNull(), F.concat(F.lit("Merged "), members, F.lit(" sentiments using "), how))
            .otherwise(F.concat(note, F.lit(" (merged from "), members, F.lit(" extractions using "),
                                how, F.lit(")")))
        )
    if best_wins:
        best, row = w["best"]["best"], w["best"]
        picked = {
            "confidence": best["confidence"], "sentiment_intensity": best["sentiment_intensity"],
            "is_implicit": row["is_implicit"], "position": row["position"],
            "conviction": row["conviction"], "time_horizon": row["time_horizon"],
            "source": F.lit("both"), "extraction_refusal": F.lit(False),
        }
        if said:
            picked["explanation"] = F.concat(
                F.lit("Highest confidence from "), F.col("n_candidates").cast("string"),
                F.lit(" extractions (confidence="), best["confidence"].cast("string"),
                F.lit("). Original: "), F.coalesce(best["note"], F.lit("")),
            )
        for name, value in picked.items():
            values[name] = F.when(conflict, value).otherwise(values[name])
    return F.when(w.isNotNull(), F.struct(*[v.alias(k) for k, v in values.items()]))


def resolved_opinions(judged: DataFrame) -> DataFrame:
    """The surviving opinions, one flat row per (date, submission, ticker)."""
    return judged.where("winner is not null").select(*KEYS, "first_seen", "winner.*")


def primary_tickers(judged: DataFrame, by: str = "most_frequent") -> DataFrame:
    """The main ticker per (date, submission) that has at least one surviving opinion."""
    kept = F.col("winner").isNotNull()
    back = (-F.col("first_seen")).alias("back")
    if by == "most_frequent":
        pick = F.max_by("ticker", F.when(F.col("mention_weight") > 0, F.struct("mention_weight", back)))
    else:
        pick = F.max_by("ticker", F.when(kept, F.struct("winner.confidence", back)))
    fallback = F.min_by("ticker", F.when(kept, F.col("first_seen")))
    return (
        judged.groupBy("date", "submission_id")
        .agg(F.coalesce(pick, fallback).alias("primary_ticker"), F.max(kept).alias("kept"))
        .where("kept")
        .drop("kept")
    )


def conflict_report(judged: DataFrame, rules: ConflictRules = ConflictRules()) -> DataFrame:
    """One row per ticker with several candidates, with spread and conviction levels."""
    levels = F.array_compact(
        F.array(*[
            F.when(F.col("conviction_bits").bitwiseAND(1 << i) != 0, name)
            for i, name in enumerate(CONVICTIONS)
        ])
    )
    return judged.where((F.col("n_candidates") > 1) & F.col("winner").isNotNull()).select(
        *KEYS,
        F.col("n_candidates").alias("conflict_count"),
        F.lit(rules.strategy).alias("resolution_method"),
        "confidence_spread",
        levels.alias("conviction_levels"),
        F.col("winner.sentiment").alias("final_sentiment"),
        F.col("winner.sentiment_intensity").alias("final_intensity"),
        F.col("winner.confidence").alias("final_confidence"),
        F.col("winner.conviction").alias("final_conviction"),
        F.col("winner.position").alias("final_position"),
        F.col("winner.is_implicit").alias("final_is_implicit"),
    )


def conflicting_opinions(df: DataFrame, judged: DataFrame, rules: ConflictRules = ConflictRules()):
    """The candidate rows behind each reported conflict, one row each instead of a nested list.

    The rows of one conflict are dealt over slices by position, so a hot group spreads.
    """
    groups = judged.where("n_candidates > 1 and winner is not null").select(
        *KEYS, (F.col("winner.is_implicit") & F.lit(rules.prefer_explicit)).alias("all_implicit")
    )
    rows = spread_lookup(quality_opinions(df, rules), KEYS, groups, "pos").where("all_implicit is not null")
    if rules.prefer_explicit:
        rows = rows.where(F.col("is_implicit") == F.col("all_implicit"))
    return rows.drop("all_implicit")


def resolution_metrics(judged: DataFrame) -> DataFrame:
    """Per date: how many rows came in, were refused, filtered, merged and survived."""
    kept = F.col("winner").isNotNull()
    several = F.col("n_told") > 1
    return judged.groupBy("date").agg(
        F.sum(F.col("n_told") + F.col("n_refused")).alias("original_sentiments"),
        F.sum("n_refused").alias("refusals_excluded"),
        F.sum("n_implicit").alias("implicit_found"),
        F.sum(F.when(F.col("n_told") > 0, 1).otherwise(0)).alias("tickers_found"),
        F.sum(F.when(kept, 1).otherwise(0)).alias("final_sentiments"),
        F.sum(F.when(~kept, F.col("n_told")).otherwise(0)).alias("sentiments_filtered"),
        F.sum(F.when(kept & several, 1).otherwise(0)).alias("conflicts_resolved"),
        F.sum(F.when(kept & (F.col("n_candidates") > 1), 1).otherwise(0)).alias("conflicts_reported"),
    )
