"""Regressions of forward returns on sentiment averages: scans, rolling and walk-forward fits.

Sliding fits share their work: rows are summarised once, in cells as long as the step between two
windows, and a window merges the summaries of its cells. Means and centred sums are merged, never
subtracted, so figures stay exact however far the level drifts. All of it stays inside the
partitioning by ticker.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.finance import neg_log10
from tidemark.functions.stats import normal_p_value, ols, ols_inputs, t_p_value
from tidemark.operators.series import age_weights, ema, fill_forward, forward_returns, from_first_trade
from tidemark.session import cut_lineage

# --- fixed values: guards against degenerate predictors and suspicious fits ---
MIN_X_STD, MIN_NONZERO, NONZERO = 0.005, 0.2, 1e-3
SUSPICIOUS_P, SUSPICIOUS_T = 1e-20, 30.0


def simple_ols(df: DataFrame, y: str, x: str, keys: list[str]) -> DataFrame:
    """One fit per key: slope, intercept, r², t, n and p."""
    sums = df.groupBy(*keys).agg(*ols_inputs(F.col(y), F.col(x)))
    out = sums.withColumns(ols(*[F.col(c) for c in ("n", "sxx", "sxy", "syy", "avgx", "avgy")]))
    return out.withColumn("p_value", t_p_value(F.col("t_stat"), F.col("n") - 2)).drop("sxx", "sxy", "syy", "avgx", "avgy")


def _by_span(df: DataFrame, spans, keep: list[str], fields: list[str]) -> DataFrame:
    """Columns ``<field>_<span>`` to one row per span."""
    rows = F.array(*[
        F.struct(F.lit(s).alias("span"), *[F.col(f"{f}_{s}").alias(f) for f in fields]) for s in spans
    ])
    return df.select(*keep, F.inline(rows))


_FIT = ["n", "sxx", "sxy", "syy", "avgx", "avgy"]


def signal_scan(panel: DataFrame, spans=(3, 5, 7, 10, 15, 20), horizons=(1, 2, 3, 5, 10, 15, 20),
                min_days: int = 50, p_threshold: float = 0.1, mentions_only: bool = False,
                covered: DataFrame | None = None) -> DataFrame:
    """All significant (ticker, span, horizon) fits with their direction.

    Horizons become rows, spans stay columns, so each row is aggregated once per horizon.
    ``covered`` holds the tickers with enough sentiment days.
    """
    if covered is not None:
        panel = panel.join(covered.select("ticker"), "ticker", "left_semi")
    df = forward_returns(ema(panel, spans), horizons)
    if mentions_only:
        df = df.where("total_mentions >= 1")
    emas = [f"ema_{s}" for s in spans]
    outcome = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("y")) for h in horizons])
    long = df.select("ticker", *emas, F.inline(outcome)).where("y is not null")
    sums = long.groupBy("ticker", "horizon").agg(
        *[c for s in spans for c in ols_inputs(F.col("y"), F.col(f"ema_{s}"), f"_{s}")]
    )
    fits = _by_span(sums, spans, ["ticker", "horizon"], _FIT).where(F.col("n") >= min_days)
    fits = fits.withColumns(ols(*[F.col(c) for c in _FIT]))
    fits = fits.withColumn("p_value", t_p_value(F.col("t_stat"), F.col("n") - 2)).where(F.col("p_value") < p_threshold)
    label = F.when(F.col("coefficient") > 0, "Momentum").otherwise("Contrarian")
    return fits.select("ticker", "horizon", "span", "n", "p_value", "coefficient", label.alias("signal_type"), "r_squared",
                       "intercept", "t_stat")


def best_signal(fits: DataFrame) -> DataFrame:
    """The fit with the lowest p per ticker, the first tested on ties."""
    w = Window.partitionBy("ticker").orderBy("p_value", "span", "horizon")
    return fits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


_MOMENTS = ("n", "avgx", "avgy", "sxx", "sxy", "syy", "nx", "mx", "m2x", "nonzero", "first_date", "last_date")


def _summary(inside: Column, suffix: str) -> list[Column]:
    """Counts, means and centred sums of the rows where ``inside`` holds."""
    x, y = F.when(inside, F.col("x")), F.when(inside, F.col("y"))
    both = F.when(x.isNotNull() & y.isNotNull(), F.col("date"))
    return [
        F.regr_count(y, x).alias(f"n{suffix}"), F.regr_avgx(y, x).alias(f"avgx{suffix}"), F.regr_avgy(y, x).alias(f"avgy{suffix}"),
        F.regr_sxx(y, x).alias(f"sxx{suffix}"), F.regr_sxy(y, x).alias(f"sxy{suffix}"), F.regr_syy(y, x).alias(f"syy{suffix}"),
        F.count(x).alias(f"nx{suffix}"), F.avg(x).alias(f"mx{suffix}"), (F.var_pop(x) * F.count(x)).alias(f"m2x{suffix}"),
        F.count(F.when(F.abs(x) > NONZERO, 1)).alias(f"nonzero{suffix}"),
        F.min(both).alias(f"first_date{suffix}"), F.max(both).alias(f"last_date{suffix}"),
    ]


def _single(inside: Column, suffix: str) -> list[Column]:
    """The same for one row at most."""
    x, y = F.max(F.when(inside, F.col("x"))), F.max(F.when(inside, F.col("y")))
    here, both = F.when(x.isNotNull(), 1).otherwise(0), F.when(x.isNotNull() & y.isNotNull(), 1).otherwise(0)
    day, none = F.max(F.when(inside, F.col("date"))), F.lit(0.0)
    values = {"n": both.cast("long"), "avgx": F.when(both == 1, x), "avgy": F.when(both == 1, y), "sxx": none, "sxy": none, "syy": none,
              "nx": here.cast("long"), "mx": x, "m2x": none, "nonzero": F.when(F.abs(x) > NONZERO, 1).otherwise(0).cast("long"),
              "first_date": F.when(both == 1, day), "last_date": F.when(both == 1, day)}
    return [values[c].alias(f"{c}{suffix}") for c in _MOMENTS]


# the summary of two runs a and b of rows from their summaries; means of no rows are 0 and weigh nothing
_MET = """(a, b) -> named_struct(
 'n', a.n + b.n, 'avgx', a.avgx + (b.avgx - a.avgx) * (b.n / greatest(a.n + b.n, 1)), 'avgy', a.avgy + (b.avgy - a.avgy) * (b.n / greatest(a.n + b.n, 1)),
 'sxx', a.sxx + b.sxx + (b.avgx - a.avgx) * (b.avgx - a.avgx) * (a.n * (b.n / greatest(a.n + b.n, 1))),
 'sxy', a.sxy + b.sxy + (b.avgx - a.avgx) * (b.avgy - a.avgy) * (a.n * (b.n / greatest(a.n + b.n, 1))),
 'syy', a.syy + b.syy + (b.avgy - a.avgy) * (b.avgy - a.avgy) * (a.n * (b.n / greatest(a.n + b.n, 1))),
 'nx', a.nx + b.nx, 'mx', a.mx + (b.mx - a.mx) * (b.nx / greatest(a.nx + b.nx, 1)),
 'm2x', a.m2x + b.m2x + (b.mx - a.mx) * (b.mx - a.mx) * (a.nx * (b.nx / greatest(a.nx + b.nx, 1))),
 'nonzero', a.nonzero + b.nonzero, 'first_date', least(a.first_date, b.first_date), 'last_date', greatest(a.last_date, b.last_date))"""


def window_fits(rows: DataFrame, keys: list[str], idx: str, length: int, step: int, first_end: Column,
                marked: Column | None = None) -> DataFrame:
    """Moments of x and y over ``length`` rows ending at ``first_end + k * step``, one row per (keys, k).

    Windows that begin before the first row are cut there; ``idx`` counts rows from 0 without gaps, rows that
    do not count have a NULL x. Each row enters one cell of ``step`` rows, whole and, near the cell's start,
    as the head that ends a window; a window is the cells before a head and the head. So no row is copied,
    whatever ``length`` and ``step`` are. ``first_end`` may depend on the keys. ``end_date`` is the last row's.
    ``marked`` lists the windows to whose ``marks`` a row adds one.
    """
    cells_before = (length - 1) // step
    head = length - cells_before * step
    at = F.col(idx) - first_end + (length - 1)
    own, in_head, last = F.lit(True), F.pmod(at, F.lit(step)) < head, F.pmod(at, F.lit(step)) == head - 1
    cell = F.floor(at / step).cast("long")
    if marked is None:
        rows = rows.withColumn("_cell", cell)
    else:
        placed = F.concat(F.array(F.struct(cell.alias("_cell"), F.lit(True).alias("_own"))), F.transform(
            marked, lambda k: F.struct((k + cells_before).cast("long").alias("_cell"), F.lit(False).alias("_own"))))
        rows = rows.select("*", F.inline(placed))
        own, in_head, last = F.col("_own"), F.col("_own") & in_head, F.col("_own") & last
    cells = rows.groupBy(*keys, "_cell").agg(
        *_summary(own, ""), *(_single if head == 1 else _summary)(in_head, "_head"), F.max(F.when(last, F.col("date"))).alias("end_date"),
        F.max("n_rows").alias("n_rows"), F.count(F.when(~own, 1)).alias("marks"))

    def packed(suffix):
        none = {"avgx", "avgy", "sxx", "sxy", "syy", "mx", "m2x"}
        return F.struct(*[(F.coalesce(f"{c}{suffix}", F.lit(0.0)) if c in none else F.col(f"{c}{suffix}")).alias(c) for c in _MOMENTS])

    before = Window.partitionBy(*keys).orderBy("_cell").rangeBetween(-cells_before, -1)
    told = cells.select(*keys, "_cell", "end_date", "n_rows", "marks", packed("").alias("whole"), packed("_head").alias("head"))
    if cells_before:
        told = told.withColumn("whole", F.collect_list("whole").over(before))
        told = told.withColumn("head", F.expr(f"aggregate(whole, head, {_MET})"))
    out = told.where(F.col("end_date").isNotNull() & (F.col("_cell") >= cells_before))
    m = F.col("head")
    return out.select(
        *keys, (F.col("_cell") - cells_before).alias("k"), "end_date", "n_rows", "marks", *[m[c].alias(c) for c in _FIT],
        F.when(m["nx"] > 0, F.sqrt(m["m2x"] / m["nx"])).alias("x_std"), F.try_divide(m["nonzero"], m["nx"]).alias("share_nonzero"),
        m["nx"].alias("nx"), m["first_date"].alias("train_start"), m["last_date"].alias("train_end"))


def rolling_diagnostics(panel: DataFrame, window: int = 180, span: int = 7, horizon: int = 10, step: int = 5,
                        min_rows: int = 30, mentions_only: bool = False) -> DataFrame:
    """Slope, p and r² over the last ``window + 1`` complete rows, every ``step`` rows."""
    df = forward_returns(ema(panel, [span]), [horizon])
    x, y = F.col(f"ema_{span}"), F.col(f"fwd_{horizon}")
    w = Window.partitionBy("ticker").orderBy("date")
    rows = df.where(F.col("close").isNotNull() & y.isNotNull()).select(
        "ticker", "date", "total_mentions", x.alias("x"), y.alias("y"),
        (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy("ticker")).alias("n_rows"),
    )
    counts = F.lit(True) if not mentions_only else F.col("total_mentions") >= 1
    rows = rows.withColumns({"x": F.when(counts, F.col("x")), "y": F.when(counts, F.col("y"))})
    fits = window_fits(rows, ["ticker"], "i", window + 1, step, F.lit(window)).where(
        (F.col("k") * step + window < F.col("n_rows")) & (F.col("n") >= min_rows)).withColumn("date", F.col("end_date"))
    fits = fits.withColumns(ols(*[F.col(c) for c in _FIT]))
    fits = fits.withColumn("p_value", t_p_value(F.col("t_stat"), F.col("n") - 2))
    return fits.select("ticker", "date", "n", "coefficient", "p_value", "r_squared", "t_stat",
                       neg_log10(F.col("p_value")).alias("neg_log_p"))


@dataclass(frozen=True)
class WalkForward:
    spans: tuple = (5, 10, 20, 50, 200)
    horizons: tuple = (1, 5, 10, 15, 20)
    window: int = 252
    min_training: int = 45
    embargo: int = 2
    refit: int = 21
    half_life: int = 84
    p_level: float = 0.10
    min_rows: int = 30
    mentions_only: bool = False
    model: str = "OLS"

    @property
    def first_refit(self) -> int:
        return self.min_training + self.embargo + max(self.horizons)


def features(panel: DataFrame, plan: WalkForward) -> DataFrame:
    """Trimmed, forward-filled series with averages and forward returns."""
    df = fill_forward(from_first_trade(panel))
    return forward_returns(ema(df, plan.spans), plan.horizons)


def _long(df: DataFrame, plan: WalkForward) -> DataFrame:
    """One row per (day, horizon, span) with x, y and the row where x was last seen.

    Days without mentions lose x and y if only days with mentions count.
    """
    counts = F.col("total_mentions") >= 1 if plan.mentions_only else F.lit(True)
    df = df.withColumns({f"_x{s}": F.when(counts, F.col(f"ema_{s}")) for s in plan.spans})
    df = df.withColumns({f"_seen{s}": F.lag("idx").over(Window.partitionBy("ticker", f"_x{s}").orderBy("idx")) for s in plan.spans})
    pairs = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.lit(s).alias("span"), F.when(counts, F.col(f"fwd_{h}")).alias("y"), F.col(f"_x{s}").alias("x"),
                 F.when(F.col(f"_x{s}").isNotNull(), F.col(f"_seen{s}")).alias("seen"))
        for h in plan.horizons for s in plan.spans
    ])
    return df.select("ticker", "date", "idx", "n_rows", "total_mentions", F.inline(pairs))


def _windows_of(first: Column, last: Column, plan: WalkForward) -> Column:
    """Refits whose training window holds both rows, ``first`` at or before ``last``."""
    gap = plan.embargo + F.col("horizon") - plan.first_refit
    lo = F.greatest(F.ceil((last + gap) / plan.refit), F.lit(0))
    hi = F.least(F.floor((first + gap + plan.window) / plan.refit),
                 F.floor((F.col("n_rows") - 1 - F.col("horizon") - plan.first_refit) / plan.refit))
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def _last_training_row(plan: WalkForward) -> Column:
    return F.col("k") * plan.refit + plan.first_refit - plan.embargo - F.col("horizon")


def _train_length(plan: WalkForward) -> Column:
    """Rows of the training window before any filter; windows are cut at the first row."""
    return F.least(_last_training_row(plan), F.lit(plan.window)) + 1


def candidate_fits(df: DataFrame, plan: WalkForward) -> DataFrame:
    """Every trainable fit per (ticker, refit, span, horizon)."""
    if plan.model == "WLS":
        fits = weighted_fits(df, plan)
    else:
        # a value that the window has met before marks the windows that hold both; such rows alone are copied
        again = F.when(F.col("seen").isNotNull(), _windows_of(F.col("seen"), F.col("idx"), plan)).otherwise(F.array().cast("array<bigint>"))
        fits = window_fits(_long(df, plan), ["ticker", "horizon", "span"], "idx", plan.window + 1, plan.refit,
                           plan.first_refit - plan.embargo - F.col("horizon"), again)
        fits = fits.where((F.col("k") >= 0) & (F.col("k") * plan.refit + plan.first_refit + F.col("horizon") < F.col("n_rows")))
        fits = fits.withColumn("n_unique", (F.col("nx") - F.col("marks")).cast("int"))
        fits = fits.withColumns(ols(*[F.col(c) for c in _FIT])).drop(
            "sxx", "sxy", "syy", "avgx", "avgy", "nx", "marks", "end_date", "n_rows")
    sound = (
        (_train_length(plan) >= plan.min_training) & (F.col("n") >= plan.min_rows)
        & (F.col("x_std") >= MIN_X_STD) & (F.col("share_nonzero") >= MIN_NONZERO)
        & F.col("coefficient").isNotNull()
    )
    fits = fits.where(sound)
    if plan.model != "WLS":
        fits = fits.withColumn("p_value", t_p_value(F.col("t_stat"), F.col("n") - 2))
    return fits.withColumn("neg_log_p", neg_log10(F.col("p_value")))


def pick_winners(candidates: DataFrame, plan: WalkForward) -> DataFrame:
    """Per refit the significant fit with the largest r²; at most spans x horizons rows compete."""
    rank = Window.partitionBy("ticker", "k").orderBy(F.col("r_squared").desc(), *[
        F.array_position(F.array(*[F.lit(v) for v in domain]), F.col(c))
        for c, domain in (("horizon", plan.horizons), ("span", plan.spans))
    ])
    won = candidates.where(F.col("p_value") < plan.p_level).withColumn("_r", F.row_number().over(rank)).where("_r = 1")
    order = Window.partitionBy("ticker").orderBy("k")
    return won.drop("_r").withColumn("model_id", F.row_number().over(order) - 1)


def stamp_models(df: DataFrame, winners: DataFrame, plan: WalkForward) -> DataFrame:
    """Rows carry the model of their refit slot; the slot number is an equality key, no range join."""
    slot = F.floor((F.col("idx") - plan.first_refit) / plan.refit)
    active = winners.select("ticker", "k", "model_id", F.col("span").alias("active_span"), F.col("horizon").alias("active_horizon"),
                            "coefficient", "intercept", "p_value", "r_squared")
    out = df.withColumn("k", slot).join(active, ["ticker", "k"], "left")
    x = F
    for s in plan.spans:
        x = x.when(F.col("active_span") == s, F.col(f"ema_{s}"))
    predicted = F.col("intercept") + F.col("coefficient") * x.otherwise(F.lit(None))
    return out.withColumn("predicted_return", predicted).drop("coefficient", "intercept", "k")


def walk_forward(panel: DataFrame, plan: WalkForward = WalkForward()) -> tuple[DataFrame, DataFrame]:
    """The series with active model and prediction, and the chosen models with their start dates."""
    # tickers x days rows, read three times below: written once, so raw input is not read again
    df = cut_lineage(features(panel, plan))
    winners = pick_winners(candidate_fits(df, plan), plan)
    starts = df.select("ticker", F.col("date").alias("prediction_start"),
                       F.floor((F.col("idx") - plan.first_refit) / plan.refit).alias("k"),
                       ((F.col("idx") - plan.first_refit) % plan.refit).alias("m")).where("m = 0").drop("m")
    return stamp_models(df, winners, plan), winners.join(starts, ["ticker", "k"])


_FIT_KEYS = ["ticker", "horizon", "span", "k"]


def _weighted_rows(df: DataFrame, plan: WalkForward) -> DataFrame:
    """Each row once per (horizon, span, refit k) whose window holds it, with its weight and the fit's weighted means.

    A weight counts the complete rows after it in the window, so here rows are copied to their windows and
    dealt by fit: a ticker of any size spreads over as many tasks as it has fits.
    """
    fanned = _long(df, plan).withColumn("k", F.explode(_windows_of(F.col("idx"), F.col("idx"), plan)))
    rows = fanned.where("x is not null").repartition(*_FIT_KEYS).withColumn("ok", F.col("y").isNotNull())
    youngest = Window.partitionBy(*_FIT_KEYS, "ok").orderBy(F.col("idx").desc())
    rows = rows.withColumn("age", F.row_number().over(youngest) - 1)
    rows = rows.withColumn("w", F.when(F.col("ok"), age_weights(F.col("age"), plan.half_life, F.col("total_mentions"))))
    fit = Window.partitionBy(*_FIT_KEYS)
    rows = rows.withColumn("w", F.col("w") / F.sum("w").over(fit))
    rows = rows.withColumns({"mx": F.sum(F.col("w") * F.col("x")).over(fit), "my": F.sum(F.col("w") * F.col("y")).over(fit)})
    return rows.withColumns({"dx": F.col("x") - F.col("mx"), "dy": F.col("y") - F.col("my")})


def weighted_coefficients(df: DataFrame, plan: WalkForward) -> DataFrame:
    """Age- and mention-weighted slope and intercept per fit."""
    w, dx, dy = (F.col(c) for c in ("w", "dx", "dy"))
    sums = _weighted_rows(df, plan).groupBy(*_FIT_KEYS).agg(
        F.count("w").alias("n"), F.first("mx").alias("mx"), F.first("my").alias("my"), F.sum(w * dx * dx).alias("sxx"), F.sum(w * dx * dy).alias("sxy"))
    slope = F.try_divide("sxy", "sxx")
    return sums.where(F.col("n") >= plan.min_rows).select(
        *_FIT_KEYS, "n", slope.alias("coefficient"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def weighted_fits(df: DataFrame, plan: WalkForward) -> DataFrame:
    """Weighted fits with errors robust to autocorrelation up to the horizon, in two phases over the same rows.

    First the slope from weighted sums, then the scores w * e * (x - mean): with x centred the slope's variance
    is their Bartlett-weighted covariance over the squared sum of w * x². A Bartlett kernel of L lags is a
    boxcar of L + 1 with itself, so the covariance is the sum of squared moving sums, those that run over
    either end included, over L + 1. No term is subtracted.
    """
    w, dx, dy = (F.col(c) for c in ("w", "dx", "dy"))
    fit = Window.partitionBy(*_FIT_KEYS)
    rows = _weighted_rows(df, plan).withColumn("b", F.try_divide(F.sum(w * dx * dy).over(fit), F.sum(w * dx * dx).over(fit)))
    rows = rows.withColumn("e", dy - F.col("b") * dx).withColumn("score", w * F.col("e") * dx)
    by_age = Window.partitionBy(*_FIT_KEYS, "ok").orderBy("idx")
    past = ahead = F
    for h in plan.horizons:
        past = past.when(F.col("horizon") == h, F.sum("score").over(by_age.rowsBetween(-h, 0)))
        ahead = ahead.when(F.col("horizon") == h, F.sum("score").over(by_age.rowsBetween(0, h)))
    rows = rows.withColumns({"past": past, "ahead": F.when(F.col("age") < F.col("horizon"), ahead)})
    ok = F.col("ok")
    sums = rows.groupBy(*_FIT_KEYS).agg(
        F.count("w").alias("n"), F.stddev_pop("x").alias("x_std"), F.avg(F.when(F.abs("x") > NONZERO, 1.0).otherwise(0.0)).alias("share_nonzero"),
        F.size(F.collect_set("x")).alias("n_unique"), F.min(F.when(ok, F.col("date"))).alias("train_start"), F.max(F.when(ok, F.col("date"))).alias("train_end"),
        F.first("b").alias("coefficient"), F.first("mx").alias("mx"), F.first("my").alias("my"), F.sum(w * dx * dx).alias("sxx"),
        F.sum(w * dy * dy).alias("syy"), F.sum(w * F.col("e") * F.col("e")).alias("sse"),
        ((F.sum(F.when(ok, F.col("past") * F.col("past"))) + F.coalesce(F.sum(F.when(ok, F.col("ahead") * F.col("ahead"))), F.lit(0.0)))
         / (F.first("horizon") + 1)).alias("meat"))
    n, r2 = F.col("n"), 1 - F.try_divide("sse", "syy")
    t = F.try_divide(F.col("coefficient") * F.col("sxx"), F.sqrt("meat"))
    return sums.where(n >= max(plan.min_rows, 3)).select(
        *_FIT_KEYS, "n", "x_std", "share_nonzero", "n_unique", "train_start", "train_end", "coefficient",
        (F.col("my") - F.col("coefficient") * F.col("mx")).alias("intercept"), r2.alias("r_squared"),
        (1 - (1 - r2) * (n - 1) / (n - 2)).alias("rsquared_adj"), t.alias("t_stat"), normal_p_value(t).alias("p_value"))


def suspicious_fits(models: DataFrame, p: float = SUSPICIOUS_P, t: float = SUSPICIOUS_T) -> DataFrame:
    found = models.where((F.col("p_value") < p) | (F.abs("t_stat") > t))
    return found.withColumn("obs_span", F.datediff("train_end", "train_start"))


def parameter_grid(models: DataFrame, param: str, index: str = "span") -> DataFrame:
    """First value per (ticker, index level, start date), the long form of a heat map."""
    return models.groupBy("ticker", index, "prediction_start").agg(F.min_by(param, "model_id").alias(param))


def parameter_pivot(models: DataFrame, param: str, index: str, starts: list) -> DataFrame:
    """The same as a pivot over the given start dates."""
    return models.groupBy("ticker", index).pivot("prediction_start", starts).agg(F.min_by(param, "model_id"))
