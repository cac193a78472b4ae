"""Regressions, model selection and trade replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import finance as N, stats as ST
from tidemark.operators import regression as R, replay as Y, series as W
from tidemark.plans.q_opinions import CTE, light_consensus
from tidemark.plans.q_series import END, PANEL, START, V, ema_sql, panel_of
from tidemark.plans.registry import query
from tidemark.plans.views import with_views

# two-sided t p-value for whole degrees of freedom, as a finite sum
_T_P = """1 - (case when {v} % 2 = 0 then sin(th) * list_sum(list_transform(range(0, ({v} // 2)::bigint), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(cos(th), 2 * k)))
 else 2 / pi() * (th + sin(th) * coalesce(list_sum(list_transform(range(0, (({v} - 1) // 2)::bigint), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * pow(cos(th), 2 * k + 1))), 0)) end)"""


def with_p(source):
    """Adds p_value from t_stat and n."""
    return f"select * exclude (th), {_T_P.format(v='(n - 2)')} as p_value from (select *, atan(abs(t_stat) / sqrt(n - 2)) as th from {source} where n > 2 and t_stat is not null)"


_OLS = """regr_count({y}, {x})::bigint as n, regr_slope({y}, {x}) as coefficient, regr_intercept({y}, {x}) as intercept, regr_r2({y}, {x}) as r_squared,
 regr_slope({y}, {x}) * sqrt((regr_count({y}, {x})::bigint - 2) * regr_sxx({y}, {x}) / nullif(regr_syy({y}, {x}) - regr_slope({y}, {x}) * regr_sxy({y}, {x}), 0)) as t_stat"""
OLS = _OLS.format(y="y", x="x")


def fit_columns(df, *keep, extra=()):
    return df.select(*keep, "n", *[F.round(c, 6).alias(c) for c in ("coefficient", "intercept", "r_squared", "t_stat", "p_value", *extra)])


_FIT_SQL = "n, round(coefficient, 6) as coefficient, round(intercept, 6) as intercept, round(r_squared, 6) as r_squared, round(t_stat, 6) as t_stat, round(p_value, 6) as p_value"


@query("r01_simple_ols", with_views(f"select l_suppkey, {_FIT_SQL} from p",
                                    f=f"select l_suppkey, {_OLS.format(y='l_extendedprice', x='l_quantity')} from lineitem group by l_suppkey having count(*) > 4", p=with_p("f")))
def _(t):
    fits = R.simple_ols(t.lineitem, "l_extendedprice", "l_quantity", ["l_suppkey"]).where("n > 4 and t_stat is not null")
    return fit_columns(fits, "l_suppkey")


@query("u05_p_values", with_views(
    "select l_orderkey, l_linenumber, l_partkey, n, round(p_value, 9) as p_value from p",
    f="select distinct l_orderkey, l_linenumber, l_partkey, 3 + l_suppkey % 60 as n, l_discount * 40 as t_stat from lineitem ", p=with_p("f")))
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (3 + F.col("l_suppkey") % 60).alias("n"), (F.col("l_discount") * 40).alias("t")).distinct()
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "n", F.round(ST.t_p_value(F.col("t"), F.col("n") - 2), 9).alias("p_value"))


# ------------------------------------------------------------------- scans

SPANS, HORIZONS = (3, 7, 15), (1, 5, 10)
_FWD = " union all ".join(
    f"select ticker, idx, date, total_mentions, {h} as horizon, (lead(close, {h}) over (partition by ticker order by date) - close) / close * 100 as y from {{src}}" for h in HORIZONS)
_EMA = ema_sql(SPANS)
_XY = "select f.ticker, f.idx, f.date, f.total_mentions, f.horizon, e.span, f.y, e.e as x from f join e using (ticker, idx)"


def scan_views(**extra):
    return dict(panel=PANEL, e=_EMA, f=_FWD.format(src="panel"), xy=_XY + " where f.y is not null", **extra)


_SCAN = dict(g=f"select ticker, horizon, span, {OLS} from xy group by ticker, horizon, span having count(*) >= 50")


@query("r02_signal_scan", with_views(
    f"select ticker, horizon, span, case when coefficient > 0 then 'Momentum' else 'Contrarian' end as signal_type, {_FIT_SQL} from p where p_value < 0.5",
    *V, **scan_views(**_SCAN, p=with_p("g"))))
def _(t):
    fits = R.signal_scan(panel_of(t), SPANS, HORIZONS, p_threshold=0.5)
    return fit_columns(fits, "ticker", "horizon", "span", "signal_type")


@query("w10_best_signal", with_views(
    f"select ticker, horizon, span, {_FIT_SQL} from (select *, row_number() over (partition by ticker order by p_value, span, horizon) as rn from p where p_value < 0.5) where rn = 1",
    *V, **scan_views(**_SCAN, p=with_p("g"))))
def _(t):
    return fit_columns(R.best_signal(R.signal_scan(panel_of(t), SPANS, HORIZONS, p_threshold=0.5)), "ticker", "horizon", "span")


@query("r03_rolling_diagnostics", with_views(
    f"select ticker, cast(date as varchar) as date, {_FIT_SQL.replace('round(intercept, 6) as intercept, ', '')} from p", *V,
    panel=PANEL, e=ema_sql((7,)), f=_FWD.format(src="panel"),
    rows=f"""select ticker, date, x, y, row_number() over (partition by ticker order by date) - 1 as i from ({_XY}) where horizon = 10 and y is not null""",
    g=f"""select a.ticker, a.date, {_OLS.format(y='b.y', x='b.x')} from rows a join rows b on a.ticker = b.ticker and b.i between a.i - 180 and a.i
          where a.i >= 180 and (a.i - 180) % 5 = 0 group by a.ticker, a.date""", p=with_p("g")))
def _(t):
    fits = R.rolling_diagnostics(panel_of(t), window=180, span=7, horizon=10, step=5)
    return fits.select("ticker", F.col("date").cast("string").alias("date"), "n", *[F.round(c, 6).alias(c) for c in ("coefficient", "r_squared", "t_stat", "p_value")])


# ------------------------------------------------------------ walk-forward

PLAN = R.WalkForward(spans=(5, 10, 20), horizons=(1, 5, 10), p_level=0.5)
_F0 = PLAN.first_refit
_TRIM = "select * exclude (idx), cast(date - first as bigint) as idx, count(*) over (partition by ticker) as n_rows from (select *, min(case when close is not null and volume > 0 then date end) over (partition by ticker) as first from panel) where date >= first"
_FILL = "select * exclude (close), last_value(close ignore nulls) over (partition by ticker order by date) as close from trim0"
_REFIT = f"""select f.*, h.horizon from (select ticker, idx as i, date as prediction_start, n_rows, (idx - {_F0}) // {PLAN.refit} as k from filled where idx >= {_F0} and (idx - {_F0}) % {PLAN.refit} = 0) f,
 (select unnest([{', '.join(map(str, PLAN.horizons))}]) as horizon) h where f.i + h.horizon < f.n_rows"""
_CAND = f"""select r.ticker, r.k, r.horizon, xy.span, any_value(r.prediction_start) as prediction_start, {OLS}, stddev_pop(x) as x_std, avg((abs(x) > 1e-3)::int) as share_nonzero, count(distinct x) as n_unique,
 min(case when y is not null then date end) as train_start, max(case when y is not null then date end) as train_end, count(*) as len
 from refit r join xy on xy.ticker = r.ticker and xy.horizon = r.horizon and xy.idx between r.i - {PLAN.embargo} - r.horizon - {PLAN.window} and r.i - {PLAN.embargo} - r.horizon group by r.ticker, r.k, r.horizon, xy.span
 having count(*) >= {PLAN.min_training} and regr_count(y, x) >= {PLAN.min_rows} and stddev_pop(x) >= 0.005 and avg((abs(x) > 1e-3)::int) >= 0.2"""


def walk_views(**extra):
    return dict(panel=PANEL, trim0=_TRIM, filled=_FILL, e=ema_sql(PLAN.spans, "trim0"), f=_FWD.format(src="filled"), xy=_XY, refit=_REFIT,
                cand0=_CAND, cand=with_p("cand0"), **extra)


_WIN = dict(win=f"""select *, row_number() over (partition by ticker order by k) - 1 as model_id from (select *, row_number() over (partition by ticker, k order by r_squared desc, horizon, span) as rn
 from cand where p_value < {PLAN.p_level}) where rn = 1""")


@query("r05_walk_forward", with_views(
    f"""select ticker, k, horizon, span, {_FIT_SQL}, round(x_std, 6) as x_std, round(share_nonzero, 6) as share_nonzero, n_unique::int as n_unique, cast(train_start as varchar) as train_start,
        cast(train_end as varchar) as train_end from cand""", *V, **walk_views()))
def _(t):
    cand = R.candidate_fits(R.features(panel_of(t), PLAN), PLAN)
    return fit_columns(cand.withColumns({c: F.col(c).cast("string") for c in ("train_start", "train_end")}), "ticker", "k", "horizon", "span", "n_unique",
                       "train_start", "train_end", extra=("x_std", "share_nonzero"))


# the whole chain: opinions, conflicts, consensus, panel, then scan and walk-forward fits
_CHAIN = dict(**CTE, opinion_days="select ticker, date, bull_score, bear_score, bull as n_bull, bear as n_bear from cons")


def panel_of_opinions(t):
    return W.stock_panel(W.sentiment_features(light_consensus(t)), t.prices, START, END)


@query("r02_scan_of_opinions", with_views(
    f"select ticker, horizon, span, case when coefficient > 0 then 'Momentum' else 'Contrarian' end as signal_type, {_FIT_SQL} from p where p_value < 0.5",
    "sentiments", "prices", **_CHAIN, **scan_views(**_SCAN, p=with_p("g"))))
def _(t):
    fits = R.signal_scan(panel_of_opinions(t), SPANS, HORIZONS, p_threshold=0.5)
    return fit_columns(fits, "ticker", "horizon", "span", "signal_type")


@query("r06_winners_of_opinions", with_views(
    "select ticker, k, model_id, horizon, span, round(r_squared, 6) as r_squared from win", "sentiments", "prices", **_CHAIN, **walk_views(**_WIN)))
def _(t):
    won = R.pick_winners(R.candidate_fits(R.features(panel_of_opinions(t), PLAN), PLAN), PLAN)
    return won.select("ticker", "k", F.col("model_id").cast("bigint").alias("model_id"), "horizon", "span", F.round("r_squared", 6).alias("r_squared"))


@query("r06_winning_models", with_views(f"select ticker, k, model_id, horizon, span, round(r_squared, 6) as r_squared from win", *V, **walk_views(**_WIN)))
def _(t):
    won = R.pick_winners(R.candidate_fits(R.features(panel_of(t), PLAN), PLAN), PLAN)
    return won.select("ticker", "k", F.col("model_id").cast("bigint").alias("model_id"), "horizon", "span", F.round("r_squared", 6).alias("r_squared"))


_STAMP = f"""select a.ticker, a.date, a.idx, a.close, a.volume, a.total_mentions, w.model_id, w.span as active_span, w.horizon as active_horizon, w.p_value, w.r_squared, w.intercept + w.coefficient * e.e as predicted_return
 from filled a join win w on w.ticker = a.ticker and a.idx - {_F0} between w.k * {PLAN.refit} and w.k * {PLAN.refit} + {PLAN.refit} - 1 join e on e.ticker = a.ticker and e.idx = a.idx and e.span = w.span"""


@query("j13_interval_stamp", with_views("select ticker, cast(date as varchar) as date, model_id, active_span, active_horizon from stamp", *V, **walk_views(**_WIN, stamp=_STAMP)))
def _(t):
    df, _m = R.walk_forward(panel_of(t), PLAN)
    return df.where("model_id is not null").select("ticker", F.col("date").cast("string").alias("date"), F.col("model_id").cast("bigint").alias("model_id"), "active_span", "active_horizon")


@query("r07_predicted_return", with_views("select ticker, cast(date as varchar) as date, round(predicted_return, 6) as predicted_return from stamp", *V, **walk_views(**_WIN, stamp=_STAMP)))
def _(t):
    df, _m = R.walk_forward(panel_of(t), PLAN)
    return df.where("model_id is not null").select("ticker", F.col("date").cast("string").alias("date"), F.round("predicted_return", 6).alias("predicted_return"))


@query("j09_model_lookup", with_views(
    """select a.ticker, cast(a.date as varchar) as date, coalesce(s.model_id, -1) as model_id, coalesce(s.p_value < 0.1, false) as is_significant, round(coalesce(s.r_squared, 0), 6) as r_squared
       from filled a left join stamp s on s.ticker = a.ticker and s.date = a.date""", *V, **walk_views(**_WIN, stamp=_STAMP)))
def _(t):
    df, _m = R.walk_forward(panel_of(t), PLAN)
    return df.select("ticker", F.col("date").cast("string").alias("date"), F.coalesce("model_id", F.lit(-1)).cast("bigint").alias("model_id"),
                     F.coalesce(F.col("p_value") < 0.1, F.lit(False)).alias("is_significant"), F.round(F.coalesce("r_squared", F.lit(0.0)), 6).alias("r_squared"))


@query("f11_suspicious_fits", with_views(
    "select ticker, k, cast(prediction_start as varchar) as prediction_start, model_id, round(t_stat, 6) as t_stat, datediff('day', train_start, train_end) as obs_span from win where p_value < 1e-3 or abs(t_stat) > 3",
    *V, **walk_views(**_WIN)))
def _(t):
    _df, models = R.walk_forward(panel_of(t), PLAN)
    found = R.suspicious_fits(models, p=1e-3, t=3.0)
    return found.select("ticker", "k", F.col("prediction_start").cast("string").alias("prediction_start"), F.col("model_id").cast("bigint").alias("model_id"), F.round("t_stat", 6).alias("t_stat"),
                        F.col("obs_span").cast("bigint").alias("obs_span"))


@query("a35_parameter_grid", with_views(
    "select ticker, span, cast(prediction_start as varchar) as prediction_start, round(coefficient, 6) as coefficient from win", *V, **walk_views(**_WIN)))
def _(t):
    _df, models = R.walk_forward(panel_of(t), PLAN)
    grid = R.parameter_grid(models, "coefficient", "span")
    return grid.select("ticker", "span", F.col("prediction_start").cast("string").alias("prediction_start"), F.round("coefficient", 6).alias("coefficient"))


_WEIGHTED = """select r.ticker, r.k, r.horizon, xy.span, xy.x, xy.y, xy.idx as w_at, exp(-ln(2) / 84 * (row_number() over (partition by r.ticker, r.k, r.horizon, xy.span order by xy.idx desc) - 1)) * sqrt(1 + xy.total_mentions) as w
 from refit r join xy on xy.ticker = r.ticker and xy.horizon = r.horizon and xy.y is not null and xy.idx between r.i - {e} - r.horizon - {w} and r.i - {e} - r.horizon""".format(e=PLAN.embargo, w=PLAN.window)


@query("r04_weighted_coefficients", with_views(
    """select ticker, k, horizon, span, n, round(b, 6) as coefficient, round(my - b * mx, 6) as intercept from (select *, (sxy - mx * my) / (sxx - mx * mx) as b from (
        select ticker, k, horizon, span, count(*) as n, sum(w * x) / sum(w) as mx, sum(w * y) / sum(w) as my, sum(w * x * x) / sum(w) as sxx, sum(w * x * y) / sum(w) as sxy from wr group by 1, 2, 3, 4 having count(*) >= 30))""",
    *V, **{k: v for k, v in walk_views().items() if k not in ("cand0", "cand")}, wr=_WEIGHTED))
def _(t):
    fits = R.weighted_coefficients(R.features(panel_of(t), PLAN), PLAN)
    return fits.select("ticker", "k", "horizon", "span", "n", F.round("coefficient", 6).alias("coefficient"), F.round("intercept", 6).alias("intercept"))


# scores of a weighted fit times those up to the horizon apart, pair by pair; the normal p-value as a series of positive terms
_ROBUST = dict(
    wb="""select ticker, k, horizon, span, count(*) as n, sum(w) as sw, sum(w * x) / sum(w) as mx, sum(w * y) / sum(w) as my from wr group by 1, 2, 3, 4 having count(*) >= 30""",
    wc="""select wr.ticker, wr.k, wr.horizon, wr.span, any_value(n) as n, any_value(mx) as mx, any_value(my) as my, sum(w * (x - mx) * (x - mx)) as sxx, sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) as b
     from wr join wb using (ticker, k, horizon, span) group by 1, 2, 3, 4""",
    ws="""select wr.ticker, wr.k, wr.horizon, wr.span, w * (y - my - b * (x - mx)) * (x - mx) as s, w * (y - my - b * (x - mx)) * (y - my - b * (x - mx)) as ee, w * (y - my) * (y - my) as yy,
     row_number() over (partition by wr.ticker, wr.k, wr.horizon, wr.span order by w_at) as p from wr join wc using (ticker, k, horizon, span)""",
    wm="""select a.ticker, a.k, a.horizon, a.span, sum(a.s * b.s * (1 - abs(a.p - b.p) / (a.horizon + 1))) as meat from ws a join ws b using (ticker, k, horizon, span)
     where b.p between a.p - a.horizon and a.p + a.horizon group by 1, 2, 3, 4""",
    wt="""select c.*, c.b * c.sxx / sqrt(m.meat) as t_stat, 1 - v.see / v.syy as r_squared from wc c join wm m using (ticker, k, horizon, span)
     join (select ticker, k, horizon, span, sum(ee) as see, sum(yy) as syy from ws group by 1, 2, 3, 4) v using (ticker, k, horizon, span)""")
_ERF = "exp(-z * z) * list_sum(list_transform(range(0, 200), lambda i: exp((2 * i + 1) * ln(z) - lgamma(i + 1.5))))"


@query("r04_robust_fits", with_views(
    f"""select ticker, k, horizon, span, n, round(b, 6) as coefficient, round(my - b * mx, 6) as intercept, round(r_squared, 6) as r_squared, round(t_stat, 6) as t_stat,
     round(case when z > 6 then 0 else greatest(1 - {_ERF}, 0) end, 6) as p_value from (select *, abs(t_stat) / sqrt(2) as z from wt)
     join (select ticker, k, horizon, span from cand0) using (ticker, k, horizon, span)""",
    *V, **{k: v for k, v in walk_views().items() if k != "cand"}, wr=_WEIGHTED, **_ROBUST))
def _(t):
    plan = R.WalkForward(spans=PLAN.spans, horizons=PLAN.horizons, p_level=0.5, model="WLS")
    cand = R.candidate_fits(R.features(panel_of(t), plan), plan)
    return cand.select("ticker", "k", "horizon", "span", "n", *[F.round(c, 6).alias(c) for c in ("coefficient", "intercept", "r_squared", "t_stat", "p_value")])


# ------------------------------------------------------------------ replay

@query("r08_position_sizes", """select o_orderkey, round(cap * case when r2 <= 0 then 0.1 else least(greatest(0.5 * (1 + r2 * 2), 0.1), 0.8) end, 6) as scaled,
 round(0.5 * least(greatest(r2 * 2, 0.1), 0.8), 6) as rsquared, round(least(greatest(abs(pred) / (sigma * sigma), 0.1), 0.8), 6) as kelly from (
 select o_orderkey, o_totalprice as cap, (o_custkey % 100 - 20) / 100 as r2, (o_orderkey % 21 - 10) / 2 as pred, 1 + (o_custkey % 9) / 3 as sigma from orders)""")
def _(t):
    cap, r2 = F.col("o_totalprice"), (F.col("o_custkey") % 100 - 20) / 100
    pred, sigma = (F.col("o_orderkey") % 21 - 10) / 2, 1 + (F.col("o_custkey") % 9) / 3
    return t.orders.select(
        "o_orderkey", F.round(N.r2_scaled_size(cap, 0.5, r2), 6).alias("scaled"),
        F.round(N.position_share("rsquared", pred, sigma, r2), 6).alias("rsquared"), F.round(N.position_share("kelly", pred, sigma, r2), 6).alias("kelly"))


@query("r10_signal_gates", """select o_orderkey, case when sig and sigma is not null and sigma <> 0 and pred > 2 then 'long' when sig and sigma is not null and sigma <> 0 and pred < -2 then 'short' else 'none' end as side
 from (select o_orderkey, o_orderstatus <> 'P' as sig, (o_orderkey % 21 - 10) / 2 as pred, case when o_custkey % 11 = 0 then null else o_custkey % 9 end as sigma from orders)""")
def _(t):
    pred = (F.col("o_orderkey") % 21 - 10) / 2
    sigma = F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey") % 9)
    return t.orders.select("o_orderkey", F.coalesce(N.entry_side(pred, sigma, F.col("o_orderstatus") != "P"), F.lit("none")).alias("side"))


RULES = [Y.ReplayRules("raw", p_level=0.5), Y.ReplayRules("kelly", sizing="kelly", p_level=0.5)]


def replayed(t):
    df, _m = R.walk_forward(panel_of(t), PLAN)
    return Y.replay(Y.gated(df, RULES), RULES)


@query("r09_trade_replay")
def _(t):
    tr = Y.trades_of(replayed(t))
    return tr.select("ticker", "param_id", "position_type", F.col("entry_date").cast("string").alias("entry_date"), F.col("exit_date").cast("string").alias("exit_date"),
                     "days_held", F.round("pnl", 6).alias("pnl"), F.round("net_return", 6).alias("net_return"), "model_id")


# performance figures over a plain equity curve, so that SQL can follow them
_EQ = "select ticker, date, 10000 + sum(x) over (partition by ticker order by date) as equity, close / first_value(close) over (partition by ticker order by date) * (10000 + first_value(x) over (partition by ticker order by date)) as bench from (select ticker, date, close, (volume // 100) % 7 - 2 as x from prices)"


@query("a34_performance", with_views(
    """select ticker, t.n as total_trades, round(t.win, 6) as win_rate_pct, round((fin / st - 1) * 100, 6) as total_return_pct, round((bn / st - 1) * 100, 6) as buy_hold_return_pct,
        round((fin - bn) / st * 100, 6) as excess_return_pct, round(dd * 100, 6) as max_drawdown_pct, round((pow(1 + mr, 252) - 1) / (sr * sqrt(252)), 6) as sharpe_ratio from (
        select ticker, arg_min(equity, date) as st, arg_max(equity, date) as fin, arg_max(bench, date) as bn, min(dd) as dd, avg(ret) as mr, stddev_pop(ret) as sr from (
          select *, equity / max(equity) over (partition by ticker order by date) - 1 as dd, equity / lag(equity) over (partition by ticker order by date) - 1 as ret from eq) group by ticker)
        join (select ticker, count(*) as n, avg(case when (volume // 100) % 7 - 2 > 0 then 1.0 else 0.0 end) * 100 as win from prices group by ticker) t using (ticker)""", "prices", eq=_EQ))
def _(t):
    x = F.floor(F.col("volume") / 100) % 7 - 2
    rows = W.Window.partitionBy("ticker").orderBy("date").rowsBetween(W.Window.unboundedPreceding, 0)
    base = t.prices.withColumns({"param_id": F.lit("p"), "x": x, "kind": F.lit("equity")})
    eq = Y.benchmark(base.select("ticker", "param_id", "date", "close", (10_000 + F.sum("x").over(rows)).cast("double").alias("equity")))
    out = Y.performance(eq, base.withColumn("pnl", F.col("x")))
    return out.select("ticker", "total_trades", *[F.round(c, 6).alias(c) for c in (
        "win_rate_pct", "total_return_pct", "buy_hold_return_pct", "excess_return_pct", "max_drawdown_pct", "sharpe_ratio")])


@query("a34_replay_performance")
def _(t):
    done = replayed(t)
    out = Y.performance(Y.equity_of(done), Y.trades_of(done))
    return out.select("ticker", "param_id", "total_trades", *[F.round(c, 6).alias(c) for c in (
        "win_rate_pct", "total_return_pct", "buy_hold_return_pct", "excess_return_pct", "max_drawdown_pct", "sharpe_ratio")])
