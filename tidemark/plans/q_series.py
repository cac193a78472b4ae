"""Daily series per ticker."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import finance as N
from tidemark.operators import series as W
from tidemark.plans.registry import query
from tidemark.plans.views import with_views

START, END = "1995-01-01", "2001-08-01"
DAY = "cast(date as varchar) as date"


def sentiment_of(t):
    bull, bear = F.col("n_bull"), F.col("n_bear")
    return t.opinion_days.select(
        "ticker", "date", N.net_conviction(F.col("bull_score"), bull, F.col("bear_score"), bear).alias("net_conviction"),
        (bull + bear).alias("total_mentions"))


def panel_of(t, log_transform=False):
    return W.stock_panel(sentiment_of(t), t.prices, START, END, log_transform)


def shown(df, *columns, digits=6):
    rounded = [F.round(c, digits).alias(c) for c in columns]
    return df.select("ticker", F.col("date").cast("string").alias("date"), *rounded)


_NET = """bull_score / (case when n_bull = 0 then 1 else n_bull end) - bear_score / (case when n_bear = 0 then 1 else n_bear end)"""
_TICKERS = "select ticker from opinion_days intersect select ticker from prices"
PANEL = f"""select t.ticker, d.date, coalesce(o.net, 0) as predictor, coalesce(o.m, 0) as total_mentions, p.open, p.high, p.low, p.close, p.volume,
 datediff('day', date '{START}', d.date) as idx from ({_TICKERS}) t
 cross join (select cast(unnest(generate_series(date '{START}', date '{END}', interval 1 day)) as date) as date) d
 left join (select ticker, date, {_NET} as net, n_bull + n_bear as m from opinion_days) o on o.ticker = t.ticker and o.date = d.date
 left join prices p on p.ticker = t.ticker and p.date = d.date"""
FILLED = "select ticker, date, idx, total_mentions, predictor, volume, last_value(close ignore nulls) over (partition by ticker order by date) as close from panel"
V = ("opinion_days", "prices")


@query("c19_net_conviction", with_views(f"select ticker, {DAY}, round({_NET}, 6) as net_conviction, n_bull + n_bear as total_mentions from opinion_days", "opinion_days"))
def _(t):
    return shown(sentiment_of(t), "net_conviction", "total_mentions")


@query("c20_signed_log", with_views(f"select ticker, {DAY}, round(sign(x) * ln(1 + abs(x)), 6) as score from (select ticker, date, {_NET} as x from opinion_days)", "opinion_days"))
def _(t):
    return shown(sentiment_of(t).withColumn("score", N.signed_log(F.col("net_conviction"))), "score")


@query("c21_neg_log_p", "select o_orderkey, round(-log10(greatest(pow(10, -(o_totalprice / 3000)), 1e-100)), 6) as neg_log_p from orders")
def _(t):
    p = F.pow(F.lit(10.0), -F.col("o_totalprice") / 3000)
    return t.orders.select("o_orderkey", F.round(N.neg_log10(p), 6).alias("neg_log_p"))


@query("j07_calendar_densify", with_views(f"select ticker, {DAY}, round(predictor, 6) as predictor, total_mentions from panel", *V, panel=PANEL))
def _(t):
    return shown(panel_of(t), "predictor", "total_mentions")


@query("j08_sentiment_prices", with_views(
    f"select ticker, {DAY}, round(predictor, 6) as predictor, coalesce(round(close, 4), -1) as close, coalesce(volume, -1) as volume from panel", *V, panel=PANEL))
def _(t):
    p = panel_of(t)
    return p.select("ticker", F.col("date").cast("string").alias("date"), F.round("predictor", 6).alias("predictor"),
                    F.coalesce(F.round("close", 4), F.lit(-1.0)).alias("close"), F.coalesce("volume", F.lit(-1)).alias("volume"))


@query("f10_mentioned_days", with_views(f"select ticker, {DAY} from panel where total_mentions >= 1", *V, panel=PANEL))
def _(t):
    return shown(panel_of(t).where("total_mentions >= 1"))


@query("f12_first_tradable_day", with_views(
    f"""select ticker, {DAY}, date - first as idx from (select ticker, date, min(case when close is not null and volume > 0 then date end) over (partition by ticker) as first from panel) where date >= first""",
    *V, panel=PANEL))
def _(t):
    df = W.from_first_trade(panel_of(t))
    return df.select("ticker", F.col("date").cast("string").alias("date"), F.col("idx").cast("bigint").alias("idx"))


def ema_sql(spans, source="panel"):
    """Weighted sums over all older rows, spelled out as a join on row distance."""
    import math

    parts = []
    for s in spans:
        r = (s - 1) / (s + 1)
        reach = math.ceil(41.5 / -math.log(r))
        parts.append(f"""select a.ticker, a.idx, {s} as span, sum(b.predictor * pow({r!r}, a.idx - b.idx)) / sum(pow({r!r}, a.idx - b.idx)) as e
          from {source} a join {source} b on a.ticker = b.ticker and b.idx between a.idx - {reach} and a.idx group by a.ticker, a.idx""")
    return " union all ".join(parts)


@query("w01_ema", with_views(
    f"select p.ticker, cast(p.date as varchar) as date, span, round(e, 6) as ema from panel p join e using (ticker, idx)", *V, panel=PANEL, e=ema_sql((3, 7, 20))))
def _(t):
    spans = (3, 7, 20)
    df = W.ema(panel_of(t), spans)
    rows = F.array(*[F.struct(F.lit(s).alias("span"), F.round(f"ema_{s}", 6).alias("ema")) for s in spans])
    return df.select("ticker", F.col("date").cast("string").alias("date"), F.inline(rows))


@query("w02_forward_returns", with_views(
    f"""select ticker, {DAY}, h, round((case h when 1 then c1 when 5 then c5 else c20 end - close) / close * 100, 6) as fwd from (select *, lead(close, 1) over w as c1, lead(close, 5) over w as c5,
        lead(close, 20) over w as c20 from panel window w as (partition by ticker order by date)), (select unnest([1, 5, 20]) as h)
        where case h when 1 then c1 when 5 then c5 else c20 end is not null and close is not null""", *V, panel=PANEL))
def _(t):
    hs = (1, 5, 20)
    df = W.forward_returns(panel_of(t), hs)
    rows = F.array(*[F.struct(F.lit(h).alias("h"), F.round(f"fwd_{h}", 6).alias("fwd")) for h in hs])
    return df.select("ticker", F.col("date").cast("string").alias("date"), F.inline(rows)).where("fwd is not null")


@query("w03_forward_fill", with_views(f"select ticker, {DAY}, round(close, 4) as close from filled where close is not null", *V, panel=PANEL, filled=FILLED))
def _(t):
    return shown(W.fill_forward(panel_of(t)).where("close is not null"), "close", digits=4)


_CHG = "select *, close / lag(close) over (partition by ticker order by date) - 1 as chg from filled where close is not null"


@query("w04_realised_volatility", with_views(
    f"""select ticker, {DAY}, round(first_value(v ignore nulls) over (partition by ticker order by date rows between current row and unbounded following), 6) as vol from (
        select *, case when count(chg) over w = 20 then stddev_pop(chg) over w * 100 end as v from chg window w as (partition by ticker order by date rows between 19 preceding and current row))""",
    *V, panel=PANEL, filled=FILLED, chg=_CHG))
def _(t):
    df = W.fill_forward(panel_of(t)).where("close is not null")
    return shown(W.realised_volatility(df), "vol")


@query("w05_drawdown", with_views(
    """select ticker, round(min(dd), 6) as max_drawdown from (select ticker, close / max(close) over (partition by ticker order by date) - 1 as dd from filled where close is not null) group by ticker""",
    *V, panel=PANEL, filled=FILLED))
def _(t):
    out = W.max_drawdown(W.fill_forward(panel_of(t)).where("close is not null"), "close")
    return out.withColumn("max_drawdown", F.round("max_drawdown", 6))


@query("w06_compounded_equity", with_views(
    f"select ticker, {DAY}, round(exp(sum(ln(1 + predictor / 10000)) over (partition by ticker order by date)), 6) as equity from panel", *V, panel=PANEL))
def _(t):
    return shown(W.compounded(panel_of(t), F.col("predictor") / 10000), "equity")


@query("w07_buy_and_hold", with_views(
    f"select ticker, {DAY}, round(close / first_value(close) over (partition by ticker order by date) * 1000, 6) as buy_hold from prices", "prices"))
def _(t):
    return shown(W.buy_and_hold(t.prices, 1000.0), "buy_hold")


_ACTIVE = "select *, case when idx % 3 = 0 then 5 when idx % 3 = 1 then 10 end as active_horizon from filled where close is not null"


def _active(t):
    df = W.fill_forward(panel_of(t)).where("close is not null")
    m = F.col("idx") % 3
    return df.withColumn("active_horizon", F.when(m == 0, 5).when(m == 1, 10))


@query("w08_realised_return", with_views(
    f"""select ticker, {DAY}, round((later - close) / close * 100, 6) as realised_return from (select *, case active_horizon when 5 then lead(close, 5) over w when 10 then lead(close, 10) over w end as later
        from act window w as (partition by ticker order by date)) where later is not null""", *V, panel=PANEL, filled=FILLED, act=_ACTIVE))
def _(t):
    return shown(W.realised_return(_active(t), (5, 10)).where("realised_return is not null"), "realised_return")


@query("w08_realised_return_by_slot", with_views(
    f"""select ticker, {DAY}, round((later - close) / close * 100, 6) as realised_return from (select *, case active_horizon when 5 then lead(close, 5) over w when 10 then lead(close, 10) over w end as later
        from act window w as (partition by ticker, active_horizon order by date)) where later is not null""", *V, panel=PANEL, filled=FILLED, act=_ACTIVE))
def _(t):
    return shown(W.realised_return(_active(t), (5, 10), calendar=False).where("realised_return is not null"), "realised_return")


@query("w09_age_weights", with_views(
    f"""select ticker, {DAY}, round(w / sum(w) over (partition by ticker), 9) as weight from (select *, exp(-ln(2) / 84 * (row_number() over (partition by ticker order by date desc) - 1)) * sqrt(1 + total_mentions) as w from panel)""",
    *V, panel=PANEL))
def _(t):
    return shown(W.normalised_weights(panel_of(t), 84), "weight", digits=9)


_POINTS = "select cast('T' || lpad(cast(o_custkey % 10 as varchar), 2, '0') as varchar) as ticker, cast(o_orderdate as date) + 3 as date, o_orderkey as trade_id from orders"


@query("j12_as_of", with_views(
    """select trade_id, round(p.close, 4) as close, cast(p.date as varchar) as seen from pts asof join prices p on pts.ticker = p.ticker and pts.date >= p.date""", "prices", pts=_POINTS))
def _(t):
    ticker = F.concat(F.lit("T"), F.lpad((F.col("o_custkey") % 10).cast("string"), 2, "0"))
    pts = t.orders.select(
        ticker.alias("ticker"), F.date_add(F.col("o_orderdate").cast("date"), 3).alias("date"), F.col("o_orderkey").alias("trade_id"))
    found = W.as_of(pts, t.prices.withColumn("seen", F.col("date")), ["close", "seen"])
    return found.where("seen_at_date is not null").select("trade_id", F.round("close_at_date", 4).alias("close"), F.col("seen_at_date").cast("string").alias("seen"))


@query("j14_pnl_calendar", with_views(
    f"""select p.ticker, cast(p.date as varchar) as date, round(coalesce(x.r, 0), 6) as daily_return from prices p left join (select ticker, date, sum(trade_id % 7 / 100.0) as r from pts group by 1, 2) x using (ticker, date)""",
    "prices", pts=_POINTS))
def _(t):
    ticker = F.concat(F.lit("T"), F.lpad((F.col("o_custkey") % 10).cast("string"), 2, "0"))
    trades = t.orders.select(
        ticker.alias("ticker"), F.date_add(F.col("o_orderdate").cast("date"), 3).alias("exit_date"), (F.col("o_orderkey") % 7 / 100).alias("net_return"))
    return shown(W.pnl_on_calendar(t.prices, trades), "daily_return")


@query("a31_ticker_coverage", with_views(
    """select ticker, count(*) as n_days from opinion_days where ticker in (select ticker from prices) group by ticker""", *V))
def _(t):
    return W.ticker_coverage(t.sentiments.select("ticker", "date"), t.prices)


@query("a33_information_metrics", with_views(
    """select ticker, count(*) as n, round(corr(predictor, r), 6) as ic, round(corr(predictor, r) / sqrt(greatest(1 - corr(predictor, r) * corr(predictor, r), 1e-12)), 6) as ir
       from (select *, (lead(close, 5) over (partition by ticker order by date) - close) / close * 100 as r from filled where close is not null) where r is not null group by ticker""",
    *V, panel=PANEL, filled=FILLED))
def _(t):
    df = W.fill_forward(panel_of(t)).where("close is not null").withColumn("active_horizon", F.lit(5))
    df = W.realised_return(df, (5,)).withColumn("predicted_return", F.col("predictor"))
    out = W.information_metrics(df)
    return out.select("ticker", "n", F.round("ic", 6).alias("ic"), F.round("ir", 6).alias("ir"))
