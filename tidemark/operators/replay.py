"""Trade replay per (ticker, parameter set) and the performance figures over it.

Gates, sizes, exits and figures are columns; only the cash that carries over from one entry to the next
is a fold over a key's signals. Keys are tickers x parameter sets, each bounded by the calendar.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.finance import entry_side, position_share
from tidemark.operators.series import from_first_trade, realised_volatility
from tidemark.session import cut_lineage

KEYS = ["ticker", "param_id"]
STOP_LOSS, TAKE_PROFIT = 0.85, 1.45  # fixed values: exits at -15 % and +45 %


@dataclass(frozen=True)
class ReplayRules:
    param_id: str = "default"
    capital: float = 10_000.0
    commission: float = 0.005
    slippage_bps: float = 2.0
    borrow_bps: float = 1.0
    threshold: float = 2.0
    share: float = 0.5
    min_share: float = 0.1
    max_share: float = 0.8
    r2_factor: float = 2.0
    sizing: str = "raw"
    p_level: float = 0.10
    default_horizon: int = 20
    mentions_only: bool = False
    several_positions: bool = False
    adverse_exit: bool = False


def gated(stamped: DataFrame, rules: list[ReplayRules]) -> DataFrame:
    """Entry side and size of every row per parameter set, from the first tradable day on.

    The series is prepared once; parameter sets fan out at the end.
    """
    df = from_first_trade(realised_volatility(stamped))
    pred, sigma = F.col("predicted_return"), F.col("vol")
    sets = []
    for r in rules:
        significant = F.coalesce(F.col("p_value") < r.p_level, F.lit(False))
        if r.mentions_only:
            significant = significant & (F.col("total_mentions") >= 1)
        share = position_share(r.sizing, pred, sigma, F.col("r_squared"), r.share, r.min_share, r.max_share, r.r2_factor)
        sets.append(F.struct(F.lit(r.param_id).alias("param_id"), entry_side(pred, sigma, significant, r.threshold).alias("side"),
                             share.alias("share")))
    return df.select("*", F.inline(F.array(*sets)))


def _by_rule(rules: list[ReplayRules], name: str) -> Column:
    """A rule's constant for the row's parameter set."""
    value = F.lit(None)
    for r in rules:
        value = F.when(F.col("param_id") == r.param_id, F.lit(getattr(r, name))).otherwise(value)
    return value


@dataclass(frozen=True)
class Replayed:
    """Days of every key in order (``n`` from 0) and the positions taken, closed or still open."""

    days: DataFrame
    positions: DataFrame


def _offers(days: DataFrame, rules: list[ReplayRules]) -> DataFrame:
    """What a position opened on each signal row would do, per share and without regard to capital.

    Entry price, exit row and profit follow from the price path alone: the exit is the first later row on
    which the holding time is over or the value leaves the band between the two fixed exits.
    """
    paths = days.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "date", "close"))), lambda d: d.dropFields("n")).alias("path"))
    sign = F.when(F.col("side") == "long", 1).otherwise(-1)
    out = days.where("n > 0 and side is not null").withColumns({
        "sign": sign, "slip": _by_rule(rules, "slippage_bps") / 2 / 1e4, "fee": _by_rule(rules, "commission"),
        "borrow": _by_rule(rules, "borrow_bps") / 1e4, "exit_sign": F.when(_by_rule(rules, "adverse_exit"), -1).otherwise(1),
        "held": F.coalesce(F.col("active_horizon").cast("int"), _by_rule(rules, "default_horizon")),
    }).withColumn("entry_price", F.col("close") * (1 + F.col("slip") * F.col("sign"))).withColumn("base", F.col("entry_price") - F.col("fee"))
    # the rows that follow, up to the last one the position can be held
    out = out.join(paths, KEYS).withColumn("later", F.slice("path", F.col("n") + 2, F.greatest("held", F.lit(1)))).drop("path")
    out = out.withColumn("values", F.transform("later", lambda d: F.when(F.col("sign") == 1, d["close"]).otherwise(
        F.col("base") + F.col("entry_price") - d["close"])))
    ending = F.transform("values", lambda v, k: F.when(
        (k + 1 >= F.col("held")) | (v <= STOP_LOSS * F.col("base")) | (v >= TAKE_PROFIT * F.col("base")), k + 1))
    out = out.withColumn("days_held", F.array_min(F.filter(ending, lambda k: k.isNotNull())))
    last = F.get("later", F.col("days_held") - 1)
    out = out.withColumns({
        "x": F.col("n") + F.col("days_held"), "exit_date": last["date"],
        "exit_price": last["close"] * (1 + F.col("slip") * F.col("sign") * F.col("exit_sign")),
        "borrow_each": F.when(F.col("sign") == 1, 0.0).otherwise(F.col("borrow") * F.col("base") * F.col("days_held")),
    }).withColumn("profit_each", (F.col("exit_price") - F.col("entry_price")) * F.col("sign") - F.col("fee") - F.col("borrow_each"))
    return out.select(*KEYS, F.col("n").alias("i"), "x", "days_held", F.col("side").alias("position_type"), F.col("date").alias("entry_date"), "exit_date",
                      "entry_price", "exit_price", "base", "fee", F.col("share").alias("size_pct"), "model_id", "borrow_each", "profit_each", "values")


def _taken(offers: DataFrame, rules: list[ReplayRules]) -> DataFrame:
    """Which offers are taken, with how many shares: a fold over a key's offers.

    It carries the cash and what open positions will pay back; an offer is taken with its share of the cash
    if no position is open, or where several may be.
    """
    facts = F.struct("i", "x", "size_pct", "entry_price", "base", "profit_each")
    keyed = offers.groupBy(*KEYS).agg(F.array_sort(F.collect_list(facts)).alias("offers")).withColumns({
        "capital": _by_rule(rules, "capital"), "several": _by_rule(rules, "several_positions")})
    due_type, taken_type = "array<struct<x:int,amount:double>>", "array<struct<i:int,shares:double>>"
    start = F.struct(F.col("capital").alias("cash"), F.array().cast(due_type).alias("due"), F.array().cast(taken_type).alias("taken"))

    def step(acc, o):
        open_ = F.filter(acc["due"], lambda p: p["x"].isNull() | (p["x"] > o["i"]))
        back = F.aggregate(F.filter(acc["due"], lambda p: p["x"] <= o["i"]), F.lit(0.0), lambda total, p: total + p["amount"])
        cash = acc["cash"] + back
        takes = ((F.size(open_) == 0) | F.col("several")) & (o["size_pct"] * cash >= 1)
        shares = F.when(F.coalesce(takes, F.lit(False)), o["size_pct"] * cash / o["entry_price"])
        pay = F.filter(F.array(F.struct(o["x"].alias("x"), (shares * (o["base"] + o["profit_each"])).alias("amount"), shares.alias("s"))), lambda p: p["s"].isNotNull())
        mine = F.filter(F.array(F.struct(o["i"].alias("i"), shares.alias("shares"))), lambda p: p["shares"].isNotNull())
        return F.struct(
            (cash - F.coalesce(shares * o["base"], F.lit(0.0))).alias("cash"),
            F.concat(open_, F.transform(pay, lambda p: p.dropFields("s"))).cast(due_type).alias("due"),
            F.concat(acc["taken"], mine).cast(taken_type).alias("taken"))

    return keyed.select(*KEYS, F.inline(F.aggregate("offers", start, step, lambda acc: acc["taken"])))


def replay(rows: DataFrame, rules: list[ReplayRules]) -> Replayed:
    """Positions of every key. ``rows`` come from :func:`gated` with the same rules."""
    order = Window.partitionBy(*KEYS).orderBy("date")
    days = rows.select(*KEYS, (F.row_number().over(order) - 1).alias("n"), "date", "close", "side", "share", "active_horizon",
                       F.col("model_id").cast("bigint").alias("model_id"), _by_rule(rules, "capital").alias("capital"))
    days = cut_lineage(days)
    offers = cut_lineage(_offers(days, rules))
    return Replayed(days, offers.join(_taken(offers, rules), [*KEYS, "i"]))


def trades_of(done: Replayed) -> DataFrame:
    """Closed positions."""
    pnl, value = F.col("shares") * F.col("profit_each"), F.col("shares") * F.col("base")
    return done.positions.where("x is not null").select(
        *KEYS, "position_type", "entry_date", "exit_date", "entry_price", "exit_price", "days_held", pnl.alias("pnl"),
        F.try_divide(pnl, value).alias("net_return"), "model_id", "size_pct", value.alias("entry_value"), "shares",
        (F.col("shares") * F.col("borrow_each")).alias("borrow_cost"), (2 * F.col("fee") * F.col("shares")).alias("commission_round"))


def equity_of(done: Replayed) -> DataFrame:
    """Equity per day with the benchmark that starts from the same capital.

    Cash moves on the day after an entry and on the exit day; open positions add their value in between.
    """
    value = F.col("shares") * F.col("base")
    moves = F.array(F.struct((F.col("i") + 1).alias("n"), (-value).alias("cash")),
                    F.struct(F.col("x").alias("n"), (value + F.col("shares") * F.col("profit_each")).alias("cash")))
    cash = done.positions.select(*KEYS, F.inline(moves)).where("n is not null").withColumn("worth", F.lit(0.0))
    held = done.positions.select(*KEYS, "i", "x", "shares", F.posexplode("values").alias("k", "v")).where("x is null or i + k + 1 < x")
    worth = held.select(*KEYS, (F.col("i") + F.col("k") + 1).alias("n"), F.lit(0.0).alias("cash"), (F.col("shares") * F.col("v")).alias("worth"))
    moved = cash.unionByName(worth).groupBy(*KEYS, "n").agg(F.sum("cash").alias("cash"), F.sum("worth").alias("worth"))
    w = Window.partitionBy(*KEYS).orderBy("n")
    so_far = F.coalesce(F.sum("cash").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    eq = done.days.join(moved, [*KEYS, "n"], "left").withColumn("equity", F.col("capital") + so_far + F.coalesce("worth", F.lit(0.0)))
    return benchmark(eq.select(*KEYS, "date", "equity", "close"))


def benchmark(equity: DataFrame) -> DataFrame:
    """Adds the curve of holding from the first day with the same capital."""
    w = Window.partitionBy(*KEYS).orderBy("date")
    return equity.withColumn("buy_hold", F.first("equity").over(w) * F.col("close") / F.first("close").over(w))


def performance(equity: DataFrame, trades: DataFrame, periods: int = 252) -> DataFrame:
    """Trades, win rate, returns against the benchmark, drawdown and Sharpe ratio per key."""
    w = Window.partitionBy(*KEYS).orderBy("date")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("equity").over(w)
    daily = equity.withColumns({
        "ret": F.try_divide(F.col("equity") - before, before),
        "dd": F.col("equity") / F.max("equity").over(so_far) - 1,
    })
    curve = daily.groupBy(*KEYS).agg(
        F.min_by("equity", "date").alias("start"), F.max_by("equity", "date").alias("final"),
        F.max_by("buy_hold", "date").alias("bench"), F.min("dd").alias("dd"),
        F.avg("ret").alias("mean_ret"), F.stddev_pop("ret").alias("std_ret"),
    )
    won = trades.groupBy(*KEYS).agg(
        F.count("*").alias("total_trades"), (F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)) * 100).alias("win_rate_pct"),
    )
    yearly = F.pow(1 + F.col("mean_ret"), F.lit(periods)) - 1
    return curve.join(won, KEYS, "left").select(
        *KEYS, F.coalesce("total_trades", F.lit(0)).alias("total_trades"), "win_rate_pct",
        ((F.col("final") / F.col("start") - 1) * 100).alias("total_return_pct"),
        ((F.col("bench") / F.col("start") - 1) * 100).alias("buy_hold_return_pct"),
        ((F.col("final") - F.col("bench")) / F.col("start") * 100).alias("excess_return_pct"),
        (F.col("dd") * 100).alias("max_drawdown_pct"),
        F.try_divide(yearly, F.col("std_ret") * F.sqrt(F.lit(float(periods)))).alias("sharpe_ratio"),
    )
