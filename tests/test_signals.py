import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats as ST
from tidemark.operators import regression as R, replay as Y, series as W, training as N


def frame(spark, n=900, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"ticker": "A", "date": pd.date_range("2020-01-01", periods=n).date, "predictor": rng.normal(size=n)})
    return spark.createDataFrame(pdf).withColumn("idx", F.datediff("date", F.lit("2020-01-01").cast("date"))), pdf


def test_ema_equals_pandas(spark):
    df, pdf = frame(spark)
    spans = (3, 7, 50, 200)
    got = W.ema(df, spans).orderBy("idx").toPandas()
    for s in spans:
        want = pdf["predictor"].ewm(span=s, adjust=True).mean()
        assert np.abs(got[f"ema_{s}"] - want).max() < 1e-12


def test_panel_fills_gaps_and_needs_both_sides(spark):
    sent = spark.createDataFrame([("A", "2024-01-03", 2.0, 1), ("B", "2024-01-03", 2.0, 1)], "ticker string, date string, net_conviction double, total_mentions int").withColumn("date", F.to_date("date"))
    price = spark.createDataFrame([("A", "2024-01-02", 10.0, 5), ("A", "2024-01-05", 11.0, 5)], "ticker string, date string, close double, volume long").withColumn("date", F.to_date("date"))
    got = W.stock_panel(sent, price, "2024-01-01", "2024-01-06").orderBy("date").collect()
    assert [r.ticker for r in got] == ["A"] * 6
    assert [r.predictor for r in got] == [0, 0, 2.0, 0, 0, 0]
    assert [r.close for r in got] == [None, 10.0, None, None, 11.0, None]


def test_p_values_match_tables():
    # t table: two-sided 5 % points
    for df, t in ((1, 12.706204736), (5, 2.570581836), (10, 2.228138852), (30, 2.042272456), (120, 1.979930405)):
        assert abs(ST.t_two_sided(t, df) - 0.05) < 1e-9
    assert ST.t_two_sided(40.0, 100) < 1e-60
    assert abs(ST.normal_two_sided([1.959963985])[0] - 0.05) < 1e-9


def wandering(n, seed, gaps=False):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({
        "ticker": "A", "date": pd.date_range("2020-01-01", periods=n).date, "predictor": np.round(1e4 * (seed == 9) + rng.normal(size=n), 1 if gaps else 6),
        "total_mentions": rng.integers(0, 3, n), "close": 100 + rng.normal(size=n).cumsum() * 0.1, "volume": 5})


def windows(df, plan):
    """Training rows of every (horizon, refit) by definition."""
    for h in plan.horizons:
        for k, start in enumerate(range(plan.first_refit, len(df) - h, plan.refit)):
            last = start - plan.embargo - h
            rows = df.iloc[max(0, last - plan.window):last + 1]
            yield h, k, rows[rows["total_mentions"] >= 1] if plan.mentions_only else rows


@pytest.mark.parametrize("mentions_only", (False, True))
@pytest.mark.parametrize("window", (252, 83, 20))
def test_window_fits_equal_plain_windows(spark, window, mentions_only):
    plan = R.WalkForward(spans=(1, 5), horizons=(1, 5), window=window, min_training=5, min_rows=5, mentions_only=mentions_only)
    df = R.features(spark.createDataFrame(wandering(420, 9, gaps=True)), plan)
    got = {(r.horizon, r.k, r.span): r for r in R.candidate_fits(df, plan).collect()}
    rows, seen = df.orderBy("idx").toPandas(), 0
    for h, k, part in windows(rows, plan):
        for s in plan.spans:
            x, y = part[f"ema_{s}"], part[f"fwd_{h}"]
            both = part[x.notna() & y.notna()]
            r = got.get((h, k, s))
            if len(both) < 5 or min(start_length(plan, h, k), window) + 1 < 5 or x.std(ddof=0) < 0.005:
                assert r is None
                continue
            seen += 1
            slope, intercept = np.polyfit(both[f"ema_{s}"] - 1e4, both[f"fwd_{h}"], 1)
            assert r.n == len(both) and r.n_unique == x.nunique() and r.x_std == pytest.approx(x.std(ddof=0), rel=1e-9)
            assert r.coefficient == pytest.approx(slope, rel=1e-7, abs=1e-10) and r.train_start == both["date"].min() and r.train_end == both["date"].max()
            assert r.r_squared == pytest.approx(np.corrcoef(both[f"ema_{s}"], both[f"fwd_{h}"])[0, 1] ** 2, rel=1e-6, abs=1e-10)
    assert seen == len(got) > 20


def start_length(plan, h, k):
    return k * plan.refit + plan.first_refit - plan.embargo - h


def test_rows_are_not_copied_to_windows(spark):
    """Rows that reach the grouping are the same for long and short windows."""
    df = spark.createDataFrame(wandering(300, 3))

    def generated(window):
        plan = R.WalkForward(spans=(5,), horizons=(1,), window=window)
        rows = R._long(R.features(df, plan), plan)
        return nodes_of(R.window_fits(rows, ["ticker", "horizon", "span"], "idx", window + 1, 21, F.lit(40)), "Generate", "Join", "Exchange")

    assert generated(252) == generated(42) and generated(252)[1] == 0


@pytest.mark.parametrize("horizon, window", [(5, 252), (20, 100), (1, 60)])
def test_robust_fits_equal_plain_loops(spark, horizon, window):
    plan = R.WalkForward(spans=(5,), horizons=(horizon,), window=window, model="WLS", mentions_only=horizon == 1, min_rows=10)
    df = R.features(spark.createDataFrame(wandering(420, 6)), plan)
    got = {r.k: r for r in R.candidate_fits(df, plan).collect()}
    assert len(got) > 8
    for h, k, part in windows(df.orderBy("idx").toPandas(), plan):
        part = part[part[f"fwd_{h}"].notna()]
        if k not in got:
            continue
        x, y, n = part["ema_5"].to_numpy(), part[f"fwd_{h}"].to_numpy(), len(part)
        w = np.exp(-np.log(2) / plan.half_life * np.arange(n)[::-1]) * np.sqrt(1 + part["total_mentions"].to_numpy())
        design = np.column_stack([np.ones(n), x])
        bread = np.linalg.inv(design.T @ np.diag(w) @ design)
        beta = bread @ design.T @ (w * y)
        e = y - design @ beta
        s = design * (w * e)[:, None]
        meat = sum((1 - abs(i - j) / (h + 1)) * np.outer(s[i], s[j]) for i in range(n) for j in range(max(0, i - h), min(n, i + h + 1)))
        r = got[k]
        assert r.n == n and r.coefficient == pytest.approx(beta[1], rel=1e-8) and r.intercept == pytest.approx(beta[0], rel=1e-8)
        assert r.t_stat == pytest.approx(beta[1] / np.sqrt((bread @ meat @ bread)[1, 1]), rel=1e-7)
        mean = (w * y).sum() / w.sum()
        assert r.r_squared == pytest.approx(1 - (w * e**2).sum() / (w * (y - mean) ** 2).sum(), rel=1e-7)


def test_constant_predictor_gives_null(spark):
    df = spark.createDataFrame([(1, 1.0, float(i)) for i in range(10)], "k int, x double, y double")
    r = R.simple_ols(df, "y", "x", ["k"]).first()
    assert r.coefficient is None and r.p_value is None


def test_training_ends_before_prediction(spark):
    rng = np.random.default_rng(5)
    n = 500
    pdf = pd.DataFrame({"ticker": "A", "date": pd.date_range("2020-01-01", periods=n).date, "predictor": rng.normal(size=n), "total_mentions": 1,
                        "close": 100 + rng.normal(size=n).cumsum() * 0.1, "volume": 5})
    plan = R.WalkForward(spans=(5,), horizons=(1, 5), p_level=1.0)
    stamped, models = R.walk_forward(spark.createDataFrame(pdf), plan)
    rows = models.withColumn("gap", F.datediff("prediction_start", "train_end")).collect()
    assert rows and all(r.gap >= plan.embargo + r.horizon for r in rows)
    assert len({r.model_id for r in rows}) == len(rows)
    first = stamped.where("model_id is not null").agg(F.min("idx")).first()[0]
    assert first >= plan.first_refit


def test_replay_carries_capital(spark):
    rows = [("A", "p", f"2024-01-{i + 1:02d}", 100.0 if i < 3 else 200.0, "long" if i == 1 else None, 0.5, 2, 0) for i in range(8)]
    df = spark.createDataFrame(rows, "ticker string, param_id string, date string, close double, side string, share double, active_horizon int, model_id long").withColumn("date", F.to_date("date"))
    rules = [Y.ReplayRules("p", slippage_bps=0.0, commission=0.0)]
    done = Y.replay(df, rules)
    trade = Y.trades_of(done).collect()
    assert len(trade) == 1 and trade[0].days_held == 2 and abs(trade[0].pnl - 5000) < 1e-9
    equity = [r.equity for r in Y.equity_of(done).orderBy("date").collect()]
    assert equity[0] == 10_000 and abs(equity[-1] - 15_000) < 1e-9
    assert abs(Y.performance(Y.equity_of(done), Y.trades_of(done)).first().total_return_pct - 50) < 1e-9


def test_as_of_takes_last_known(spark):
    pts = spark.createDataFrame([("A", "2024-01-01"), ("A", "2024-01-04")], "ticker string, date string")
    ser = spark.createDataFrame([("A", "2024-01-02", 1.0), ("A", "2024-01-03", 2.0), ("A", "2024-01-05", 3.0)], "ticker string, date string, v double")
    assert [(r.date, r.v_at_date) for r in W.as_of(pts, ser, ["v"]).orderBy("date").collect()] == [("2024-01-01", None), ("2024-01-04", 2.0)]


def test_scaling_uses_the_population_deviation(spark):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    df = spark.range(7).select(array_to_vector(F.array((F.col("id") * F.col("id")).cast("double"), F.lit(3.0))).alias("features"))
    v = N.fit_scaler(df).transform(df).select(vector_to_array("scaled").alias("v"))
    got = v.agg(F.avg(F.col("v")[0]).alias("m"), F.stddev_pop(F.col("v")[0]).alias("s"), F.max(F.abs(F.col("v")[1])).alias("c")).first()
    assert abs(got.m) < 1e-12 and abs(got.s - 1) < 1e-12 and got.c == 0


def test_keys_without_trades_stay(spark):
    rows = [("A", "p", f"2024-01-{i + 1:02d}", 100.0 + i, None, 0.5, 2, 0) for i in range(5)]
    df = spark.createDataFrame(rows, "ticker string, param_id string, date string, close double, side string, share double, active_horizon int, model_id long").withColumn("date", F.to_date("date"))
    done = Y.replay(df, [Y.ReplayRules("p")])
    figures = Y.performance(Y.equity_of(done), Y.trades_of(done)).first()
    assert figures.total_trades == 0 and figures.win_rate_pct is None and figures.total_return_pct == 0


def test_cash_and_positions_make_the_equity(spark):
    rng = np.random.default_rng(3)
    for several in (False, True):
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.08, 120)))
        side = [None if u < 0.6 else ("long" if u < 0.8 else "short") for u in rng.random(120)]
        rule = Y.ReplayRules("p", several_positions=several, share=0.3, default_horizon=6)
        df = spark.createDataFrame([("A", "p", i, float(c), s, 0.3, None, 1) for i, (c, s) in enumerate(zip(close, side))],
                                   "ticker string, param_id string, i int, close double, side string, share double, active_horizon int, model_id long")
        done = Y.replay(df.withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("i"))).drop("i"), [rule])
        got = {(r.date.isoformat()): r.equity for r in Y.equity_of(done).collect()}
        placed = [r for r in done.positions.orderBy("i").collect()]
        assert placed and (several or all(a.x is not None and a.x <= b.i for a, b in zip(placed, placed[1:])))
        for day in range(120):  # equity from the ledger by definition
            cash = rule.capital
            for p in placed:
                sign = 1 if p.position_type == "long" else -1
                if p.i < day:
                    worth = p.shares * (close[min(day, 119)] if sign == 1 else p.base + p.entry_price - close[day])
                    cash += (p.shares * p.profit_each) if p.x is not None and p.x <= day else worth - p.shares * p.base
            assert got[str((pd.Timestamp("2024-01-01") + pd.Timedelta(days=day)).date())] == pytest.approx(cash, rel=1e-9)


def test_hash_ranks_are_exact(spark):
    df = spark.range(5000).selectExpr("id as submission_id", "if(id % 3 = 0, 1, 0) as label")
    got = N.hash_ranked(df, "label", "submission_id").groupBy("label").agg(F.countDistinct("rn").alias("n"), F.max("rn").alias("hi"), F.min("rn").alias("lo"), F.max("n_stratum").alias("s")).collect()
    assert all(r.n == r.hi == r.s and r.lo == 1 for r in got)


def test_ranking_metrics_by_brute_force(spark):
    rng = np.random.default_rng(2)
    s, y = np.round(rng.random(3000) ** 6, 3), rng.integers(0, 2, 3000)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "probability_relevant double, label int")
    pos, neg = s[y == 1], s[y == 0]
    roc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    pr, before_r, before_p = 0.0, 0.0, 1.0
    for cut in sorted(set(s), reverse=True):
        picked = s >= cut
        r, p = y[picked].sum() / len(pos), y[picked].mean()
        pr, before_r, before_p = pr + (r - before_r) * (p + before_p) / 2, r, p
    got = N.ranking_metrics(df).first()
    assert got.roc_auc == pytest.approx(roc, abs=1e-12) and got.pr_auc == pytest.approx(pr, abs=1e-12)


def nodes_of(df, *names):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [plan.count(n) for n in names]


def test_averages_read_their_input_once(spark, tmp_path):
    """Scans, joins, shuffles and sorts do not grow with the number of spans."""
    df, _pdf = frame(spark, 300)
    df.write.parquet(str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p"))
    one, six = (nodes_of(W.ema(rows, s), "Scan parquet", "Join", "Exchange", "Sort [", "Window [") for s in ((7,), (3, 5, 7, 10, 15, 20)))
    assert one == six and one[:2] == [1, 0]
    assert len(W.ema(rows, range(2, 40))._jdf.queryExecution().analyzed().toString().splitlines()) < 40


def test_averages_of_long_series_and_odd_spans(spark):
    df, pdf = frame(spark, 1500, seed=4)
    df = df.withColumn("predictor", F.when(F.col("idx") < 1490, F.col("predictor") * 1e6).otherwise(0.0))
    spans = (1, 2, 3, 400)
    got = W.ema(df, spans).orderBy("idx").toPandas()
    assert [c for c in got.columns if c.startswith("ema_")] == [f"ema_{s}" for s in spans]
    for s in spans:
        want = got["predictor"].ewm(span=s, adjust=True).mean()
        assert np.allclose(got[f"ema_{s}"], want, rtol=1e-9, atol=1e-6)


def test_certificate_tells_the_best_fit_from_others(spark):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.2]
    y = (x @ [1, -0.3, 2] + rng.logistic(size=400) > 0).astype(int)
    df = spark.createDataFrame([([float(v) for v in r], int(k)) for r, k in zip(x, y)], "f array<double>, label int").select(array_to_vector("f").alias("scaled"), "label")
    for penalty in (0.0, 0.05):
        best = N.make_classifier(regParam=penalty, tol=1e-12, maxIter=500).fit(df)
        early = N.make_classifier(regParam=penalty, maxIter=1).fit(df)
        names = ["a", "b", "c"]
        good, bad = (N.fit_certificate(df, m, names).toPandas().set_index("feature") for m in (best, early))
        assert good["gradient"].abs().max() < 1e-6 < 1e-3 < bad["gradient"].abs().max()
        assert good.loc["b", "observed"] == pytest.approx((y * x[:, 1]).mean()) and good.loc["intercept", "observed"] == pytest.approx(y.mean())
