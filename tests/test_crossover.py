import math

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from candlemill.operators import crossover as xo


def state(on, off):
    pos, out = 0, []
    for s, r in zip(on, off):
        if pos == 0 and s:
            pos = 1
        elif pos == 1 and r:
            pos = 0
        out.append(pos)
    return out


@pytest.mark.parametrize("block", [5, 4096])
def test_closed_form_equals_the_state_machine(spark, block):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame([(f"S{s}", i, bool(a), bool(b)) for s in range(60)
                        for i, (a, b) in enumerate(rng.random((80, 2)) < rng.uniform(0.2, 0.8, 2))],
                       columns=["symbol", "idx", "on", "off"])
    out = rows(xo.positions(spark.createDataFrame(pdf), F.col("on"), F.col("off"), block=block), "symbol", "idx")
    for _, g in out.groupby("symbol"):
        assert list(g["position"]) == state(g["on"], g["off"])


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(2)
    n = 420
    sig = 100 * np.exp(np.cumsum(rng.normal(0.0005, 0.02, n)))
    asset = 50 * np.exp(np.cumsum(rng.normal(0.001, 0.03, n)))
    pdf = pd.DataFrame({"symbol": "M", "idx": range(n), "ts": pd.date_range("2015-01-01", periods=n, freq="W"),
                        "n_bars": n, "signal_close": sig, "asset_close": asset})
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return pdf, xo.with_averages(df, block=100).cache()


def one_run(pdf, kinds, e, x, cash, sample, drop_null=True):
    c = pdf["signal_close"]
    make = {"ema": lambda p: c.ewm(span=p, adjust=False).mean(), "sma": lambda p: c.rolling(p).mean()}
    df = pdf.assign(e=make[kinds[0]](e), x=make[kinds[1]](x), ar=pdf["asset_close"].pct_change().fillna(0))
    if drop_null:
        df = df.dropna()
    df = df.iloc[max(e, x) + 5:]
    pos = pd.Series(state(df.signal_close >= df.e, df.signal_close < df.x), index=df.index).shift(1).fillna(0)
    ret = np.where(pos == 1, df.ar, (1 + cash) ** (1 / 252) - 1)
    eq = 100_000 * np.cumprod(1 + ret)
    dd = eq / np.maximum.accumulate(eq) - 1
    d = 1 if sample else 0
    cagr = (eq[-1] / 100_000) ** (252 / len(eq)) - 1
    neg = ret[ret < 0]
    change = pos.diff().fillna(0).to_numpy()
    ins, outs = np.where(change == 1)[0], np.where(change == -1)[0]
    wins = [eq[b] / eq[a] > 1 for a, b in zip(ins, outs)]
    roll = pd.Series(ret)
    rs = (roll.rolling(252).mean() / roll.rolling(252).std() * np.sqrt(252)).dropna()
    month = pd.Series(ret, index=df.ts).resample("ME").apply(lambda v: (1 + v).prod() - 1)
    stab = 0.5 / (1 + rs.std()) + 0.3 * (month > 0).mean() + 0.2 / (1 + np.sqrt(((dd * 100) ** 2).mean()))
    return {"cagr": cagr, "max_dd": dd.min(), "sharpe": ret.mean() / ret.std(ddof=d) * math.sqrt(252),
            "sortino": ret.mean() / neg.std(ddof=d) * math.sqrt(252), "time_in_market": pos.mean(), "num_trades": len(ins),
            "trade_wr": np.mean(wins) if wins else 0.0, "calmar": cagr / abs(dd.min()), "stability_score": stab}


@pytest.mark.parametrize("drop_null,sample", [(True, False), (False, True)])
def test_runs_equal_a_pandas_backtest(spark, market, drop_null, sample):
    pdf, averaged = market
    grid = xo.Grid(entry=(5, 13), exit=(20, 50), cash=(0.0, 0.045), drop_null=drop_null)
    runs = xo.run_table(spark, grid)
    got = xo.metrics(xo.simulate(averaged, runs), sample=sample).join(runs, "run_id").toPandas()
    assert len(got) == 24
    for r in got.itertuples():
        kinds = (r.entry_kind, r.exit_kind)
        if not drop_null and "sma" in kinds and r.exit_kind == "sma" and max(r.entry_period, r.exit_period) < r.exit_period - 1:
            continue
        want = one_run(pdf, kinds, r.entry_period, r.exit_period, r.cash_yield, sample, drop_null)
        for k, v in want.items():
            assert math.isclose(getattr(r, k), v, rel_tol=1e-6, abs_tol=1e-8), (k, r)


def test_hold_matches_prices(market):
    pdf, averaged = market
    m = xo.metrics(xo.hold_asset(averaged, block=64)).first()
    assert math.isclose(m["total_return"], pdf.asset_close.iloc[-1] / pdf.asset_close.iloc[0] - 1, rel_tol=1e-9)
    assert m["time_in_market"] == 1.0


def test_grid_sizes(spark):
    assert xo.run_table(spark).count() == 7203
    small = xo.run_table(spark, xo.SMALL_GRID)
    assert small.filter("entry_period >= exit_period").count() == 0
    assert small.select("run_id").distinct().count() == small.count()


def test_rank_score_is_zero_for_losing_runs(spark, market):
    _, averaged = market
    res = xo.metrics(xo.simulate(averaged, xo.run_table(spark, xo.Grid(entry=(3, 9, 27), exit=(5, 30)))))
    out = xo.rank_score(res).toPandas()
    assert (out[out.calmar <= 0]["rank_score"] == 0).all() and out["rank_score"].between(0, 1).all()
    years = xo.yearly(xo.simulate(averaged, xo.run_table(spark, xo.Grid(entry=(3, 9), exit=(5,)))))
    counts = xo.consistency(years, best=2, worst=1).toPandas()
    n_years = years.select("year").distinct().count()
    assert counts["years_top"].sum() == 2 * n_years and counts["years_bottom"].sum() == n_years


def test_a_total_loss_leaves_nothing(spark):
    rows_ = [(k, r) for k, r in enumerate([None, 0.1, -1.0, 0.5, -1.2, 0.1])]
    df = spark.createDataFrame(rows_, "idx int, ret double")
    got = df.agg((F.exp(F.sum(xo.growth(F.col("ret")))) - 1).alias("x")).first()["x"]
    assert got == -1.0
    some = df.where("idx < 2").agg(F.exp(F.sum(xo.growth(F.col("ret")))).alias("x")).first()["x"]
    assert abs(some - 1.1) < 1e-12
    dd = spark.createDataFrame([(5.0, 10.0), (0.0, 0.0), (None, 1.0)], "equity double, peak double")
    assert [r[0] for r in dd.select(xo.drop_from("peak")).collect()] == [-0.5, -1.0, None]


def test_years_come_from_the_data_and_troughs_from_what_is_left(spark):
    rows = [(0, f"{1987 + k // 2}-0{1 + k % 2}-01", k, e) for k, e in enumerate([1.0, 1e-18, 1e-19, 1e-17])]
    sim = spark.createDataFrame(rows, "run_id int, day string, idx int, equity double").selectExpr(
        "'s' AS symbol", "run_id", "cast(day AS timestamp_ntz) AS ts", "idx", "equity", "equity AS share", "equity - 1 AS dd",
        "0.0D AS ret")
    assert str(xo.drawdown_dates(sim).first().trough_ts) == "1988-01-01 00:00:00"  # every drawdown is -1 but the first
    assert xo.year_matrix(xo.yearly(sim)).columns == ["run_id", "1987", "1988"]
