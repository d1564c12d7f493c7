import math

import numpy as np
import pandas as pd
import pytest
from conftest import random_bars, rows, to_spark
from pyspark.sql import functions as F

from candlemill.config import BacktestConfig, WalkForwardConfig
from candlemill.operators import engine as en
from candlemill.operators import signals as sg
from candlemill.schemas import KEYS

CFG = BacktestConfig(recompute_interval=3, lookback=40)


def last_bar_setups(bars, keys):
    """Two setups on the last bar of each prefix, from its own prices only."""
    c, h, lo = F.col("close"), F.col("high"), F.col("low")
    last = bars.filter(F.col("idx") == F.col("n_bars") - 1)
    long = F.pmod(F.floor(c), F.lit(2)) == 0
    shape = F.array(*[F.struct(
        F.when(long, "LONG").otherwise("SHORT").alias("direction"), c.alias("entry"),
        F.when(long, lo - gap).otherwise(h + gap).alias("stop"), F.when(long, h + gap * 2).otherwise(lo - gap * 2).alias("target"),
        F.lit(conf).alias("confidence"), F.lit(rr).alias("filter_rr"), F.lit(o).alias("ord"))
        for o, gap, conf, rr in ((0, 6.0, 0.8, 2.0), (1, 14.0, 0.55, 1.2))])
    return last.select(*keys, "idx", "ts", F.inline(shape)).withColumns({
        "reason": F.lit("test"), "pattern_type": F.lit(None).cast("string"),
        "level_price": F.lit(None).cast("double"), "level_type": F.lit(None).cast("string")})


EMITTER = sg.Emitter(last_bar_setups, False, 0.5, 1.0)


def loop(df, cfg, conf=0.5, rr=1.0):
    """Bar-by-bar event loop over the same signals."""
    equity, open_, closed, cap = [cfg.initial_capital], [], [], cfg.initial_capital

    def finish(t, price, reason, i):
        gross = price - t["fill"] if t["long"] else t["fill"] - price
        net = gross - 2 * cfg.commission - t["slip"]
        closed.append({**t, "exit": i, "reason": reason, "price": price, "net": net})
        return net

    def excursion(t, b):
        up, dn = b.high - t["fill"], t["fill"] - b.low
        t["mfe"], t["mae"] = max(t["mfe"], up if t["long"] else dn), max(t["mae"], dn if t["long"] else up)

    bars = list(df.itertuples())
    for i in range(cfg.warmup, len(bars)):
        b, keep = bars[i], []
        for t in open_:
            excursion(t, b)
            if t["long"]:
                hit = ("stop_loss", min(b.open, t["stop"])) if b.low <= t["stop"] else (
                    ("take_profit", max(b.open, t["target"])) if b.high >= t["target"] else None)
            else:
                hit = ("stop_loss", max(b.open, t["stop"])) if b.high >= t["stop"] else (
                    ("take_profit", min(b.open, t["target"])) if b.low <= t["target"] else None)
            if hit:
                price = hit[1] * (1 - cfg.slippage if t["long"] else 1 + cfg.slippage)
                cap += finish(t, price, hit[0], i)
            else:
                keep.append(t)
        open_ = keep
        if i % cfg.recompute_interval == 0:
            long = math.floor(b.close) % 2 == 0
            for gap, c_, r_ in ((6.0, 0.8, 2.0), (14.0, 0.55, 1.2)):
                if c_ < conf or r_ < rr:
                    continue
                if len(open_) >= cfg.max_open:
                    break
                if (b.low <= b.close) if long else (b.high >= b.close):
                    slip = b.close * cfg.slippage
                    open_.append({"entry": i, "long": long, "fill": b.close + slip if long else b.close - slip, "slip": slip,
                                  "stop": b.low - gap if long else b.high + gap,
                                  "target": b.high + 2 * gap if long else b.low - 2 * gap, "mae": 0.0, "mfe": 0.0})
        equity.append(cap)
    for t in open_:
        excursion(t, bars[-1])
        cap += finish(t, bars[-1].close, "end_of_data", len(bars) - 1)
        equity.append(cap)
    return closed, equity


def loop_stats(closed, equity):
    eq = np.array(equity)
    ret = np.diff(eq) / eq[:-1]
    peak = np.maximum.accumulate(eq)
    return {
        "total_trades": len(closed), "total_net_pnl": sum(t["net"] for t in closed),
        "sharpe_ratio": ret.mean() / ret.std() * math.sqrt(252) if len(ret) and ret.std() > 0 else 0.0,
        "max_drawdown_pct": ((peak - eq) / peak).max(), "final_equity": eq[-1],
    }


@pytest.fixture(scope="module")
def frames():
    return [random_bars(220, 21, "A"), random_bars(160, 22, "B"), random_bars(25, 23, "C")]


@pytest.fixture(scope="module")
def bars(spark, frames):
    return to_spark(spark, *frames).cache()


def test_trades_equal_the_event_loop(bars, frames):
    got = rows(en.backtest(bars, EMITTER, CFG), "symbol", "trade_id")
    assert set(got["exit_reason"]) == {"stop_loss", "take_profit", "end_of_data"}
    for f in frames:
        want, _ = loop(f, CFG)
        want = sorted(want, key=lambda t: (t["entry"], t["stop"] if not t["long"] else -t["stop"]))
        part = got[got.symbol == f.symbol[0]].sort_values(["entry_idx", "ord"])
        assert list(part["entry_idx"]) == [t["entry"] for t in want]
        assert list(part["exit_idx"]) == [t["exit"] for t in want]
        assert list(part["exit_reason"]) == [t["reason"] for t in want]
        for col, key in (("exit_price", "price"), ("net_pnl", "net"), ("mae", "mae"), ("mfe", "mfe")):
            np.testing.assert_allclose(part[col], [t[key] for t in want], rtol=1e-9, atol=1e-9)
    assert (got[["mae", "mfe"]] >= 0).all().all()


def test_position_limit_binds(bars):
    free = en.backtest(bars, EMITTER, BacktestConfig(recompute_interval=3, lookback=40, max_open=100)).count()
    assert en.backtest(bars, EMITTER, CFG).count() < free


def test_metrics_and_curve_equal_the_loop(bars, frames):
    trades = en.backtest(bars, EMITTER, CFG)
    got = en.metrics(trades, en.runs_of(bars), KEYS, CFG).toPandas().set_index("symbol")
    curve = rows(en.equity_curve(trades, bars, KEYS, KEYS, CFG), "symbol", "step")
    assert len(got) == 3 and got.loc["C", "total_trades"] == 0 and got.loc["C", "final_equity"] == CFG.initial_capital
    for f in frames[:2]:
        symbol = f.symbol[0]
        closed, equity = loop(f, CFG)
        for k, v in loop_stats(closed, equity).items():
            assert math.isclose(got.loc[symbol, k], v, rel_tol=1e-6, abs_tol=1e-9), k
        np.testing.assert_allclose(curve[curve.symbol == symbol]["equity"], equity[1:])


def test_costs_reduce_profit(bars):
    def total(cfg):
        return en.metrics(en.backtest(bars, EMITTER, cfg), en.runs_of(bars), KEYS, cfg).agg(F.sum("total_net_pnl")).first()[0]

    free = BacktestConfig(recompute_interval=3, lookback=40, slippage=0.0, commission=0.0)
    assert total(CFG) < total(free)


def test_sweep_equals_one_run_per_parameter(bars, frames):
    got = en.sweep(bars, EMITTER, CFG).toPandas()
    assert len(got) == 3 * 20
    for conf, rr in ((0.5, 1.0), (0.6, 1.5), (0.7, 2.5)):
        row = got[(got.symbol == "A") & (got.min_confidence == conf) & (got.min_rr_ratio == rr)].iloc[0]
        want = loop_stats(*loop(frames[0], CFG, conf, rr))
        assert row["total_trades"] == want["total_trades"]
        assert math.isclose(row["total_net_pnl"], want["total_net_pnl"], rel_tol=1e-9, abs_tol=1e-9)


def test_walk_forward_aggregates_its_folds(bars, frames):
    wf = WalkForwardConfig(80, 40, 40)
    per_fold, total = en.walk_forward(bars, EMITTER, CFG, wf)
    folds, whole = per_fold.toPandas(), total.toPandas().set_index("symbol")
    assert sorted(folds[folds.symbol == "A"]["fold"]) == [0, 1, 2]
    for s, g in folds.groupby("symbol"):
        assert whole.loc[s, "oos_total_trades"] == g["oos_total_trades"].sum()
        assert math.isclose(whole.loc[s, "oos_total_net_pnl"], g["oos_total_net_pnl"].sum(), rel_tol=1e-9, abs_tol=1e-9)
    f = folds[(folds.symbol == "A") & (folds.fold == 1)].iloc[0]
    test = frames[0].iloc[120:160].reset_index(drop=True)
    want = loop_stats(*loop(test, CFG, f["min_confidence"], f["min_rr_ratio"]))
    assert f["oos_total_trades"] == want["total_trades"]
    assert math.isclose(f["oos_sharpe_ratio"], want["sharpe_ratio"], rel_tol=1e-6, abs_tol=1e-9)


@pytest.mark.parametrize("mode", ["anchored", "rolling"])
def test_folds_share_their_prefixes(bars, mode):
    ranges = en.folds(en.runs_of(bars), WalkForwardConfig(80, 40, 20, mode))
    run = [*KEYS, "fold"]
    for part in ("train", "test"):
        asked = en.evaluations(ranges, part, CFG)
        got = en.shared_setups(bars, asked, EMITTER, CFG, KEYS)
        want = en.setups_at_evals(en.fold_bars(bars, ranges, part), EMITTER, CFG, run)
        cols = [*run, "eval_idx", "idx", "last", "direction", "entry", "stop", "target", "ord"]
        assert rows(got.select(cols), *cols).equals(rows(want.select(cols), *cols)) and want.count()


def test_anchored_folds_add_no_detection(bars):
    def prefix_rows(step):
        ranges = en.folds(en.runs_of(bars), WalkForwardConfig(80, 30, step))
        last = ranges.groupBy(*KEYS).agg(F.max("fold").alias("fold"))
        asked = en.evaluations(ranges, "train", CFG)
        every = en.shared_prefixes(bars, asked, CFG, KEYS).count()
        return ranges.count(), every, en.shared_prefixes(bars, asked.join(last, [*KEYS, "fold"]), CFG, KEYS).count()

    few, many = prefix_rows(30), prefix_rows(3)
    assert many[0] > 4 * few[0]
    assert few[1] == few[2] and many[1] == many[2]  # as many rows as the longest fold needs alone


@pytest.mark.parametrize("mode", ["anchored", "rolling"])
def test_fold_boundaries(spark, mode):
    runs = spark.createDataFrame([("A", "1d", 800), ("B", "1d", 599)], "symbol string, timeframe string, n_bars bigint")
    out = rows(en.folds(runs, WalkForwardConfig(mode=mode)), "fold")
    assert list(out["symbol"]) == ["A"] * 3 and list(out["test_end"]) == [600, 700, 800]
    assert list(out["train_start"]) == ([0, 0, 0] if mode == "anchored" else [0, 100, 200])


def test_portfolio_adds_up_and_a_single_series_stands_alone(bars, frames):
    per, whole = en.portfolio(bars, EMITTER, CFG)
    p, w = per.toPandas(), whole.first()
    assert math.isclose(p["total_net_pnl"].sum(), w["total_net_pnl"], rel_tol=1e-9)
    assert set(p["initial_capital"].round(6)) == {round(CFG.initial_capital / 3, 6)}
    deltas = [np.diff(loop(f, CFG)[1]) for f in frames]
    total = np.zeros(max(map(len, deltas)))
    for d in deltas:
        total[:len(d)] += d
    eq = CFG.initial_capital + np.concatenate([[0], np.cumsum(total)])
    ret = np.diff(eq) / eq[:-1]
    assert math.isclose(w["sharpe_ratio"], ret.mean() / ret.std() * math.sqrt(252), rel_tol=1e-6)
    _, one = en.portfolio(bars.filter("symbol = 'A'"), EMITTER, CFG)
    alone = loop_stats(*loop(frames[0], CFG))
    assert math.isclose(one.first()["sharpe_ratio"], alone["sharpe_ratio"], rel_tol=1e-6)


def test_admission_by_chains_equals_one_pass(spark):
    rng = np.random.default_rng(1)
    entry = np.sort(rng.integers(0, 400, 150))
    pdf = pd.DataFrame({"run": "r", "entry_idx": entry, "ord": range(150), "busy_until": entry + rng.integers(1, 30, 150)})
    got = rows(en.admit(spark.createDataFrame(pdf), ["run"], 3), "trade_id")
    live, want = [], []
    for t in pdf.itertuples():
        live = [u for u in live if u > t.entry_idx]
        if len(live) < 3:
            live.append(t.busy_until)
            want.append(t.ord)
    assert list(got["ord"]) == want and len(want) < 150


def test_regime_gate_only_removes(spark, bars):
    gated = sg.regime_gate(EMITTER, ("range_bound", "high_volatility"))
    assert en.backtest(bars, gated, CFG).count() <= en.backtest(bars, EMITTER, CFG).count()
