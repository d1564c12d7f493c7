"""Signals and signal backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlemill.config import BacktestConfig, PatternConfig, PatternSignalConfig, SignalConfig, WalkForwardConfig
from candlemill.operators import engine as en
from candlemill.operators import indicators as ind
from candlemill.operators import patterns as pt
from candlemill.operators import signals as sg
from candlemill.plans.oracle import ATR, PINS, W, bars, rnd
from candlemill.plans.queries_bars import ADX, BIAS, PCT, REGIME, week
from candlemill.plans.queries_levels import LEVELS, MATCH, weekly_analysis
from candlemill.plans.queries_patterns import ALL, LAST, all_patterns, last_bars
from candlemill.plans.registry import Registry, pick, r
from candlemill.schemas import KEYS
from candlemill.session import materialize
from candlemill.sources import tables

reg = Registry()
CFG = SignalConfig()
BT = BacktestConfig()
# Brand bars are weekly and short: evaluate every 5 bars instead of every 50.
DENSE = BacktestConfig(recompute_interval=5)


def weekly_setups(spark, sf):
    return tables.built(spark, sf, "setups_week", lambda: sg.setups(weekly_analysis(spark, sf), CFG))


_LP = "l.price + l.slope * (m.idx - l.anchor_idx)"
SETUPS = f"""st AS (SELECT m.*, avg_volume, bias, (SELECT count(*) FROM levels l WHERE l.symbol = m.symbol AND abs({_LP} - m.close) <= m.close * 0.005) AS nearby,
  CASE WHEN pin_direction = 'LONG' THEN low - (high - low) * 0.1 ELSE high + (high - low) * 0.1 END AS stop,
  CASE WHEN pin_direction = 'LONG' THEN (SELECT min({_LP}) FROM levels l WHERE l.symbol = m.symbol AND {_LP} > m.level_price)
       ELSE (SELECT max({_LP}) FROM levels l WHERE l.symbol = m.symbol AND {_LP} < m.level_price) END AS nxt
  FROM matched m JOIN stats s USING (symbol, timeframe) JOIN bias b USING (symbol, timeframe)),
setups AS MATERIALIZED (SELECT symbol, timeframe, idx, ts, pin_direction AS direction, level_price AS entry, stop, 0.3 AS confluence,
  coalesce(nxt, level_price + 2.0 * (level_price - stop)) AS target, lv_role,
  greatest(0.0, least(1.0, 0.30 * lv_strength + 0.20 * least(wick_ratio / 5.0, 1.0) + 0.15 * least(volume / avg_volume / 2.0, 1.0)
    + 0.20 * CASE WHEN bias IS NULL THEN 0.5 WHEN bias = pin_direction THEN 0.8 ELSE 0.3 END + 0.15 * 0.3)) AS confidence
  FROM st WHERE CASE WHEN pin_direction = 'LONG' THEN level_price > stop ELSE stop > level_price END)"""
_PRE = f"WITH RECURSIVE {bars()}, {ATR}, {LEVELS}, {MATCH}, {BIAS}, {SETUPS}"


@reg.add("e1_setup_confidence", f"{_PRE} SELECT symbol, idx, direction, {rnd('confidence', 6)} AS confidence FROM setups")
def _(spark, sf):
    return pick(weekly_setups(spark, sf), "symbol idx direction", confidence=6)


@reg.add("e2_confluence_score", f"""WITH RECURSIVE {bars()}, {ATR}, {LEVELS}
SELECT b.symbol, b.idx, CASE WHEN count(DISTINCT l.sr_type) <= 1 THEN 0.3 WHEN count(DISTINCT l.sr_type) = 2 THEN 0.6 ELSE 1.0 END AS score
FROM bars b LEFT JOIN levels l ON l.symbol = b.symbol AND abs(l.price + l.slope * (b.idx - l.anchor_idx) - b.close) <= b.close * 0.005
GROUP BY b.symbol, b.idx""")
def _(spark, sf):
    # weekly levels carry no source timeframe, so the level kind plays that part
    from candlemill.operators import levels as lv

    a = weekly_analysis(spark, sf)
    out = lv.level_features(a.flagged, a.levels.withColumn("source_tf", F.col("sr_type")))
    return out.select("symbol", "idx", sg.confluence_score(F.col("num_tf_confluence")).alias("score"))


@reg.add("e3_trade_levels", f"{_PRE} SELECT symbol, idx, direction, {rnd('entry')} AS entry, {rnd('stop')} AS stop, {rnd('target')} AS target FROM setups")
def _(spark, sf):
    return pick(weekly_setups(spark, sf), "symbol idx direction", entry=4, stop=4, target=4)


def signals_sql(conf: float = 0.6, rr: float = 1.5) -> str:
    return f"""signals AS MATERIALIZED (SELECT * FROM setups WHERE confidence >= {conf} AND abs(target - entry) / abs(entry - stop) >= {rr}
  QUALIFY row_number() OVER (PARTITION BY symbol, timeframe, round(entry, 2), direction ORDER BY confidence DESC, idx) = 1)"""


@reg.add("e4_signals", f"{_PRE}, {signals_sql(0.5, 1.0)} SELECT symbol, idx, direction, {rnd('entry')} AS entry, {rnd('confidence', 6)} AS confidence FROM signals")
def _(spark, sf):
    out = sg.choose(weekly_setups(spark, sf), F.lit(0.5), F.lit(1.0), True)
    return pick(out, "symbol idx direction", entry=4, confidence=6)


def dense_setups(spark, sf):
    """Pin-bar setups of every prefix, found once; the backtests below share them."""
    return tables.built(spark, sf, "setups_prefix", lambda: en.setups_at_evals(
        week(spark, sf), sg.pin_bar_emitter(), DENSE, list(KEYS)))


def dense_emitter(spark, sf, conf=0.5, rr=1.0):
    """The pin-bar source over the setups already found for every prefix."""
    return sg.Emitter(lambda bars_, keys: dense_setups(spark, sf).drop("last"), True, conf, rr)


@reg.add("e5_pin_bar_emitter")
def _(spark, sf):
    found = sg.choose(dense_setups(spark, sf), F.lit(0.5), F.lit(1.0), True, [*KEYS, "eval_idx"])
    return pick(found.filter("last"), "symbol eval_idx direction reason", entry=4, stop=4, target=4, confidence=6)


@reg.add("e6_pattern_signals", f"""{ALL}, {LAST} SELECT p.symbol, last_idx AS idx, CASE WHEN bull THEN 'LONG' ELSE 'SHORT' END AS direction, pattern_type,
{rnd('close')} AS entry, {rnd('stop')} AS stop, {rnd('t1')} AS target, {rnd('confidence', 4)} AS confidence
FROM pat p JOIN last_bar USING (symbol) WHERE breakout_idx = last_idx AND confidence >= 0.0 AND rr_ratio >= 0.0""")
def _(spark, sf):
    last = week(spark, sf).filter(F.col("idx") == F.col("n_bars") - 1).select(
        *KEYS, "ts", "close", F.col("idx").alias("last_idx"))
    cfg = PatternSignalConfig(min_confidence=0.0, min_rr=0.0, statuses=("confirmed", "forming"))
    out = sg.from_patterns(all_patterns(spark, sf), last, cfg)
    return pick(out, "symbol idx direction pattern_type", entry=4, stop=4, target=4, confidence=4)


@reg.add("e6_pattern_emitter")
def _(spark, sf):
    found = en.setups_at_evals(week(spark, sf), sg.pattern_emitter(), BT, KEYS)
    out = sg.choose(found, F.lit(0.5), F.lit(1.5), False, [*KEYS, "eval_idx"])
    return pick(out, "symbol eval_idx direction pattern_type", entry=4, stop=4, target=4, confidence=4)


@reg.add("e7_regime_gate", f"""WITH RECURSIVE {bars()}, {ATR}, {LEVELS}, {MATCH}, {BIAS}, {SETUPS}, {signals_sql(0.5, 1.0)}, {REGIME}
SELECT s.symbol, s.idx, direction, regime FROM signals s JOIN regime USING (symbol, timeframe, idx) WHERE regime IN ('range_bound', 'trending_up')""")
def _(spark, sf):
    inner = sg.Emitter(lambda b, k: weekly_setups(spark, sf), True, 0.5, 1.0)
    b = week(spark, sf)
    out = sg.regime_gate(inner, ("range_bound", "trending_up")).emit(b)
    state = ind.with_regime(b).select(*KEYS, "idx", "regime")
    return out.join(state, [*KEYS, "idx"]).select("symbol", "idx", "direction", "regime")


# ---- backtest building blocks on one signal per pin bar, which SQL can state in full ----

SIMPLE = """sig AS MATERIALIZED (SELECT symbol, timeframe, idx AS eval_idx, pin_direction AS direction,
  CASE WHEN pin_direction = 'LONG' THEN close * 0.9 ELSE close * 1.1 END AS entry,
  CASE WHEN pin_direction = 'LONG' THEN low * 0.5 ELSE high * 1.5 END AS stop,
  CASE WHEN pin_direction = 'LONG' THEN close * 1.5 ELSE close * 0.5 END AS target FROM pins),
fill AS MATERIALIZED (SELECT s.*, s.entry * 0.0005 AS slippage_cost,
  CASE WHEN direction = 'LONG' THEN s.entry * 1.0005 ELSE s.entry - s.entry * 0.0005 END AS entry_price
  FROM sig s JOIN bars b ON b.symbol = s.symbol AND b.idx = s.eval_idx
  WHERE CASE WHEN direction = 'LONG' THEN b.low <= s.entry ELSE b.high >= s.entry END)"""
EXITS = """ex AS (SELECT f.symbol, f.eval_idx, min(b.idx) AS hit_idx FROM fill f JOIN bars b ON b.symbol = f.symbol AND b.idx > f.eval_idx
  AND CASE WHEN direction = 'LONG' THEN b.low <= f.stop OR b.high >= f.target ELSE b.high >= f.stop OR b.low <= f.target END GROUP BY ALL),
exq AS (SELECT f.*, hit_idx, b.open AS bo, CASE WHEN direction = 'LONG' THEN b.low <= f.stop ELSE b.high >= f.stop END AS stopped, l.idx AS last_idx, l.close AS last_close
  FROM fill f LEFT JOIN ex USING (symbol, eval_idx) LEFT JOIN bars b ON b.symbol = f.symbol AND b.idx = ex.hit_idx
  JOIN bars l ON l.symbol = f.symbol AND l.idx = l.n_bars - 1),
raw AS (SELECT *, CASE WHEN direction = 'LONG' THEN CASE WHEN stopped THEN least(bo, stop) ELSE greatest(bo, target) END
  ELSE CASE WHEN stopped THEN greatest(bo, stop) ELSE least(bo, target) END END AS raw_exit FROM exq),
out0 AS (SELECT *, CASE WHEN hit_idx IS NULL THEN 'end_of_data' WHEN stopped THEN 'stop_loss' ELSE 'take_profit' END AS exit_reason,
  coalesce(hit_idx, last_idx) AS exit_idx, CASE WHEN hit_idx IS NULL THEN last_close WHEN direction = 'LONG' THEN raw_exit - raw_exit * 0.0005
  ELSE raw_exit + raw_exit * 0.0005 END AS exit_price FROM raw),
trades AS MATERIALIZED (SELECT *, gross_pnl - 5.0 - slippage_cost AS net_pnl, exit_idx - eval_idx AS hold_bars,
  greatest(0.0, CASE WHEN direction = 'LONG' THEN mh - entry_price ELSE entry_price - ml END) AS mfe,
  greatest(0.0, CASE WHEN direction = 'LONG' THEN entry_price - ml ELSE mh - entry_price END) AS mae FROM (
    SELECT *, CASE WHEN direction = 'LONG' THEN exit_price - entry_price ELSE entry_price - exit_price END AS gross_pnl,
      (SELECT max(high) FROM bars b WHERE b.symbol = o.symbol AND b.idx BETWEEN least(o.eval_idx + 1, o.exit_idx) AND o.exit_idx) AS mh,
      (SELECT min(low) FROM bars b WHERE b.symbol = o.symbol AND b.idx BETWEEN least(o.eval_idx + 1, o.exit_idx) AND o.exit_idx) AS ml FROM out0 o))"""


def simple_signals(spark, sf):
    c = F.col("close")
    long = F.col("pin_direction") == "LONG"
    return ind.pin_bars(week(spark, sf)).select(
        *KEYS, F.col("idx").alias("eval_idx"), "ts", F.col("pin_direction").alias("direction"),
        F.when(long, c * 0.9).otherwise(c * 1.1).alias("entry"),
        F.when(long, F.col("low") * 0.5).otherwise(F.col("high") * 1.5).alias("stop"),
        F.when(long, c * 1.5).otherwise(c * 0.5).alias("target"), F.lit(0).alias("ord"),
        F.lit(0.7).alias("confidence"))


def simple_trades(spark, sf):
    def build():
        b = week(spark, sf)
        filled = en.fills(simple_signals(spark, sf), b, BT, KEYS)
        return en.outcomes(filled, b, BT, KEYS, ["eval_idx"])

    return tables.built(spark, sf, "simple_trades", build)


_S = f"WITH {bars()}, {PINS}, {SIMPLE}"


@reg.add("g1_fills", f"{_S} SELECT symbol, eval_idx, direction, {rnd('entry_price')} AS entry_price, {rnd('slippage_cost')} AS slippage_cost FROM fill")
def _(spark, sf):
    out = en.fills(simple_signals(spark, sf), week(spark, sf), BT, KEYS)
    return pick(out, "symbol eval_idx direction", entry_price=4, slippage_cost=4)


@reg.add("g2_exits", f"{_S}, {EXITS} SELECT symbol, eval_idx, exit_idx, exit_reason, {rnd('exit_price')} AS exit_price FROM trades")
def _(spark, sf):
    b = week(spark, sf)
    out = en.outcomes(en.fills(simple_signals(spark, sf), b, BT, KEYS), b, BT, KEYS, ["eval_idx"])
    return pick(out, "symbol eval_idx exit_idx exit_reason", exit_price=4)


@reg.add("g3_excursions", f"{_S}, {EXITS} SELECT symbol, eval_idx, {rnd('mae')} AS mae, {rnd('mfe')} AS mfe FROM trades")
def _(spark, sf):
    return pick(simple_trades(spark, sf), "symbol eval_idx", mae=4, mfe=4)


@reg.add("g4_closed_trades", f"""{_S}, {EXITS} SELECT symbol, eval_idx, {rnd('gross_pnl')} AS gross_pnl, {rnd('net_pnl')} AS net_pnl, hold_bars,
{rnd('abs(entry - stop)')} AS risk, {rnd('abs(target - entry) / abs(entry - stop)', 6)} AS rr_ratio FROM trades""")
def _(spark, sf):
    return pick(simple_trades(spark, sf), "symbol eval_idx hold_bars", gross_pnl=4, net_pnl=4, risk=4, rr_ratio=6)


CURVE = """stp AS (SELECT *, CASE WHEN exit_reason = 'end_of_data' THEN last_idx + row_number() OVER (PARTITION BY symbol, exit_reason ORDER BY eval_idx) ELSE exit_idx END AS pos FROM trades),
dl AS (SELECT symbol, pos, sum(net_pnl) AS delta FROM stp GROUP BY ALL),
gridp AS (SELECT symbol, idx AS pos FROM bars WHERE idx >= 30 UNION SELECT symbol, pos FROM dl WHERE pos >= 30),
curve AS MATERIALIZED (SELECT symbol, pos - 29 AS step, coalesce(delta, 0.0) AS delta,
  10000000.0 + sum(coalesce(delta, 0.0)) OVER (PARTITION BY symbol ORDER BY pos ROWS UNBOUNDED PRECEDING) AS equity
  FROM gridp LEFT JOIN dl USING (symbol, pos))"""
# a capital large enough that the unit-sized trades here never exhaust it
WIDE = BacktestConfig(initial_capital=10_000_000.0)


def _unlimited(spark, sf):
    """Simple trades after the first 30 bars, all admitted."""
    t = simple_trades(spark, sf).filter(F.col("eval_idx") >= WIDE.warmup)
    return en.admit(t.withColumn("ord", F.lit(0)), KEYS, 10**9)


_LATE = EXITS.replace("FROM fill f LEFT JOIN ex", "FROM (SELECT * FROM fill WHERE eval_idx >= 30) f LEFT JOIN ex")


@reg.add("g6_metrics", f"""{_S}, {_LATE}, {CURVE},
pk AS (SELECT *, greatest(10000000.0, max(equity) OVER (PARTITION BY symbol ORDER BY step ROWS UNBOUNDED PRECEDING)) AS peak, delta / (equity - delta) AS ret FROM curve),
eq AS (SELECT symbol, max((peak - equity) / peak) AS dd, coalesce(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252), 0) AS sharpe FROM pk GROUP BY symbol),
agg AS (SELECT symbol, count(*) AS n, count(*) FILTER (WHERE net_pnl > 0) AS won, sum(net_pnl) AS net, coalesce(sum(net_pnl) FILTER (WHERE net_pnl > 0), 0.0) AS w,
  abs(coalesce(sum(net_pnl) FILTER (WHERE net_pnl <= 0), 0.0)) AS l, avg(mae) AS mae, avg(hold_bars) AS hold, max(net_pnl) AS best FROM trades GROUP BY symbol)
SELECT s.symbol, coalesce(n, 0) AS total_trades, coalesce(won, 0) AS winners, {rnd('coalesce(dd, 0.0)', 6)} AS max_drawdown_pct, {rnd('coalesce(sharpe, 0.0)', 5)} AS sharpe_ratio,
{rnd('coalesce(net, 0.0)', 3)} AS total_net_pnl, CASE WHEN l > 0 THEN {rnd('w / l', 5)} WHEN w > 0 THEN CAST('inf' AS DOUBLE) ELSE 0.0 END AS profit_factor,
{rnd('coalesce(mae, 0.0)', 3)} AS avg_mae, {rnd('coalesce(hold, 0.0)', 5)} AS avg_hold_bars, {rnd('coalesce(best, 0.0)', 3)} AS largest_win
FROM (SELECT DISTINCT symbol FROM bars) s LEFT JOIN agg USING (symbol) LEFT JOIN eq USING (symbol)""")
def _(spark, sf):
    out = en.metrics(_unlimited(spark, sf), en.runs_of(week(spark, sf)), KEYS, WIDE)
    return pick(out, "symbol total_trades winners", max_drawdown_pct=6, sharpe_ratio=5, total_net_pnl=3,
                profit_factor=5, avg_mae=3, avg_hold_bars=5, largest_win=3)


@reg.add("g7_equity_curve", f"{_S}, {_LATE}, {CURVE} SELECT symbol, step, {rnd('equity', 3)} AS equity FROM curve")
def _(spark, sf):
    out = en.equity_curve(_unlimited(spark, sf), week(spark, sf), KEYS, KEYS, WIDE)
    return pick(out, "symbol step", equity=3)


@reg.add("g5_backtest")
def _(spark, sf):
    out = en.backtest(week(spark, sf), dense_emitter(spark, sf), DENSE)
    return pick(out, "symbol trade_id direction entry_idx exit_idx exit_reason", entry_price=4, exit_price=4, net_pnl=4, mae=4, mfe=4)


@reg.add("g5_backtest_patterns")
def _(spark, sf):
    cfg = PatternSignalConfig(min_rr=0.0)
    out = en.backtest(week(spark, sf), sg.pattern_emitter(cfg=cfg), BacktestConfig(recompute_interval=10))
    return pick(out, "symbol trade_id direction entry_idx exit_idx exit_reason", entry_price=4, exit_price=4, net_pnl=4)


@reg.add("g8_sweep")
def _(spark, sf):
    out = en.sweep(week(spark, sf), dense_emitter(spark, sf), DENSE)
    return pick(out, "symbol param_id min_confidence min_rr_ratio total_trades", total_net_pnl=4, sharpe_ratio=5, profit_factor=5, max_drawdown_pct=6)


def _fold_sql(mode: str, train: int, test: int, step: int) -> str:
    begin = f"f * {step}" if mode == "rolling" else "0"
    return f"""WITH {bars()}, n AS (SELECT symbol, any_value(n_bars) AS n FROM bars GROUP BY symbol),
f AS (SELECT symbol, n, unnest(range(0, 1000)) AS f FROM n)
SELECT symbol, f AS fold, CAST({begin} AS BIGINT) AS train_start, CAST({train} + f * {step} AS BIGINT) AS train_end, CAST({train} + f * {step} AS BIGINT) AS test_start,
CAST({train + test} + f * {step} AS BIGINT) AS test_end FROM f WHERE {train + test} + f * {step} <= n"""


for _mode in ("anchored", "rolling"):
    reg.add(f"g9_folds_{_mode}", _fold_sql(_mode, 150, 50, 50))(
        lambda spark, sf, m=_mode: en.folds(en.runs_of(week(spark, sf)), WalkForwardConfig(150, 50, 50, m)).drop("timeframe"))


@reg.add("g10_walk_forward")
def _(spark, sf):
    per_fold, _ = en.walk_forward(week(spark, sf), sg.pin_bar_emitter(), DENSE, WalkForwardConfig(150, 100, 100))
    return pick(per_fold, "symbol fold param_id is_total_trades oos_total_trades", is_sharpe_ratio=5, oos_total_net_pnl=4)


@reg.add("g11_portfolio")
def _(spark, sf):
    _, whole = en.portfolio(week(spark, sf), dense_emitter(spark, sf), DENSE)
    return pick(whole, "total_trades", total_net_pnl=4, sharpe_ratio=5, max_drawdown_pct=6, final_equity=4)
