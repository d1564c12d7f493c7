"""Bar tables, indicators and structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlemill.operators import indicators as ind
from candlemill.operators import structure as st
from candlemill.plans.oracle import ATR, PINS, PIVOTS, W, bars, rnd
from candlemill.plans.registry import Registry, pick, r
from candlemill.sources import tables

reg = Registry()


def week(spark: SparkSession, sf: str) -> DataFrame:
    return tables.indexed(spark, sf, "week")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Pin bars with ATR, straight from the order lines."""
    from candlemill.functions.blocks import with_index
    from candlemill.schemas import KEYS

    raw = with_index(tables.brand_bars_raw(spark, sf, "week"), KEYS)
    out = ind.compute(raw, *ind.atr(), ind.pin_bar_flag())
    out = out.filter(F.col("pin_direction").isNotNull())
    return pick(out, "symbol ts idx pin_direction", atr=4, wick_ratio=4)


_BARS_OUT = """SELECT symbol, timeframe, ts, open, high, low, close, CAST(volume AS DOUBLE) AS volume
FROM b"""
for _name, _build in (
    ("week", lambda s, d: tables.brand_bars_raw(s, d, "week")),
    ("day", lambda s, d: tables.brand_bars_raw(s, d, "day")),
    ("month", tables.supplier_prices_raw),
    ("hour", tables.event_bars_raw),
):
    from candlemill.plans.oracle import RAW

    reg.add(f"a0_bars_{_name}", f"WITH b AS ({RAW[_name]}) {_BARS_OUT}")(_build)


@reg.add("a0_bar_index", f"""WITH {bars()} SELECT symbol, timeframe, ts, idx, n_bars FROM bars""")
def _(spark, sf):
    return week(spark, sf).select("symbol", "timeframe", "ts", "idx", "n_bars")


reg.add("b0_pin_bars_with_atr", f"""WITH {bars()}, {ATR}, {PINS}
SELECT p.symbol, p.ts, p.idx, pin_direction, {rnd('atr')} AS atr, {rnd('wick_ratio')} AS wick_ratio
FROM pins p JOIN atr USING (symbol, timeframe, idx)""")(flagship)


@reg.add("b1_candle", f"""WITH {bars()} SELECT symbol, ts, greatest(open, close) AS body_top,
least(open, close) AS body_bottom, {rnd('abs(close - open)')} AS body_size,
{rnd('high - low')} AS "range", {rnd('high - greatest(open, close)')} AS upper_wick,
{rnd('least(open, close) - low')} AS lower_wick, close > open AS is_bullish FROM bars""")
def _(spark, sf):
    return pick(ind.candle(week(spark, sf)), "symbol ts body_top body_bottom is_bullish",
                body_size=4, range=4, upper_wick=4, lower_wick=4)


@reg.add("b2_atr", f"WITH {bars()}, {ATR} SELECT symbol, ts, {rnd('tr')} AS tr, {rnd('atr')} AS atr FROM atr")
def _(spark, sf):
    return pick(ind.compute(week(spark, sf), *ind.atr()), "symbol ts", tr=4, atr=4)


@reg.add("b3_sma", f"""WITH {bars()} SELECT symbol, ts,
CASE WHEN idx >= 19 THEN {rnd(f'avg(close) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)')} END AS sma_strict,
{rnd(f'avg(close) OVER ({W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)')} AS sma_lenient FROM bars""")
def _(spark, sf):
    out = ind.compute(week(spark, sf), ind.sma("close", 20, "sma_strict", strict=True),
                      ind.sma("close", 50, "sma_lenient"))
    return pick(out, "symbol ts", sma_strict=4, sma_lenient=4)


def ema_sql(x: str, alpha: float, where: str = "") -> str:
    """Closed form of the recursive mean over short series."""
    rate = ind.decay(alpha)
    return (
        f"sum(CASE WHEN idx = 0 THEN 1.0 ELSE {alpha!r} END * {x} * exp(idx * {rate!r})) "
        f"OVER ({W} ROWS UNBOUNDED PRECEDING) * exp(-idx * {rate!r})"
    )


@reg.add("b4_ema", f"""WITH {bars()} SELECT symbol, ts, {rnd(ema_sql('close', 2 / 14), 3)} AS ema_13,
{rnd(ema_sql('close', 2 / 51), 3)} AS ema_50, {rnd(ema_sql('close', 1 / 14), 3)} AS wilder_14 FROM bars""")
def _(spark, sf):
    out = week(spark, sf)
    for alpha, name in ((2 / 14, "ema_13"), (2 / 51, "ema_50"), (1 / 14, "wilder_14")):
        out = ind.compute(out, ind.ema("close", alpha, name), block=ind.ema_block(alpha))
    return pick(out, "symbol ts", ema_13=3, ema_50=3, wilder_14=3)


_A = 1 / 14
ADX = f"""mv AS (SELECT *, high - lag(high) OVER ({W}) AS up, lag(low) OVER ({W}) - low AS dn FROM tr),
dm AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS pdm,
              CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS mdm FROM mv),
sm AS (SELECT *, {ema_sql('tr', _A)} AS str, {ema_sql('pdm', _A)} AS sp, {ema_sql('mdm', _A)} AS smm FROM dm),
dx AS (SELECT *, CASE WHEN idx < 13 OR str = 0 OR sp + smm = 0 THEN 0.0
              ELSE 100 * abs(100 * sp / str - 100 * smm / str) / (100 * sp / str + 100 * smm / str) END AS dx FROM sm),
adx AS MATERIALIZED (SELECT *, CASE WHEN idx < 13 THEN 0.0 ELSE {ema_sql('dx', _A)} END AS adx FROM dx)"""

PCT = f"""pl AS (SELECT *, list(atr) OVER ({W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS vals,
  avg(close) OVER ({W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS sma50 FROM atr),
pct AS MATERIALIZED (SELECT *, (len(list_filter(vals, lambda v: v < atr))
   + (len(list_filter(vals, lambda v: v = atr)) + 1) / 2.0) / len(vals) AS atr_pct,
   coalesce(sma50 - lag(sma50) OVER ({W}), 0.0) AS slope FROM pl)"""

REGIME = f"""{ADX}, {PCT},
regime AS MATERIALIZED (SELECT p.symbol, p.timeframe, p.idx, p.ts, a.adx, p.atr_pct, p.slope,
  CASE WHEN atr_pct * 100 > 80 AND adx < 25 THEN 'high_volatility'
       WHEN adx >= 25 AND slope > 0 THEN 'trending_up' WHEN adx >= 25 THEN 'trending_down'
       ELSE 'range_bound' END AS regime
  FROM pct p JOIN adx a USING (symbol, timeframe, idx))"""


@reg.add("b5_adx", f"WITH {bars()}, {ATR}, {ADX} SELECT symbol, ts, {rnd('adx')} AS adx FROM adx")
def _(spark, sf):
    return pick(ind.with_adx(week(spark, sf)), "symbol ts", adx=4)


@reg.add("b6_atr_percentile", f"WITH {bars()}, {ATR}, {PCT} SELECT symbol, ts, {rnd('atr_pct', 6)} AS atr_pct FROM pct")
def _(spark, sf):
    out = ind.compute(week(spark, sf), *ind.atr(), ind.percentile_rank("atr", 100, "atr_pct"))
    return pick(out, "symbol ts", atr_pct=6)


def _lag(k: int) -> str:
    return f"coalesce(close / lag(close, {k}) OVER ({W}) - 1, 0.0)"


@reg.add("b7_pct_change", f"""WITH {bars()} SELECT symbol, ts, {rnd(_lag(1), 6)} AS return_1bar,
{rnd(_lag(5), 6)} AS return_5bar FROM bars""")
def _(spark, sf):
    out = ind.compute(week(spark, sf), ind.pct_change(1, "return_1bar"), ind.pct_change(5, "return_5bar"))
    return pick(out, "symbol ts", return_1bar=6, return_5bar=6)


@reg.add("b8_volume_ratio", f"""WITH {bars()} SELECT symbol, ts,
{rnd(f'volume / avg(volume) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)', 6)} AS volume_ratio FROM bars""")
def _(spark, sf):
    return pick(ind.compute(week(spark, sf), ind.volume_ratio()), "symbol ts", volume_ratio=6)


@reg.add("b9_volatility", f"""WITH {bars()}, ret AS (SELECT *, {_lag(1)} AS ret FROM bars)
SELECT symbol, ts, {rnd(f'coalesce(stddev_samp(ret) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0.0)', 6)}
AS rolling_volatility_20 FROM ret""")
def _(spark, sf):
    return pick(ind.compute(week(spark, sf), *ind.volatility()), "symbol ts", rolling_volatility_20=6)


SMA_BIAS = f"""sb AS (SELECT *, CASE WHEN idx >= 49 THEN avg(close) OVER
  ({W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END AS s50 FROM bars),
sbias AS MATERIALIZED (SELECT symbol, timeframe, idx, ts, n_bars, CASE WHEN idx < 59 THEN NULL
  WHEN s50 - lag(s50, 9) OVER ({W}) > 0 THEN 'LONG'
  WHEN s50 - lag(s50, 9) OVER ({W}) < 0 THEN 'SHORT' END AS sma_bias FROM sb)"""


@reg.add("b10_sma_slope", f"""WITH {bars()}, {ATR}, {PCT}, {SMA_BIAS}
SELECT p.symbol, p.ts, {rnd('slope')} AS sma_50_slope, sma_bias FROM pct p JOIN sbias USING (symbol, timeframe, idx)""")
def _(spark, sf):
    out = ind.compute(week(spark, sf), *ind.sma_slope(), *ind.sma_bias())
    return pick(out, "symbol ts sma_bias", sma_50_slope=4)


@reg.add("b11_atr_ratio", f"""WITH {bars()}, {ATR} SELECT symbol, ts,
{rnd(f'atr / avg(atr) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)', 6)} AS atr_ratio,
{rnd('(high - low) / atr', 6)} AS range_vs_atr FROM atr""")
def _(spark, sf):
    return pick(ind.compute(week(spark, sf), *ind.atr_ratio()), "symbol ts", atr_ratio=6, range_vs_atr=6)


INSIDE = f"""ib AS (SELECT *, lag(high) OVER ({W}) AS mh, lag(low) OVER ({W}) AS ml FROM bars),
inside AS MATERIALIZED (SELECT *, (high - low) / (mh - ml) AS compression FROM ib
  WHERE high <= mh AND low >= ml AND mh <> ml)"""


@reg.add("b12_inside_bars", f"""WITH {bars()}, {INSIDE} SELECT symbol, ts, idx, idx - 1 AS mother_idx,
mh AS mother_high, ml AS mother_low, {rnd('compression', 6)} AS compression FROM inside""")
def _(spark, sf):
    return pick(ind.inside_bars(week(spark, sf)), "symbol ts idx mother_idx mother_high mother_low",
                compression=6)


@reg.add("b13_pin_bars", f"""WITH {bars()}, {PINS} SELECT symbol, ts, idx, pin_direction, tip,
{rnd('wick_ratio')} AS wick_ratio FROM pins""")
def _(spark, sf):
    return pick(ind.pin_bars(week(spark, sf)), "symbol ts idx pin_direction tip", wick_ratio=4)


@reg.add("b14_pivots", f"WITH {bars()}, {PIVOTS} SELECT symbol, ts, idx, price, is_high FROM pivots")
def _(spark, sf):
    return st.pivots(week(spark, sf)).select("symbol", "ts", "idx", "price", "is_high")


SWINGS = PIVOTS + """,
swings AS MATERIALIZED (
  SELECT symbol, timeframe, idx, ts, high AS price, true AS is_high, n_bars,
         CASE WHEN idx < n_bars - 5 THEN 5 ELSE 4 END AS strength FROM pv
  WHERE idx >= 5 AND idx < n_bars - 2 AND high > hb AND high > ha
  UNION ALL
  SELECT symbol, timeframe, idx, ts, low, false, n_bars, CASE WHEN idx < n_bars - 5 THEN 5 ELSE 4 END FROM pv
  WHERE idx >= 5 AND idx < n_bars - 2 AND low < lb AND low < la)"""


@reg.add("b15_swing_points", f"""WITH {bars()}, {SWINGS}
SELECT symbol, ts, idx, price, is_high, CAST(strength AS BIGINT) AS strength FROM swings""")
def _(spark, sf):
    out = st.swing_points(week(spark, sf))
    return out.select("symbol", "ts", "idx", "price", "is_high", F.col("strength").cast("bigint").alias("strength"))


@reg.add("b16_regime", f"WITH {bars()}, {ATR}, {REGIME} SELECT symbol, ts, regime FROM regime")
def _(spark, sf):
    return ind.with_regime(week(spark, sf)).select("symbol", "ts", "regime")


@reg.add("b17_regime_at_pins", f"""WITH {bars()}, {ATR}, {REGIME}, {PINS}
SELECT p.symbol, p.idx, pin_direction, regime FROM pins p JOIN regime USING (symbol, timeframe, idx)""")
def _(spark, sf):
    b = week(spark, sf)
    points = ind.pin_bars(b).select("symbol", "timeframe", "idx", "pin_direction")
    out = ind.regime_at(ind.with_regime(b).select("symbol", "timeframe", "idx", "regime"), points)
    return out.select("symbol", "idx", "pin_direction", "regime")


@reg.add("b18_bars_since_swing", f"""WITH {bars()}, {PIVOTS}
SELECT symbol, ts,
  coalesce(idx - (SELECT max(idx) FROM pivots p WHERE p.symbol = b.symbol AND p.idx <= b.idx AND is_high), n_bars) AS bars_since_swing_high,
  coalesce(idx - (SELECT max(idx) FROM pivots p WHERE p.symbol = b.symbol AND p.idx <= b.idx AND NOT is_high), n_bars) AS bars_since_swing_low
FROM bars b""")
def _(spark, sf):
    b = week(spark, sf)
    out = st.bars_since_swing(b, st.pivots(b))
    return out.select("symbol", "ts", "bars_since_swing_high", "bars_since_swing_low")


@reg.add("b19_closing_runs", f"""WITH {bars()}, {PIVOTS},
s AS (SELECT *, row_number() OVER (PARTITION BY symbol, is_high ORDER BY idx) AS seq,
  lag(price) OVER (PARTITION BY symbol, is_high ORDER BY idx) AS prev FROM pivots),
g AS (SELECT symbol, is_high, max(seq) - max(seq) FILTER (WHERE prev IS NULL
  OR (is_high AND price <= prev) OR (NOT is_high AND price >= prev)) AS run FROM s GROUP BY ALL)
SELECT symbol, coalesce(max(run) FILTER (WHERE is_high), 0) AS consecutive_higher_highs,
  coalesce(max(run) FILTER (WHERE NOT is_high), 0) AS consecutive_lower_lows FROM g GROUP BY symbol""")
def _(spark, sf):
    return st.closing_runs(st.pivots(week(spark, sf))).drop("timeframe")


BIAS = SMA_BIAS + """,
few AS (SELECT * FROM pivots QUALIFY row_number() OVER (PARTITION BY symbol, timeframe, is_high ORDER BY idx DESC) <= 4),
mv4 AS (SELECT *, sign(price - lag(price) OVER (PARTITION BY symbol, timeframe, is_high ORDER BY idx)) AS mv FROM few),
bs AS (SELECT symbol, timeframe, count(*) FILTER (WHERE mv > 0) AS u, count(*) FILTER (WHERE mv < 0) AS d,
  count(*) FILTER (WHERE is_high) AS nh, count(*) FILTER (WHERE NOT is_high) AS nl FROM mv4 GROUP BY ALL),
bias AS MATERIALIZED (SELECT s.symbol, s.timeframe, CASE WHEN NOT (nh >= 2 AND nl >= 2) THEN NULL WHEN u > d THEN 'LONG'
  WHEN d > u THEN 'SHORT' ELSE sma_bias END AS bias
  FROM sbias s LEFT JOIN bs USING (symbol, timeframe) WHERE s.idx = s.n_bars - 1)"""


@reg.add("b20_bias", f"WITH {bars()}, {PIVOTS}, {BIAS} SELECT symbol, bias FROM bias")
def _(spark, sf):
    b = week(spark, sf)
    return st.bias(b, st.pivots(b)).select("symbol", "bias")


VOLPRICE = f"""vp0 AS (SELECT symbol, timeframe, idx, ts, n_bars, close, volume,
  first_value(close) OVER ({W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS ref,
  coalesce(avg(volume) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), volume) AS mv FROM bars),
vp AS MATERIALIZED (SELECT *, volume / mv AS vp_ratio, volume / mv < 1 AS vp_divergence,
  CASE WHEN close >= ref THEN 'price_up_' ELSE 'price_down_' END ||
  CASE WHEN volume / mv >= 1 THEN 'vol_up' ELSE 'vol_down' END AS vp_type FROM vp0)"""


@reg.add("b21_volume_price", f"""WITH {bars()}, {VOLPRICE}
SELECT symbol, ts, vp_type, vp_divergence, {rnd('vp_ratio', 6)} AS vp_ratio FROM vp""")
def _(spark, sf):
    return pick(ind.compute(week(spark, sf), ind.volume_price()), "symbol ts vp_type vp_divergence", vp_ratio=6)


def _fwd(h: int) -> str:
    return f"((lead(close, {h}) OVER ({W}) - close) / close)"


@reg.add("b22_forward_labels", "WITH " + bars() + " SELECT symbol, ts, " + ", ".join(
    f"{rnd(_fwd(h), 6)} AS fwd_return_{h}d, CASE WHEN {_fwd(h)} > 0.01 THEN 1.0 WHEN {_fwd(h)} < -0.01 "
    f"THEN 0.0 END AS label_{h}d" for h in (5, 10, 20)) + " FROM bars")
def _(spark, sf):
    out = ind.compute(week(spark, sf), ind.forward_labels())
    return pick(out, "symbol ts label_5d label_10d label_20d", fwd_return_5d=6, fwd_return_10d=6, fwd_return_20d=6)
