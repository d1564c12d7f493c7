"""SQL text shared by the reference answers, in the dialect of the checking engine."""

from __future__ import annotations


def nudge(digits: int) -> float:
    """Shift that moves exact decimal ties off the rounding boundary on both sides alike."""
    return float(f"3e-{digits + 4}")


def rnd(expr: str, digits: int = 4) -> str:
    return f"(round({expr} + {nudge(digits)!r}, {digits}) + 0.0)"


_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _line_bars(symbol: str, unit: str, timeframe: str, join: str = "") -> str:
    return f"""
  SELECT {symbol} AS symbol, '{timeframe}' AS timeframe,
         CAST(date_trunc('{unit}', l_shipdate) AS TIMESTAMP) AS ts,
         first(l_extendedprice / l_quantity ORDER BY {_ORDER}) AS open,
         max(l_extendedprice / l_quantity) AS high,
         min(l_extendedprice / l_quantity) AS low,
         last(l_extendedprice / l_quantity ORDER BY {_ORDER}) AS close,
         sum(l_quantity) AS volume
  FROM lineitem {join} GROUP BY ALL"""


_PART = "JOIN part ON l_partkey = p_partkey"

RAW = {
    "week": _line_bars("p_brand", "week", "1w", _PART),
    "day": _line_bars("p_brand", "day", "1d", _PART),
    "month": _line_bars("'S' || l_suppkey", "month", "1mo"),
    "hour": """
  SELECT event_type AS symbol, '1h' AS timeframe,
         CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts,
         first(value ORDER BY events.ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY events.ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY ALL""",
}


def bars(name: str = "week", alias: str = "bars") -> str:
    """CTE list giving a bar table with idx and n_bars."""
    return f"""{alias}_raw AS MATERIALIZED ({RAW[name]}),
{alias} AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts) - 1 AS idx,
         count(*) OVER (PARTITION BY symbol, timeframe) AS n_bars
  FROM {alias}_raw)"""


W = "PARTITION BY symbol, timeframe ORDER BY idx"

ATR = f"""tr AS (
  SELECT *, greatest(high - low, abs(high - lag(close) OVER ({W})),
                     abs(low - lag(close) OVER ({W}))) AS tr FROM bars),
atr AS MATERIALIZED (
  SELECT *, avg(tr) OVER ({W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr FROM tr)"""

PIVOTS = f"""pv AS (
  SELECT *, max(high) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS hb,
         max(high) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ha,
         min(low) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS lb,
         min(low) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS la FROM bars),
pivots AS MATERIALIZED (
  SELECT symbol, timeframe, idx, ts, high AS price, true AS is_high, volume FROM pv
  WHERE idx >= 5 AND idx < n_bars - 5 AND high > hb AND high > ha
  UNION ALL
  SELECT symbol, timeframe, idx, ts, low AS price, false AS is_high, volume FROM pv
  WHERE idx >= 5 AND idx < n_bars - 5 AND low < lb AND low < la)"""

PINS = f"""pm AS (
  SELECT *, high - greatest(open, close) AS uw, least(open, close) - low AS lw, high - low AS rng,
         CASE WHEN abs(close - open) > 0 THEN abs(close - open) ELSE (high - low) * 0.01 END AS body,
         median(high - low) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS med
  FROM bars),
pins AS MATERIALIZED (
  SELECT symbol, timeframe, idx, ts, open, high, low, close, volume, n_bars,
         CASE WHEN lw > uw THEN 'LONG' ELSE 'SHORT' END AS pin_direction,
         greatest(lw, uw) / body AS wick_ratio,
         CASE WHEN lw > uw THEN low ELSE high END AS tip
  FROM pm
  WHERE idx > 0 AND rng <> 0 AND lw <> uw
    AND greatest(lw, uw) / rng >= 0.667 AND least(lw, uw) / greatest(lw, uw) <= 0.333
    AND greatest(lw, uw) / body >= 2.0 AND (least(idx, 20) < 5 OR rng >= med)
    AND CASE WHEN lw > uw THEN least(open, close) >= (high + low) / 2
             ELSE greatest(open, close) <= (high + low) / 2 END)"""
