"""Explicit schemas of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("symbol", "timeframe")
OHLCV = ("open", "high", "low", "close", "volume")


def _struct(text: str) -> T.StructType:
    fields = []
    for part in text.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, _KINDS[kind]))
    return T.StructType(fields)


_KINDS = {
    "string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(),
    "int": T.IntegerType(), "date": T.DateType(), "boolean": T.BooleanType(),
    "ts": T.TimestampNTZType(), "names": T.ArrayType(T.StringType()),
}

BARS = _struct(
    "symbol string, timeframe string, ts ts, open double, high double, low double,"
    " close double, volume double"
)
DAILY_PRICES = _struct(
    "symbol string, date date, open double, high double, low double, close double, volume bigint"
)
RANKINGS = _struct(
    "captured_at ts, capture_session string, data_date date, view_type string, ranking_type string,"
    " symbol string, rank int, daily_change int, sector string, industry string, long_short string"
)
FLOWS = _struct(
    "symbol string, captured_at ts, flow_date date, period_type string, week_start date,"
    " week_end date, direction string, long_short string, rank int, rank_total int"
)
READINGS = _struct(
    "monitor string, field string, recorded_at ts, value double"
)
ALERTS = _struct(
    "monitor string, field string, recorded_at ts, severity string, message string, value double"
)

TIMEFRAMES = ("1w", "1d", "4h", "1h", "30m", "15m", "5m", "1m")  # coarse to fine
DIRECTIONS = ("LONG", "SHORT")
ROLES = ("support", "resistance")
REGIMES = ("trending_up", "trending_down", "range_bound", "high_volatility")


def check_enum(col: Column | str, allowed: tuple[str, ...]) -> Column:
    """The value itself, or a query failure when it is outside ``allowed``."""
    col = F.col(col) if isinstance(col, str) else col
    bad = F.raise_error(F.concat(F.lit("unexpected value: "), col))
    return F.when(col.isNull() | col.isin(*allowed), col).otherwise(bad)


def timeframe_rank(col: Column | str) -> Column:
    """0 for the coarsest timeframe; unknown or missing ones rank last."""
    col = F.col(col) if isinstance(col, str) else col
    rank = F.lit(len(TIMEFRAMES))
    for position, name in enumerate(TIMEFRAMES):
        rank = F.when(col == name, F.lit(position)).otherwise(rank)
    return rank
