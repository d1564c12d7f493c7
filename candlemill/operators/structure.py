"""Pivots, swing points and the trend structure read from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from candlemill.functions.blocks import Stage, blocked, running, with_index
from candlemill.operators.indicators import sma_bias
from candlemill.schemas import KEYS


def extreme_flags(lookback: int = 5) -> Stage:
    """``_peak``/``_trough``: strictly beyond every other bar within ``lookback`` either side."""

    def apply(df: DataFrame, w: WindowSpec) -> DataFrame:
        back, ahead = w.rowsBetween(-lookback, -1), w.rowsBetween(1, lookback)
        high, low = F.col("high"), F.col("low")
        return df.withColumns({
            "_peak": (high > F.max("high").over(back)) & (high > F.max("high").over(ahead)),
            "_trough": (low < F.min("low").over(back)) & (low < F.min("low").over(ahead)),
        })

    return Stage(lookback, lookback, apply)


def _points(flagged: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """One row per peak and per trough."""
    sides = F.array_compact(F.array(
        F.when(F.col("_peak"), F.struct(F.lit(True).alias("is_high"), F.col("high").alias("price"))),
        F.when(F.col("_trough"), F.struct(F.lit(False).alias("is_high"), F.col("low").alias("price"))),
    ))
    return flagged.select(
        *keys, "idx", "ts", *extra, "n_bars", F.inline(sides)
    )


def pivots(
    bars: DataFrame, lookback: int = 5, keys: Sequence[str] = KEYS, block: int | None = None
) -> DataFrame:
    """Confirmed pivots only: ``lookback`` bars exist on both sides."""
    flagged = blocked(bars, keys, [extreme_flags(lookback)], block=block)
    inner = (F.col("idx") >= lookback) & (F.col("idx") < F.col("n_bars") - lookback)
    return _points(flagged.filter(inner), list(keys), ["volume"])


def swing_points(
    bars: DataFrame, lookback: int = 5, min_right: int = 2, keys: Sequence[str] = KEYS,
    block: int | None = None,
) -> DataFrame:
    """Pivots plus provisional ones near the right edge, with ``strength`` one lower."""
    flagged = blocked(bars, keys, [extreme_flags(lookback)], block=block)
    seen = (F.col("idx") >= lookback) & (F.col("idx") < F.col("n_bars") - min_right)
    strength = F.when(F.col("idx") < F.col("n_bars") - lookback, lookback).otherwise(lookback - 1)
    flagged = flagged.filter(seen).withColumn("strength", strength)
    return _points(flagged, list(keys), ["strength"])


def numbered(points: DataFrame, keys: Sequence[str] = KEYS, bucket: str | None = "year") -> DataFrame:
    """Add ``seq`` and ``n_side``: position and count within (series, side)."""
    return with_index(points, [*keys, "is_high"], "idx", bucket, out="seq", size="n_side")


def bars_since_swing(
    bars: DataFrame, points: DataFrame, keys: Sequence[str] = KEYS, block: int | None = None
) -> DataFrame:
    """Bars since the latest pivot of each side; the series length before the first one.

    A pivot is only knowable ``lookback`` bars later, so this looks ahead by that much.
    """
    keys = list(keys)
    marks = points.groupBy(*keys, "idx").agg(
        F.bool_or("is_high").alias("_h"), F.bool_or(~F.col("is_high")).alias("_l")
    )
    out = running(
        bars.join(marks, keys + ["idx"], "left"), keys,
        {"_lh": ("last", F.when(F.col("_h"), F.col("idx"))),
         "_ll": ("last", F.when(F.col("_l"), F.col("idx")))},
        block=block,
    )
    return out.withColumns({
        "bars_since_swing_high": F.coalesce(F.col("idx") - F.col("_lh"), F.col("n_bars")),
        "bars_since_swing_low": F.coalesce(F.col("idx") - F.col("_ll"), F.col("n_bars")),
    }).drop("_h", "_l", "_lh", "_ll")


def closing_runs(
    points: DataFrame, keys: Sequence[str] = KEYS, bucket: str | None = "year",
    block: int | None = None,
) -> DataFrame:
    """Length of the run of higher highs and of lower lows that ends each series."""

    def steps(df: DataFrame, w: WindowSpec) -> DataFrame:
        prev = F.lag("price").over(w)
        going = F.when(F.col("is_high"), F.col("price") > prev).otherwise(F.col("price") < prev)
        return df.withColumn("_on", F.coalesce(going, F.lit(False)))

    keys = list(keys)
    out = blocked(
        numbered(points, keys, bucket), [*keys, "is_high"], [Stage(1, 0, steps)], block, "seq"
    )
    run = F.max("seq") - F.max(F.when(~F.col("_on"), F.col("seq")))
    sides = out.groupBy(*keys, "is_high").agg(run.alias("_run"))
    return sides.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("is_high"), F.col("_run"))), F.lit(0))
         .alias("consecutive_higher_highs"),
        F.coalesce(F.max(F.when(~F.col("is_high"), F.col("_run"))), F.lit(0))
         .alias("consecutive_lower_lows"),
    )


def bias(
    bars: DataFrame, points: DataFrame, recent: int = 4, keys: Sequence[str] = KEYS,
    block: int | None = None,
) -> DataFrame:
    """LONG, SHORT or null per series, from its last pivots; the mean's slope breaks ties."""
    keys = list(keys)
    latest = Window.partitionBy(*keys, "is_high").orderBy(F.col("idx").desc())
    inside = Window.partitionBy(*keys, "is_high").orderBy("idx")
    few = (
        points.withColumn("_rn", F.row_number().over(latest)).filter(F.col("_rn") <= recent)
        .withColumn("_move", F.signum(F.col("price") - F.lag("price").over(inside)))
    )
    score = few.groupBy(*keys).agg(
        F.count_if(F.col("_move") > 0).alias("_up"),
        F.count_if(F.col("_move") < 0).alias("_down"),
        F.count_if("is_high").alias("_nh"), F.count_if(~F.col("is_high")).alias("_nl"),
    )
    slope = (
        blocked(bars, keys, sma_bias(), block=block)
        .filter(F.col("idx") == F.col("n_bars") - 1).select(*keys, "sma_bias")
    )
    enough = (F.col("_nh") >= 2) & (F.col("_nl") >= 2)
    side = (
        F.when(F.col("_up") > F.col("_down"), "LONG")
        .when(F.col("_down") > F.col("_up"), "SHORT")
        .otherwise(F.col("sma_bias"))
    )
    return slope.join(score, keys, "left").select(*keys, F.when(enough, side).alias("bias"))
