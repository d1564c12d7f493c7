"""Tables of the daily report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlemill.operators.analysis import Analysis
from candlemill.schemas import KEYS


def top_levels(result: Analysis, k: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """The strongest horizontal levels of each series."""
    w = Window.partitionBy(*keys).orderBy(F.col("strength").desc(), "pos")
    flat = result.levels.filter(F.col("sr_type") == "horizontal")
    return flat.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def recent_inside_bars(result: Analysis, last: int = 10) -> DataFrame:
    return result.inside_bars.filter(F.col("idx") >= F.col("n_bars") - last)


def summary(result: Analysis, signals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bias, signal count and recent inside bars per series."""
    keys = list(keys)
    counts = signals.groupBy(*keys).agg(F.count(F.lit(1)).alias("signals"))
    inside = recent_inside_bars(result).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("recent_inside_bars"))
    return (
        result.bias.join(counts, keys, "left").join(inside, keys, "left")
        .fillna(0, ["signals", "recent_inside_bars"])
    )
