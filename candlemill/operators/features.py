"""Per-bar feature frame, labels and the feature store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlemill.config import AnalysisConfig, RegimeConfig
from candlemill.operators import analysis as an
from candlemill.operators import indicators as ind
from candlemill.operators import levels as lv
from candlemill.operators import structure as st
from candlemill.schemas import KEYS, REGIMES

META = ("symbol", "timeframe", "ts", "idx", "n_bars", "close", "volume")
MIN_BARS = 100
# What a missing feature becomes; all others become 0.
DEFAULTS = {
    "body_range_ratio": 0.5, "close_position": 0.5, "atr_ratio": 1.0, "range_vs_atr": 1.0,
    "volume_ratio": 0.5, "dist_nearest_support": 0.1, "dist_nearest_resistance": 0.1,
    "pinbar_sr_distance": 1.0, "atr_percentile": 0.5,
}
BAR_FEATURES = (
    "body_size", "range", "body_range_ratio", "upper_wick", "lower_wick", "close_position",
    "is_bullish", "atr_14", "atr_ratio", "range_vs_atr", "is_inside_bar", "inside_bar_compression",
    "sma_50_slope", "return_1bar", "return_5bar", "volume_ratio", "rolling_volatility_20",
)
PIN_FEATURES = ("is_pinbar", "pinbar_wick_ratio", "pinbar_direction", "pinbar_sr_distance", "pinbar_sr_strength")
LEVEL_FEATURES = ("dist_nearest_support", "dist_nearest_resistance", "nearest_sr_strength",
                  "nearest_sr_touches", "levels_within_1atr", "num_tf_confluence")
TREND_FEATURES = ("higher_tf_bias", "bars_since_swing_high", "bars_since_swing_low",
                  "consecutive_higher_highs", "consecutive_lower_lows")
REGIME_FEATURES = ("atr_percentile", "adx", *[f"regime_{r}" for r in REGIMES])
FEATURES = (*BAR_FEATURES, *PIN_FEATURES, *LEVEL_FEATURES, *TREND_FEATURES, *REGIME_FEATURES)


def bar_features(flagged: DataFrame, keys: Sequence[str] = KEYS, block: int | None = None) -> DataFrame:
    """Candle, volatility, inside-bar and rolling columns, in one shuffle."""
    out = ind.compute(
        ind.candle(flagged), *ind.atr_ratio(), *ind.sma_slope(), *ind.volatility(),
        ind.pct_change(5, "return_5bar"), ind.volume_ratio(), keys=keys, block=block,
    )
    return out.withColumns({
        "is_bullish": F.col("is_bullish").cast("double"), "atr_14": F.col("atr"),
        "is_inside_bar": F.col("compression").isNotNull().cast("double"),
        "inside_bar_compression": F.coalesce("compression", F.lit(0.0)),
    })


def pin_features(df: DataFrame, pins: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Flags and attributes of matched pin bars on their bars; defaults elsewhere."""
    keys = list(keys)
    side = pins.select(
        *keys, "idx", F.lit(1.0).alias("is_pinbar"), F.col("wick_ratio").alias("pinbar_wick_ratio"),
        F.when(F.col("pin_direction") == "LONG", 1.0).otherwise(-1.0).alias("pinbar_direction"),
        F.col("sr_distance").alias("pinbar_sr_distance"), F.col("lv_strength").alias("pinbar_sr_strength"),
    )
    return df.join(side, keys + ["idx"], "left").fillna({
        c: DEFAULTS.get(c, 0.0) for c in PIN_FEATURES})


def regime_features(
    df: DataFrame, cfg: RegimeConfig = RegimeConfig(), keys: Sequence[str] = KEYS,
    block: int | None = None,
) -> DataFrame:
    out = ind.with_regime(df, cfg, keys, block).withColumnRenamed("atr_pct", "atr_percentile")
    return out.withColumns({
        f"regime_{r}": (F.col("regime") == r).cast("double") for r in REGIMES
    })


def extract(
    result: an.Analysis, keys: Sequence[str] = KEYS, block: int | None = None
) -> DataFrame:
    """The full feature frame of every bar; no feature is null."""
    keys = list(keys)
    df = regime_features(bar_features(result.flagged, keys, block), keys=keys, block=block)
    df = pin_features(df, result.pin_bars, keys)
    df = lv.level_features(df, result.levels, keys)
    df = st.bars_since_swing(df, result.pivots, keys, block)
    df = df.join(st.closing_runs(result.pivots, keys, block=block), keys, "left").join(result.bias, keys, "left")
    side = F.when(F.col("bias") == "LONG", 1.0).when(F.col("bias") == "SHORT", -1.0).otherwise(0.0)
    df = df.withColumn("higher_tf_bias", side)
    meta = [c for c in dict.fromkeys((*keys, *META)) if c in df.columns]
    df = df.select(*meta, *[F.col(c).cast("double").alias(c) for c in FEATURES])
    return df.fillna({c: DEFAULTS.get(c, 0.0) for c in FEATURES})


def null_count(df: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """One row: how many of ``columns`` are null anywhere (0 for a clean frame)."""
    bad = sum((F.col(c).isNull().cast("bigint") for c in columns), F.lit(0))
    return df.agg(F.coalesce(F.sum(bad), F.lit(0)).alias("nulls"), F.count(F.lit(1)).alias("rows"))


def training_frame(
    bars: DataFrame, cfg: AnalysisConfig = AnalysisConfig(), keys: Sequence[str] = KEYS,
    min_bars: int = MIN_BARS, block: int | None = None,
) -> DataFrame:
    """Features and forward labels of every series with at least ``min_bars`` bars."""
    enough = bars.filter(F.col("n_bars") >= min_bars)
    features = extract(an.analyze(enough, cfg, keys, block), keys, block)
    labels = ind.compute(enough, ind.forward_labels(), keys=keys, block=block)
    names = [c for c in labels.columns if c.startswith(("fwd_return_", "label_"))]
    return features.join(labels.select(*keys, "idx", *names), [*keys, "idx"])


def export(frame: DataFrame, path: str) -> None:
    """Write a training frame partitioned by symbol."""
    by_year = frame.repartition("symbol", F.year("ts"))  # several writers per symbol, few files each
    by_year.write.mode("overwrite").partitionBy("symbol").parquet(path)


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in META and not c.startswith(("label_", "fwd_return_"))]


def profile(frame: DataFrame) -> DataFrame:
    """One row: size, range, nulls, label coverage and positive rate, from one aggregate."""
    features = feature_columns(frame)
    labels = [c for c in frame.columns if c.startswith("label_")]
    nulls = sum((F.col(c).isNull().cast("bigint") for c in features), F.lit(0))
    per_symbol = frame.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("_n"), F.min("ts").alias("_a"), F.max("ts").alias("_b"),
        F.sum(nulls).alias("_nulls"), *[F.count(c).alias(f"_c_{c}") for c in labels],
        *[F.sum(c).alias(f"_s_{c}") for c in labels])
    return per_symbol.agg(
        F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("symbols"), F.lit(len(features)).alias("features"),
        F.min("_a").alias("first_ts"), F.max("_b").alias("last_ts"), F.sum("_nulls").alias("feature_nulls"),
        *[F.try_divide(F.sum(f"_c_{c}"), F.sum("_n")).alias(f"{c}_coverage") for c in labels],
        *[F.try_divide(F.sum(f"_s_{c}"), F.sum(f"_c_{c}")).alias(f"{c}_positive") for c in labels])


def trade_labels(trades: DataFrame, exclude_end: bool = True) -> DataFrame:
    """1 for a target hit, 0 for a stop; trades cut by the end of data by profit sign, if kept."""
    reason = F.col("exit_reason")
    soft = reason == "end_of_data"
    label = (
        F.when(reason == "take_profit", 1).when(reason == "stop_loss", 0)
        .when(soft, (F.col("net_pnl") > 0).cast("int"))
    )
    out = trades.withColumns({"label": label, "is_soft_label": soft}).filter(F.col("label").isNotNull())
    return out.filter(~soft) if exclude_end else out


def label_summary(labels: DataFrame) -> DataFrame:
    return labels.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("label") == 1).alias("positive"),
        F.count_if(F.col("label") == 0).alias("negative"), F.count_if("is_soft_label").alias("soft"),
        F.avg("label").alias("positive_rate"))


def ordered_rows(df: DataFrame, order: Sequence[Column | str], bucket: Column) -> DataFrame:
    """``row`` (0-based global position) and ``n_rows``.

    ``bucket`` is a coarse prefix of the order with bounded size (a day, a symbol); positions
    are bucket offsets plus the row number inside a bucket, so no task sorts the whole table.
    """
    df = df.withColumn("_b", bucket)
    sizes = df.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumns({
        "_off": F.coalesce(F.sum("_n").over(w), F.lit(0)), "n_rows": F.sum("_n").over(Window.partitionBy()),
    }).drop("_n")
    inside = Window.partitionBy("_b").orderBy(*order)
    return df.join(offsets, "_b").withColumn(
        "row", F.col("_off") + F.row_number().over(inside) - 1).drop("_b", "_off")
