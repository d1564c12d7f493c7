"""Trade signals from matched pin bars and from pattern breakouts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlemill.config import (
    AnalysisConfig, PatternConfig, PatternSignalConfig, RegimeConfig, SignalConfig,
)
from candlemill.operators import analysis as an
from candlemill.operators import indicators as ind
from candlemill.operators import levels as lv
from candlemill.operators import patterns as pt
from candlemill.schemas import KEYS

SETUP_COLUMNS = (
    "idx", "ts", "direction", "entry", "stop", "target", "confidence", "filter_rr", "ord",
    "reason", "pattern_type", "level_price", "level_type",
)


def confluence_score(count: Column) -> Column:
    """From the number of distinct timeframes with a level near the price."""
    return F.when(count <= 1, 0.3).when(count == 2, 0.6).otherwise(1.0)


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(x, F.lit(1.0)))


def setups(
    result: an.Analysis, cfg: SignalConfig = SignalConfig(), keys: Sequence[str] = KEYS,
    proximity: float = 0.005,
) -> DataFrame:
    """Every matched pin bar with score, entry, stop and target; nothing is filtered by score."""
    keys = list(keys)
    stats = lv.series_stats(result.flagged, keys).select(*keys, "avg_volume", "sum_volume")
    # A series has its final few levels only; pack them once for both level lookups.
    tf = (F.coalesce("source_tf", F.lit("_local")) if "source_tf" in result.levels.columns
          else F.lit("_local"))
    packed = result.levels.groupBy(*keys).agg(
        F.collect_list(F.struct("price", "slope", "anchor_idx", tf.alias("tf"))).alias("_lv")
    )
    df = result.pin_bars.join(stats, keys).join(result.bias, keys, "left").join(packed, keys)

    def at(x: Column) -> Column:
        return x["price"] + x["slope"] * (F.col("idx") - x["anchor_idx"])

    near = F.filter("_lv", lambda x: F.abs(at(x) - F.col("close")) <= F.col("close") * proximity)
    tfs = F.size(F.array_distinct(F.transform(near, lambda x: x["tf"])))
    long = F.col("pin_direction") == "LONG"
    quiet = (F.col("sum_volume") == 0) | (F.col("avg_volume") == 0)
    volume = F.when(quiet, 0.5).otherwise(
        _unit(F.try_divide(F.try_divide("volume", "avg_volume"), F.lit(2.0)))
    )
    trend = (
        F.when(F.col("bias").isNull(), 0.5).when(F.col("bias") == F.col("pin_direction"), 0.8)
        .otherwise(0.3)
    )
    total = (
        cfg.w_level * F.col("lv_strength") + cfg.w_wick * _unit(F.col("wick_ratio") / 5.0)
        + cfg.w_volume * volume + cfg.w_trend * trend + cfg.w_confluence * confluence_score(tfs)
    )
    pad = (F.col("high") - F.col("low")) * 0.1
    entry = F.col("level_price")
    stop = F.when(long, F.col("low") - pad).otherwise(F.col("high") + pad)
    prices = F.transform("_lv", at)
    above = F.array_min(F.filter(prices, lambda p: p > entry))
    below = F.array_max(F.filter(prices, lambda p: p < entry))
    risk = F.when(long, entry - stop).otherwise(stop - entry)
    target = F.when(long, F.coalesce(above, entry + risk * cfg.default_rr)).otherwise(
        F.coalesce(below, entry - risk * cfg.default_rr)
    )
    reason = F.concat(F.lit("pin_bar_"), F.lower("pin_direction"), F.lit("_at_"), F.col("lv_role"))
    return df.withColumn("_risk", risk).filter(F.col("_risk") > 0).select(
        *keys, "idx", "ts", F.col("pin_direction").alias("direction"), entry.alias("entry"),
        stop.alias("stop"), target.alias("target"), _unit(total).alias("confidence"),
        F.try_divide(F.abs(target - entry), F.abs(entry - stop)).alias("filter_rr"),
        F.lit(0).alias("ord"), reason.alias("reason"),
        F.lit(None).cast("string").alias("pattern_type"),
        F.col("lv_price").alias("level_price"), F.col("lv_sr_type").alias("level_type"),
    )


def choose(
    found: DataFrame, min_confidence: Column, min_rr: Column, dedupe: bool,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Threshold setups, then keep the best per (rounded entry, direction) and series.

    Thresholds apply before the dedupe, so each parameter pair needs its own pass.
    """
    ok = found.filter(
        (F.col("confidence") >= min_confidence)
        & ((F.col("entry") == F.col("stop")) | (F.col("filter_rr") >= min_rr))
    )
    gate = F.col("allowed") if "allowed" in found.columns else F.lit(True)
    if not dedupe:
        return ok.filter(gate)
    w = Window.partitionBy(*keys, F.round("entry", 2), "direction").orderBy(
        F.col("confidence").desc(), "idx"
    )
    return ok.withColumn("_rn", F.row_number().over(w)).filter((F.col("_rn") == 1) & gate).drop("_rn")


def generate(
    result: an.Analysis, cfg: SignalConfig = SignalConfig(), keys: Sequence[str] = KEYS
) -> DataFrame:
    return choose(setups(result, cfg, keys), F.lit(cfg.min_confidence), F.lit(cfg.min_rr), True, keys)


@dataclass(frozen=True)
class Emitter:
    """A signal source: ``setups(bars, keys)`` over whole series or prefixes of series."""

    setups: Callable[[DataFrame, list[str]], DataFrame]
    dedupe: bool
    min_confidence: float
    min_rr: float

    def emit(self, bars: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
        return choose(self.setups(bars, list(keys)), F.lit(self.min_confidence),
                      F.lit(self.min_rr), self.dedupe, keys)


def pin_bar_emitter(
    analysis: AnalysisConfig = AnalysisConfig(), cfg: SignalConfig = SignalConfig()
) -> Emitter:
    def run(bars: DataFrame, keys: list[str]) -> DataFrame:
        return setups(an.analyze(bars, analysis, keys), cfg, keys)

    return Emitter(run, True, cfg.min_confidence, cfg.min_rr)


def from_patterns(
    patterns: DataFrame, last: DataFrame, cfg: PatternSignalConfig = PatternSignalConfig(),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Setups for patterns that break out on the last bar of their series."""
    keys = list(keys)
    target = F.col("target1")
    if cfg.wave == "wave2":
        target = F.coalesce("target2", "target1")
    best = Window.partitionBy(*keys).orderBy(*pt.order_columns())
    fresh = patterns.join(last, keys).filter(
        (F.col("breakout_idx") == F.col("last_idx")) & F.col("status").isin(*cfg.statuses)
    )
    return fresh.select(
        *keys, F.col("last_idx").alias("idx"), "ts",
        F.when(F.col("direction") == "bullish", "LONG").otherwise("SHORT").alias("direction"),
        F.col("close").alias("entry"), "stop", target.alias("target"), "confidence",
        F.col("rr_ratio").alias("filter_rr"), F.row_number().over(best).alias("ord"),
        F.concat(F.lit("pattern_breakout_"), F.col("pattern_type")).alias("reason"),
        "pattern_type", F.lit(None).cast("double").alias("level_price"),
        F.lit(None).cast("string").alias("level_type"),
    )


def pattern_emitter(
    patterns: PatternConfig = PatternConfig(), cfg: PatternSignalConfig = PatternSignalConfig()
) -> Emitter:
    def run(bars: DataFrame, keys: list[str]) -> DataFrame:
        last = bars.filter(F.col("idx") == F.col("n_bars") - 1).select(
            *keys, "ts", "close", F.col("idx").alias("last_idx")
        )
        return from_patterns(pt.detect(bars, patterns, keys=keys), last, cfg, keys)

    # A pattern's own reward to risk decides, also where entry equals stop.
    return Emitter(run, False, cfg.min_confidence, cfg.min_rr)


def regime_gate(
    inner: Emitter, allowed: Sequence[str], cfg: RegimeConfig = RegimeConfig()
) -> Emitter:
    """Pass the inner source's signals whose bar is in an allowed regime of the same series.

    The gate comes after the inner source's own dedupe, so it rides along as ``allowed``.
    """

    def run(bars: DataFrame, keys: list[str]) -> DataFrame:
        state = ind.with_regime(bars, cfg, keys).select(*keys, "idx", "regime")
        found = inner.setups(bars, keys).join(state, keys + ["idx"])
        return found.withColumn("allowed", F.col("regime").isin(*allowed)).drop("regime")

    return Emitter(run, inner.dedupe, inner.min_confidence, inner.min_rr)
