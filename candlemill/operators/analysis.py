"""The single- and multi-timeframe analysis of a bar table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.config import AnalysisConfig
from candlemill.operators import indicators as ind
from candlemill.operators import levels as lv
from candlemill.operators import structure as st
from candlemill.schemas import KEYS, timeframe_rank
from candlemill.session import materialize


@dataclass(frozen=True)
class Analysis:
    """Result tables, keyed by series; nothing is collected."""

    pivots: DataFrame
    levels: DataFrame
    pin_bars: DataFrame
    inside_bars: DataFrame
    bias: DataFrame
    flagged: DataFrame


def flag_bars(
    bars: DataFrame, cfg: AnalysisConfig, keys: Sequence[str], block: int | None
) -> DataFrame:
    """ATR, pin-bar, inside-bar and pivot flags in one shuffle."""
    return ind.compute(
        bars, *ind.atr(cfg.atr_period), ind.pin_bar_flag(cfg.pin), ind.inside_bar_flag(),
        st.extreme_flags(cfg.pivot_lookback), keys=keys, block=block,
    ).filter(F.col("n_bars") >= 2)


def _pivots(flagged: DataFrame, cfg: AnalysisConfig, keys: list[str]) -> DataFrame:
    inner = (F.col("idx") >= cfg.pivot_lookback) & (
        F.col("idx") < F.col("n_bars") - cfg.pivot_lookback
    )
    return st._points(flagged.filter(inner), keys, ["volume"])


def _pins(flagged: DataFrame) -> DataFrame:
    tip = F.when(F.col("pin_direction") == "LONG", F.col("low")).otherwise(F.col("high"))
    return flagged.filter(F.col("pin_direction").isNotNull()).withColumn("tip", tip)


def own_levels(
    pins: DataFrame, points: DataFrame, stats: DataFrame, cfg: AnalysisConfig,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Pin-bar lines first, then pivot levels away from them; the strongest few."""
    merged = lv.merge_levels(
        lv.pin_bar_lines(pins, stats, cfg, keys),
        lv.horizontal_levels(points, stats, cfg.horizontal, keys),
        stats, cfg.merge_atr, keys,
    )
    return lv.top_levels(merged, cfg.max_levels, keys)


def own_diagonals(
    points: DataFrame, stats: DataFrame, cfg: AnalysisConfig, keys: Sequence[str] = KEYS
) -> DataFrame:
    lines = lv.diagonal_lines(points, stats, cfg.diagonal, keys)
    # The dedupe walks by strength, so the first it keeps are the strongest it would keep.
    return lv.dedupe_diagonals(lines, stats, cfg.diagonal, keys, cfg.max_diagonals).drop("i1")


def _finish(
    horizontal: DataFrame, diagonal: DataFrame | None, stats: DataFrame, cfg: AnalysisConfig,
    keys: list[str],
) -> DataFrame:
    """Clip to the visible range, thin by touches, append diagonals."""
    flat = lv.dedupe_by_touches(
        lv.clip_to_range(horizontal, stats, cfg.clip_margin, keys), stats, cfg.final_dedup, keys
    )
    if "source_tf" not in flat.columns:
        flat = flat.withColumn("source_tf", F.lit(None).cast("string"))
    cols = [*keys, "pos", *lv.LEVEL_COLUMNS, "source_tf"]
    if diagonal is None:
        return flat.select(*cols)
    sloped = (
        lv.clip_to_range(diagonal, stats, cfg.clip_margin, keys)
        .withColumn("source_tf", F.lit(None).cast("string"))
        .withColumn("pos", F.col("pos") + 1_000_000)  # after every horizontal level
    )
    return flat.select(*cols).unionByName(sloped.select(*cols))


def analyze(
    bars: DataFrame, cfg: AnalysisConfig = AnalysisConfig(), keys: Sequence[str] = KEYS,
    block: int | None = None, staged: bool = True,
) -> Analysis:
    """Pivots, levels, matched pin bars, inside bars and bias of every series.

    ``staged`` writes the flagged bars and the final levels once, because several branches
    read them.
    """
    keys = list(keys)
    stage = materialize if staged else (lambda df, name: df)
    flagged = stage(flag_bars(bars, cfg, keys, block), "flagged")
    points, pins = _pivots(flagged, cfg, keys), _pins(flagged)
    stats = lv.series_stats(flagged, keys)
    levels = stage(_finish(
        own_levels(pins, points, stats, cfg, keys), own_diagonals(points, stats, cfg, keys),
        stats, cfg, keys,
    ), "levels")
    return Analysis(
        pivots=points, levels=levels,
        pin_bars=lv.match_pins(pins, levels, cfg.pin.proximity, keys),
        inside_bars=flagged.filter(F.col("compression").isNotNull()),
        bias=st.bias(flagged, points, keys=keys, block=block), flagged=flagged,
    )


def analyze_timeframes(
    bars: DataFrame, trading_tf: str, cfg: AnalysisConfig = AnalysisConfig(),
    block: int | None = None,
) -> Analysis:
    """Levels come from the coarser timeframes only and are applied to ``trading_tf``."""
    keys = list(KEYS)
    flagged = materialize(flag_bars(bars, cfg, keys, block), "flagged")
    coarser = timeframe_rank("timeframe") < timeframe_rank(F.lit(trading_tf))
    high = flagged.filter(coarser)
    trade = flagged.filter(F.col("timeframe") == trading_tf)
    stats = lv.series_stats(high, keys)
    per_tf = own_levels(_pins(high), _pivots(high, cfg, keys), stats, cfg, keys).withColumn(
        "source_tf", F.col("timeframe")
    )
    trade_stats = lv.series_stats(trade, keys)
    near = trade_stats.select(
        "symbol", (F.col("avg_atr") * cfg.multi_tf_merge_atr).alias("_near")
    )
    merged = lv.merge_timeframes(per_tf, near).withColumn("timeframe", F.lit(trading_tf))
    levels = materialize(_finish(merged, None, trade_stats, cfg, keys), "levels")
    points, pins = _pivots(trade, cfg, keys), _pins(trade)
    return Analysis(
        pivots=points, levels=levels,
        pin_bars=lv.match_pins(pins, levels, cfg.pin.proximity, keys),
        inside_bars=trade.filter(F.col("compression").isNotNull()),
        bias=st.bias(trade, points, block=block), flagged=trade,
    )
