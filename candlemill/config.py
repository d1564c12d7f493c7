"""Operator parameters. Defaults are fixed values the results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PinBarConfig:
    min_dominant: float = 0.667
    max_secondary: float = 0.333
    min_wick_body: float = 2.0
    amplitude_lookback: int = 20
    amplitude_min_bars: int = 5
    proximity: float = 0.005


@dataclass(frozen=True)
class HorizontalConfig:
    cluster_atr: float = 0.5
    min_touches: int = 3
    w_touches: float = 0.4
    w_recency: float = 0.3
    w_volume: float = 0.2
    w_round: float = 0.1


@dataclass(frozen=True)
class DiagonalConfig:
    min_points: int = 2
    tolerance_atr: float = 0.3
    slope_tol: float = 0.05
    intercept_atr: float = 0.5
    min_touches: int = 2
    recent_points: int = 20


@dataclass(frozen=True)
class AnalysisConfig:
    pivot_lookback: int = 5
    atr_period: int = 14
    pin: PinBarConfig = PinBarConfig()
    horizontal: HorizontalConfig = HorizontalConfig()
    diagonal: DiagonalConfig = DiagonalConfig()
    line_cluster_atr: float = 0.15
    tick_size: float = 0.25
    min_touches: int = 3
    max_levels: int = 10
    max_diagonals: int = 3
    merge_atr: float = 0.3
    multi_tf_merge_atr: float = 0.5
    clip_margin: float = 0.10
    final_dedup: float = 0.0015


@dataclass(frozen=True)
class SignalConfig:
    min_confidence: float = 0.60
    w_level: float = 0.30
    w_wick: float = 0.20
    w_volume: float = 0.15
    w_trend: float = 0.20
    w_confluence: float = 0.15
    default_rr: float = 2.0
    min_rr: float = 1.5


@dataclass(frozen=True)
class BacktestConfig:
    initial_capital: float = 100_000.0
    recompute_interval: int = 50
    lookback: int = 500
    warmup: int = 30
    slippage: float = 0.0005
    commission: float = 2.50
    max_open: int = 3
    sweep_confidence: tuple[float, ...] = (0.50, 0.55, 0.60, 0.65, 0.70)
    sweep_rr: tuple[float, ...] = (1.0, 1.5, 2.0, 2.5)


@dataclass(frozen=True)
class WalkForwardConfig:
    train: int = 500
    test: int = 100
    step: int = 100
    mode: str = "anchored"
    metric: str = "sharpe_ratio"


@dataclass(frozen=True)
class RegimeConfig:
    sma_period: int = 50
    atr_period: int = 14
    percentile_window: int = 100
    high_vol_percentile: float = 80.0
    adx_period: int = 14
    trend_threshold: float = 25.0


@dataclass(frozen=True)
class PatternSignalConfig:
    min_confidence: float = 0.50
    min_rr: float = 1.5
    statuses: tuple[str, ...] = ("confirmed",)
    wave: str = "wave1"


# Weight of each chart pattern in its score.
PATTERN_WEIGHTS = {
    "false_breakdown": 1.0, "false_breakout": 1.0, "false_breakdown_w_bottom": 0.95,
    "w_bottom": 0.85, "m_top": 0.85, "hs_bottom": 0.80, "hs_top": 0.80, "bull_flag": 0.75,
    "bear_flag": 0.75, "false_breakout_hs": 0.75, "sym_triangle_bottom": 0.65,
    "sym_triangle_top": 0.65,
}


@dataclass(frozen=True)
class PatternConfig:
    weights: dict[str, float] = field(default_factory=lambda: dict(PATTERN_WEIGHTS))
    w_flow: float = 0.25
    w_sector: float = 0.10
    w_pattern: float = 0.65
    strong_buy: float = 0.80
    buy: float = 0.65
    watch: float = 0.50
    volume_mult: float = 1.5
    volume_window: int = 20
    swing_lookback: int = 5
    neckline_tol: float = 0.03
    shoulder_tol: float = 0.05
    min_bars: int = 10
    max_bars: int = 120
    stop_buffer: float = 0.02
    min_daily_bars: int = 60
    recovery_bars: int = 5
    flag_bars: int = 30
