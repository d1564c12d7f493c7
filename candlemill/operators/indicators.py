"""Bar-level indicator columns, as stages that share one blocked window pass."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from candlemill.config import PinBarConfig, RegimeConfig
from candlemill.functions.blocks import BLOCK, Stage, blocked
from candlemill.schemas import KEYS

HORIZONS = (5, 10, 20)
LABEL_MOVE = 0.01


def frame(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the ``n - 1`` rows before it."""
    return w.rowsBetween(-(n - 1), 0)


def compute(
    bars: DataFrame, *stages: Stage, keys: Sequence[str] = KEYS, block: int | None = None
) -> DataFrame:
    return blocked(bars, keys, stages, block=block)


def candle(df: DataFrame) -> DataFrame:
    """Body, wicks and range of each bar (ratios are null on a zero range)."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    rng = h - lo
    return df.withColumns({
        "body_top": F.greatest(o, c),
        "body_bottom": F.least(o, c),
        "body_size": F.abs(c - o),
        "range": rng,
        "upper_wick": h - F.greatest(o, c),
        "lower_wick": F.least(o, c) - lo,
        "body_range_ratio": F.try_divide(F.abs(c - o), rng),
        "close_position": F.try_divide(c - lo, rng),
        "is_bullish": c > o,
    })


def true_range(out: str = "tr") -> Stage:
    def apply(df: DataFrame, w: WindowSpec) -> DataFrame:
        prev = F.lag("close").over(w)
        return df.withColumn(out, F.greatest(
            F.col("high") - F.col("low"),
            F.abs(F.col("high") - prev),
            F.abs(F.col("low") - prev),
        ))

    return Stage(1, 0, apply)


def sma(x: str, n: int, out: str, strict: bool = False) -> Stage:
    """Rolling mean; ``strict`` is null until the frame is full."""

    def apply(df: DataFrame, w: WindowSpec) -> DataFrame:
        mean = F.avg(x).over(frame(w, n))
        if strict:
            mean = F.when(F.count(x).over(frame(w, n)) == n, mean)
        return df.withColumn(out, mean)

    return Stage(n - 1, 0, apply)


def atr(period: int = 14, out: str = "atr") -> list[Stage]:
    return [true_range(), sma("tr", period, out)]


def decay(alpha: float) -> float:
    return -math.log1p(-alpha)


def ema(x: str, alpha: float, out: str, min_periods: int = 1) -> Stage:
    """Recursive mean ``y = (1 - alpha) * y_prev + alpha * x`` with ``y_0 = x_0``.

    Written as a running sum of exponentially scaled terms, so it stays a JVM window. Rows
    further back than 40 time constants weigh less than one ulp.
    """
    rate = decay(alpha)

    def apply(df: DataFrame, w: WindowSpec) -> DataFrame:
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        start = F.first("idx").over(upto)
        return _scaled_mean(df, F.lit(rate), F.lit(alpha), x, out, start, upto, min_periods)

    return Stage(math.ceil(40 / rate), 0, apply)


def _scaled_mean(
    df: DataFrame, rate: Column, alpha: Column, x: str, out: str, start: Column,
    upto: WindowSpec, min_periods: int = 1,
) -> DataFrame:
    coef = F.when(F.col("idx") == 0, F.lit(1.0)).otherwise(alpha)
    df = df.withColumn("_off", (F.col("idx") - start).cast("double") * rate)
    total = F.sum(coef * F.col(x) * F.exp(F.col("_off"))).over(upto)
    value = total * F.exp(-F.col("_off"))
    if min_periods > 1:
        value = F.when(F.col("idx") >= min_periods - 1, value)
    return df.withColumn(out, value).drop("_off")


def ema_block(alpha: float) -> int:
    """Largest block whose exponential scale stays far inside a double."""
    return max(1, int(300 / decay(alpha)))


def ema_table(
    df: DataFrame, x: str, alpha: Column, out: str, keys: Sequence[str]
) -> DataFrame:
    """EMA with a per-row ``alpha``, constant within ``keys`` (for example one per period)."""
    keys = list(keys)
    df = df.withColumns({"_alpha": alpha, "_rate": -F.log1p(-alpha)})
    size, halo = F.ceil(300 / F.col("_rate")), F.ceil(40 / F.col("_rate"))
    home = F.floor(F.col("idx") / size).cast("bigint")
    nxt = F.when(F.pmod(F.col("idx"), size) >= size - halo, home + 1)
    df = df.withColumn("_blk", F.explode(F.array_compact(F.array(home, nxt))))
    upto = (
        Window.partitionBy(*keys, "_blk").orderBy("idx")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    df = _scaled_mean(
        df, F.col("_rate"), F.col("_alpha"), x, out, F.first("idx").over(upto), upto
    )
    return df.filter(home == F.col("_blk")).drop("_blk", "_alpha", "_rate")


def with_adx(
    bars: DataFrame, period: int = 14, keys: Sequence[str] = KEYS, block: int | None = None
) -> DataFrame:
    """Average directional index. Warm-up DX counts as zero in the second smoothing."""
    alpha = 1.0 / period

    def moves(df: DataFrame, w: WindowSpec) -> DataFrame:
        up = F.col("high") - F.lag("high").over(w)
        down = F.lag("low").over(w) - F.col("low")
        df = df.withColumns({"_up": up, "_down": down})
        up, down = F.col("_up"), F.col("_down")
        zero = F.lit(0.0)
        return df.withColumns({
            "_plus": F.when((up > down) & (up > 0), up).otherwise(zero),
            "_minus": F.when((down > up) & (down > 0), down).otherwise(zero),
        })

    def directional(df: DataFrame, w: WindowSpec) -> DataFrame:
        plus = F.try_divide(100 * F.col("_sp"), F.col("_str"))
        minus = F.try_divide(100 * F.col("_sm"), F.col("_str"))
        dx = F.try_divide(100 * F.abs(plus - minus), plus + minus)
        return df.withColumn("_dx", F.coalesce(dx, F.lit(0.0)))

    size = min(block or BLOCK, ema_block(alpha))
    out = compute(
        bars, true_range("_tr"), Stage(1, 0, moves),
        ema("_tr", alpha, "_str", period), ema("_plus", alpha, "_sp", period),
        ema("_minus", alpha, "_sm", period), Stage(0, 0, directional),
        ema("_dx", alpha, "adx", period), keys=keys, block=size,
    )
    return out.withColumn("adx", F.coalesce("adx", F.lit(0.0))).drop(
        "_tr", "_up", "_down", "_plus", "_minus", "_str", "_sp", "_sm", "_dx"
    )


def percentile_rank(x: str, n: int, out: str) -> Stage:
    """Average-rank percentile of the current value within its trailing ``n`` rows."""

    def apply(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = df.withColumn("_vals", F.collect_list(x).over(frame(w, n)))
        vals, cur = F.col("_vals"), F.col(x)
        less = F.size(F.filter(vals, lambda v: v < cur))
        same = F.size(F.filter(vals, lambda v: v == cur))
        pct = F.try_divide(less + (same + 1) / 2.0, F.size(vals))
        return df.withColumn(out, F.coalesce(pct, F.lit(0.5))).drop("_vals")

    return Stage(n - 1, 0, apply)


def pct_change(k: int, out: str) -> Stage:
    def apply(df: DataFrame, w: WindowSpec) -> DataFrame:
        change = F.try_divide(F.col("close"), F.lag("close", k).over(w)) - 1
        return df.withColumn(out, F.coalesce(change, F.lit(0.0)))

    return Stage(k, 0, apply)


def volume_ratio(n: int = 20, out: str = "volume_ratio") -> Stage:
    def apply(df: DataFrame, w: WindowSpec) -> DataFrame:
        mean = F.avg("volume").over(frame(w, n))
        return df.withColumn(out, F.try_divide(F.col("volume"), mean))

    return Stage(n - 1, 0, apply)


def volatility(n: int = 20, out: str = "rolling_volatility_20") -> list[Stage]:
    """Sample deviation of one-bar returns; 0 while undefined."""

    def apply(df: DataFrame, w: WindowSpec) -> DataFrame:
        dev = F.stddev_samp("return_1bar").over(frame(w, n))
        return df.withColumn(out, F.coalesce(dev, F.lit(0.0)))

    return [pct_change(1, "return_1bar"), Stage(n - 1, 0, apply)]


def diff(x: str, k: int, out: str, fill: float | None = None) -> Stage:
    def apply(df: DataFrame, w: WindowSpec) -> DataFrame:
        value = F.col(x) - F.lag(x, k).over(w)
        if fill is not None:
            value = F.coalesce(value, F.lit(fill))
        return df.withColumn(out, value)

    return Stage(k, 0, apply)


def sma_slope(n: int = 50, out: str = "sma_50_slope") -> list[Stage]:
    return [sma("close", n, "_sma"), diff("_sma", 1, out, 0.0)]


def sma_bias(n: int = 50, out: str = "sma_bias") -> list[Stage]:
    """Sign of the strict mean's move over 9 bars, for series of ``n + 10`` bars or more."""

    def apply(df: DataFrame, w: WindowSpec) -> DataFrame:
        move = F.col("_sma") - F.lag("_sma", 9).over(w)
        side = F.when(move > 0, "LONG").when(move < 0, "SHORT")
        return df.withColumn(out, F.when(F.col("idx") >= n + 9, side)).drop("_sma")

    return [sma("close", n, "_sma", strict=True), Stage(9, 0, apply)]


def atr_ratio(n: int = 20) -> list[Stage]:
    def apply(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumns({
            "atr_ratio": F.try_divide(F.col("atr"), F.avg("atr").over(frame(w, n))),
            "range_vs_atr": F.try_divide(F.col("high") - F.col("low"), F.col("atr")),
        })

    return [*atr(14, "atr"), Stage(n - 1, 0, apply)]


def inside_bar_flag() -> Stage:
    """``compression`` of bars whose range lies within the bar before; null elsewhere."""

    def apply(df: DataFrame, w: WindowSpec) -> DataFrame:
        top, bottom = F.lag("high").over(w), F.lag("low").over(w)
        inside = (F.col("high") <= top) & (F.col("low") >= bottom) & (top != bottom)
        ratio = F.try_divide(F.col("high") - F.col("low"), top - bottom)
        return df.withColumns({
            "mother_high": top, "mother_low": bottom, "compression": F.when(inside, ratio),
        })

    return Stage(1, 0, apply)


def inside_bars(bars: DataFrame, keys: Sequence[str] = KEYS, block: int | None = None) -> DataFrame:
    out = compute(bars, inside_bar_flag(), keys=keys, block=block)
    return out.filter(F.col("compression").isNotNull()).withColumn("mother_idx", F.col("idx") - 1)


def pin_bar_flag(cfg: PinBarConfig = PinBarConfig()) -> Stage:
    """``pin_direction`` and ``wick_ratio`` of rejection candles; null elsewhere."""

    def apply(df: DataFrame, w: WindowSpec) -> DataFrame:
        o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
        rng = h - lo
        recent = w.rowsBetween(-cfg.amplitude_lookback, -1)
        df = df.withColumns({
            "_up": h - F.greatest(o, c),
            "_dn": F.least(o, c) - lo,
            "_body": F.when(F.abs(c - o) > 0, F.abs(c - o)).otherwise(rng * 0.01),
            "_med": F.percentile(rng, F.lit(0.5)).over(recent),
            "_cnt": F.count(rng).over(recent),
        })
        up, dn, body = F.col("_up"), F.col("_dn"), F.col("_body")
        major, minor = F.greatest(up, dn), F.least(up, dn)
        bull = (dn > up) & (F.try_divide(dn, body) >= cfg.min_wick_body)
        bear = (up > dn) & (F.try_divide(up, body) >= cfg.min_wick_body)
        mid = (h + lo) / 2
        valid = (
            (F.col("idx") > 0) & (rng != 0)
            & (F.try_divide(major, rng) >= cfg.min_dominant)
            & ((major <= 0) | (F.try_divide(minor, major) <= cfg.max_secondary))
            & ((F.col("_cnt") < cfg.amplitude_min_bars) | (rng >= F.col("_med")))
        )
        long_ok = valid & bull & (F.least(o, c) >= mid)
        short_ok = valid & bear & (F.greatest(o, c) <= mid)
        return df.withColumns({
            "pin_direction": F.when(long_ok, "LONG").when(short_ok, "SHORT"),
            "wick_ratio": F.when(long_ok, F.try_divide(dn, body))
                           .when(short_ok, F.try_divide(up, body)),
        }).drop("_up", "_dn", "_body", "_med", "_cnt")

    return Stage(cfg.amplitude_lookback, 0, apply)


def pin_bars(
    bars: DataFrame, cfg: PinBarConfig = PinBarConfig(), keys: Sequence[str] = KEYS,
    block: int | None = None,
) -> DataFrame:
    out = compute(bars, pin_bar_flag(cfg), keys=keys, block=block)
    return out.filter(F.col("pin_direction").isNotNull()).withColumn(
        "tip", F.when(F.col("pin_direction") == "LONG", F.col("low")).otherwise(F.col("high"))
    )


def volume_price(n: int = 20) -> Stage:
    """Volume-price class of every bar as if it were the last one."""

    def apply(df: DataFrame, w: WindowSpec) -> DataFrame:
        ref = F.first("close").over(w.rowsBetween(-n, 0))
        mean = F.coalesce(F.avg("volume").over(w.rowsBetween(-n, -1)), F.col("volume"))
        df = df.withColumns({
            "_up": F.col("close") >= ref,
            "vp_ratio": F.when(mean > 0, F.try_divide(F.col("volume"), mean)).otherwise(1.0),
        })
        loud = F.col("vp_ratio") >= 1.0
        side = F.when(F.col("_up"), "price_up_").otherwise("price_down_")
        return df.withColumns({
            "vp_type": F.concat(side, F.when(loud, "vol_up").otherwise("vol_down")),
            "vp_divergence": ~loud,
        }).drop("_up")

    return Stage(n, 0, apply)


def forward_labels(horizons: Sequence[int] = HORIZONS, move: float = LABEL_MOVE) -> Stage:
    def apply(df: DataFrame, w: WindowSpec) -> DataFrame:
        for h in horizons:
            ahead = F.lead("close", h).over(w)
            ret = F.try_divide(ahead - F.col("close"), F.col("close"))
            df = df.withColumn(f"fwd_return_{h}d", ret)
        return df.withColumns({
            f"label_{h}d": F.when(F.col(f"fwd_return_{h}d") > move, 1.0)
                            .when(F.col(f"fwd_return_{h}d") < -move, 0.0)
            for h in horizons
        })

    return Stage(0, max(horizons), apply)


def with_regime(
    bars: DataFrame, cfg: RegimeConfig = RegimeConfig(), keys: Sequence[str] = KEYS,
    block: int | None = None,
) -> DataFrame:
    """Regime label of every bar from its own past only."""
    out = with_adx(bars, cfg.adx_period, keys=keys, block=block)
    out = compute(
        out, *atr(cfg.atr_period, "atr"), percentile_rank("atr", cfg.percentile_window, "atr_pct"),
        *sma_slope(cfg.sma_period, "sma_slope"), keys=keys, block=block,
    )
    trending = F.col("adx") >= cfg.trend_threshold
    return out.withColumn(
        "regime",
        F.when((F.col("atr_pct") * 100 > cfg.high_vol_percentile) & ~trending, "high_volatility")
        .when(trending & (F.col("sma_slope") > 0), "trending_up")
        .when(trending, "trending_down")
        .otherwise("range_bound"),
    ).drop("tr", "_sma")


def regime_at(regimes: DataFrame, points: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Regime at given ``idx`` values; positions past the end take the last bar."""
    keys = list(keys)
    last = regimes.groupBy(*keys).agg(F.max("idx").alias("_last"))
    at = points.join(last, keys).withColumn("_at", F.least("idx", "_last")).drop("_last")
    state = regimes.select(*keys, F.col("idx").alias("_at"), "regime")
    return at.join(state, keys + ["_at"]).drop("_at")
