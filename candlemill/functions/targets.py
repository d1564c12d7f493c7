"""Entry, stop and price targets of chart patterns as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plan(entry: Column, stop: Column, first: Column, second: Column | None) -> dict[str, Column]:
    none = F.lit(None).cast("double")
    return {"entry": entry, "stop": stop, "target1": first,
            "target2": none if second is None else second}


def double_bottom(neck: Column, a: Column, b: Column, pad: float = 0.02) -> dict[str, Column]:
    height = neck - (a + b) / 2
    return _plan(neck, neck * (1 - pad), neck + height, neck + height + height)


def double_top(neck: Column, a: Column, b: Column, pad: float = 0.02) -> dict[str, Column]:
    height = (a + b) / 2 - neck
    return _plan(neck, neck * (1 + pad), neck - height, neck - height - height)


def head_shoulders(neck: Column, head: Column, bullish: bool, pad: float = 0.02) -> dict[str, Column]:
    height = F.abs(neck - head)
    if bullish:
        return _plan(neck, neck * (1 - pad), neck + height, neck + height + height)
    return _plan(neck, neck * (1 + pad), neck - height, neck - height - height)


def flag(start: Column, end: Column, turn: Column, bullish: bool, pad: float = 0.02) -> dict[str, Column]:
    """``turn`` is the pullback low of a bull flag or the pullback high of a bear flag."""
    pole = F.abs(end - start)
    if bullish:
        return _plan(end, turn * (1 - pad), turn + pole, None)
    return _plan(end, turn * (1 + pad), turn - pole, None)


def triangle(top: Column, bottom: Column, level: Column, bullish: bool, pad: float = 0.02) -> dict[str, Column]:
    side = top - bottom
    if bullish:
        return _plan(level, level * (1 - pad), level + side, None)
    return _plan(level, level * (1 + pad), level - side, None)


def false_breakdown(
    support: Column, low: Column, neck: Column | None = None, pad: float = 0.02
) -> dict[str, Column]:
    stop = low * (1 - pad)
    if neck is None:
        return _plan(support, stop, support + (support - low) * 2, None)
    height = neck - low
    return _plan(support, stop, neck + height, neck + height + height)


def false_breakout(
    resistance: Column, high: Column, neck: Column | None = None, pad: float = 0.02
) -> dict[str, Column]:
    stop = high * (1 + pad)
    if neck is None:
        return _plan(resistance, stop, resistance - (high - resistance) * 2, None)
    height = high - neck
    return _plan(resistance, stop, neck - height, neck - height - height)


def reward_risk(entry: str = "entry", stop: str = "stop", target: str = "target1") -> dict[str, Column]:
    """``risk_pct``, ``reward_pct`` and ``rr_ratio``; 0 where a divisor is 0."""
    zero = F.lit(0.0)

    def share(x: str) -> Column:
        return F.coalesce(F.try_divide(F.abs(F.col(x) - F.col(entry)), F.abs(F.col(entry))), zero)

    risk, reward = share(stop), share(target)
    return {"risk_pct": risk, "reward_pct": reward,
            "rr_ratio": F.coalesce(F.try_divide(reward, risk), zero)}
