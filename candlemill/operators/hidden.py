"""Hidden-state regimes: one Gaussian Markov model per series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlemill.functions.blocks import Stage, running
from candlemill.operators import indicators as ind
from candlemill.schemas import KEYS

OBSERVED = ("log_return", "atr_ratio", "adx")


def observations(bars: DataFrame, keys: Sequence[str] = KEYS, block: int | None = None) -> DataFrame:
    """Log return, ATR ratio and ADX per bar; the first bar has none."""

    def returns(df: DataFrame, w) -> DataFrame:
        return df.withColumn("log_return", F.log(F.try_divide(F.col("close"), F.lag("close").over(w))))

    out = ind.compute(ind.with_adx(bars, keys=keys, block=block), *ind.atr_ratio(), Stage(1, 0, returns),
                      keys=keys, block=block)
    fill = F.coalesce("atr_ratio", F.lit(1.0))
    return out.filter(F.col("idx") > 0).withColumns({
        "atr_ratio": fill, "log_return": F.coalesce("log_return", F.lit(0.0)),
    })


def _emission(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    gap = (x[:, None, :] - mean[None]) ** 2 / var[None]
    return -0.5 * (gap + np.log(2 * np.pi * var)[None]).sum(axis=2)


def fit_states(x: np.ndarray, n: int = 3, rounds: int = 200, tol: float = 1e-4, seed: int = 42) -> np.ndarray:
    """Most likely state path of a diagonal Gaussian Markov model fitted to ``x`` (scaled)."""
    rng = np.random.default_rng(seed)
    t = len(x)
    if t < n:
        return np.zeros(t, dtype=int)
    order = np.argsort(x[:, 0], kind="stable")
    mean = np.stack([x[part].mean(axis=0) for part in np.array_split(order, n)])
    mean += rng.normal(scale=1e-3, size=mean.shape)
    var = np.tile(x.var(axis=0) + 1e-2, (n, 1))
    start, move = np.full(n, 1 / n), np.full((n, n), 0.1 / max(n - 1, 1))
    np.fill_diagonal(move, 0.9)
    last = -np.inf
    for _ in range(rounds):
        emit = _emission(x, mean, var)
        shift = emit.max(axis=1, keepdims=True)
        b = np.exp(emit - shift)
        alpha, scale = np.empty((t, n)), np.empty(t)
        alpha[0] = start * b[0]
        scale[0] = alpha[0].sum()
        alpha[0] /= scale[0]
        for i in range(1, t):
            alpha[i] = (alpha[i - 1] @ move) * b[i]
            scale[i] = alpha[i].sum()
            alpha[i] /= scale[i]
        beta = np.ones((t, n))
        for i in range(t - 2, -1, -1):
            beta[i] = move @ (b[i + 1] * beta[i + 1]) / scale[i + 1]
        gamma = alpha * beta
        joint = move * (alpha[:-1].T @ (b[1:] * beta[1:] / scale[1:, None]))
        start = gamma[0] / gamma[0].sum()
        move = joint / np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
        weight = np.maximum(gamma.sum(axis=0), 1e-12)[:, None]
        mean = gamma.T @ x / weight
        var = np.maximum(gamma.T @ (x * x) / weight - mean * mean, 1e-3)
        like = float(np.log(scale).sum() + shift.sum())
        if like - last < tol:
            break
        last = like
    emit, step = _emission(x, mean, var), np.log(np.maximum(move, 1e-300))
    best, back = np.log(np.maximum(start, 1e-300)) + emit[0], np.zeros((t, n), dtype=int)
    for i in range(1, t):
        options = best[:, None] + step
        back[i] = options.argmax(axis=0)
        best = options.max(axis=0) + emit[i]
    path = np.empty(t, dtype=int)
    path[-1] = int(best.argmax())
    for i in range(t - 2, -1, -1):
        path[i] = back[i + 1][path[i + 1]]
    return path


def with_states(obs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Hidden state of each bar, from one model fitted to the whole series.

    A series is one group: a bar has three numbers here, so a million bars are 24 MB.
    """
    keys = list(keys)
    slim = obs.select(*keys, "idx", *OBSERVED)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema) + ", state int"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        x = np.nan_to_num(pdf[list(OBSERVED)].to_numpy(dtype=float), nan=0.0, posinf=0.0, neginf=0.0)
        dev = x.std(axis=0)
        scaled = (x - x.mean(axis=0)) / np.where(dev > 0, dev, 1.0)
        return pdf.assign(state=fit_states(scaled).astype("int32"))

    return slim.groupBy(*keys).applyInPandas(fit, schema)


def to_regimes(states: DataFrame, bars: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Name the states by their mean return and ATR ratio; the first bar takes the second's name."""
    group = list(keys)
    means = states.groupBy(*group, "state").agg(
        F.avg("log_return").alias("_r"), F.avg("atr_ratio").alias("_a"))
    w = Window.partitionBy(*group)
    named = means.withColumns({
        "_top": F.row_number().over(w.orderBy(F.col("_r").desc(), "state")),
        "_low": F.row_number().over(w.orderBy("_r", "state")),
    }).withColumn("regime", F.when(F.col("_low") == 1, "trending_down").when(F.col("_top") == 1, "trending_up")
                  .when(F.col("_a") > 1.3, "high_volatility").otherwise("range_bound"))
    out = states.join(named.select(*group, "state", "regime"), [*group, "state"]).select(*keys, "idx", "regime")
    first = out.filter(F.col("idx") == 1).withColumn("idx", F.lit(0).cast("bigint"))
    return bars.select(*keys, "idx", "ts").join(out.unionByName(first), [*keys, "idx"])


def regime_summary(regimes: DataFrame, keys: Sequence[str] = KEYS, block: int | None = None) -> DataFrame:
    """Bars, share and average run length per series and regime."""
    keys = list(keys)
    prev = running(regimes, keys, {"_prev": ("last", F.col("regime"))}, block=block, inclusive=False)
    starts = (F.col("_prev").isNull() | (F.col("_prev") != F.col("regime"))).cast("int")
    total = Window.partitionBy(*keys)
    return prev.groupBy(*keys, "regime").agg(
        F.count(F.lit(1)).alias("bars"), F.sum(starts).alias("runs")
    ).withColumns({
        "share": F.col("bars") / F.sum("bars").over(total), "avg_duration": F.col("bars") / F.col("runs"),
    })
