"""Ordered computation over long series without one task per series.

A plain ``Window.partitionBy(symbol)`` puts a whole series into one task, so one symbol that
holds a third of all rows stalls the job. Here a series is cut into blocks of consecutive bars:

* ``with_index``  numbers the bars of each series from per-bucket counts;
* ``blocked``     runs bounded-frame windows per block, each block carrying the few rows before
                  and after it that the frames reach;
* ``running``     runs unbounded scans as block partials, a scan over the block summaries, and
                  a combine.

All three are exact for any block size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

BLOCK = 4096


def with_index(
    df: DataFrame, keys: Sequence[str], order: str = "ts", bucket: str | None = "year",
    out: str = "idx", size: str = "n_bars", ts: str = "ts",
) -> DataFrame:
    """Add the 0-based position ``out`` and the row count ``size`` per series.

    Positions come from the counts of calendar buckets plus the row number inside a bucket, so
    the largest sort unit is one bucket of one series. ``bucket=None`` numbers in one window;
    use it only for series of bounded length.
    """
    keys = list(keys)
    if bucket is None:
        w = Window.partitionBy(*keys)
        return df.withColumns({
            out: (F.row_number().over(w.orderBy(order)) - 1).cast("bigint"),
            size: F.count(F.lit(1)).over(w),
        })
    df = df.withColumn("_b", F.date_trunc(bucket, F.col(ts)).cast("timestamp_ntz"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn(size, F.sum("_n").over(Window.partitionBy(*keys)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(order)
    return (
        df.join(sizes, keys + ["_b"])
        .withColumn(out, (F.col("_off") + F.row_number().over(inside) - 1).cast("bigint"))
        .drop("_b", "_off")
    )


@dataclass(frozen=True)
class Stage:
    """A bounded-frame step: reads ``back`` rows before and ``ahead`` rows after each bar."""

    back: int
    ahead: int
    apply: Callable[[DataFrame, WindowSpec], DataFrame]


def blocked(
    df: DataFrame, keys: Sequence[str], stages: Sequence[Stage], block: int | None = None,
    idx: str = "idx",
) -> DataFrame:
    """Apply ``stages`` in order over blocks of ``idx``; one shuffle for all of them."""
    keys = list(keys)
    back = sum(s.back for s in stages)
    ahead = sum(s.ahead for s in stages)
    size = max(block or BLOCK, back, ahead, 1)
    i = F.col(idx)
    home = F.floor(i / size).cast("bigint")
    spots = [home]
    if back:
        spots.append(F.when(F.pmod(i, F.lit(size)) >= size - back, home + 1))
    if ahead:
        spots.append(F.when((F.pmod(i, F.lit(size)) < ahead) & (home > 0), home - 1))
    if len(spots) == 1:
        out = df.withColumn("_blk", home)
    else:
        out = df.withColumn("_blk", F.explode(F.array_compact(F.array(*spots))))
    w = Window.partitionBy(*keys, "_blk").orderBy(idx)
    for stage in stages:
        out = stage.apply(out, w)
    if len(spots) > 1:
        out = out.filter(home == F.col("_blk"))
    return out.drop("_blk")


def running(
    df: DataFrame, keys: Sequence[str], specs: dict[str, tuple[str, Column | str]],
    order: str = "idx", block: int | None = None, inclusive: bool = True,
) -> DataFrame:
    """Scans from the start of each series, as new columns.

    ``specs`` maps a column to ``(kind, expr)`` with kind ``sum``, ``count``, ``max``, ``min``
    or ``last`` (latest non-null). ``inclusive=False`` stops before the current row. ``order``
    must be an integer that is unique within a series.
    """
    keys = list(keys)
    size = block or BLOCK
    fold = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    out = df.withColumn("_blk", F.floor(F.col(order) / size).cast("bigint"))
    for name, (kind, expr) in specs.items():
        expr = F.col(expr) if isinstance(expr, str) else expr
        if kind == "count":
            expr = F.when(expr, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
        out = out.withColumn(f"_x_{name}", expr)

    summary = []
    for name, (kind, _) in specs.items():
        x = F.col(f"_x_{name}")
        if kind == "last":
            summary.append(F.max_by(x, F.when(x.isNotNull(), F.col(order))).alias(f"_s_{name}"))
        else:
            summary.append(fold[kind](x).alias(f"_s_{name}"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = out.groupBy(*keys, "_blk").agg(*summary)
    for name, (kind, _) in specs.items():
        s = F.col(f"_s_{name}")
        value = F.last(s, ignorenulls=True) if kind == "last" else fold[kind](s)
        carried = carried.withColumn(f"_c_{name}", value.over(before)).drop(f"_s_{name}")

    inside = (
        Window.partitionBy(*keys, "_blk").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    out = out.join(carried, keys + ["_blk"])
    for name, (kind, _) in specs.items():
        x, c = F.col(f"_x_{name}"), F.col(f"_c_{name}")
        if kind == "last":
            value = F.coalesce(F.last(x, ignorenulls=True).over(inside), c)
        elif kind in ("sum", "count"):
            here = F.sum(x).over(inside)
            value = F.coalesce(here + F.coalesce(c, F.lit(0)), here, c)
            if kind == "count" or not inclusive:
                value = F.coalesce(value, F.lit(0))
        elif kind == "max":
            value = F.greatest(F.max(x).over(inside), c)
        else:
            value = F.least(F.min(x).over(inside), c)
        out = out.withColumn(name, value)
    drops = ["_blk"] + [f"_x_{n}" for n in specs] + [f"_c_{n}" for n in specs]
    return out.drop(*drops)
