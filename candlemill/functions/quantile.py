"""Exact medians without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, width: float, out: str = "median"
) -> DataFrame:
    """Median of ``value`` per key.

    Counts per cell of ``width`` combine map-side; only the one or two cells that hold the
    middle are sorted.
    """
    keys = list(keys)
    df = df.filter(F.col(value).isNotNull()).withColumn("_cell", F.floor(F.col(value) / width))
    w = Window.partitionBy(*keys).orderBy("_cell")
    cells = df.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n")).withColumns({
        "_upto": F.sum("_n").over(w),
        "_all": F.sum("_n").over(Window.partitionBy(*keys)),
    })
    lo, hi = F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2)
    before = F.col("_upto") - F.col("_n")
    middle = cells.filter((hi > before) & (lo <= F.col("_upto"))).withColumn("_before", before)
    inside = Window.partitionBy(*keys, "_cell").orderBy(value)
    placed = df.join(middle, keys + ["_cell"]).withColumn(
        "_at", F.row_number().over(inside) + F.col("_before")
    )
    return (
        placed.filter((F.col("_at") == lo) | (F.col("_at") == hi))
        .groupBy(*keys).agg(F.avg(value).alias(out))
    )
