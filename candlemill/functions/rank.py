"""Ranks of large groups without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_descending(
    df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[Column | str],
    cell: Column, out: str = "rank", size: str = "size",
) -> DataFrame:
    """Position by falling ``value`` (then ``ties``) within ``keys``, and the group's size.

    ``cell`` is any non-decreasing function of ``value``. Cells are counted map-side; a row's
    rank is the rows in higher cells plus its row number inside its own cell.
    """
    keys = list(keys)
    df = df.withColumn("_cell", cell)
    above = Window.partitionBy(*keys).orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n")).withColumns({
        "_above": F.coalesce(F.sum("_n").over(above), F.lit(0)),
        size: F.sum("_n").over(Window.partitionBy(*keys)),
    }).drop("_n")
    inside = Window.partitionBy(*keys, "_cell").orderBy(F.col(value).desc(), *ties)
    return df.join(counts, keys + ["_cell"]).withColumn(
        out, F.col("_above") + F.row_number().over(inside)).drop("_cell", "_above")
