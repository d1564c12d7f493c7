"""As-of lookup without a range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.functions.blocks import running


def as_of_last(
    points: DataFrame, rows: DataFrame, keys: Sequence[str], value: str, date: str = "date",
    block: int | None = None,
) -> DataFrame:
    """Latest ``value`` of ``rows`` on or before each point's ``date``, per key.

    Both sides are laid on one line per key and scanned once in blocks. ``points`` must be
    unique per key and date, and so must ``rows``.
    """
    keys = list(keys)
    day = F.unix_date(F.col(date).cast("date")).cast("bigint") * 2
    marks = rows.select(*keys, day.alias("_at"), F.col(value)).withColumn("_point", F.lit(False))
    asks = points.select(*keys, F.col(date).alias("_date"), (day + 1).alias("_at")).withColumn("_point", F.lit(True))
    line = marks.unionByName(asks, allowMissingColumns=True)
    out = running(line, keys, {"_got": ("last", F.col(value))}, order="_at", block=block)
    got = out.filter("_point").select(*keys, F.col("_date").alias(date), F.col("_got").alias(value))
    return points.join(got, [*keys, date])
