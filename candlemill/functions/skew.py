"""Joins of a large side with a small per-key side, split so no key lands in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 8


def salted_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], spread: Column | str,
    how: str = "inner", salts: int = SALTS,
) -> DataFrame:
    """Join on ``on`` with ``big`` split ``salts`` ways by ``spread`` inside each key.

    ``small`` is replicated ``salts`` times; use it for sides with few rows per key.
    """
    spread = F.col(spread) if isinstance(spread, str) else spread
    big = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.join(small, list(on) + ["_salt"], how).drop("_salt")
