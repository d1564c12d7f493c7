"""Query registration: a Spark plan under a name, with the SQL that answers it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlemill.plans.oracle import nudge


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        def wrap(fn: Callable) -> Callable:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return wrap


def r(col: Column | str, digits: int = 4) -> Column:
    """Rounded under its own name; sums differ in the last bits between engines."""
    name = col if isinstance(col, str) else None
    out = F.round((F.col(col) if isinstance(col, str) else col) + nudge(digits), digits)
    return out.alias(name) if name else out


def pick(df: DataFrame, plain: str, **rounded: int) -> DataFrame:
    """Select ``plain`` columns as they are and ``name=digits`` columns rounded."""
    return df.select(*plain.split(), *[r(n, d) for n, d in rounded.items()])
