"""Ranking and flow snapshots: parsing, idempotent loading, universe questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Glyphs that mark a rise or a fall at the start of a change text.
RISE = r"^[▲△↑+]\s*(\d+)"
FALL = r"^[▼▽↓-]\s*(\d+)"


def change(text: Column) -> Column:
    """``▲ 9`` is 9, ``▼ 3`` is -3, ``new`` and anything unreadable is 0."""
    text = F.trim(text)
    up = F.regexp_extract(text, RISE, 1).try_cast("int")
    down = F.regexp_extract(text, FALL, 1).try_cast("int")
    return F.coalesce(up, -down, text.try_cast("int"), F.lit(0))


def parse_rankings(raw: DataFrame) -> DataFrame:
    """Ranking rows from strings; rows with a blank symbol are dropped."""
    trimmed = {c: F.trim(F.coalesce(c, F.lit(""))) for c in ("sector", "industry", "long_short")}
    return raw.withColumns({
        "symbol": F.upper(F.trim("symbol")),
        "rank": F.coalesce(F.trim("rank").try_cast("int"), F.lit(0)),
        "daily_change": change(F.coalesce("daily_change", F.lit("0"))),
        **trimmed,
    }).filter(F.col("symbol") != "")


def fraction(text: Column) -> tuple[Column, Column]:
    """``1/1672`` as (1, 1672); (0, 0) when it does not read as two integers."""
    parts = F.split(F.trim(text), "/")
    a, b = F.trim(F.get(parts, 0)).try_cast("int"), F.trim(F.get(parts, 1)).try_cast("int")
    ok = (F.size(parts) == 2) & a.isNotNull() & b.isNotNull()
    return F.when(ok, a).otherwise(0), F.when(ok, b).otherwise(0)


def parse_flows(raw: DataFrame) -> DataFrame:
    """Flow rows from strings; a weekly ``a ~ b`` starts at ``a``. Unreadable dates are dropped."""
    rank, total = fraction(F.coalesce("rank", F.lit("0/0")))
    weekly = (F.col("period_type") == "weekly") & F.col("date").contains("~")
    ends = F.split("date", "~")
    first, second = F.trim(F.get(ends, 0)), F.trim(F.get(ends, 1))
    day = F.when(weekly, first).otherwise(F.trim("date"))
    return raw.select(
        "symbol", F.try_to_date(day, "yyyy-MM-dd").alias("flow_date"), "period_type",
        F.when(weekly, F.try_to_date(first, "yyyy-MM-dd")).alias("week_start"),
        F.when(weekly, F.try_to_date(second, "yyyy-MM-dd")).alias("week_end"),
        F.trim(F.coalesce("direction", F.lit("N"))).alias("direction"),
        F.trim(F.coalesce("long_short", F.lit(""))).alias("long_short"),
        rank.alias("rank"), total.alias("rank_total"),
    ).filter(F.col("flow_date").isNotNull())


def slices_to_load(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows of (date, ranking type) slices the target does not hold in full.

    A partly loaded slice comes again whole, less the symbols already there.
    """
    key = ["data_date", "ranking_type"]
    have = target.groupBy(*key).agg(F.count(F.lit(1)).alias("_have"))
    size = incoming.groupBy(*key).agg(F.count(F.lit(1)).alias("_size"))
    due = size.join(have, key, "left").filter(F.coalesce("_have", F.lit(0)) < F.col("_size"))
    rows = incoming.join(due.select(*key), key, "left_semi").dropDuplicates([*key, "symbol"])
    return rows.join(target.select(*key, "symbol"), [*key, "symbol"], "left_anti")


def symbols(rankings: DataFrame) -> DataFrame:
    return rankings.select("symbol").distinct()


def symbols_with_history(prices: DataFrame, start: str, end: str, min_bars: int = 100) -> DataFrame:
    inside = F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    return (
        prices.filter(inside).groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))
        .filter(F.col("bars") >= min_bars)
    )


def missed_sessions(days: DataFrame, sessions: DataFrame, snapshots: DataFrame, now: Column) -> DataFrame:
    """Weekday sessions already due at ``now`` without any snapshot row.

    ``sessions`` has ``capture_session`` and ``due`` (HH:mm).
    """
    due_at = F.to_timestamp_ntz(F.concat_ws(" ", F.col("date").cast("string"), "due"),
                                F.lit("yyyy-MM-dd HH:mm"))
    expected = days.filter(F.weekday("date") < 5).crossJoin(sessions).filter(due_at <= now)
    seen = snapshots.select("capture_session", F.col("data_date").alias("date")).distinct()
    return expected.join(seen, ["capture_session", "date"], "left_anti")


def top_recent(rankings: DataFrame, dimension: DataFrame, n: int) -> DataFrame:
    """The first ``n`` known top-list symbols, newest snapshot first, then by rank."""
    return (
        rankings.filter(F.col("ranking_type") == "top100").join(dimension, "symbol", "left_semi")
        .orderBy(F.col("captured_at").desc(), "rank", "symbol").limit(n)
        .select("symbol", "captured_at", "rank")
    )
