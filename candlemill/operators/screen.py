"""Stock screening: flow score, sector trend, pattern, composite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlemill.config import PatternConfig

BULLISH, BEARISH, TOP_SYMBOLS = 0.3, -0.3, 5
BOOST = 0.1


def latest(rankings: DataFrame) -> DataFrame:
    """Rows of the newest snapshot."""
    newest = rankings.agg(F.max("captured_at").alias("captured_at"))
    return rankings.join(newest, "captured_at")


def fresh(snapshot: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """The snapshot, or no rows when it is more than ``hours`` older than ``as_of``."""
    age = F.timestamp_diff("SECOND", F.col("captured_at"), as_of)
    return snapshot.filter(age <= hours * 3600)


def long_list(snapshot: DataFrame) -> DataFrame:
    return snapshot.filter((F.col("ranking_type") == "top100") & (F.col("long_short") == "Long in"))


def flow_state(flows: DataFrame, recent: int = 5) -> DataFrame:
    """Per symbol, from its newest daily rows: latest direction and leading run of ``+``."""
    newest = Window.partitionBy("symbol").orderBy(F.col("flow_date").desc())
    few = (
        flows.filter(F.col("period_type") == "daily").withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= recent)
    )
    other = ~F.coalesce(F.col("direction") == "+", F.lit(False))
    run = F.coalesce(F.min(F.when(other, F.col("_rn"))) - 1, F.count(F.lit(1)))
    return few.groupBy("symbol").agg(
        F.max(F.when(F.col("_rn") == 1, F.col("direction"))).alias("flow_direction"),
        run.alias("flow_run"),
    )


def enrich(names: DataFrame, flows: DataFrame) -> DataFrame:
    out = names.join(flow_state(flows), "symbol", "left")
    return out.withColumns({
        "flow_direction": F.coalesce("flow_direction", F.lit("N")),
        "flow_run": F.coalesce("flow_run", F.lit(0)),
        "sector": F.coalesce(F.nullif("sector", F.lit("")), F.lit("Unknown")),
        "daily_change": F.coalesce("daily_change", F.lit(0)),
    })


def flow_score() -> Column:
    def if_(test: Column, points: float) -> Column:
        return F.when(test, points).otherwise(0.0)

    return F.round(
        if_(F.col("long_short") == "Long in", 0.5) + if_(F.col("flow_direction") == "+", 0.2)
        + if_(F.col("rank") <= 30, 0.15) + if_(F.col("daily_change") > 0, 0.1)
        + if_(F.col("flow_run") >= 3, 0.05), 4)


def sectors(snapshot: DataFrame) -> DataFrame:
    """Per sector: long and short counts, net sentiment, trend, best long symbols, rank."""
    df = snapshot.withColumn("sector", F.coalesce(F.nullif("sector", F.lit("")), F.lit("Unknown")))
    long, short = F.col("long_short") == "Long in", F.col("long_short") == "Short in"
    best = Window.partitionBy("sector").orderBy("rank", "symbol")
    # only the few best names per sector are gathered
    names = (
        df.filter(long).withColumn("_rn", F.row_number().over(best))
        .filter(F.col("_rn") <= TOP_SYMBOLS).groupBy("sector")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "symbol"))),
                         lambda s: s["symbol"]).alias("top_symbols"))
    )
    net = F.try_divide(F.count_if(long) - F.count_if(short), F.count(F.lit(1)))
    out = df.groupBy("sector").agg(
        F.count_if(long).alias("long_count"), F.count_if(short).alias("short_count"), net.alias("_net"),
    ).join(names, "sector", "left")
    # a handful of sectors: ranking them in one window is a fixed small cost
    order = Window.orderBy(F.col("net_sentiment").desc(), "sector")
    return out.withColumns({
        "net_sentiment": F.round("_net", 4),
        "trend": F.when(F.col("_net") > BULLISH, "bullish").when(F.col("_net") < BEARISH, "bearish")
                  .otherwise("neutral"),
        "top_symbols": F.coalesce("top_symbols", F.array().cast("array<string>")),
    }).withColumn("sector_rank", F.row_number().over(order)).drop("_net")


def with_boost(names: DataFrame, trends: DataFrame) -> DataFrame:
    """Add the sector trend; names in bullish sectors gain strength."""
    out = names.join(trends.select("sector", "trend"), "sector", "left").withColumn(
        "trend", F.coalesce("trend", F.lit("neutral"))
    )
    boost = F.when(F.col("trend") == "bullish", BOOST).otherwise(0.0)
    return out.withColumn("sector_boost", boost).withColumn(
        "strength", F.round(F.col("strength") + F.col("sector_boost"), 4)
    )


def tier(composite: Column, cfg: PatternConfig = PatternConfig()) -> Column:
    return (
        F.when(composite >= cfg.strong_buy, "strong_buy").when(composite >= cfg.buy, "buy")
        .when(composite >= cfg.watch, "watch").otherwise("avoid")
    )


def composite(
    names: DataFrame, best: DataFrame, cfg: PatternConfig = PatternConfig()
) -> DataFrame:
    """Weighted score with each name's leading actionable pattern, where it has one.

    The sector boost is already in ``strength`` and enters once more on its own.
    """
    out = names.join(best, "symbol", "left").withColumn(
        "_score", cfg.w_flow * F.col("strength") + cfg.w_sector * F.col("sector_boost")
        + cfg.w_pattern * F.coalesce("confidence", F.lit(0.0)))
    return out.withColumns({
        "composite": F.round("_score", 4), "recommendation": tier(F.col("_score"), cfg),
    }).drop("_score")


def leading(actionable: DataFrame) -> DataFrame:
    """First actionable pattern per symbol: highest priority, then pattern order."""
    w = Window.partitionBy("symbol").orderBy(
        F.col("priority").desc(), F.col("confidence").desc(), "detector", "start_idx", "end_idx")
    return actionable.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).select(
        "symbol", "pattern_type", "direction", "status", "confidence", "entry", "stop", "target1",
        "rr_ratio", "volume_confirmed", "breakout_idx", "risk_pct")


def candidates(scored: DataFrame, last: DataFrame) -> DataFrame:
    """Output rows with the price context of each name (``close``, ``last_idx``)."""
    out = scored.join(last, "symbol", "left")
    gap = F.try_divide(F.col("close") - F.col("entry"), F.col("entry")) * 100
    return out.withColumns({
        "current_price": F.round("close", 2), "distance_to_entry_pct": F.round(gap, 2),
        "bars_since_breakout": F.col("last_idx") - F.col("breakout_idx"),
    }).drop("close", "last_idx", "breakout_idx")


def alerts(ranked: DataFrame, n: int = 20) -> DataFrame:
    """The best ``n`` candidates; ``has_detail`` marks those with a pattern."""
    return ranked.orderBy(F.col("composite").desc(), "rank", "symbol").limit(n).withColumn(
        "has_detail", F.col("pattern_type").isNotNull())
