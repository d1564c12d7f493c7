"""Bar, ranking and flow tables derived from the order, part and event tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlemill.functions.blocks import with_index
from candlemill.functions.rank import rank_descending
from candlemill.schemas import KEYS
from candlemill.session import materialize

_BUILT: dict[tuple, DataFrame] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def built(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Build a derived table once per session and folder, as a written table."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), name)
    if key not in _BUILT:
        _BUILT[key] = materialize(build(), name)
    return _BUILT[key]


def bars_from_ticks(
    ticks: DataFrame, keys: list[str], bucket: Column, order: list[str], timeframe: str
) -> DataFrame:
    """OHLCV per key and bucket. ``order`` must order the ticks totally.

    Every aggregate combines map-side, so a hot symbol ships one row per bucket and task.
    """
    at = F.struct(*order)
    return (
        ticks.withColumn("ts", bucket.cast("timestamp_ntz"))
        .groupBy(*keys, "ts")
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("size").alias("volume"),
        )
        .withColumn("timeframe", F.lit(timeframe))
        .select(*keys, "timeframe", "ts", "open", "high", "low", "close", "volume")
    )


LINES_A_TASK = 500_000
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _line_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        *LINE_ORDER,
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        F.col("l_quantity").alias("size"),
    )


def brand_bars_raw(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    part = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol")
    )
    ticks = _line_ticks(spark, sf_dir).join(part, "l_partkey")
    name = {"week": "1w", "day": "1d"}[unit]
    return bars_from_ticks(ticks, ["symbol"], F.date_trunc(unit, "l_shipdate"), LINE_ORDER, name)


def event_bars_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = read(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").alias("at"), "event_id",
        F.col("value").alias("price"), F.lit(1.0).alias("size"),
    )
    return bars_from_ticks(ticks, ["symbol"], F.date_trunc("hour", "at"), ["at", "event_id"], "1h")


def supplier_prices_raw(spark: SparkSession, sf_dir: str, names: DataFrame | None = None) -> DataFrame:
    """Monthly bars per supplier, or of the ``symbol`` of ``names``: the price side of the ranking tables.

    A supplier has few lines a month, so combining them map-side would ship nearly as many rows, each
    with two order structs, and sort all of them twice. The lines are shipped bare instead, once, to
    as many tasks as keep a task's sort in memory.
    """
    month = F.date_trunc("month", "l_shipdate").cast("timestamp_ntz")
    order = [c for c in LINE_ORDER if c != "l_suppkey"]  # one value in a group
    lines = read(spark, sf_dir, "lineitem").select(
        "l_suppkey", month.alias("ts"), *order, "l_extendedprice", "l_quantity")
    if names is not None:
        keys = names.select(F.expr("substring(symbol, 2)").cast(lines.schema["l_suppkey"].dataType).alias("l_suppkey"))
        lines = lines.join(keys, "l_suppkey", "left_semi")
    tasks = 1 + lines.count() // LINES_A_TASK
    ticks = lines.repartition(tasks, "l_suppkey", "ts").withColumns({
        "price": F.try_divide("l_extendedprice", "l_quantity"), "size": F.col("l_quantity")})
    bars = bars_from_ticks(ticks, ["l_suppkey"], F.col("ts"), order, "1mo")
    symbol = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    return bars.withColumn("l_suppkey", symbol).withColumnRenamed("l_suppkey", "symbol")


def market_series_raw(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """Market-wide series: mean unit price (the signal) and mean line value (the asset)."""
    # cents keep the sums exact in any order
    value = F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / 100
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.date_trunc(unit, "l_shipdate").cast("timestamp_ntz").alias("ts"))
        .agg((value / F.sum("l_quantity")).alias("signal_close"),
             (value / F.count(F.lit(1))).alias("asset_close"))
        .withColumn("symbol", F.lit("MARKET"))
    )


def indexed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A bar table with ``idx`` and ``n_bars``, built once."""
    raw = {
        "week": lambda: brand_bars_raw(spark, sf_dir, "week"),
        "day": lambda: brand_bars_raw(spark, sf_dir, "day"),
        "hour": lambda: event_bars_raw(spark, sf_dir),
        "month": lambda: supplier_prices_raw(spark, sf_dir),
    }[name]
    # The bar aggregate is read twice to number it; write it first.
    bars = built(spark, sf_dir, f"bars_{name}_raw", raw)
    return built(spark, sf_dir, f"bars_{name}", lambda: with_index(bars, KEYS))


def supplier_revenue_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue and lines of each supplier and month."""
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        read(spark, sf_dir, "lineitem")
        .withColumn("month", F.date_trunc("month", "l_shipdate").cast("date"))
        .groupBy("l_suppkey", "month")
        # cents keep the sum exact in any order
        .agg((F.sum(F.round(revenue * 100).cast("bigint")) / 100).alias("revenue"),
             F.count(F.lit(1)).alias("lines"))
    )


def revenue_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "supplier_revenue", lambda: supplier_revenue_raw(spark, sf_dir))


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ts``: the months that have bars of any supplier."""
    return revenue_by_month(spark, sf_dir).select(F.col("month").cast("timestamp_ntz").alias("ts")).distinct()


def month_bars_of(spark: SparkSession, sf_dir: str, names: DataFrame, name: str) -> DataFrame:
    """``indexed`` monthly bars of the ``symbol`` of ``names`` only, built once under ``name``."""
    raw = built(spark, sf_dir, f"{name}_raw", lambda: supplier_prices_raw(spark, sf_dir, names))
    return built(spark, sf_dir, name, lambda: with_index(raw, KEYS))


def rankings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly supplier ranking by revenue; the shape of a ranking snapshot feed."""
    # Ranking counts cells and then joins them back; the lines are summed once for both.
    monthly = revenue_by_month(spark, sf_dir)
    own = Window.partitionBy("l_suppkey").orderBy("month")
    supplier = (
        read(spark, sf_dir, "supplier")
        .join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), "r_name", "n_name")
    )
    # logarithmic cells hold similar counts over any scale of revenue
    cell = F.floor(F.log1p("revenue") * 64)
    out = (
        rank_descending(monthly, ["month"], "revenue", ["l_suppkey"], cell)
        .withColumns({
            "prev_rank": F.lag("rank").over(own), "prev_rev": F.lag("revenue").over(own),
            "prev_lines": F.lag("lines").over(own),
        })
        .join(supplier, "l_suppkey")
    )
    top = F.col("rank") <= F.ceil(F.col("size") / 2)
    return out.select(
        F.col("month").cast("timestamp_ntz").alias("captured_at"),
        F.col("month").alias("data_date"),
        F.when(top, "top100").otherwise("bottom100").alias("ranking_type"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
        F.when(top, F.col("rank")).otherwise(F.col("size") - F.col("rank") + 1)
         .cast("int").alias("rank"),
        F.coalesce(F.col("prev_rank") - F.col("rank"), F.lit(0)).cast("int").alias("daily_change"),
        F.col("r_name").alias("sector"),
        F.col("n_name").alias("industry"),
        F.when(F.col("revenue") > F.col("prev_rev"), "Long in")
         .when(F.col("revenue") < F.col("prev_rev"), "Short in")
         .otherwise("No dominance").alias("long_short"),
        F.when(F.col("lines") > F.col("prev_lines"), "+")
         .when(F.col("lines") < F.col("prev_lines"), "-")
         .otherwise("N").alias("direction"),
        F.col("size").cast("int").alias("rank_total"),
    )


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "rankings", lambda: rankings_raw(spark, sf_dir))
