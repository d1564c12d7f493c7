"""Backtests of ranking lists: buy the best ranks, hold, sell. Runs are keys of one job."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import astuple, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlemill.functions.quantile import exact_median
from candlemill.session import materialize

CAPITAL = 100_000.0
# Rank ranges and holding periods of the sweep, and report buckets.
RANK_RANGES = ((1, 5), (6, 10), (1, 10), (11, 20), (1, 20), (6, 20), (1, 30), (1, 50))
HOLDS = (3, 5, 7, 10, 15, 20)
BUCKETS = ((1, 5), (6, 10), (11, 20), (21, 30), (31, 50))
# The patterns traded by default.
TRADED_PATTERNS = ("false_breakdown_w_bottom", "false_breakdown", "bull_flag")


@dataclass(frozen=True)
class RankRun:
    """One configuration. ``momentum`` > 0 keeps names that rose over that many dates."""

    run_id: str
    top_n: int = 20
    hold: int = 5
    min_rank: int = 1
    max_rank: int = 50
    delay: int = 0
    momentum: int = 0
    short: bool = False
    long_only: bool = True


VARIATIONS = (
    RankRun("baseline"),
    RankRun("sweet_spot", top_n=10, min_rank=6, max_rank=10),
    RankRun("top10_hold7", top_n=10, hold=7, max_rank=10),
    RankRun("delay_1", max_rank=20, delay=1),
    RankRun("delay_2", max_rank=20, delay=2),
    RankRun("momentum_3", max_rank=20, momentum=3),
    RankRun("hold_10", hold=10, max_rank=20),
    RankRun("short_bottom", max_rank=10**9, short=True),
)


def sweep_runs() -> tuple[RankRun, ...]:
    return tuple(
        RankRun(f"{lo}-{hi}/{hold}", top_n=hi, hold=hold, min_rank=lo, max_rank=hi)
        for lo, hi in RANK_RANGES for hold in HOLDS
    )


def run_table(spark: SparkSession, runs: Sequence[RankRun]) -> DataFrame:
    kinds = {"str": "string", "int": "int", "bool": "boolean"}
    schema = ", ".join(f"{f.name} {kinds[f.type]}" for f in fields(RankRun))
    return spark.createDataFrame([astuple(r) for r in runs], schema)


def calendar(prices: DataFrame) -> DataFrame:
    """``date`` and its position. A calendar has one row per trading day, so one window serves."""
    days = prices.select("date").distinct()
    w = Window.orderBy("date")
    return days.withColumns({
        "pos": F.row_number().over(w) - 1, "n_days": F.count(F.lit(1)).over(Window.partitionBy()),
    })


def next_position(days: DataFrame, signal_dates: DataFrame) -> DataFrame:
    """First trading-day position strictly after each signal date."""
    both = days.select("date", "pos", "n_days", F.lit(1).alias("_day")).unionByName(
        signal_dates.select(F.col("date"), F.lit(None).cast("int").alias("pos"),
                            F.lit(None).cast("bigint").alias("n_days"), F.lit(0).alias("_day")))
    # a signal sorts after a trading day of the same date, so only later days follow it
    ahead = Window.orderBy("date", F.col("_day").desc()).rowsBetween(1, Window.unboundedFollowing)
    return both.withColumns({
        "next_pos": F.first("pos", ignorenulls=True).over(ahead),
        "n_days": F.max("n_days").over(Window.partitionBy()),
    }).filter(F.col("_day") == 0).select("date", "next_pos", "n_days")


def _date_positions(rows: DataFrame) -> DataFrame:
    """Distinct signal dates of each run with their position and count."""
    w = Window.partitionBy("run_id")
    return rows.select("run_id", "data_date").distinct().withColumns({
        "d_pos": F.row_number().over(w.orderBy("data_date")) - 1,
        "n_dates": F.count(F.lit(1)).over(w),
    })


def selections(rankings: DataFrame, runs: DataFrame, widest: int) -> DataFrame:
    """Names each run buys per signal date. ``widest`` is the largest ``top_n``.

    The top-n cut is a row_number filter, which Spark also applies before the shuffle.
    """
    side = F.when(F.col("short"), "bottom100").otherwise("top100")
    flow = F.when(F.col("short"), "Short in").otherwise("Long in")
    pool = rankings.select("data_date", "symbol", "rank", "ranking_type", "long_short", "sector").crossJoin(runs).filter(
        (F.col("ranking_type") == side) & (~F.col("long_only") | (F.col("long_short") == flow))
        & F.col("rank").between(F.col("min_rank"), F.col("max_rank"))
    )
    w = Window.partitionBy("run_id", "data_date").orderBy("rank", "symbol")
    top = (
        pool.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= widest)
        .filter(F.col("_rn") <= F.col("top_n")).drop("_rn")
    )
    dates = _date_positions(pool)
    plain = top.filter(F.col("momentum") == 0)
    dated = top.filter(F.col("momentum") > 0).join(dates, ["run_id", "data_date"])
    earlier = (
        pool.filter(F.col("momentum") > 0).join(dates, ["run_id", "data_date"])
        .select("run_id", "symbol", (F.col("d_pos") + F.col("momentum")).alias("d_pos"),
                F.col("rank").alias("_before"))
    )
    risen = (
        dated.filter(F.col("d_pos") >= F.col("momentum"))
        .join(earlier, ["run_id", "symbol", "d_pos"], "left")
        .filter(F.col("_before").isNull() | (F.col("rank") < F.col("_before")))
        .select(*plain.columns)
    )
    chosen = plain.unionByName(risen)
    # dates come from the pool, or from what momentum left of it; the last ``hold`` are dropped
    used = _date_positions(pool.filter(F.col("momentum") == 0).select("run_id", "data_date")
                           .unionByName(risen.select("run_id", "data_date")))
    return chosen.join(used, ["run_id", "data_date"]).filter(
        F.col("d_pos") < F.col("n_dates") - F.col("hold")
    ).drop("d_pos", "n_dates")


def trades(picks: DataFrame, prices: DataFrame, strict_exit: bool = False) -> DataFrame:
    """Enter at the open after the signal (plus ``delay``), leave at the close ``hold`` days on."""
    days = calendar(prices)
    ahead = next_position(days, picks.select(F.col("data_date").alias("date")).distinct())
    placed = picks.join(ahead.withColumnRenamed("date", "data_date"), "data_date").withColumn(
        "entry_pos", F.col("next_pos") + F.col("delay")
    ).filter(F.col("entry_pos") < F.col("n_days")).withColumn(
        "exit_pos", F.least(F.col("entry_pos") + F.col("hold"), F.col("n_days") - 1).cast("int"))
    if strict_exit:
        placed = placed.filter(F.col("exit_pos") > F.col("entry_pos"))
    at = prices.join(days.select("date", "pos"), "date")
    buy = at.select("symbol", F.col("pos").alias("entry_pos"), F.col("date").alias("entry_date"),
                    F.col("open").alias("entry_price"))
    sell = at.select("symbol", F.col("pos").alias("exit_pos"), F.col("date").alias("exit_date"),
                     F.col("close").alias("exit_price"))
    gain = F.try_divide(F.col("exit_price") - F.col("entry_price"), F.col("entry_price"))
    return (
        placed.join(buy, ["symbol", "entry_pos"]).join(sell, ["symbol", "exit_pos"])
        .filter((F.col("entry_price") > 0) & F.col("exit_price").isNotNull())
        .withColumn("return_pct", F.when(F.col("short"), -gain).otherwise(gain))
        .drop("next_pos", "n_days")
    )


def _compound(returns: Column) -> Column:
    return F.product(1 + returns)


def trade_metrics(done: DataFrame, runs: DataFrame) -> DataFrame:
    """Win rate, mean, median, compounded daily return and Sharpe per run."""
    per_day = done.groupBy("run_id", "entry_date").agg(F.avg("return_pct").alias("_day"))
    daily = per_day.groupBy("run_id").agg(
        ((_compound(F.col("_day")) - 1) * 100).alias("total_return_pct"),
        F.avg("_day").alias("_mean"), F.stddev_pop("_day").alias("_dev"),
    )
    basic = done.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.avg((F.col("return_pct") > 0).cast("double")).alias("win_rate"),
        (F.avg("return_pct") * 100).alias("avg_return_pct"),
        (F.avg(F.when(F.col("long_short") == "Long in", F.col("return_pct"))) * 100).alias("long_avg_pct"),
        (F.avg(F.when(F.col("long_short") == "Short in", F.col("return_pct"))) * 100).alias("short_avg_pct"),
    )
    middle = exact_median(done, ["run_id"], "return_pct", 0.01)
    sharpe = F.when(F.col("_dev") > 0, F.col("_mean") / F.col("_dev") * F.sqrt(252 / F.col("hold"))).otherwise(0.0)
    return (
        basic.join(daily, "run_id").join(middle, "run_id").join(runs.select("run_id", "hold"), "run_id")
        .withColumns({"sharpe_ratio": sharpe, "median_return_pct": F.col("median") * 100})
        .drop("_mean", "_dev", "median")
    )


def sector_returns(done: DataFrame, rankings: DataFrame) -> DataFrame:
    """Mean return per sector; a name's sector is its first ranking row of the signal date."""
    first = rankings.groupBy("symbol", "data_date").agg(
        F.min_by("sector", F.struct("ranking_type", "rank")).alias("_sector"))
    return (
        done.drop("sector").join(first, ["symbol", "data_date"], "left")
        .groupBy("run_id", F.coalesce("_sector", F.lit("Unknown")).alias("sector"))
        .agg((F.avg("return_pct") * 100).alias("avg_return_pct"), F.count(F.lit(1)).alias("trades"))
    )


def equity_curve(done: DataFrame, prices: DataFrame) -> DataFrame:
    """Daily equity of overlapping positions, equally weighted and compounded.

    A trade lives at most ``hold + 1`` days, so its days come from an explode and an equi-join.
    """
    days = calendar(prices)
    close = prices.join(days.select("date", "pos"), "date").select("symbol", "pos", "close")
    held = done.select(
        "run_id", "symbol", "data_date", "entry_price", "entry_pos", "exit_pos",
        F.explode(F.sequence("entry_pos", "exit_pos")).alias("pos"),
    ).join(close, ["symbol", "pos"], "left")
    w = Window.partitionBy("run_id", "symbol", "data_date").orderBy("pos")
    prev = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    moves = held.withColumn("_ref", F.coalesce(prev, "entry_price"))
    day = moves.filter(F.col("close").isNotNull() & (F.col("_ref") > 0)).groupBy("run_id", "pos").agg(
        F.avg(F.try_divide(F.col("close") - F.col("_ref"), F.col("_ref"))).alias("day_return"))
    begin = done.groupBy("run_id").agg(F.min(F.struct("data_date", "entry_pos"))["entry_pos"].alias("_b"))
    grid = begin.crossJoin(days.select("date", "pos")).filter(F.col("pos") >= F.col("_b"))
    along = Window.partitionBy("run_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        grid.join(day, ["run_id", "pos"], "left")
        .withColumn("day_return", F.coalesce("day_return", F.lit(0.0)))
        .withColumn("equity", CAPITAL * _compound(F.col("day_return")).over(along))
        .drop("_b")
    )


def drawdown(curve: DataFrame) -> DataFrame:
    w = Window.partitionBy("run_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest(F.lit(CAPITAL), F.max("equity").over(w))
    return (
        curve.withColumn("_dd", F.when(peak > 0, (peak - F.col("equity")) / peak).otherwise(0.0))
        .groupBy("run_id").agg(F.greatest(F.max("_dd"), F.lit(0.0)).alias("max_drawdown_pct"))
    )


def benchmark(prices: DataFrame, symbol: str, first_signal: DataFrame) -> DataFrame:
    """Buy at the first calendar day on or after each run's start, hold to the last close."""
    days = calendar(prices)
    start = first_signal.crossJoin(days.select("date", "pos")).filter(
        F.col("date") >= F.col("start_date")).groupBy("run_id").agg(F.min("date").alias("date"))
    own = prices.filter(F.col("symbol") == symbol)
    end = own.join(days.filter(F.col("pos") == F.col("n_days") - 1).select("date"), "date").select(
        F.col("close").alias("_end"))
    got = start.join(own.select("date", "open"), "date").crossJoin(end)
    return got.filter(F.col("open") > 0).select(
        "run_id", (F.try_divide(F.col("_end") - F.col("open"), F.col("open")) * 100).alias("benchmark_return_pct"))


def compare(
    rankings: DataFrame, prices: DataFrame, runs: Sequence[RankRun], bench: str,
) -> DataFrame:
    """One row per run: trade metrics, drawdown, benchmark and alpha. Empty runs are absent."""
    spark = prices.sparkSession
    table = run_table(spark, runs)
    done = materialize(trades(selections(rankings, table, max(r.top_n for r in runs)), prices), "trades")
    return summary(done, prices, table, rankings, bench)


def summary(
    done: DataFrame, prices: DataFrame, table: DataFrame, rankings: DataFrame, bench: str
) -> DataFrame:
    start = done.groupBy("run_id").agg(F.min("data_date").alias("start_date"))
    out = (
        trade_metrics(done, table).join(drawdown(equity_curve(done, prices)), "run_id")
        .join(benchmark(prices, bench, start), "run_id", "left")
    )
    return out.withColumn("alpha_pct", F.col("total_return_pct") - F.col("benchmark_return_pct"))


def best_runs(results: DataFrame) -> DataFrame:
    """Best run by Sharpe, return, win rate and (smallest) drawdown; first listed among equals."""
    goals = {"sharpe_ratio": 1, "total_return_pct": 1, "win_rate": 1, "max_drawdown_pct": -1}
    rows = F.explode(F.array(*[
        F.struct(F.lit(g).alias("goal"), (F.col(g) * s).alias("_v"), F.col(g).alias("value"))
        for g, s in goals.items()])).alias("_g")
    long = results.select("run_id", rows).select("run_id", "_g.*")
    return long.groupBy("goal").agg(
        F.max_by(F.struct("run_id", "value"), F.struct("_v", "run_id")).alias("_b")
    ).select("goal", "_b.run_id", "_b.value")


def bucket_stats(done: DataFrame, hold: int) -> DataFrame:
    """Trades, win rate, mean and Sharpe per rank bucket."""
    label = F.lit(None).cast("string")
    for lo, hi in BUCKETS:
        label = F.when(F.col("rank").between(lo, hi), f"{lo}-{hi}").otherwise(label)
    dev = F.stddev_pop("return_pct")
    return (
        done.withColumn("bucket", label).filter(F.col("bucket").isNotNull())
        .groupBy("run_id", "bucket").agg(
            F.count(F.lit(1)).alias("trades"), F.avg((F.col("return_pct") > 0).cast("double")).alias("win_rate"),
            (F.avg("return_pct") * 100).alias("avg_return_pct"),
            F.when(dev > 0, F.avg("return_pct") / dev * math.sqrt(252 / hold)).otherwise(0.0).alias("sharpe"))
    )


def symbol_stats(done: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` symbols with most ``trades`` or largest ``total_return``."""
    stats = done.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("trades"), F.avg((F.col("return_pct") > 0).cast("double")).alias("win_rate"),
        (F.avg("return_pct") * 100).alias("avg_return_pct"), (F.sum("return_pct") * 100).alias("total_return"))
    return stats.orderBy(F.col(by).desc(), "symbol").limit(k)


def pattern_stats(done: DataFrame) -> DataFrame:
    return done.groupBy("pattern_type").agg(
        F.count(F.lit(1)).alias("trades"), F.avg((F.col("return_pct") > 0).cast("double")).alias("win_rate"),
        (F.avg("return_pct") * 100).alias("avg_return_pct"))


def pattern_picks(
    matches: DataFrame, top_n: int = 5, hold: int = 5,
    allowed: Sequence[str] = TRADED_PATTERNS,
) -> DataFrame:
    """Most confident allowed patterns per signal date, in the shape ``trades`` reads.

    ``matches`` has symbol, pattern_type, confidence, data_date and the pattern order columns.
    """
    w = Window.partitionBy("data_date").orderBy(
        F.col("confidence").desc(), "symbol", "detector", "start_idx", "end_idx")
    return (
        matches.filter(F.col("pattern_type").isin(*allowed))
        .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top_n).drop("_rn")
        .withColumns({
            "run_id": F.lit("patterns"), "rank": F.lit(0), "long_short": F.lit("Long in"),
            "hold": F.lit(hold), "delay": F.lit(0), "short": F.lit(False),
        })
    )
