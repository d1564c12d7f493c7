"""Moving-average crossover backtests. Parameter sets are keys: one job runs a whole sweep."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlemill.functions.blocks import Stage, blocked, running
from candlemill.operators.indicators import ema_table, frame

CAPITAL = 100_000.0
CASH_YIELD = 0.045
PERIODS = range(2, 51)
YEAR = 252
# The strategy families and the periods of the small sweep.
FAMILIES = (("EMA/SMA", "ema", "sma"), ("EMA/EMA", "ema", "ema"), ("SMA/SMA", "sma", "sma"))
SMALL_ENTRY = (5, 8, 10, 13, 15, 20, 25, 30)
SMALL_EXIT = (10, 15, 20, 25, 30, 40, 50)
CASH_YIELDS = (0.0, 0.045)


def position(set_on: Column, set_off: Column, w_row: Column | None = None) -> tuple[Column, Column]:
    """(definite value, toggle) of one bar: on, off, flip when both, keep when neither."""
    definite = F.when(set_on != set_off, set_on.cast("int"))
    return definite, (set_on & set_off).cast("int")


def positions(
    bars: DataFrame, set_on: Column, set_off: Column, keys: Sequence[str] = ("symbol",),
    block: int | None = None,
) -> DataFrame:
    """In-market state of long series, by block scans: no state machine runs row by row.

    State is the latest definite value, flipped once per bar since then on which both hold.
    """
    definite, toggle = position(set_on, set_off)
    out = running(bars, keys, {"_t": ("sum", toggle)}, block=block)
    out = running(
        out, keys, {"_d": ("last", F.when(set_on != set_off, F.struct(definite.alias("v"), F.col("_t").alias("t"))))},
        block=block,
    )
    state = F.coalesce(F.col("_d.v"), F.lit(0)) + F.col("_t") - F.coalesce(F.col("_d.t"), F.lit(0))
    return out.withColumn("position", F.pmod(state, F.lit(2)).cast("int")).drop("_t", "_d")


def with_averages(
    series: DataFrame, periods: Sequence[int] = PERIODS, keys: Sequence[str] = ("symbol",),
    block: int | None = None,
) -> DataFrame:
    """Every bar with ``sma``/``ema`` arrays of ``signal_close``, one entry per period.

    All averages are computed once and shared by every run.
    """
    keys, periods = list(keys), list(periods)

    def means(df: DataFrame, w):
        cols = []
        for p in periods:
            full = F.count("signal_close").over(frame(w, p)) == p
            cols.append(F.when(full, F.avg("signal_close").over(frame(w, p))))
        return df.withColumns({"sma": F.array(*cols), "_prev": F.lag("asset_close").over(w)})

    base = blocked(series, keys, [Stage(max(periods), 0, means)], block=block)
    ret = F.try_divide(F.col("asset_close"), F.col("_prev")) - 1
    base = base.withColumn("asset_return", F.coalesce(ret, F.lit(0.0))).drop("_prev")
    each = series.select(*keys, "idx", "signal_close").withColumn(
        "period", F.explode(F.array(*[F.lit(p) for p in periods])))
    each = ema_table(each, "signal_close", 2.0 / (F.col("period") + 1), "_ema", [*keys, "period"])
    packed = each.groupBy(*keys, "idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("period", "_ema"))), lambda s: s["_ema"]).alias("ema"))
    return base.join(packed, keys + ["idx"])


@dataclass(frozen=True)
class Grid:
    """Which parameter sets to run. ``drop_null`` skips the null mean rows before the warm-up."""

    families: tuple = FAMILIES
    entry: tuple = tuple(PERIODS)
    exit: tuple = tuple(PERIODS)
    cash: tuple = (CASH_YIELD,)
    ordered: bool = False
    drop_null: bool = True


SMALL_GRID = Grid(FAMILIES[:1], SMALL_ENTRY, SMALL_EXIT, CASH_YIELDS, ordered=True, drop_null=False)


def run_table(spark: SparkSession, grid: Grid = Grid(), periods: Sequence[int] = PERIODS) -> DataFrame:
    """One row per run: family, periods, array positions of its averages, first traded bar."""
    pairs = (
        spark.createDataFrame([(i, *f) for i, f in enumerate(grid.families)],
                              "f int, strategy string, entry_kind string, exit_kind string")
        .withColumn("entry_period", F.explode(F.array(*[F.lit(p) for p in grid.entry])))
        .withColumn("exit_period", F.explode(F.array(*[F.lit(p) for p in grid.exit])))
        .withColumn("cash_yield", F.explode(F.array(*[F.lit(float(c)) for c in grid.cash])))
    )
    if grid.ordered:
        pairs = pairs.filter(F.col("entry_period") < F.col("exit_period"))
    low = min(periods)
    null_rows = F.greatest(
        F.when(F.col("entry_kind") == "sma", F.col("entry_period") - 1).otherwise(0),
        F.when(F.col("exit_kind") == "sma", F.col("exit_period") - 1).otherwise(0))
    start = F.greatest("entry_period", "exit_period") + 5
    return pairs.withColumns({
        "e_at": F.col("entry_period") - low, "x_at": F.col("exit_period") - low,
        "start": start + null_rows if grid.drop_null else start,
        "run_id": ((F.col("f") * 1000 + F.col("entry_period")) * 1000 + F.col("exit_period")) * 10
                  + F.when(F.col("cash_yield") > 0, 1).otherwise(0),
    }).drop("f")


RUIN = -1e6  # the logarithm of nothing, for sums; its exponential is 0


def growth(ret: Column) -> Column:
    """Log growth of a return; a loss of everything or more leaves nothing, now and later."""
    return F.when(ret > -1, F.log(1 + ret)).when(ret.isNotNull(), F.lit(RUIN))


def drop_from(level: str) -> Column:
    """Equity against ``level``, as a return; nothing from nothing is a loss of everything."""
    return F.when(F.col(level) > 0, F.try_divide("equity", level) - 1).when(F.col(level) <= 0, F.lit(-1.0))


def simulate(
    averaged: DataFrame, runs: DataFrame, keys: Sequence[str] = ("symbol",), rolling: int = YEAR,
) -> DataFrame:
    """Every traded bar of every run: return, equity, drawdown, trade marks.

    Averages are picked from the bar's arrays, so bars meet runs by a cross join with the run
    table (7,203 slim rows) and nothing else; all windows share one shuffle on (series, run).
    """
    keys = list(keys)
    pick_e = F.when(F.col("entry_kind") == "ema", F.get("ema", F.col("e_at"))).otherwise(F.get("sma", F.col("e_at")))
    pick_x = F.when(F.col("exit_kind") == "ema", F.get("ema", F.col("x_at"))).otherwise(F.get("sma", F.col("x_at")))
    rows = (
        averaged.crossJoin(runs).filter(F.col("idx") >= F.col("start"))
        .select(*keys, "run_id", "idx", "ts", "asset_return", "cash_yield",
                (F.col("signal_close") >= pick_e).alias("_on"), (F.col("signal_close") < pick_x).alias("_off"))
    )
    w = Window.partitionBy(*keys, "run_id").orderBy("idx")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    definite, toggle = position(F.col("_on"), F.col("_off"))
    rows = rows.withColumn("_t", F.sum(toggle).over(upto))
    mark = F.when(F.col("_on") != F.col("_off"), definite * 1 + 2 * F.col("_t"))
    rows = rows.withColumn("_m", F.coalesce(F.last(mark, ignorenulls=True).over(upto), F.lit(0)))
    state = F.pmod(F.col("_m"), F.lit(2)) + F.col("_t") - F.floor(F.col("_m") / 2)
    rows = rows.withColumn("_p", F.pmod(state, F.lit(2)).cast("int"))
    # signals act on the next bar
    rows = rows.withColumn("held", F.coalesce(F.lag("_p").over(w), F.lit(0)))
    cash = F.pow(1 + F.col("cash_yield"), F.lit(1.0 / YEAR)) - 1
    rows = rows.withColumn("ret", F.when(F.col("held") == 1, F.col("asset_return")).otherwise(cash))
    rows = rows.withColumns({
        "equity": CAPITAL * F.exp(F.sum(growth(F.col("ret"))).over(upto)),
        "_was": F.coalesce(F.lag("held").over(w), F.lit(0)),
        "_s1": F.sum("ret").over(upto), "_s2": F.sum(F.col("ret") * F.col("ret")).over(upto),
        "_k": F.row_number().over(w),
    })
    opened = (F.col("held") == 1) & (F.col("_was") == 0)
    rows = rows.withColumns({
        "peak": F.max("equity").over(upto),
        "opened": opened.cast("int"), "closed": ((F.col("held") == 0) & (F.col("_was") == 1)).cast("int"),
        "_at_open": F.last(F.when(opened, F.col("equity")), ignorenulls=True).over(upto),
        "_b1": F.coalesce(F.lag("_s1", rolling).over(w), F.lit(0.0)),
        "_b2": F.coalesce(F.lag("_s2", rolling).over(w), F.lit(0.0)),
    })
    mean = (F.col("_s1") - F.col("_b1")) / rolling
    var = ((F.col("_s2") - F.col("_b2")) - rolling * mean * mean) / (rolling - 1)
    return rows.select(
        *keys, "run_id", "idx", "ts", "ret", "held", "equity", "opened", "closed",
        drop_from("peak").alias("dd"), F.when(F.col("peak") > 0, F.col("equity") / F.col("peak")).otherwise(0.0).alias("share"),
        F.when(F.col("closed") == 1, drop_from("_at_open")).alias("trade_return"),
        F.when((F.col("_k") >= rolling) & (var > 1e-18), mean / F.sqrt(var) * F.sqrt(F.lit(float(YEAR)))).alias("rolling_sharpe"),
    )


def hold_asset(averaged: DataFrame, keys: Sequence[str] = ("symbol",), block: int | None = None) -> DataFrame:
    """The buy-and-hold run in the shape ``simulate`` returns."""
    out = running(averaged.withColumn("ret", F.col("asset_return")), keys,
                  {"_log": ("sum", growth(F.col("asset_return")))}, block=block)
    out = out.withColumn("equity", CAPITAL * F.exp("_log"))
    out = running(out, keys, {"_peak": ("max", F.col("equity"))}, block=block)
    return out.select(
        *keys, F.lit(0).alias("run_id"), "idx", "ts", "ret", F.lit(1).alias("held"), "equity",
        F.lit(0).alias("opened"), F.lit(0).alias("closed"), drop_from("_peak").alias("dd"),
        F.when(F.col("_peak") > 0, F.col("equity") / F.col("_peak")).otherwise(0.0).alias("share"),
        F.lit(None).cast("double").alias("trade_return"), F.lit(None).cast("double").alias("rolling_sharpe"))


def metrics(sim: DataFrame, keys: Sequence[str] = ("symbol",), sample: bool = True) -> DataFrame:
    """CAGR, drawdown, Sharpe, Sortino, Calmar, stability and trade figures per run.

    Rows are folded to months first; months then give both the totals and the share of
    positive months, without another shuffle.
    """
    run = [*keys, "run_id"]
    r, neg = F.col("ret"), F.when(F.col("ret") < 0, F.col("ret"))
    month = F.date_trunc("month", "ts").alias("_month")
    monthly = sim.groupBy(*run, month).agg(
        F.sum(growth(r)).alias("_log"), F.count(r).alias("_n"), F.sum(r).alias("_r"), F.sum(r * r).alias("_r2"),
        F.count(neg).alias("_nn"), F.sum(neg).alias("_nr"), F.sum(neg * neg).alias("_nr2"),
        F.min("dd").alias("_dd"), F.sum(F.pow(F.col("dd") * 100, F.lit(2))).alias("_dd2"),
        F.sum("held").alias("_held"), F.sum("opened").alias("_open"),
        F.count("trade_return").alias("_closed"), F.count_if(F.col("trade_return") > 0).alias("_won"),
        F.count("rolling_sharpe").alias("_rn"), F.sum("rolling_sharpe").alias("_rs"),
        F.sum(F.pow("rolling_sharpe", F.lit(2))).alias("_rs2"),
    )
    tot = monthly.groupBy(*run).agg(
        *[F.sum(c).alias(c) for c in ("_log", "_n", "_r", "_r2", "_nn", "_nr", "_nr2", "_dd2", "_held",
                                      "_open", "_closed", "_won", "_rn", "_rs", "_rs2")],
        F.min("_dd").alias("max_dd"), F.avg((F.col("_log") > 0).cast("double")).alias("pct_months_positive"),
    )

    def dev(n: str, s: str, s2: str, sample_: bool) -> Column:
        m = F.try_divide(s, n)
        ss = F.greatest(F.col(s2) - F.col(n) * m * m, F.lit(0.0))
        return F.sqrt(F.try_divide(ss, F.col(n) - 1 if sample_ else F.col(n)))

    root = F.sqrt(F.lit(float(YEAR)))
    mean = F.col("_r") / F.col("_n")
    zero = F.lit(0.0)
    tot = tot.withColumns({
        "cagr": F.exp(F.col("_log") / (F.col("_n") / YEAR)) - 1,
        "total_return": F.exp("_log") - 1,
        "sharpe": F.coalesce(F.try_divide(mean, F.nullif(dev("_n", "_r", "_r2", sample), zero)) * root, zero),
        "sortino": F.coalesce(F.try_divide(mean, F.nullif(dev("_nn", "_nr", "_nr2", sample), zero)) * root, zero),
        "time_in_market": F.col("_held") / F.col("_n"),
        "num_trades": F.col("_open"),
        "trade_wr": F.coalesce(F.try_divide("_won", "_closed"), zero),
        "rolling_sharpe_std": F.when(F.col("_rn") > 0, dev("_rn", "_rs", "_rs2", True)).otherwise(10.0),
        "ulcer_index": F.sqrt(F.col("_dd2") / F.col("_n")),
        "final_equity": CAPITAL * F.exp("_log"),
    }).withColumn("calmar", F.coalesce(F.try_divide("cagr", F.nullif(F.abs("max_dd"), zero)), zero))
    stability = (
        0.5 / (1 + F.col("rolling_sharpe_std")) + 0.3 * F.col("pct_months_positive")
        + 0.2 / (1 + F.col("ulcer_index"))
    )
    return tot.withColumn("stability_score", stability).select(
        *run, "cagr", "total_return", "max_dd", "sharpe", "sortino", "calmar", "time_in_market", "num_trades",
        "trade_wr", "final_equity", "rolling_sharpe_std", "pct_months_positive", "ulcer_index", "stability_score")


def rank_score(results: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """0.4 stability + 0.3 return percentile + 0.3 drawdown percentile over viable runs, else 0."""
    keys = list(keys)
    ok = F.col("calmar") > 0
    w = Window.partitionBy(*keys, "_ok")
    out = results.withColumn("_ok", ok)
    n = F.count(F.lit(1)).over(w)
    by_cagr = F.row_number().over(w.orderBy("cagr", "run_id")) / n
    by_dd = 1.0 - F.row_number().over(w.orderBy(F.abs("max_dd"), "run_id")) / n
    score = 0.4 * F.col("stability_score") + 0.3 * by_cagr + 0.3 * by_dd
    return out.withColumn("rank_score", F.when(F.col("_ok"), score).otherwise(0.0)).drop("_ok")


def yearly(sim: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Compounded return, own drawdown and Calmar of each run and year."""
    run = [*keys, "run_id", "year"]
    w = Window.partitionBy(*run).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    df = sim.withColumn("year", F.year("ts")).withColumn("_peak", F.max("equity").over(w))
    out = df.groupBy(*run).agg(
        (F.exp(F.sum(growth(F.col("ret")))) - 1).alias("year_return"),
        F.min(drop_from("_peak")).alias("year_dd"),
    )
    other = F.when(F.col("year_return") > 0, 10.0).otherwise(0.0)
    return out.withColumn("year_calmar", F.coalesce(
        F.try_divide("year_return", F.nullif(F.abs("year_dd"), F.lit(0.0))), other))


def drawdown_dates(sim: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """When each run's deepest drawdown bottomed, and its depth.

    The ``share`` of the peak that is left tells near-total losses apart; as drawdowns they all round to -1.
    """
    return sim.groupBy(*keys, "run_id").agg(
        F.min_by("ts", F.struct("share", "idx")).alias("trough_ts"), F.min("dd").alias("max_dd"))


def consistency(years: DataFrame, keys: Sequence[str] = ("symbol",), best: int = 10, worst: int = 5) -> DataFrame:
    """Number of years each run is among the best and the worst."""
    w = Window.partitionBy(*keys, "year")
    ranked = years.withColumns({
        "_up": F.row_number().over(w.orderBy(F.col("year_return").desc(), "run_id")),
        "_dn": F.row_number().over(w.orderBy("year_return", "run_id")),
    })
    return ranked.groupBy(*keys, "run_id").agg(
        F.count_if(F.col("_up") <= best).alias("years_top"), F.count_if(F.col("_dn") <= worst).alias("years_bottom"))


def top_by_metrics(results: DataFrame, metrics_: Sequence[str], k: int = 15, by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` best runs by each metric (every metric is better when larger)."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics_]))
    long = results.select(*by, "run_id", rows.alias("_m")).select(*by, "run_id", "_m.*")
    w = Window.partitionBy(*by, "metric").orderBy(F.col("value").desc(), "run_id")
    return long.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def year_matrix(years: DataFrame) -> DataFrame:
    """One row per run, one column per year of the data."""
    return years.groupBy("run_id").pivot("year").agg(F.first("year_return"))
