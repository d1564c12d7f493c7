"""A cash-limited daily portfolio over pattern signals of ranked names.

Entries and exits are computed for all candidates in parallel; an exit never depends on cash.
Patterns are detected at the listed names' signal dates, which gives the candidates, and then at the
dates on which a candidate may still be held, which tells when its pattern is gone. What is left for the sequential part is a few candidates per date
and scenario: names held are at most ``max_positions``, so the best ``top_n + max_positions``
of a date always contain its best ``top_n`` names not held.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import astuple, dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlemill.config import BacktestConfig, PatternConfig
from candlemill.functions.asof import as_of_last
from candlemill.functions.quantile import exact_median
from candlemill.functions.search import first_hit
from candlemill.operators import engine as en
from candlemill.operators import patterns as pt
from candlemill.session import materialize

TRADED = ("false_breakdown", "false_breakdown_w_bottom")
MAX_RANK = 20


@dataclass(frozen=True)
class Scenario:
    scenario: str
    capital: float = 100.0
    max_positions: int = 5
    top_n: int = 2
    max_hold: int = 0
    hard_stop: float = 0.0
    use_close: bool = False
    stop_limit: bool = False


ALL_BARS = 2**31 - 1


def scenario_table(spark: SparkSession, scenarios: Sequence[Scenario]) -> DataFrame:
    kinds = {"str": "string", "int": "int", "float": "double", "bool": "boolean"}
    schema = ", ".join(f"{f.name} {kinds[f.type]}" for f in fields(Scenario))
    return spark.createDataFrame([astuple(s) for s in scenarios], schema)


def patterns_as_of(bars: DataFrame, cfg: PatternConfig = PatternConfig(), lookback: int = ALL_BARS) -> DataFrame:
    """Traded patterns seen at every bar of every symbol, from all of that bar's past."""
    every = BacktestConfig(recompute_interval=1, warmup=cfg.min_bars - 1, lookback=lookback)
    keys = ["symbol", "eval_idx"]
    return pt.detect(en.prefixes(bars, every), cfg, TRADED, keys)


def patterns_at(
    bars: DataFrame, points: DataFrame, cfg: PatternConfig = PatternConfig(), lookback: int = ALL_BARS,
) -> DataFrame:
    """``patterns_as_of`` at the bars of ``points`` (``symbol, eval_idx``) only."""
    known = points.filter(F.col("eval_idx") >= cfg.min_bars - 1)
    return pt.detect(en.prefixes_at(bars, known, ["symbol"], lookback), cfg, TRADED, ["symbol", "eval_idx"])


def panel(bars: DataFrame, found: DataFrame, dates: DataFrame, cfg: PatternConfig = PatternConfig()) -> DataFrame:
    """Prices on the ledger's dates, with whether each traded pattern is gone: looked for and not detected."""
    kinds = found.groupBy("symbol", F.col("eval_idx").alias("idx")).agg(*[
        F.bool_or(F.col("pattern_type") == k).alias(f"has_{k}") for k in TRADED])
    out = bars.withColumn("date", F.col("ts").cast("date")).join(dates, "date").join(kinds, ["symbol", "idx"], "left")
    known = F.col("idx") >= cfg.min_bars - 1
    gone = {f"gone_{k}": known & ~F.coalesce(f"has_{k}", F.lit(False)) for k in TRADED}
    return out.withColumns(gone).select("symbol", "date", "idx", "pos", "lpos", "open", "high", "low", "close", *gone)


def still_open(placed: DataFrame, prices: DataFrame) -> DataFrame:
    """``symbol, eval_idx``: the bars after entry at which a candidate with these exits may be held."""
    last = F.coalesce(F.col("exit_lpos"), F.col("n_dates") - 1).cast("int")
    first = F.col("scan_from").cast("int")
    days = placed.filter(first <= last).select("symbol", F.explode(F.sequence(first, last)).alias("lpos")).distinct()
    return days.join(prices, ["symbol", "lpos"]).select("symbol", F.col("idx").alias("eval_idx"))


def calendar(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """Ledger dates: signal dates with their number, and both positions of those that are trading days.

    Trading days are the ``ts`` of ``bars``. ``last`` is the ``lpos`` of the latest trading day up to a date, null before the first one.
    """
    days = bars.select(F.col("ts").cast("date").alias("date")).distinct()
    days = days.withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)
    used = signals.select(F.col("data_date").alias("date")).distinct().join(days, "date", "left")
    w = Window.orderBy("date")
    last = F.nullif(F.count("pos").over(w), F.lit(0)).cast("int") - 1
    return used.withColumns({"day": F.row_number().over(w) - 1, "last": last}).withColumns({
        "lpos": F.when(F.col("pos").isNotNull(), F.col("last")), "n_dates": F.count("pos").over(Window.partitionBy()),
    })


def on_every_date(done: DataFrame, dates: DataFrame, scenarios: DataFrame) -> DataFrame:
    """The ledger by all its dates; one without prices has the last equity and no trades."""
    at = dates.filter(F.col("lpos").isNotNull()).select("date", "day", "lpos")
    out = done.join(at, "lpos")
    for col in ("entry_lpos", "exit_lpos"):
        out = out.join(at.select(F.col("lpos").alias(col), F.col("day").alias(f"_{col}")), col, "left")
    out = out.withColumns({"lpos": F.col("day"), "entry_lpos": F.col("_entry_lpos"), "exit_lpos": F.col("_exit_lpos")})
    held = done.filter(F.col("kind") == "equity").select("scenario", F.col("lpos").alias("last"), "value")
    known = scenarios.join(done.select("scenario").distinct(), "scenario", "left_semi").select("scenario", "capital")
    idle = dates.filter(F.col("lpos").isNull()).select("date", "day", "last").crossJoin(known)
    carried = idle.join(held, ["scenario", "last"], "left").select(
        "scenario", "date", F.lit("equity").alias("kind"), F.col("day").alias("lpos"),
        F.coalesce("value", "capital").alias("value"))
    return out.drop("day", "_entry_lpos", "_exit_lpos").unionByName(carried, allowMissingColumns=True)


def candidates(
    rankings: DataFrame, bars: DataFrame, found: DataFrame, dates: DataFrame, scenarios: DataFrame,
    widest: int,
) -> DataFrame:
    """Per scenario and date, the most confident pattern names, enough for any held set."""
    best = pt.best_pattern(found, ["symbol", "eval_idx"]).select(
        "symbol", "eval_idx", "pattern_type", "confidence", F.col("stop").alias("pattern_stop"),
        F.col("target1").alias("target"))
    rows = listed(rankings, bars).join(best, ["symbol", "eval_idx"]).join(dates.select("date", "lpos", "n_dates"), "date")
    w = Window.partitionBy("date").orderBy(F.col("confidence").desc(), "rank", "symbol")
    few = rows.withColumn("ord", F.row_number().over(w)).filter(F.col("ord") <= widest)
    return few.crossJoin(scenarios).filter(F.col("ord") <= F.col("top_n") + F.col("max_positions"))


def signals(rankings: DataFrame) -> DataFrame:
    return rankings.filter(
        (F.col("ranking_type") == "top100") & (F.col("long_short") == "Long in") & (F.col("rank") <= MAX_RANK))


def listed(rankings: DataFrame, bars: DataFrame) -> DataFrame:
    """The names of each signal date with the latest bar up to it."""
    names = signals(rankings).select("symbol", "data_date", "rank")
    return as_of_last(
        names.withColumnRenamed("data_date", "date"),
        bars.select("symbol", F.col("ts").cast("date").alias("date"), F.col("idx").alias("eval_idx")),
        ["symbol"], "eval_idx")


def with_exits(cands: DataFrame, prices: DataFrame) -> DataFrame:
    """Entry and exit of every candidate, as if it were bought."""
    entry_at = F.when(F.col("use_close"), F.col("lpos")).otherwise(F.col("lpos") + 1)
    entry = prices.select("symbol", F.col("lpos").alias("entry_lpos"), F.col("pos").alias("entry_pos"),
                          F.col("date").alias("entry_date"), F.col("open").alias("_o"), F.col("close").alias("_c"))
    placed = cands.withColumn("entry_lpos", entry_at).withColumnRenamed("lpos", "signal_lpos").drop("date").join(
        entry, ["symbol", "entry_lpos"]).withColumn("entry_price", F.when(F.col("use_close"), F.col("_c")).otherwise(F.col("_o")))
    hard = F.col("hard_stop") > 0
    placed = placed.withColumns({
        "stop": F.when(hard, F.col("entry_price") * (1 - F.col("hard_stop"))).otherwise(F.col("pattern_stop")),
        "scan_from": F.col("entry_lpos") + 1, "cand": F.concat_ws("/", "scenario", "signal_lpos", "symbol"),
    }).drop("_o", "_c").filter(
        (F.col("entry_price") > 0) & (F.col("target") > F.col("entry_price"))
        & (F.col("use_close") | (F.col("pattern_stop") < F.col("entry_price"))))
    # Each reason to leave, as a test on one bar and as the same test on a block's extremes.
    closing = F.col("use_close")
    cut = F.col("entry_price") * (1 - F.col("hard_stop"))
    stop_bar = F.when(~closing | (F.col("stop_limit") & hard), F.col("low") <= F.col("stop")).when(
        hard, F.try_divide(F.col("close") - F.col("entry_price"), F.col("entry_price")) <= -F.col("hard_stop")).otherwise(False)
    stop_blk = F.when(~closing | (F.col("stop_limit") & hard), F.col("_lo") <= F.col("stop")).when(
        hard, F.try_divide(F.col("_lc") - F.col("entry_price"), F.col("entry_price")) <= -F.col("hard_stop")).otherwise(False)
    hit_bar = F.when(closing, F.col("close") >= F.col("target")).otherwise(F.col("high") >= F.col("target"))
    hit_blk = F.when(closing, F.col("_hc") >= F.col("target")).otherwise(F.col("_hi") >= F.col("target"))
    aged = (F.col("max_hold") > 0) & (F.col("pos") - F.col("entry_pos") >= F.col("max_hold"))
    aged_blk = (F.col("max_hold") > 0) & (F.col("_pos") - F.col("entry_pos") >= F.col("max_hold"))
    gone, gone_blk = F.lit(False), F.lit(False)
    for k in TRADED:
        gone = gone | ((F.col("pattern_type") == k) & F.col(f"gone_{k}"))
        gone_blk = gone_blk | ((F.col("pattern_type") == k) & F.col(f"_g_{k}"))
    price = (
        F.when(stop_bar, F.when(~closing | F.col("stop_limit"), F.col("stop")).otherwise(F.col("close")))
        .when(hit_bar, F.when(closing, F.col("close")).otherwise(F.col("target"))).otherwise(F.col("close")))
    reason = (F.when(stop_bar, "stop_loss").when(hit_bar, "target_hit").when(aged, "max_hold")
              .otherwise("pattern_invalidated"))
    line = prices.withColumn("idx", F.col("lpos"))
    hits = first_hit(
        placed, line, ["symbol"], ["cand"],
        ["pattern_type", "entry_price", "entry_pos", "stop", "target", "hard_stop", "use_close", "stop_limit", "max_hold"],
        "scan_from",
        {"_lo": F.min("low"), "_hi": F.max("high"), "_lc": F.min("close"), "_hc": F.max("close"), "_pos": F.max("pos"),
         **{f"_g_{k}": F.bool_or(f"gone_{k}") for k in TRADED}},
        stop_blk | hit_blk | aged_blk | gone_blk, stop_bar | hit_bar | aged | gone,
        F.struct(F.col("lpos").alias("exit_lpos"), F.col("date").alias("exit_date"), price.alias("exit_price"),
                 reason.alias("exit_reason")))
    return placed.join(hits.select("symbol", "cand", "hit.*"), ["symbol", "cand"], "left")


def with_path(placed: DataFrame, prices: DataFrame) -> DataFrame:
    """Closes of each candidate from entry to exit, for marking to market."""
    last = F.coalesce(F.col("exit_lpos"), F.col("n_dates") - 1)
    days = placed.select("symbol", "cand", F.explode(F.sequence(F.col("entry_lpos").cast("int"), last.cast("int"))).alias("lpos"))
    path = days.join(prices.select("symbol", "lpos", "close", "date"), ["symbol", "lpos"]).groupBy("cand").agg(
        F.array_sort(F.collect_list(F.struct("lpos", "close"))).alias("path"))
    return placed.join(path, "cand")


_OUT = ("scenario string, kind string, lpos int, symbol string, pattern_type string, entry_lpos int, exit_lpos int,"
        " entry_price double, exit_price double, exit_reason string, shares double, allocated double, value double,"
        " rank int, confidence double")


def play(pdf: pd.DataFrame) -> pd.DataFrame:
    """One scenario's cash ledger over its dates: trades taken and equity after each date."""
    first = pdf.iloc[0]
    limit, top_n, n = int(first.max_positions), int(first.top_n), int(first.n_dates)
    by_date: dict[int, list] = {}
    for c in pdf.sort_values(["signal_lpos", "ord"]).itertuples():
        by_date.setdefault(int(c.signal_lpos), []).append(c)
    marks = {c.cand: {int(p["lpos"]): p["close"] for p in c.path} for c in pdf.itertuples() if c.path is not None}
    cash, held, waiting, rows = float(first.capital), [], [], []

    def worth(day: int) -> float:
        return cash + sum(s * marks[c.cand][day] for c, s, _ in held if day in marks[c.cand])

    def buy(c, day: int) -> None:
        nonlocal cash
        part = min(worth(day) / limit, cash)
        if part > 0:
            held.append((c, part / c.entry_price, part))
            cash -= part

    def close(c, shares: float, part: float, day: int, price: float, reason: str) -> None:
        rows.append((c.scenario, "trade", day, c.symbol, c.pattern_type, int(c.entry_lpos), day, c.entry_price, price,
                     reason, shares, part, shares * (price - c.entry_price), int(c.rank), c.confidence))

    for day in range(n):
        for c in waiting:
            if len(held) >= limit:
                break
            if c.tradable:
                buy(c, day)
        waiting, keep = [], []
        for c, shares, part in held:
            if not math.isnan(c.exit_lpos) and int(c.exit_lpos) == day:
                close(c, shares, part, day, c.exit_price, c.exit_reason)
                cash += shares * c.exit_price
            else:
                keep.append((c, shares, part))
        held = keep
        room = limit - len(held)
        if room > 0:
            names = {c.symbol for c, _, _ in held}
            fresh = [c for c in by_date.get(day, []) if c.symbol not in names][:min(top_n, room)]
            if first.use_close:
                for c in fresh:
                    if c.tradable and len(held) < limit:
                        buy(c, day)
            else:
                waiting = fresh
        rows.append((first.scenario, "equity", day, None, None, None, None, None, None, None, None, None, worth(day),
                     None, None))
    for c, shares, part in held:
        price = marks[c.cand].get(n - 1)
        if price is not None:
            close(c, shares, part, n - 1, price, "end_of_backtest")
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in _OUT.split(", ")])
    for col in ("lpos", "entry_lpos", "exit_lpos", "rank"):
        out[col] = out[col].astype("Int32")
    for col in ("entry_price", "exit_price", "shares", "allocated", "value", "confidence"):
        out[col] = out[col].astype(float)
    return out


def run(
    rankings: DataFrame, bars: DataFrame, scenarios: Sequence[Scenario],
    cfg: PatternConfig = PatternConfig(), lookback: int = ALL_BARS, found: DataFrame | None = None,
    days: DataFrame | None = None,
) -> DataFrame:
    """Trades (``kind = trade``) and daily equity (``kind = equity``) of every scenario.

    ``bars`` need hold the names of ``signals`` only if ``days`` has the ``ts`` of all bars.
    """
    spark = bars.sparkSession
    table = scenario_table(spark, scenarios)
    rankings = materialize(signals(rankings), "ledger_names")
    own = materialize(bars.join(rankings.select("symbol").distinct(), "symbol", "left_semi"), "ledger_bars")
    every = materialize(calendar(bars if days is None else days, rankings), "ledger_dates")
    dates = every.filter(F.col("lpos").isNotNull())
    on = dates.select("date", "pos", "lpos")
    widest = max(s.top_n + s.max_positions for s in scenarios)
    at_entry = found
    if found is None:
        asked = listed(rankings, own).select("symbol", "eval_idx")
        at_entry = materialize(patterns_at(own, asked, cfg, lookback), "entry_patterns")
    cands = materialize(candidates(rankings, own, at_entry, dates, table, widest), "ledger_candidates")
    if found is None:
        # A lost pattern can only bring an exit forward, so it matters up to the exit without it.
        plain = materialize(panel(own, at_entry.limit(0), on, cfg).withColumns(
            {f"gone_{k}": F.lit(False) for k in TRADED}), "ledger_plain")
        held = materialize(still_open(with_exits(cands, plain), plain), "ledger_held")
        found = materialize(patterns_at(own, held, cfg, lookback), "held_patterns")
    prices = materialize(panel(own, found, on, cfg), "ledger_prices")
    placed = with_path(with_exits(cands, prices), prices)
    keep = ["scenario", "symbol", "signal_lpos", "ord"]
    traded = placed.select(*keep, "cand", "entry_lpos", "entry_price", F.col("exit_lpos").cast("double").alias("exit_lpos"),
                           "exit_price", "exit_reason", "path", F.lit(True).alias("tradable"))
    # names that cannot be entered still take their place in the day's list
    ranked = cands.withColumnRenamed("lpos", "signal_lpos").select(
        *keep, "rank", "confidence", "pattern_type", "capital", "max_positions", "top_n", "use_close", "n_dates")
    rows = ranked.join(traded, keep, "left").withColumn("tradable", F.coalesce("tradable", F.lit(False)))
    done = materialize(rows.groupBy("scenario").applyInPandas(play, _OUT), "ledger_played")
    return on_every_date(done, every, table)


def results(done: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Return, win rate, median, Sharpe, drawdown and exit counts per scenario."""
    trades = done.filter(F.col("kind") == "trade").withColumn(
        "return_pct", F.try_divide(F.col("exit_price") - F.col("entry_price"), F.col("entry_price")))
    per = trades.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("total_trades"), F.avg((F.col("return_pct") > 0).cast("double")).alias("win_rate"),
        (F.avg("return_pct") * 100).alias("avg_return_pct"),
        *[F.count_if(F.col("exit_reason") == r).alias(f"exit_{r}")
          for r in ("stop_loss", "target_hit", "pattern_invalidated", "max_hold", "end_of_backtest")])
    w = Window.partitionBy("scenario").orderBy("lpos")
    eq = done.filter(F.col("kind") == "equity").join(scenarios.select("scenario", "capital"), "scenario")
    eq = eq.withColumns({
        "ret": F.try_divide(F.col("value"), F.lag("value").over(w)) - 1,
        "peak": F.greatest("capital", F.max("value").over(w)),
    })
    curve = eq.groupBy("scenario").agg(
        F.max_by("value", "lpos").alias("final_capital"), F.first("capital").alias("capital"),
        F.coalesce(F.avg("ret") / F.nullif(F.stddev_pop("ret"), F.lit(0.0)) * math.sqrt(252), F.lit(0.0)).alias("sharpe_ratio"),
        F.max((F.col("peak") - F.col("value")) / F.col("peak")).alias("max_drawdown_pct"))
    middle = exact_median(trades, ["scenario"], "return_pct", 0.01)
    return curve.join(per, "scenario", "left").join(middle, "scenario", "left").withColumns({
        "median_return_pct": F.col("median") * 100,
        "total_return_pct": (F.col("final_capital") - F.col("capital")) / F.col("capital") * 100,
    }).drop("median", "capital")


def extremes(done: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best and worst trades of each scenario."""
    trades = done.filter(F.col("kind") == "trade").withColumn(
        "return_pct", F.try_divide(F.col("exit_price") - F.col("entry_price"), F.col("entry_price")))
    w = Window.partitionBy("scenario")
    tie = ["lpos", "symbol"]
    out = trades.withColumns({
        "best": F.row_number().over(w.orderBy(F.col("return_pct").desc(), *tie)),
        "worst": F.row_number().over(w.orderBy("return_pct", *tie)),
    })
    return out.filter((F.col("best") <= k) | (F.col("worst") <= k))
