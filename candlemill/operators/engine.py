"""Signal backtests: emission as of each evaluation bar, fills, exits, admission, metrics.

A trade's exit depends on prices only, so every filled signal gets its outcome in parallel.
Only the position limit is sequential, and only among trades whose lifetimes overlap.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlemill.config import BacktestConfig, WalkForwardConfig
from candlemill.functions.blocks import running
from candlemill.functions.search import first_hit, range_extremes
from candlemill.operators.signals import Emitter, choose
from candlemill.schemas import KEYS
from candlemill.session import materialize


def prefixes(bars: DataFrame, cfg: BacktestConfig = BacktestConfig()) -> DataFrame:
    """The trailing bars seen at each evaluation bar, keyed by ``eval_idx``, renumbered from 0.

    A bar knows which evaluations see it, so this is an explode, not a join; each prefix has at
    most ``lookback + 1`` rows.
    """
    step = cfg.recompute_interval
    lowest = math.ceil(cfg.warmup / step) * step
    first = F.greatest(F.ceil(F.col("idx") / step) * step, F.lit(lowest))
    last = F.least(F.col("idx") + cfg.lookback, F.col("n_bars") - 1)
    evals = F.when(first <= last, F.sequence(first, last, F.lit(step).cast("bigint")))
    start = F.greatest(F.col("eval_idx") - cfg.lookback, F.lit(0))
    return (
        bars.withColumn("eval_idx", F.explode(evals))
        .withColumn("idx", F.col("idx") - start)
        .withColumn("n_bars", F.col("eval_idx") - start + 1)
    )


def prefixes_at(bars: DataFrame, points: DataFrame, keys: Sequence[str], lookback: int) -> DataFrame:
    """``prefixes`` of the evaluations in ``points`` (keys and ``eval_idx``) only."""
    asked = points.groupBy(*keys).agg(F.collect_set(F.col("eval_idx").cast("bigint")).alias("_asked"))
    seen_by = F.filter("_asked", lambda e: e.between(F.col("idx"), F.col("idx") + lookback))
    start = F.greatest(F.col("eval_idx") - lookback, F.lit(0))
    return (
        bars.join(asked, list(keys)).withColumn("eval_idx", F.explode(seen_by)).drop("_asked")
        .withColumn("idx", F.col("idx") - start)
        .withColumn("n_bars", F.col("eval_idx") - start + 1)
    )


def setups_at_evals(
    bars: DataFrame, emitter: Emitter, cfg: BacktestConfig, keys: Sequence[str]
) -> DataFrame:
    """All setups of every prefix; ``last`` marks those stamped at the evaluation bar."""
    keys = list(keys)
    seen = prefixes(bars, cfg)
    found = emitter.setups(seen, [*keys, "eval_idx"])
    span = F.least(F.col("eval_idx"), F.lit(cfg.lookback))
    return found.withColumn("last", F.col("idx") == span)


def fills(signals: DataFrame, bars: DataFrame, cfg: BacktestConfig, keys: Sequence[str]) -> DataFrame:
    """Limit fills on the signal bar, at an adverse price. ``signals.eval_idx`` is that bar."""
    keys = list(keys)
    at = bars.select(*keys, F.col("idx").alias("eval_idx"), F.col("high").alias("_h"),
                     F.col("low").alias("_l"))
    long = F.col("direction") == "LONG"
    got = F.when(long, F.col("_l") <= F.col("entry")).otherwise(F.col("_h") >= F.col("entry"))
    slip = F.col("entry") * cfg.slippage
    return signals.join(at, keys + ["eval_idx"]).filter(got).drop("_h", "_l").withColumns({
        "slippage_cost": slip,
        "entry_price": F.when(long, F.col("entry") + slip).otherwise(F.col("entry") - slip),
        "entry_idx": F.col("eval_idx"), "scan_from": F.col("eval_idx") + 1,
    })


def exit_rule() -> tuple[Column, Column, Column]:
    """(touched, price before slippage, reason) of one bar against one trade; stops go first."""
    long = F.col("direction") == "LONG"
    stop, target = F.col("stop"), F.col("target")
    stopped = F.when(long, F.col("low") <= stop).otherwise(F.col("high") >= stop)
    reached = F.when(long, F.col("high") >= target).otherwise(F.col("low") <= target)
    worse = F.when(long, F.least("open", "stop")).otherwise(F.greatest("open", "stop"))
    better = F.when(long, F.greatest("open", "target")).otherwise(F.least("open", "target"))
    return (
        stopped | reached, F.when(stopped, worse).otherwise(better),
        F.when(stopped, "stop_loss").otherwise("take_profit"),
    )


def outcomes(
    filled: DataFrame, bars: DataFrame, cfg: BacktestConfig, keys: Sequence[str],
    ids: Sequence[str],
) -> DataFrame:
    """Exit, excursions and profit of every filled signal, as if there were no position limit."""
    keys, ids = list(keys), list(ids)
    long = F.col("direction") == "LONG"
    touched, price, reason = exit_rule()
    may = F.when(long, (F.col("_lo") <= F.col("stop")) | (F.col("_hi") >= F.col("target"))).otherwise(
        (F.col("_hi") >= F.col("stop")) | (F.col("_lo") <= F.col("target"))
    )
    ohlc = bars.select(*keys, "idx", "ts", "open", "high", "low", "close").withColumnRenamed("ts", "_ts")
    hits = first_hit(
        filled, ohlc, keys, ids, ["direction", "stop", "target"], "scan_from",
        {"_hi": F.max("high"), "_lo": F.min("low")}, may, touched,
        F.struct(F.col("idx").alias("exit_idx"), F.col("_ts").alias("exit_ts"),
                 price.alias("raw_exit"), reason.alias("exit_reason")),
    ).select(*keys, *ids, "hit.*")
    final = bars.filter(F.col("idx") == F.col("n_bars") - 1).select(
        *keys, F.col("idx").alias("_last"), F.col("ts").alias("_last_ts"), F.col("close").alias("_last_close")
    )
    slip = F.col("raw_exit") * cfg.slippage
    out = filled.join(hits, keys + ids, "left").join(final, keys).withColumns({
        "exit_price": F.when(F.col("exit_idx").isNull(), F.col("_last_close"))
                       .when(long, F.col("raw_exit") - slip).otherwise(F.col("raw_exit") + slip),
        "busy_until": F.coalesce("exit_idx", F.col("_last") + 1),
        "exit_reason": F.coalesce("exit_reason", F.lit("end_of_data")),
        "exit_ts": F.coalesce("exit_ts", "_last_ts"),
        "exit_idx": F.coalesce("exit_idx", "_last"),
    }).drop("raw_exit", "_last", "_last_ts", "_last_close")
    # an end-of-data trade opened on the last bar still sees that bar once
    seen = out.withColumn("_from", F.least("scan_from", "exit_idx"))
    extremes = range_extremes(seen, ohlc, keys, ids, "_from", "exit_idx")
    up, down = F.col("max_high") - F.col("entry_price"), F.col("entry_price") - F.col("min_low")
    zero = F.lit(0.0)
    gross = F.when(long, F.col("exit_price") - F.col("entry_price")).otherwise(
        F.col("entry_price") - F.col("exit_price")
    )
    commission = cfg.commission * 2
    return out.join(extremes, keys + ids).withColumns({
        "mfe": F.greatest(zero, F.when(long, up).otherwise(down)),
        "mae": F.greatest(zero, F.when(long, down).otherwise(up)),
        "gross_pnl": gross, "commission": F.lit(commission),
        # the fill already contains the slippage; it is charged a second time here
        "net_pnl": gross - commission - F.col("slippage_cost"),
        "hold_bars": F.col("exit_idx") - F.col("entry_idx"),
        "risk": F.abs(F.col("entry") - F.col("stop")),
        "rr_ratio": F.coalesce(F.try_divide(F.abs(F.col("target") - F.col("entry")),
                                            F.abs(F.col("entry") - F.col("stop"))), zero),
    }).drop("max_high", "min_low", "scan_from")


def admit(trades: DataFrame, run: Sequence[str], limit: int) -> DataFrame:
    """Apply the position limit in entry order.

    Trades are cut into chains of overlapping lifetimes; each chain is decided on its own, so
    no run is gathered whole. A slot is free again on the bar its trade exits.
    """
    run = list(run)
    order = Window.partitionBy(*run).orderBy("entry_idx", "ord")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    busy = F.max("busy_until").over(before)
    numbered = trades.withColumn(
        "_new", (busy.isNull() | (busy <= F.col("entry_idx"))).cast("int")
    ).withColumn("_chain", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cols = [c for c in trades.columns if c not in run]
    packed = numbered.groupBy(*run, "_chain").agg(F.array_sort(F.collect_list(
        F.struct(F.col("entry_idx").alias("_e"), F.col("ord").alias("_o"), *cols)
    )).alias("_all"))
    start = F.struct(
        F.transform(F.slice("_all", 1, 0), lambda t: t["busy_until"]).alias("open"),
        F.slice("_all", 1, 0).alias("taken"),
    )

    def step(acc: Column, t: Column) -> Column:
        live = F.filter(acc["open"], lambda until: until > t["_e"])
        ok = F.size(live) < limit
        return F.struct(
            F.when(ok, F.concat(live, F.array(t["busy_until"]))).otherwise(live).alias("open"),
            F.when(ok, F.concat(acc["taken"], F.array(t))).otherwise(acc["taken"]).alias("taken"),
        )

    taken = packed.select(*run, F.explode(F.aggregate("_all", start, step)["taken"]).alias("t"))
    out = taken.select(*run, *[F.col(f"t.{c}").alias(c) for c in cols])
    return out.withColumn("trade_id", F.row_number().over(order))


def _steps(trades: DataFrame, run: Sequence[str]) -> DataFrame:
    """Equity moves of each run in curve order; trades left open at the end move one by one."""
    late = F.when(F.col("exit_reason") == "end_of_data", F.col("trade_id")).otherwise(0)
    return trades.groupBy(*run, F.col("busy_until").alias("at"), late.alias("late")).agg(
        F.sum("net_pnl").alias("delta"), F.max("exit_idx").alias("exit_idx")
    )


def equity_stats(
    steps: DataFrame, points: DataFrame, run: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Sharpe and drawdown of a realised equity curve from its moves alone.

    ``points`` has per run the starting ``capital`` and the number of ``moves`` in the full
    curve; bars without an exit contribute a zero return and need no row.
    """
    run = list(run)
    w = Window.partitionBy(*run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    curve = steps.join(points, run).withColumn("equity", F.col("capital") + F.sum("delta").over(w))
    prev = F.col("equity") - F.col("delta")
    curve = curve.withColumns({
        "ret": F.try_divide(F.col("delta"), prev),
        "peak": F.greatest(F.col("capital"), F.max("equity").over(w)),
    }).withColumn("dd", F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")) / F.col("peak")).otherwise(0.0))
    sums = curve.groupBy(*run).agg(
        F.sum("ret").alias("_r"), F.sum(F.col("ret") * F.col("ret")).alias("_r2"),
        F.max("dd").alias("max_drawdown_pct"),
        F.max_by(F.col("peak") - F.col("equity"), F.struct("dd", *[-F.col(o) for o in order])).alias("max_drawdown"),
        F.sum("delta").alias("_d"),
    )
    mean = F.try_divide("_r", "moves")
    var = F.try_divide("_r2", "moves") - mean * mean
    sharpe = F.when(var > 0, mean / F.sqrt(var) * math.sqrt(252)).otherwise(0.0)
    zero = F.lit(0.0)
    return points.join(sums, run, "left").select(
        *run, F.coalesce(sharpe, zero).alias("sharpe_ratio"),
        F.coalesce("max_drawdown_pct", zero).alias("max_drawdown_pct"),
        F.coalesce("max_drawdown", zero).alias("max_drawdown"),
        "capital", (F.col("capital") + F.coalesce("_d", zero)).alias("final_equity"),
    )


def trade_stats(trades: DataFrame, run: Sequence[str]) -> DataFrame:
    net = F.col("net_pnl")
    win, loss = F.when(net > 0, net), F.when(net <= 0, net)
    return trades.groupBy(*run).agg(
        F.count(F.lit(1)).alias("total_trades"), F.count(win).alias("winners"),
        F.count(loss).alias("losers"), F.sum("gross_pnl").alias("total_gross_pnl"),
        F.sum("commission").alias("total_commission"), F.sum("slippage_cost").alias("total_slippage"),
        F.sum("net_pnl").alias("total_net_pnl"), F.coalesce(F.sum(win), F.lit(0.0)).alias("_w"),
        F.coalesce(F.abs(F.sum(loss)), F.lit(0.0)).alias("_l"), F.avg(win).alias("avg_win"),
        F.avg(loss).alias("avg_loss"), F.avg("hold_bars").alias("avg_hold_bars"),
        F.avg("mae").alias("avg_mae"), F.avg("mfe").alias("avg_mfe"),
        F.max("net_pnl").alias("largest_win"), F.min("net_pnl").alias("largest_loss"),
    ).withColumns({
        "win_rate": F.col("winners") / F.col("total_trades"),
        "profit_factor": F.when(F.col("_l") > 0, F.col("_w") / F.col("_l"))
                          .when(F.col("_w") > 0, F.lit(float("inf"))).otherwise(0.0),
    }).drop("_w", "_l")


def metrics(
    trades: DataFrame, runs: DataFrame, run: Sequence[str], cfg: BacktestConfig = BacktestConfig(),
    capital: Column | None = None,
) -> DataFrame:
    """One row per run in ``runs`` (which has ``n_bars``), also for runs without trades."""
    run = list(run)
    late = trades.groupBy(*run).agg(
        F.count_if(F.col("exit_reason") == "end_of_data").alias("_late")
    )
    points = runs.join(late, run, "left").select(
        *run, (capital if capital is not None else F.lit(cfg.initial_capital)).alias("capital"),
        (F.greatest(F.col("n_bars") - cfg.warmup, F.lit(0)) + F.coalesce("_late", F.lit(0))).alias("moves"),
    )
    out = equity_stats(_steps(trades, run), points, run, ["at", "late"]).join(
        trade_stats(trades, run), run, "left"
    )
    filled = [c for c in out.columns if c not in run]
    return out.fillna(0, filled).withColumnRenamed("capital", "initial_capital")


def equity_curve(
    trades: DataFrame, bars: DataFrame, run: Sequence[str], keys: Sequence[str],
    cfg: BacktestConfig = BacktestConfig(),
) -> DataFrame:
    """Realised equity after each bar, then one point per trade closed at the end of data."""
    run, keys = list(run), list(keys)
    steps = _steps(trades, run)
    exits = steps.filter(F.col("late") == 0).select(*run, F.col("at").alias("idx"), "delta")
    runs = trades.select(*run).distinct()
    grid = bars.filter(F.col("idx") >= cfg.warmup).select(*keys, "idx", "n_bars").join(runs, keys)
    late = steps.filter(F.col("late") > 0)
    ordinal = Window.partitionBy(*run).orderBy("late")
    ends = late.select(*run, (F.col("at") + F.row_number().over(ordinal) - 1).alias("idx"), "delta")
    rows = (
        grid.join(exits, run + ["idx"], "left").select(*run, "idx", F.coalesce("delta", F.lit(0.0)).alias("delta"))
        .unionByName(ends)
    )
    out = running(rows, run, {"_sum": ("sum", F.col("delta"))})
    return out.select(
        *run, (F.col("idx") - cfg.warmup + 1).alias("step"),
        (F.lit(cfg.initial_capital) + F.col("_sum")).alias("equity"),
    )


def grid(spark: SparkSession, cfg: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Confidence by reward-to-risk parameter pairs in sweep order."""
    rows = [(i, c, r) for i, (c, r) in enumerate(
        (c, r) for c in cfg.sweep_confidence for r in cfg.sweep_rr)]
    return spark.createDataFrame(rows, "param_id int, min_confidence double, min_rr_ratio double")


def _trades(
    found: DataFrame, bars: DataFrame, dedupe: bool, cfg: BacktestConfig, keys: list[str],
    params: list[str],
) -> DataFrame:
    """Signals of one or many parameter sets to admitted trades."""
    run = [*keys, *params]
    picked = choose(found, F.col("min_confidence"), F.col("min_rr_ratio"), dedupe, [*run, "eval_idx"])
    stamped = picked.filter(F.col("last")).drop("last", "idx")
    filled = fills(stamped, bars, cfg, keys)
    # the same signal under several parameter sets has one outcome
    ids = ["eval_idx", "direction", "entry", "stop", "target", "ord"]
    distinct = filled.select(*keys, *ids, "slippage_cost", "entry_price", "entry_idx", "scan_from").distinct()
    known = outcomes(distinct, bars, cfg, keys, ids)
    extra = [c for c in filled.columns if c not in distinct.columns]
    return admit(filled.select(*keys, *ids, *extra).join(known, keys + ids), run, cfg.max_open)


def backtest(
    bars: DataFrame, emitter: Emitter, cfg: BacktestConfig = BacktestConfig(),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Trades of one emitter on every series."""
    keys = list(keys)
    found = setups_at_evals(bars, emitter, cfg, keys).withColumns({
        "min_confidence": F.lit(emitter.min_confidence), "min_rr_ratio": F.lit(emitter.min_rr),
    })
    return _trades(materialize(found, "setups"), bars, emitter.dedupe, cfg, keys, [])


def runs_of(bars: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return bars.groupBy(*keys).agg(F.max("n_bars").alias("n_bars"))


def sweep(
    bars: DataFrame, emitter: Emitter, cfg: BacktestConfig = BacktestConfig(),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Metrics per series and parameter pair. Setups are found once for the whole grid."""
    keys = list(keys)
    params = grid(bars.sparkSession, cfg)
    found = materialize(setups_at_evals(bars, emitter, cfg, keys), "setups")
    run = [*keys, "param_id"]
    trades = materialize(
        _trades(found.crossJoin(params), bars, emitter.dedupe, cfg, keys, ["param_id"]), "sweep_trades"
    )
    out = metrics(trades, runs_of(bars, keys).crossJoin(params.select("param_id")), run, cfg)
    return out.drop("min_confidence", "min_rr_ratio").join(params, "param_id")


def best_params(swept: DataFrame, metric: str, run: Sequence[str]) -> DataFrame:
    """Best parameters per run; the first in sweep order among equals."""
    ok = F.col("total_trades") >= (5 if metric == "profit_factor" else 0)
    w = Window.partitionBy(*run).orderBy(F.col(metric).desc(), "param_id")
    return (
        swept.filter(ok).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
        .select(*run, "param_id", "min_confidence", "min_rr_ratio", F.col(metric).alias("best_value"))
    )


def folds(runs: DataFrame, cfg: WalkForwardConfig = WalkForwardConfig()) -> DataFrame:
    """Train and test ranges per series (ends exclusive), while the test range fits."""
    spare = F.col("n_bars") - (cfg.train + cfg.test)
    number = F.explode(F.when(spare >= 0, F.sequence(F.lit(0).cast("bigint"), F.floor(spare / cfg.step))))
    start = F.col("fold") * cfg.step
    begin = start if cfg.mode == "rolling" else F.lit(0)
    return runs.withColumn("fold", number).withColumns({
        "train_start": begin.cast("bigint"), "train_end": start + cfg.train,
        "test_start": start + cfg.train, "test_end": start + cfg.train + cfg.test,
    }).drop("n_bars")


def fold_bars(bars: DataFrame, ranges: DataFrame, part: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bars of each fold's train or test range, renumbered from 0."""
    lo, hi = F.col(f"{part}_start"), F.col(f"{part}_end")
    return (
        bars.join(ranges.select(*keys, "fold", lo.alias("_lo"), hi.alias("_hi")), list(keys))
        .filter((F.col("idx") >= F.col("_lo")) & (F.col("idx") < F.col("_hi")))
        .withColumns({"idx": F.col("idx") - F.col("_lo"), "n_bars": F.col("_hi") - F.col("_lo")})
        .drop("_lo", "_hi")
    )


def evaluations(ranges: DataFrame, part: str, cfg: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Every fold's evaluation bars (``eval_idx``, counted from the fold's first bar), with the first
    and last bar each sees, ``_from`` and ``_to``, counted from the start of the series."""
    step, lo = cfg.recompute_interval, F.col(f"{part}_start")
    lowest, last = math.ceil(cfg.warmup / step) * step, F.col(f"{part}_end") - lo - 1
    at = F.when(last >= lowest, F.sequence(F.lit(lowest).cast("bigint"), last, F.lit(step).cast("bigint")))
    return ranges.withColumn("eval_idx", F.explode(at)).withColumns({
        "_from": lo + F.greatest(F.col("eval_idx") - cfg.lookback, F.lit(0)), "_to": lo + F.col("eval_idx"),
    }).drop(*[f"{p}_{end}" for p in ("train", "test") for end in ("start", "end")])


def shared_setups(
    bars: DataFrame, asked: DataFrame, emitter: Emitter, cfg: BacktestConfig, keys: Sequence[str],
) -> DataFrame:
    """All setups of every evaluation in ``asked``, as ``setups_at_evals`` would find them fold by fold.

    Folds that see the same bars at an evaluation share one prefix, so anchored folds detect their
    common past once. A prefix takes its bars from the two or three blocks it touches.
    """
    keys = list(keys)
    seen = materialize(shared_prefixes(bars, asked, cfg, keys), "prefixes")
    found = materialize(emitter.setups(seen, [*keys, "_from", "_to"]), "prefix_setups")
    return found.withColumn("last", F.col("idx") == F.col("_to") - F.col("_from")).join(
        asked, [*keys, "_from", "_to"]).drop("_from", "_to")


def shared_prefixes(bars: DataFrame, asked: DataFrame, cfg: BacktestConfig, keys: Sequence[str]) -> DataFrame:
    """The bars of each different (``_from``, ``_to``) of ``asked``, renumbered from 0."""
    keys, size = list(keys), cfg.lookback + 1
    first, last = F.floor(F.col("_from") / size), F.floor(F.col("_to") / size)
    spans = asked.select(*keys, "_from", "_to").distinct().withColumn("_blk", F.explode(F.sequence(first, last)))
    return (
        bars.withColumn("_blk", F.floor(F.col("idx") / size)).join(spans, [*keys, "_blk"])
        .filter(F.col("idx").between(F.col("_from"), F.col("_to")))
        .withColumns({"idx": F.col("idx") - F.col("_from"), "n_bars": F.col("_to") - F.col("_from") + 1})
        .drop("_blk")
    )


def walk_forward(
    bars: DataFrame, emitter: Emitter, cfg: BacktestConfig = BacktestConfig(),
    wf: WalkForwardConfig = WalkForwardConfig(), keys: Sequence[str] = KEYS,
) -> tuple[DataFrame, DataFrame]:
    """(per-fold metrics, per-series aggregate): sweep on train, best parameters on test.

    All folds of all series run as keys of one job, over the setups of prefixes that they share.
    """
    keys = list(keys)
    run = [*keys, "fold"]
    ranges = folds(runs_of(bars, keys), wf)
    spark = bars.sparkSession
    params = grid(spark, cfg)
    parts = {p: materialize(fold_bars(bars, ranges, p, keys), p) for p in ("train", "test")}
    asked = evaluations(ranges, "train", cfg).withColumn("part", F.lit("train")).unionByName(
        evaluations(ranges, "test", cfg).withColumn("part", F.lit("test")))
    setups = materialize(shared_setups(bars, asked, emitter, cfg, keys), "setups")
    found = {p: setups.filter(F.col("part") == p).drop("part") for p in parts}
    swept = materialize(_trades(found["train"].crossJoin(params), parts["train"], emitter.dedupe, cfg,
                                run, ["param_id"]), "train_trades")
    every = ranges.select(*run, (F.col("train_end") - F.col("train_start")).alias("n_bars"))
    train = metrics(swept, every.crossJoin(params.select("param_id")), [*run, "param_id"], cfg).join(params, "param_id")
    best = best_params(train, wf.metric, run)
    first = params.filter(F.col("param_id") == 0)
    best = materialize(ranges.select(*run).join(best, run, "left").crossJoin(
        first.select(F.col("param_id").alias("_p"), F.col("min_confidence").alias("_c"),
                     F.col("min_rr_ratio").alias("_r"))
    ).select(*run, F.coalesce("param_id", "_p").alias("param_id"),
             F.coalesce("min_confidence", "_c").alias("min_confidence"),
             F.coalesce("min_rr_ratio", "_r").alias("min_rr_ratio")), "best")
    is_trades = swept.join(best.select(*run, "param_id"), [*run, "param_id"]).drop("param_id")
    chosen = found["test"].join(best.drop("param_id"), run)
    oos_trades = materialize(_trades(chosen, parts["test"], emitter.dedupe, cfg, run, []), "oos_trades")
    tests = ranges.select(*run, (F.col("test_end") - F.col("test_start")).alias("n_bars"))
    per_fold = best.join(_named(metrics(is_trades, every, run, cfg), run, "is_"), run).join(
        _named(metrics(oos_trades, tests, run, cfg), run, "oos_"), run)
    whole_is = _aggregate(is_trades, every, keys, cfg)
    whole_oos = _aggregate(oos_trades, tests, keys, cfg)
    total = _named(whole_is, keys, "is_").join(_named(whole_oos, keys, "oos_"), keys).withColumn(
        "robustness", F.try_divide("oos_total_net_pnl", "is_total_net_pnl"))
    return per_fold, total


def _named(df: DataFrame, keep: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keep])


def _aggregate(trades: DataFrame, spans: DataFrame, keys: list[str], cfg: BacktestConfig) -> DataFrame:
    """Metrics over all folds of a series, with their equity moves joined end to end."""
    late = trades.groupBy(*keys).agg(F.count_if(F.col("exit_reason") == "end_of_data").alias("_late"))
    moves = spans.groupBy(*keys).agg(
        F.sum(F.greatest(F.col("n_bars") - cfg.warmup, F.lit(0))).alias("_bars")
    )
    points = moves.join(late, keys, "left").select(
        *keys, F.lit(cfg.initial_capital).alias("capital"),
        (F.col("_bars") + F.coalesce("_late", F.lit(0))).alias("moves"))
    steps = _steps(trades, [*keys, "fold"])
    out = equity_stats(steps, points, keys, ["fold", "at", "late"]).join(trade_stats(trades, keys), keys, "left")
    return out.fillna(0, [c for c in out.columns if c not in keys])


def portfolio(
    bars: DataFrame, emitter: Emitter, cfg: BacktestConfig = BacktestConfig(),
    keys: Sequence[str] = KEYS,
) -> tuple[DataFrame, DataFrame]:
    """(per-series metrics, one-row portfolio): capital is split equally over the series."""
    keys = list(keys)
    trades = materialize(backtest(bars, emitter, cfg, keys), "portfolio_trades")
    runs = runs_of(bars, keys)
    count = runs.agg(F.count(F.lit(1)).alias("series"))
    per = metrics(trades, runs.crossJoin(count), keys, cfg, F.lit(cfg.initial_capital) / F.col("series"))
    # Curves are aligned by position, bar by bar, then end-of-data trades one by one.
    steps = _steps(trades, keys)
    ordinal = Window.partitionBy(*keys, "at").orderBy("late")
    at = F.col("at") + F.when(F.col("late") > 0, F.row_number().over(ordinal) - 1).otherwise(0)
    moves = steps.withColumn("pos", at).groupBy("pos").agg(F.sum("delta").alias("delta"))
    late = trades.groupBy(*keys).agg(F.count_if(F.col("exit_reason") == "end_of_data").alias("_late"))
    longest = runs.join(late, keys, "left").agg(F.max(
        F.greatest(F.col("n_bars") - cfg.warmup, F.lit(0)) + F.coalesce("_late", F.lit(0))).alias("moves"))
    one = F.lit("portfolio").alias("run")
    points = longest.select(one, F.lit(cfg.initial_capital).alias("capital"), "moves")
    whole = equity_stats(moves.withColumn("run", one), points, ["run"], ["pos"])
    total = per.agg(F.sum("total_net_pnl").alias("total_net_pnl"), F.sum("total_trades").alias("total_trades"))
    return per, whole.crossJoin(total).drop("run")
