"""Ranking backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlemill.operators import patterns as pt
from candlemill.operators import rank_backtest as rb
from candlemill.plans.oracle import bars, rnd
from candlemill.plans.queries_patterns import detect_sql
from candlemill.plans.queries_screen import month_patterns
from candlemill.plans.queries_sources import RANKINGS, month
from candlemill.plans.registry import Registry, pick
from candlemill.sources import tables

reg = Registry()
BENCH = "S5"  # priced in every month


def prices(spark, sf):
    return month(spark, sf).select("symbol", F.col("ts").cast("date").alias("date"), "open", "close")


def _picks_sql(runs) -> str:
    values = ", ".join(
        f"('{r.run_id}', {r.top_n}, {r.hold}, {r.min_rank}, {r.max_rank}, {r.delay}, {r.momentum}, {str(r.short).lower()})" for r in runs)
    return f"""runs(run_id, top_n, hold, min_rank, max_rank, delay, momentum, short) AS (VALUES {values}),
pool AS MATERIALIZED (SELECT r.*, p.* FROM rankings r, runs p WHERE ranking_type = CASE WHEN short THEN 'bottom100' ELSE 'top100' END
  AND long_short = CASE WHEN short THEN 'Short in' ELSE 'Long in' END AND rank BETWEEN min_rank AND max_rank),
pd AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY data_date) AS dp FROM (SELECT DISTINCT run_id, data_date FROM pool)),
topn AS (SELECT p.*, dp FROM pool p JOIN pd USING (run_id, data_date) QUALIFY row_number() OVER (PARTITION BY run_id, data_date ORDER BY rank, symbol) <= top_n),
kept AS MATERIALIZED (SELECT t.* FROM topn t LEFT JOIN (SELECT p.run_id, p.symbol, dp, rank AS before FROM pool p JOIN pd USING (run_id, data_date)) b
  ON b.run_id = t.run_id AND b.symbol = t.symbol AND b.dp = t.dp - t.momentum
  WHERE t.momentum = 0 OR (t.dp > t.momentum AND (before IS NULL OR t.rank < before))),
ud AS (SELECT run_id, data_date, row_number() OVER (PARTITION BY run_id ORDER BY data_date) AS k, count(*) OVER (PARTITION BY run_id) AS n
  FROM (SELECT DISTINCT run_id, data_date FROM pool WHERE momentum = 0 UNION SELECT DISTINCT run_id, data_date FROM kept WHERE momentum > 0)),
picks AS MATERIALIZED (SELECT kept.* FROM kept JOIN ud USING (run_id, data_date) WHERE k <= n - hold)"""


TRADES = """px AS MATERIALIZED (SELECT symbol, CAST(ts AS DATE) AS date, open, close FROM bars),
days AS MATERIALIZED (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS nd FROM (SELECT DISTINCT date FROM px)),
pxp AS MATERIALIZED (SELECT px.*, pos FROM px JOIN days USING (date)),
pl AS (SELECT p.*, (SELECT min(pos) FROM days WHERE date > p.data_date) + delay AS entry_pos, (SELECT max(nd) FROM days) AS nd FROM picks p),
done AS MATERIALIZED (SELECT p.*, least(entry_pos + hold, nd - 1) AS exit_pos, b.open AS entry_price, b.date AS entry_date, s.close AS exit_price, s.date AS exit_date,
  CASE WHEN short THEN (b.open - s.close) / b.open ELSE (s.close - b.open) / b.open END AS return_pct
  FROM pl p JOIN pxp b ON b.symbol = p.symbol AND b.pos = p.entry_pos JOIN pxp s ON s.symbol = p.symbol AND s.pos = least(entry_pos + hold, nd - 1) WHERE b.open > 0)"""
CURVE = """hd AS (SELECT d.run_id, d.symbol, d.data_date, x.pos, c.close, d.entry_price FROM done d JOIN days x ON x.pos BETWEEN d.entry_pos AND d.exit_pos
  LEFT JOIN pxp c ON c.symbol = d.symbol AND c.pos = x.pos),
hr AS (SELECT *, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY run_id, symbol, data_date ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), entry_price) AS ref FROM hd),
dr AS (SELECT run_id, pos, avg((close - ref) / ref) AS r FROM hr WHERE close IS NOT NULL AND ref > 0 GROUP BY ALL),
bg AS (SELECT run_id, arg_min(entry_pos, data_date) AS b FROM done GROUP BY run_id),
cv AS MATERIALIZED (SELECT bg.run_id, days.pos, days.date, 100000.0 * exp(sum(ln(1 + coalesce(r, 0.0))) OVER (PARTITION BY bg.run_id ORDER BY days.pos ROWS UNBOUNDED PRECEDING)) AS equity
  FROM bg JOIN days ON days.pos >= b LEFT JOIN dr ON dr.run_id = bg.run_id AND dr.pos = days.pos),
dd AS MATERIALIZED (SELECT run_id, greatest(max(1 - equity / greatest(100000.0, pk)), 0.0) AS max_drawdown_pct FROM
  (SELECT *, max(equity) OVER (PARTITION BY run_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS pk FROM cv) GROUP BY run_id)"""
METRICS = f"""td AS (SELECT run_id, entry_date, avg(return_pct) AS d FROM done GROUP BY ALL),
tdm AS (SELECT run_id, (exp(sum(ln(1 + d))) - 1) * 100 AS total_return_pct, avg(d) AS m, stddev_pop(d) AS s FROM td GROUP BY ALL),
met AS MATERIALIZED (SELECT run_id, count(*) AS total_trades, avg(CAST(return_pct > 0 AS INT)) AS win_rate, avg(return_pct) * 100 AS avg_return_pct,
  median(return_pct) * 100 AS median_return_pct, any_value(total_return_pct) AS total_return_pct, any_value(m / s * sqrt(252 / hold)) AS sharpe_ratio FROM done JOIN tdm USING (run_id) GROUP BY run_id),
bm AS (SELECT g.run_id, (e.close - s.open) / s.open * 100 AS benchmark_return_pct FROM (SELECT run_id, (SELECT min(date) FROM days WHERE date >= min(data_date)) AS d FROM done GROUP BY run_id) g
  JOIN pxp s ON s.symbol = '{BENCH}' AND s.date = g.d JOIN pxp e ON e.symbol = '{BENCH}' AND e.pos = (SELECT max(nd) - 1 FROM days))"""


def pre(runs) -> str:
    return f"WITH {RANKINGS}, {bars('month')}, {_picks_sql(runs)}, {TRADES}"


def _done(spark, sf, runs):
    table = rb.run_table(spark, runs)
    picks = rb.selections(tables.rankings(spark, sf), table, max(r.top_n for r in runs))
    return rb.trades(picks, prices(spark, sf))


_BASE, _DELAY, _SHORT, _MOM = (rb.VARIATIONS[0],), (rb.VARIATIONS[3],), (rb.VARIATIONS[7],), (rb.VARIATIONS[5],)
for _key, _runs in (("g12_rank_backtest", _BASE), ("g13_delayed_entry", _DELAY), ("g14_short_side", _SHORT), ("g15_rank_momentum", _MOM)):
    reg.add(_key, f"{pre(_runs)} SELECT symbol, rank, data_date, entry_date, exit_date, {rnd('return_pct', 6)} AS return_pct FROM done")(
        lambda spark, sf, r=_runs: pick(_done(spark, sf, r).withColumn("rank", F.col("rank").cast("bigint")),
                                        "symbol rank data_date entry_date exit_date", return_pct=6))

MATCHES = f"""WITH {bars('month')}, {detect_sql()}, picks AS MATERIALIZED (SELECT p.symbol, pattern_type, confidence, CAST(b.ts AS DATE) AS data_date, 'patterns' AS run_id, 0 AS delay, 5 AS hold, false AS short
  FROM pat p JOIN bars b ON b.symbol = p.symbol AND b.idx = p.e_idx WHERE pattern_type IN ('false_breakdown_w_bottom', 'false_breakdown', 'bull_flag')
  QUALIFY row_number() OVER (PARTITION BY b.ts ORDER BY confidence DESC, p.symbol, detector, s_idx, e_idx) <= 5), {TRADES}"""


def matches(spark, sf, stamp="retrospective"):
    """Patterns with the date they are stamped on: their last bar, or the first bar they are known."""
    p = month_patterns(spark, sf).drop("idx")
    at = F.col("end_idx") if stamp == "retrospective" else pt.known_idx()
    dates = month(spark, sf).select("symbol", "idx", F.col("ts").cast("date").alias("data_date"))
    return p.withColumn("idx", at).join(dates, ["symbol", "idx"])


@reg.add("g16_pattern_backtest", f"{MATCHES} SELECT symbol, pattern_type, data_date, entry_date, exit_date, {rnd('return_pct', 6)} AS return_pct FROM done WHERE exit_pos > entry_pos")
def _(spark, sf):
    done = rb.trades(rb.pattern_picks(matches(spark, sf)), prices(spark, sf), strict_exit=True)
    return pick(done, "symbol pattern_type data_date entry_date exit_date", return_pct=6)


@reg.add("g16_pattern_backtest_as_of")
def _(spark, sf):
    done = rb.trades(rb.pattern_picks(matches(spark, sf, "as_of")), prices(spark, sf), strict_exit=True)
    return pick(done, "symbol pattern_type data_date entry_date exit_date", return_pct=6)


@reg.add("g17_rank_metrics", f"{pre(_BASE)}, {METRICS} SELECT run_id, total_trades, {rnd('win_rate', 6)} AS win_rate, {rnd('avg_return_pct', 5)} AS avg_return_pct, {rnd('median_return_pct', 5)} AS median_return_pct, {rnd('ln(1 + total_return_pct / 100)', 5)} AS log_return, {rnd('sharpe_ratio', 5)} AS sharpe_ratio FROM met")
def _(spark, sf):
    out = rb.trade_metrics(_done(spark, sf, _BASE), rb.run_table(spark, _BASE))
    out = out.withColumn("log_return", F.log(1 + F.col("total_return_pct") / 100))
    return pick(out, "run_id total_trades", win_rate=6, avg_return_pct=5, median_return_pct=5, log_return=5, sharpe_ratio=5)


@reg.add("g17_sector_returns", f"{pre(_BASE)} SELECT sector, count(*) AS trades, {rnd('avg(return_pct) * 100', 5)} AS avg_return_pct FROM done GROUP BY sector")
def _(spark, sf):
    return pick(rb.sector_returns(_done(spark, sf, _BASE), tables.rankings(spark, sf)), "sector trades", avg_return_pct=5)


@reg.add("g18_equity_curve", f"{pre(_BASE)}, {CURVE} SELECT date, {rnd('ln(equity)', 6)} AS log_equity FROM cv")
def _(spark, sf):
    out = rb.equity_curve(_done(spark, sf, _BASE), prices(spark, sf)).withColumn("log_equity", F.log("equity"))
    return pick(out, "date", log_equity=6)


@reg.add("g19_benchmark", f"{pre(_BASE)}, {METRICS} SELECT run_id, {rnd('benchmark_return_pct', 5)} AS benchmark_return_pct FROM bm")
def _(spark, sf):
    done = _done(spark, sf, _BASE)
    start = done.groupBy("run_id").agg(F.min("data_date").alias("start_date"))
    return pick(rb.benchmark(prices(spark, sf), BENCH, start), "run_id", benchmark_return_pct=5)


_BUCKET = "CASE WHEN rank <= 5 THEN '1-5' WHEN rank <= 10 THEN '6-10' WHEN rank <= 20 THEN '11-20' WHEN rank <= 30 THEN '21-30' WHEN rank <= 50 THEN '31-50' END"


@reg.add("g20_rank_buckets", f"{pre(_BASE)} SELECT {_BUCKET} AS bucket, count(*) AS trades, {rnd('avg(CAST(return_pct > 0 AS INT))', 6)} AS win_rate, {rnd('avg(return_pct) * 100', 5)} AS avg_return_pct, {rnd('avg(return_pct) / stddev_pop(return_pct) * sqrt(252 / 5)', 5)} AS sharpe FROM done GROUP BY bucket")
def _(spark, sf):
    return pick(rb.bucket_stats(_done(spark, sf, _BASE), 5), "bucket trades", win_rate=6, avg_return_pct=5, sharpe=5)


@reg.add("g20_symbol_frequency", f"{pre(_BASE)} SELECT symbol, count(*) AS trades, {rnd('avg(return_pct) * 100', 5)} AS avg_return_pct FROM done GROUP BY symbol ORDER BY trades DESC, symbol LIMIT 15")
def _(spark, sf):
    return pick(rb.symbol_stats(_done(spark, sf, _BASE), "trades", 15), "symbol trades", avg_return_pct=5)


@reg.add("g20_top_performers", f"{pre(_BASE)} SELECT symbol, count(*) AS trades, {rnd('sum(return_pct) * 100', 5)} AS total_return FROM done GROUP BY symbol ORDER BY sum(return_pct) DESC, symbol LIMIT 10")
def _(spark, sf):
    return pick(rb.symbol_stats(_done(spark, sf, _BASE), "total_return", 10), "symbol trades", total_return=5)


@reg.add("g20_by_pattern", f"{MATCHES} SELECT pattern_type, count(*) AS trades, {rnd('avg(CAST(return_pct > 0 AS INT))', 6)} AS win_rate, {rnd('avg(return_pct) * 100', 5)} AS avg_return_pct FROM done WHERE exit_pos > entry_pos GROUP BY pattern_type")
def _(spark, sf):
    done = rb.trades(rb.pattern_picks(matches(spark, sf)), prices(spark, sf), strict_exit=True)
    return pick(rb.pattern_stats(done), "pattern_type trades", win_rate=6, avg_return_pct=5)


_ALL = f"SELECT run_id, total_trades, {rnd('win_rate', 6)} AS win_rate, {rnd('avg_return_pct', 5)} AS avg_return_pct, {rnd('sharpe_ratio', 5)} AS sharpe_ratio, {rnd('max_drawdown_pct', 6)} AS max_drawdown_pct FROM met JOIN dd USING (run_id)"


def _compared(spark, sf, runs):
    out = rb.compare(tables.rankings(spark, sf), prices(spark, sf), runs, BENCH)
    return pick(out, "run_id total_trades", win_rate=6, avg_return_pct=5, sharpe_ratio=5, max_drawdown_pct=6)


reg.add("g21_rank_sweep", f"{pre(rb.sweep_runs())}, {METRICS}, {CURVE} {_ALL}")(lambda spark, sf: _compared(spark, sf, rb.sweep_runs()))
_VAR = rb.VARIATIONS
reg.add("g22_variations", f"{pre(_VAR)}, {METRICS}, {CURVE} {_ALL}")(lambda spark, sf: _compared(spark, sf, _VAR))


@reg.add("g21_best_runs", f"""{pre(rb.sweep_runs())}, {METRICS}, {CURVE}, res AS (SELECT met.*, max_drawdown_pct FROM met JOIN dd USING (run_id)),
g AS (SELECT run_id, 'sharpe_ratio' AS goal, sharpe_ratio AS v, sharpe_ratio AS value FROM res UNION ALL SELECT run_id, 'total_return_pct', total_return_pct, total_return_pct FROM res
UNION ALL SELECT run_id, 'win_rate', win_rate, win_rate FROM res UNION ALL SELECT run_id, 'max_drawdown_pct', -max_drawdown_pct, max_drawdown_pct FROM res)
SELECT goal, run_id FROM g QUALIFY row_number() OVER (PARTITION BY goal ORDER BY v DESC, run_id DESC) = 1""")
def _(spark, sf):
    res = rb.compare(tables.rankings(spark, sf), prices(spark, sf), rb.sweep_runs(), BENCH)
    return rb.best_runs(res).select("goal", "run_id")
