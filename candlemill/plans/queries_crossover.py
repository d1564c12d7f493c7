"""Moving-average crossover backtests on the market series."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from candlemill.functions.blocks import with_index
from candlemill.operators import crossover as xo
from candlemill.plans.oracle import rnd
from candlemill.plans.registry import Registry, pick
from candlemill.sources import tables

reg = Registry()


def series(spark, sf, unit="week"):
    """Market-wide signal and asset closes with idx, built once."""
    def build():
        raw = tables.market_series_raw(spark, sf, unit)
        return with_index(raw, ["symbol"])

    return tables.built(spark, sf, f"market_{unit}", build)


def averaged(spark, sf, unit="week"):
    return tables.built(spark, sf, f"averages_{unit}", lambda: xo.with_averages(series(spark, sf, unit)))


MARKET = """mkt AS MATERIALIZED (SELECT *, coalesce(asset_close / lag(asset_close) OVER (ORDER BY ts) - 1, 0.0) AS ar, row_number() OVER (ORDER BY ts) - 1 AS idx FROM (
  SELECT CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS ts, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100 / sum(l_quantity) AS signal_close,
  sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100 / count(*) AS asset_close FROM lineitem GROUP BY 1)),
pr AS (SELECT unnest(range(2, 51)) AS p),
ma AS MATERIALIZED (SELECT 'ema' AS kind, p, idx, sum(CASE WHEN idx = 0 THEN 1.0 ELSE 2.0 / (p + 1) END * signal_close * exp(-ln(1 - 2.0 / (p + 1)) * idx))
    OVER (PARTITION BY p ORDER BY idx ROWS UNBOUNDED PRECEDING) * exp(ln(1 - 2.0 / (p + 1)) * idx) AS v FROM mkt, pr
  UNION ALL SELECT 'sma', p, m.idx, (SELECT CASE WHEN m.idx >= p - 1 THEN avg(signal_close) END FROM mkt x WHERE x.idx BETWEEN m.idx - p + 1 AND m.idx) FROM mkt m, pr)"""


def runs_sql(families: str, entry: str, exit_: str, cash: str = "0.045", ordered: bool = False, drop_null: bool = True) -> str:
    nulls = "+ greatest(CASE WHEN ek = 'sma' THEN ep - 1 ELSE 0 END, CASE WHEN xk = 'sma' THEN xp - 1 ELSE 0 END)" if drop_null else ""
    return f"""fam(f, ek, xk) AS (VALUES {families}),
runs AS MATERIALIZED (SELECT *, ((f * 1000 + ep) * 1000 + xp) * 10 + CASE WHEN cy > 0 THEN 1 ELSE 0 END AS run_id, greatest(ep, xp) + 5 {nulls} AS start
  FROM fam, (SELECT unnest({entry}) AS ep), (SELECT unnest({exit_}) AS xp), (SELECT unnest([{cash}]) AS cy) {'WHERE ep < xp' if ordered else ''})"""


SIM = """s0 AS (SELECT run_id, m.idx, m.ts, ar, cy, signal_close >= e.v AS son, signal_close < x.v AS soff FROM runs r JOIN ma e ON e.kind = ek AND e.p = ep
  JOIN ma x ON x.kind = xk AND x.p = xp AND x.idx = e.idx JOIN mkt m ON m.idx = e.idx WHERE m.idx >= start),
s1 AS (SELECT *, sum(CAST(son AND soff AS INT)) OVER w AS t FROM s0 WINDOW w AS (PARTITION BY run_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
s2 AS (SELECT *, last_value(CASE WHEN son <> soff THEN CAST(son AS INT) END IGNORE NULLS) OVER w AS d, last_value(CASE WHEN son <> soff THEN t END IGNORE NULLS) OVER w AS dt
  FROM s1 WINDOW w AS (PARTITION BY run_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
s3 AS (SELECT *, coalesce(lag((coalesce(d, 0) + t - coalesce(dt, 0)) % 2) OVER (PARTITION BY run_id ORDER BY idx), 0) AS held FROM s2),
s4 AS (SELECT *, CASE WHEN held = 1 THEN ar ELSE pow(1 + cy, 1.0 / 252) - 1 END AS ret FROM s3),
s5 AS (SELECT *, 100000.0 * exp(sum(ln(1 + ret)) OVER w) AS equity, coalesce(lag(held) OVER (PARTITION BY run_id ORDER BY idx), 0) AS was,
  row_number() OVER (PARTITION BY run_id ORDER BY idx) AS k, avg(ret) OVER (PARTITION BY run_id ORDER BY idx ROWS 251 PRECEDING) AS rm, stddev_samp(ret) OVER (PARTITION BY run_id ORDER BY idx ROWS 251 PRECEDING) AS rs
  FROM s4 WINDOW w AS (PARTITION BY run_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
sim AS MATERIALIZED (SELECT *, equity / max(equity) OVER w - 1 AS dd, equity / max(equity) OVER w AS share, CASE WHEN held = 0 AND was = 1 THEN equity / last_value(CASE WHEN held = 1 AND was = 0 THEN equity END IGNORE NULLS) OVER w - 1 END AS tr,
  CASE WHEN k >= 252 AND rs > 1e-9 THEN rm / rs * sqrt(252) END AS rsh FROM s5 WINDOW w AS (PARTITION BY run_id ORDER BY idx ROWS UNBOUNDED PRECEDING))"""


def metrics_sql(sample: bool = True) -> str:
    dev = "stddev_samp" if sample else "stddev_pop"
    return f"""mo AS (SELECT run_id, avg(CAST(p > 0 AS INT)) AS pct FROM (SELECT run_id, date_trunc('month', ts) AS mth, sum(ln(1 + ret)) AS p FROM sim GROUP BY ALL) GROUP BY run_id),
mt AS MATERIALIZED (SELECT run_id, exp(sum(ln(1 + ret)) / (count(*) / 252)) - 1 AS cagr, exp(sum(ln(1 + ret))) - 1 AS total_return, min(dd) AS max_dd,
  coalesce(avg(ret) / nullif({dev}(ret), 0) * sqrt(252), 0) AS sharpe, coalesce(avg(ret) / nullif({dev}(ret) FILTER (WHERE ret < 0), 0) * sqrt(252), 0) AS sortino, avg(held) AS time_in_market,
  count(*) FILTER (WHERE held = 1 AND was = 0) AS num_trades, coalesce(avg(CAST(tr > 0 AS INT)), 0.0) AS trade_wr, CASE WHEN count(rsh) > 0 THEN stddev_samp(rsh) ELSE 10.0 END AS rolling_sharpe_std,
  sqrt(avg(pow(dd * 100, 2))) AS ulcer_index FROM sim GROUP BY run_id),
met AS MATERIALIZED (SELECT mt.*, pct AS pct_months_positive, coalesce(cagr / nullif(abs(max_dd), 0), 0.0) AS calmar,
  0.5 / (1 + rolling_sharpe_std) + 0.3 * pct + 0.2 / (1 + ulcer_index) AS stability_score FROM mt JOIN mo USING (run_id))"""


_ONE = ("(0, 'ema', 'sma')", "[13]", "[20]")
_FEW = ("(0, 'ema', 'sma'), (1, 'ema', 'ema'), (2, 'sma', 'sma')", "[5, 13, 30]", "[10, 20, 50]")
_FULL = ("(0, 'ema', 'sma'), (1, 'ema', 'ema'), (2, 'sma', 'sma')", "range(2, 51)", "range(2, 51)")
_SMALL = ("(0, 'ema', 'sma')", str(list(xo.SMALL_ENTRY)), str(list(xo.SMALL_EXIT)), "0.0, 0.045", True, False)
ONE = xo.Grid(xo.FAMILIES[:1], (13,), (20,))
FEW = xo.Grid(xo.FAMILIES, (5, 13, 30), (10, 20, 50))


def pre(spec) -> str:
    return f"WITH {MARKET}, {runs_sql(*spec)}, {SIM}"


def sim(spark, sf, grid, unit="week"):
    return xo.simulate(averaged(spark, sf, unit), xo.run_table(spark, grid))


def _ids(df):
    return df.withColumn("run_id", F.col("run_id").cast("bigint"))


@reg.add("g25_crossover_position", f"""WITH {MARKET}, {runs_sql(*_ONE[:3], drop_null=False).replace('greatest(ep, xp) + 5', '0')},
{SIM.replace('signal_close >= e.v', 'coalesce(signal_close >= e.v, false)').replace('signal_close < x.v', 'coalesce(signal_close < x.v, false)')}
SELECT idx, CAST((coalesce(d, 0) + t - coalesce(dt, 0)) % 2 AS BIGINT) AS position FROM s2""")
def _(spark, sf, unit="week"):
    a = averaged(spark, sf, unit)
    on = F.coalesce(F.col("signal_close") >= F.get("ema", F.lit(11)), F.lit(False))
    off = F.coalesce(F.col("signal_close") < F.get("sma", F.lit(18)), F.lit(False))
    out = xo.positions(a, on, off)
    return out.select("idx", F.col("position").cast("bigint").alias("position"))


@reg.add("g26_strategy_metrics", f"{pre(_FEW)}, {metrics_sql()} SELECT run_id, {rnd('cagr', 5)} AS cagr, {rnd('max_dd', 6)} AS max_dd, {rnd('sharpe', 5)} AS sharpe, {rnd('sortino', 4)} AS sortino, {rnd('time_in_market', 6)} AS time_in_market, num_trades, {rnd('trade_wr', 6)} AS trade_wr FROM met")
def _(spark, sf, unit="week"):
    out = _ids(xo.metrics(sim(spark, sf, FEW, unit)))
    return pick(out, "run_id num_trades", cagr=5, max_dd=6, sharpe=5, sortino=4, time_in_market=6, trade_wr=6)


@reg.add("g26_strategy_equity", f"{pre(_FEW)} SELECT run_id, idx, held, {rnd('ln(equity)', 6)} AS log_equity, {rnd('dd', 6)} AS dd FROM sim")
def _(spark, sf, unit="week"):
    out = _ids(sim(spark, sf, FEW, unit)).withColumns({"log_equity": F.log("equity"), "held": F.col("held").cast("bigint")})
    return pick(out, "run_id idx held", log_equity=6, dd=6)


@reg.add("g27_buy_and_hold", f"""WITH {MARKET}, q AS (SELECT *, exp(sum(ln(1 + ar)) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING)) AS eq FROM mkt), q2 AS (SELECT *, eq / max(eq) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM q)
SELECT {rnd('exp(sum(ln(1 + ar)) / (count(*) / 252)) - 1', 5)} AS cagr, {rnd('min(dd)', 6)} AS max_dd, {rnd('avg(ar) / stddev_samp(ar) * sqrt(252)', 5)} AS sharpe FROM q2""")
def _(spark, sf, unit="week"):
    return pick(xo.metrics(xo.hold_asset(averaged(spark, sf, unit))), "", cagr=5, max_dd=6, sharpe=5)


YEARS = """yq AS (SELECT *, year(ts) AS yr, max(equity) OVER (PARTITION BY run_id, year(ts) ORDER BY idx ROWS UNBOUNDED PRECEDING) AS ypk FROM sim),
yrs AS MATERIALIZED (SELECT run_id, CAST(yr AS BIGINT) AS year, exp(sum(ln(1 + ret))) - 1 AS year_return, min(equity / ypk - 1) AS year_dd FROM yq GROUP BY ALL)"""


@reg.add("g28_yearly_returns", f"{pre(_FEW)}, {YEARS} SELECT run_id, year, {rnd('year_return', 5)} AS year_return, {rnd('year_dd', 6)} AS year_dd, {rnd('coalesce(year_return / nullif(abs(year_dd), 0), CASE WHEN year_return > 0 THEN 10.0 ELSE 0.0 END)', 4)} AS year_calmar FROM yrs")
def _(spark, sf, unit="week"):
    out = _ids(xo.yearly(sim(spark, sf, FEW, unit))).withColumn("year", F.col("year").cast("bigint"))
    return pick(out, "run_id year", year_return=5, year_dd=6, year_calmar=4)


@reg.add("g28_drawdown_dates", f"{pre(_FEW)} SELECT run_id, arg_min(ts, share) AS trough_ts, {rnd('min(dd)', 6)} AS max_dd FROM sim GROUP BY run_id")
def _(spark, sf, unit="week"):
    return pick(_ids(xo.drawdown_dates(sim(spark, sf, FEW, unit))), "run_id trough_ts", max_dd=6)


@reg.add("g29_stability", f"{pre(_FEW)}, {metrics_sql(False)} SELECT run_id, {rnd('rolling_sharpe_std', 5)} AS rolling_sharpe_std, {rnd('pct_months_positive', 6)} AS pct_months_positive, {rnd('ulcer_index', 5)} AS ulcer_index, {rnd('stability_score', 5)} AS stability_score FROM met")
def _(spark, sf, unit="week"):
    out = _ids(xo.metrics(sim(spark, sf, FEW, unit), sample=False))
    return pick(out, "run_id", rolling_sharpe_std=5, pct_months_positive=6, ulcer_index=5, stability_score=5)


_SCORE = """sco AS (SELECT *, calmar > 0 AS ok FROM met),
scored AS MATERIALIZED (SELECT *, CASE WHEN ok THEN 0.4 * stability_score + 0.3 * row_number() OVER (PARTITION BY ok ORDER BY cagr, run_id) / count(*) OVER (PARTITION BY ok)
  + 0.3 * (1 - row_number() OVER (PARTITION BY ok ORDER BY abs(max_dd), run_id) / count(*) OVER (PARTITION BY ok)) ELSE 0.0 END AS rank_score FROM sco)"""


@reg.add("g30_rank_score", f"{pre(_FEW)}, {metrics_sql(False)}, {_SCORE} SELECT run_id, {rnd('rank_score', 5)} AS rank_score FROM scored")
def _(spark, sf, unit="week"):
    return pick(_ids(xo.rank_score(xo.metrics(sim(spark, sf, FEW, unit), sample=False))), "run_id", rank_score=5)


@reg.add("g31_full_sweep", f"{pre(_FULL)}, {metrics_sql(False)} SELECT run_id, {rnd('cagr', 4)} AS cagr, {rnd('max_dd', 5)} AS max_dd, {rnd('sharpe', 4)} AS sharpe, num_trades, {rnd('stability_score', 4)} AS stability_score FROM met")
def _(spark, sf, unit="week"):
    out = _ids(xo.metrics(sim(spark, sf, xo.Grid(), unit), sample=False))
    return pick(out, "run_id num_trades", cagr=4, max_dd=5, sharpe=4, stability_score=4)


@reg.add("g32_small_sweep", f"""{pre(_SMALL)}, {metrics_sql()}, lg AS (SELECT run_id, unnest(['calmar', 'cagr', 'sharpe', 'max_dd']) AS metric, unnest([calmar, cagr, sharpe, max_dd]) AS value FROM met)
SELECT metric, row_number() OVER (PARTITION BY metric ORDER BY value DESC, run_id) AS position, {rnd('value', 4)} AS value FROM lg QUALIFY position <= 15""")
def _(spark, sf, unit="week"):
    res = xo.metrics(sim(spark, sf, xo.SMALL_GRID, unit))
    out = xo.top_by_metrics(res, ("calmar", "cagr", "sharpe", "max_dd"))
    return pick(out.withColumn("position", F.col("position").cast("bigint")), "metric position", value=4)


@reg.add("g33_consistency", f"""{pre(_FEW)}, {YEARS}, rk AS (SELECT run_id, row_number() OVER (PARTITION BY year ORDER BY year_return DESC, run_id) AS u, row_number() OVER (PARTITION BY year ORDER BY year_return, run_id) AS d FROM yrs)
SELECT run_id, count(*) FILTER (WHERE u <= 10) AS years_top, count(*) FILTER (WHERE d <= 5) AS years_bottom FROM rk GROUP BY run_id""")
def _(spark, sf, unit="week"):
    return _ids(xo.consistency(xo.yearly(sim(spark, sf, FEW, unit)))).drop("symbol")


@reg.add("g34_year_matrix", f"""{pre(_FEW)}, {YEARS}, ym AS MATERIALIZED (SELECT run_id, year, {rnd('year_return', 5)} AS v FROM yrs)
SELECT * FROM (PIVOT ym ON year USING first(v) GROUP BY run_id)""")
def _(spark, sf, unit="week"):
    out = _ids(xo.year_matrix(xo.yearly(sim(spark, sf, FEW, unit))))
    return pick(out, "run_id", **{y: 5 for y in out.columns if y != "run_id"})


# the same family on daily bars; averages by recursion, because their scaled terms leave the range of doubles
DAILY = MARKET.split("ma AS", 1)[0].replace("date_trunc('week'", "date_trunc('day'") + """em(p, idx, v) AS (SELECT p, CAST(0 AS BIGINT), signal_close FROM mkt, pr WHERE idx = 0
  UNION ALL SELECT e.p, e.idx + 1, e.v + 2.0 / (e.p + 1) * (m.signal_close - e.v) FROM em e JOIN mkt m ON m.idx = e.idx + 1),
ma AS MATERIALIZED (SELECT 'ema' AS kind, p, idx, v FROM em UNION ALL SELECT 'sma', p, idx, CASE WHEN idx >= p - 1 THEN avg(signal_close)
  OVER (PARTITION BY p ORDER BY idx ROWS BETWEEN p - 1 PRECEDING AND CURRENT ROW) END FROM mkt, pr)"""

for _name, _query in list(reg.queries.items()):
    reg.add(f"{_name}_day", reg.sql[_name].replace(f"WITH {MARKET}", f"WITH RECURSIVE {DAILY}"))(partial(_query, unit="day"))
