"""Screening over ranking and flow snapshots, and the daily report."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlemill.config import PatternConfig
from candlemill.operators import patterns as pt
from candlemill.operators import report
from candlemill.operators import screen as sc
from candlemill.plans.oracle import ATR, bars, rnd
from candlemill.plans.queries_bars import BIAS, INSIDE, week
from candlemill.plans.queries_levels import LEVELS, MATCH, weekly_analysis
from candlemill.plans.queries_patterns import ACTION, LAST, detect_sql, last_bars
from candlemill.plans.queries_signals import SETUPS, signals_sql, weekly_setups
from candlemill.plans.queries_sources import RANKINGS, RK, longs, month
from candlemill.plans.registry import Registry, pick
from candlemill.operators import signals as sg
from candlemill.sources import tables

reg = Registry()

LATEST = "latest AS MATERIALIZED (SELECT * FROM rankings WHERE captured_at = (SELECT max(captured_at) FROM rankings))"


def rankings(spark, sf):
    return tables.rankings(spark, sf)


def latest(spark, sf):
    """The newest snapshot."""
    return sc.latest(rankings(spark, sf))


def flows(spark, sf):
    return rankings(spark, sf).select("symbol", F.col("data_date").alias("flow_date"),
                                      F.lit("daily").alias("period_type"), "direction")


@reg.add("f1_latest_snapshot", f"{RK}, {LATEST} SELECT symbol, ranking_type, rank, long_short FROM latest")
def _(spark, sf):
    return longs(latest(spark, sf), "rank").select("symbol", "ranking_type", "rank", "long_short")


@reg.add("f2_staleness", f"{RK}, {LATEST} SELECT symbol, ranking_type, captured_at FROM latest WHERE date_diff('second', captured_at, captured_at + INTERVAL 23 HOUR) <= 24 * 3600")
def _(spark, sf):
    ok = sc.fresh(latest(spark, sf), F.col("captured_at") + F.expr("interval 23 hours"))
    stale = sc.fresh(latest(spark, sf), F.col("captured_at") + F.expr("interval 25 hours"))
    return ok.unionByName(stale).select("symbol", "ranking_type", "captured_at")


@reg.add("f3_long_list", f"{RK}, {LATEST} SELECT symbol, rank FROM latest WHERE ranking_type = 'top100' AND long_short = 'Long in'")
def _(spark, sf):
    return longs(sc.long_list(latest(spark, sf)), "rank").select("symbol", "rank")


FLOW = """fr AS (SELECT symbol, direction, row_number() OVER (PARTITION BY symbol ORDER BY data_date DESC) AS rn FROM rankings QUALIFY rn <= 5),
fs AS MATERIALIZED (SELECT symbol, max(direction) FILTER (WHERE rn = 1) AS flow_direction,
  coalesce(min(rn) FILTER (WHERE direction <> '+') - 1, count(*)) AS flow_run FROM fr GROUP BY symbol)"""


@reg.add("f4_flow_state", f"{RK}, {FLOW} SELECT symbol, flow_direction, flow_run FROM fs")
def _(spark, sf):
    return longs(sc.flow_state(flows(spark, sf)), "flow_run")


NAMES = f"""{LATEST}, {FLOW}, names AS MATERIALIZED (SELECT l.symbol, l.rank, sector, daily_change, long_short, flow_direction, flow_run,
  round(0.5 + CASE WHEN flow_direction = '+' THEN 0.2 ELSE 0 END + CASE WHEN rank <= 30 THEN 0.15 ELSE 0 END
  + CASE WHEN daily_change > 0 THEN 0.1 ELSE 0 END + CASE WHEN flow_run >= 3 THEN 0.05 ELSE 0 END, 4) AS strength
  FROM latest l JOIN fs USING (symbol) WHERE ranking_type = 'top100' AND long_short = 'Long in')"""


def names(spark, sf):
    out = sc.enrich(sc.long_list(latest(spark, sf)).drop("direction"), flows(spark, sf))
    return out.withColumn("strength", sc.flow_score())


@reg.add("f5_flow_score", f"{RK}, {NAMES} SELECT symbol, rank, {rnd('strength', 4)} AS strength FROM names")
def _(spark, sf):
    return pick(longs(names(spark, sf), "rank"), "symbol rank", strength=4)


SECTORS = """sec AS (SELECT sector, count(*) FILTER (WHERE long_short = 'Long in') AS lc, count(*) FILTER (WHERE long_short = 'Short in') AS scn, count(*) AS n FROM latest GROUP BY sector),
top5 AS (SELECT sector, list(symbol ORDER BY rank, symbol)[1:5] AS top_symbols FROM latest WHERE long_short = 'Long in' GROUP BY sector),
sectors AS MATERIALIZED (SELECT sector, lc AS long_count, scn AS short_count, round((lc - scn) / n, 4) AS net_sentiment,
  CASE WHEN (lc - scn) / n > 0.3 THEN 'bullish' WHEN (lc - scn) / n < -0.3 THEN 'bearish' ELSE 'neutral' END AS trend,
  array_to_string(coalesce(top_symbols, []), ',') AS top_symbols, row_number() OVER (ORDER BY round((lc - scn) / n, 4) DESC, sector) AS sector_rank FROM sec LEFT JOIN top5 USING (sector))"""


@reg.add("f6_sectors", f"{RK}, {LATEST}, {SECTORS} SELECT sector, long_count, short_count, {rnd('net_sentiment', 4)} AS net_sentiment, trend, top_symbols, sector_rank FROM sectors")
def _(spark, sf):
    out = sc.sectors(latest(spark, sf)).withColumn("top_symbols", F.concat_ws(",", "top_symbols"))
    return pick(longs(out, "sector_rank"), "sector long_count short_count trend top_symbols sector_rank", net_sentiment=4)


BOOSTED = f"""{NAMES}, {SECTORS}, boosted AS MATERIALIZED (SELECT n.* EXCLUDE (strength), trend, CASE WHEN trend = 'bullish' THEN 0.1 ELSE 0.0 END AS sector_boost,
  round(strength + CASE WHEN trend = 'bullish' THEN 0.1 ELSE 0.0 END, 4) AS strength FROM names n LEFT JOIN sectors USING (sector))"""


def boosted(spark, sf):
    return sc.with_boost(names(spark, sf), sc.sectors(latest(spark, sf)))


@reg.add("f7_sector_boost", f"{RK}, {BOOSTED} SELECT symbol, trend, sector_boost, {rnd('strength', 4)} AS strength FROM boosted")
def _(spark, sf):
    return pick(boosted(spark, sf), "symbol trend sector_boost", strength=4)


# Monthly supplier bars move a lot: widen the actionable band so the join has matches.
_ACT = ACTION.replace("0.05", "0.6").replace("<= 10", "<= 80").replace("/ 10)", "/ 80)")
SCORED = f"""{BOOSTED}, {bars('month')}, {detect_sql()}, {_ACT},
lead AS (SELECT * FROM act QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY priority DESC, confidence DESC, detector, s_idx, e_idx) = 1),
sc0 AS (SELECT b.*, l.pattern_type, l.status, l.confidence, l.entry, l.breakout_idx,
  0.25 * b.strength + 0.10 * sector_boost + 0.65 * coalesce(l.confidence, 0.0) AS score FROM boosted b LEFT JOIN lead l USING (symbol)),
scored AS MATERIALIZED (SELECT s.*, CASE WHEN score >= 0.8 THEN 'strong_buy' WHEN score >= 0.65 THEN 'buy' WHEN score >= 0.5 THEN 'watch' ELSE 'avoid' END AS recommendation,
  lb.close, lb.last_idx FROM sc0 s LEFT JOIN last_bar lb USING (symbol))"""


def month_patterns(spark, sf):
    """Monthly supplier patterns, built once."""
    return tables.built(spark, sf, "patterns_month", lambda: pt.detect(month(spark, sf), PatternConfig()))


def listed_bars(spark, sf):
    """Monthly bars of the names on the newest long list: the only series that a composite looks at."""
    listed = sc.long_list(latest(spark, sf)).select("symbol").distinct()
    return month(spark, sf).join(listed, "symbol", "left_semi")


def listed_patterns(spark, sf):
    """Their patterns, built once; the other suppliers' series are not searched for them."""
    return tables.built(spark, sf, "patterns_listed", lambda: pt.detect(listed_bars(spark, sf), PatternConfig()))


def scored(spark, sf):
    last = last_bars(month(spark, sf))
    act = pt.actionable(listed_patterns(spark, sf), last, max_bars=80, near=0.6)
    return sc.candidates(sc.composite(boosted(spark, sf), sc.leading(act)), last.drop("timeframe"))


@reg.add("f8_composite", f"{RK}, {SCORED} SELECT symbol, pattern_type, recommendation, {rnd('score', 3)} AS composite FROM scored")
def _(spark, sf):
    return pick(scored(spark, sf), "symbol pattern_type recommendation", composite=3)


@reg.add("f9_candidates", f"{RK}, {SCORED} SELECT symbol, rank, status, {rnd('close', 0)} AS current_price, {rnd('(close - entry) / entry * 100', 0)} AS distance_to_entry_pct, last_idx - breakout_idx AS bars_since_breakout FROM scored")
def _(spark, sf):
    return pick(longs(scored(spark, sf), "rank"), "symbol rank status bars_since_breakout", current_price=0, distance_to_entry_pct=0)


@reg.add("f10_alerts", f"{RK}, {SCORED} SELECT symbol, recommendation, pattern_type IS NOT NULL AS has_detail FROM scored ORDER BY round(score, 4) DESC, rank, symbol LIMIT 20")
def _(spark, sf):
    return sc.alerts(scored(spark, sf)).select("symbol", "recommendation", "has_detail")


@reg.add("r1_report_levels", f"""WITH RECURSIVE {bars()}, {ATR}, {LEVELS} SELECT symbol, role, {rnd('price')} AS price, touches, rk AS position FROM
(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY strength DESC, pos) AS rk FROM levels WHERE sr_type = 'horizontal') WHERE rk <= 5""")
def _(spark, sf):
    return pick(longs(report.top_levels(weekly_analysis(spark, sf)), "position"), "symbol role touches position", price=4)


@reg.add("r1_report_summary", f"""WITH RECURSIVE {bars()}, {ATR}, {LEVELS}, {MATCH}, {BIAS}, {SETUPS}, {signals_sql(0.6, 1.5)}, {INSIDE}
SELECT b.symbol, b.bias, (SELECT count(*) FROM signals s WHERE s.symbol = b.symbol) AS signals,
(SELECT count(*) FROM inside i WHERE i.symbol = b.symbol AND i.idx >= i.n_bars - 10) AS recent_inside_bars FROM bias b""")
def _(spark, sf):
    s = sg.choose(weekly_setups(spark, sf), F.lit(0.6), F.lit(1.5), True)
    return report.summary(weekly_analysis(spark, sf), s).drop("timeframe")
