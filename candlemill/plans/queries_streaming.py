"""Ledger and streaming queries."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from candlemill.operators import ledger as lg
from candlemill.plans.oracle import RAW, rnd
from candlemill.plans.queries_sources import COLS, OHLC, RK, month
from candlemill.plans.registry import Registry, pick
from candlemill.session import table_path
from candlemill.sources import tables
from candlemill.streaming import flows

reg = Registry()
SCENARIOS = (
    lg.Scenario("intraday"), lg.Scenario("stop5_close", hard_stop=0.05, use_close=True),
    lg.Scenario("stop9_limit", hard_stop=0.09, use_close=True, stop_limit=True), lg.Scenario("hold3", max_hold=3),
)


def ledger(spark, sf):
    def build():
        ranks = tables.rankings(spark, sf)
        names = lg.signals(ranks).select("symbol").distinct()
        bars = tables.month_bars_of(spark, sf, names, "bars_month_ledger")
        return lg.run(ranks, bars, SCENARIOS, days=tables.months(spark, sf))

    return tables.built(spark, sf, "ledger", build)


@reg.add("g23_ledger_trades")
def _(spark, sf):
    done = ledger(spark, sf).filter(F.col("kind") == "trade")
    return pick(done, "scenario symbol pattern_type entry_lpos exit_lpos exit_reason", entry_price=4, exit_price=4, value=4)


@reg.add("g23_ledger_equity")
def _(spark, sf):
    return pick(ledger(spark, sf).filter(F.col("kind") == "equity"), "scenario date", value=4)


@reg.add("g24_ledger_results")
def _(spark, sf):
    out = lg.results(ledger(spark, sf), lg.scenario_table(spark, SCENARIOS))
    return pick(out, "scenario total_trades exit_stop_loss exit_target_hit exit_pattern_invalidated exit_max_hold",
                win_rate=6, total_return_pct=4, sharpe_ratio=5, max_drawdown_pct=6, median_return_pct=5)


@reg.add("g24_best_worst_trades")
def _(spark, sf):
    return pick(lg.extremes(ledger(spark, sf)), "scenario symbol best worst", return_pct=6)


def hour(spark, sf):
    return tables.built(spark, sf, "bars_hour_raw", lambda: tables.event_bars_raw(spark, sf))


_CUT = "2024-01-15"


@reg.add("s1_stream_merge", f"""WITH b AS ({RAW['hour']}) SELECT symbol, timeframe, ts, open, high, low, CASE WHEN ts >= TIMESTAMP '{_CUT}' THEN close * 2 ELSE close END AS close, volume FROM b""")
def _(spark, sf):
    landing, table, state = (table_path(spark, n) for n in ("landing", "bars_live", "chk"))
    old = hour(spark, sf).withColumn("arrived", F.lit(0))
    late = old.filter(F.col("ts") >= F.lit(_CUT).cast("timestamp_ntz")).withColumns(
        {"close": F.col("close") * 2, "arrived": F.lit(1)})
    for part in (old, late):  # the second run resumes from the checkpoint
        part.write.mode("append").parquet(landing)
        flows.merge_bars(flows.read_stream(spark, landing, part.schema), table, state).awaitTermination()
    return spark.read.parquet(table).select(*COLS)


@reg.add("s2_stream_bars", f"""WITH b AS ({RAW['hour']}), g AS (SELECT symbol, '4h' AS timeframe, time_bucket(INTERVAL '4 hours', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
arg_max(close, ts) AS close, sum(volume) AS volume FROM b GROUP BY symbol, time_bucket(INTERVAL '4 hours', ts))
SELECT * FROM g WHERE ts + INTERVAL 4 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM b)""")
def _(spark, sf):
    landing, table, state = (table_path(spark, n) for n in ("landing", "bars_4h", "chk"))
    bars = hour(spark, sf)
    bars.write.parquet(landing)
    stream = flows.read_stream(spark, landing, bars.schema)
    flows.build_bars(stream, "4 hours", "4h", table, state).awaitTermination()
    return spark.read.parquet(table).select(*COLS)


@reg.add("s3_stream_rankings", f"{RK} SELECT data_date, ranking_type, symbol, CAST(rank AS BIGINT) AS rank FROM rankings")
def _(spark, sf):
    landing, table, state = (table_path(spark, n) for n in ("landing", "rankings_live", "chk"))
    df = tables.rankings(spark, sf)
    for _ in range(2):  # the same capture arrives twice
        df.write.mode("append").parquet(landing)
        flows.load_rankings(flows.read_stream(spark, landing, df.schema), table, state).awaitTermination()
    return spark.read.parquet(table).select("data_date", "ranking_type", "symbol", F.col("rank").cast("bigint").alias("rank"))


@reg.add("s4_stream_checks", f"""WITH q AS (SELECT *, avg(value) OVER w AS m, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT event_type AS monitor, 'value' AS field, ts AS recorded_at, CASE WHEN value > 4 * m THEN 'critical' ELSE 'warning' END AS severity, {rnd('value', 4)} AS value FROM q WHERE n = 5 AND value > 2 * m""")
def _(spark, sf):
    table, state = table_path(spark, "alerts"), table_path(spark, "chk")
    events = tables.read(spark, sf, "events")
    if all(f.endswith("/events.parquet") for f in events.inputFiles()):
        stream = flows.read_stream(spark, sf, events.schema, only="events.parquet")
    else:  # a folder of files
        stream = flows.read_stream(spark, os.path.join(sf, "events.parquet"), events.schema)
    readings = stream.select(F.col("event_type").alias("monitor"), F.lit("value").alias("field"),
                             F.col("ts").cast("timestamp").alias("recorded_at"), "value", "event_id")
    flows.write_alerts(flows.check_readings(readings, flows.ThresholdCheck(), ["event_id"]), table, state).awaitTermination()
    out = spark.read.parquet(table).withColumn("recorded_at", F.col("recorded_at").cast("timestamp_ntz"))
    return pick(out, "monitor field recorded_at severity", value=4)
