"""Sources, sinks and ranking ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlemill.config import BacktestConfig
from candlemill.operators import indicators as ind
from candlemill.operators import signals as sg
from candlemill.plans.oracle import RAW, bars, nudge, rnd
from candlemill.plans.queries_bars import week
from candlemill.plans.queries_signals import _LATE, _PRE, _S, CURVE, WIDE, _unlimited, signals_sql, simple_trades, weekly_setups
from candlemill.plans.registry import Registry, pick, r
from candlemill.schemas import KEYS
from candlemill.session import table_path
from candlemill.sources import io, rankings as rk, tables

reg = Registry()
OHLC = "symbol, timeframe, ts, open, high, low, close, volume"
COLS = ["symbol", "timeframe", "ts", "open", "high", "low", "close", "volume"]

# Ranking snapshot in SQL, the counterpart of sources.tables.rankings_raw.
RANKINGS = """rm AS (SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
  sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) / 100 AS revenue, count(*) AS lines FROM lineitem GROUP BY ALL),
rr AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY revenue DESC, l_suppkey) AS rk, count(*) OVER (PARTITION BY month) AS sz FROM rm),
rp AS (SELECT *, lag(rk) OVER (PARTITION BY l_suppkey ORDER BY month) AS prk, lag(revenue) OVER (PARTITION BY l_suppkey ORDER BY month) AS prev,
  lag(lines) OVER (PARTITION BY l_suppkey ORDER BY month) AS pl FROM rr),
rankings AS MATERIALIZED (SELECT CAST(month AS TIMESTAMP) AS captured_at, month AS data_date,
  CASE WHEN rk <= ceil(sz / 2) THEN 'top100' ELSE 'bottom100' END AS ranking_type, 'S' || l_suppkey AS symbol,
  CAST(CASE WHEN rk <= ceil(sz / 2) THEN rk ELSE sz - rk + 1 END AS BIGINT) AS rank, CAST(coalesce(prk - rk, 0) AS BIGINT) AS daily_change,
  r_name AS sector, n_name AS industry, CASE WHEN revenue > prev THEN 'Long in' WHEN revenue < prev THEN 'Short in' ELSE 'No dominance' END AS long_short,
  CASE WHEN lines > pl THEN '+' WHEN lines < pl THEN '-' ELSE 'N' END AS direction, sz AS rank_total
  FROM rp JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
RK = f"WITH {RANKINGS}"


def longs(df, *names):
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


@reg.add("a0_rankings", f"{RK} SELECT * EXCLUDE (direction, rank_total) FROM rankings")
def _(spark, sf):
    return longs(tables.rankings_raw(spark, sf), "rank", "daily_change").drop("direction", "rank_total")


@reg.add("a1_csv_bars", f"""WITH b AS ({RAW['hour']}) SELECT symbol, timeframe, timezone('America/Los_Angeles', timezone('UTC', ts)) AS ts,
open, high, low, close, volume FROM b""")
def _(spark, sf):
    b = tables.event_bars_raw(spark, sf)
    path = table_path(spark, "csv")
    # the writer names folders, so give each series its own folder and file-like name
    b = b.withColumn("file", F.concat_ws("_", "symbol", "timeframe"))
    out = b.select("file", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Date"), F.col("open").alias("Open"),
                   F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"),
                   F.col("volume").alias("Volume"))
    out.repartition("file").write.partitionBy("file").option("header", True).csv(path)
    raw = io.by_lower_name(spark.read.option("header", True).csv(path))
    local = F.convert_timezone(F.lit("UTC"), F.lit(io.LOCAL_ZONE), F.to_timestamp_ntz("ts"))
    return raw.select(
        F.split("file", "_")[0].alias("symbol"), F.split("file", "_")[1].alias("timeframe"), local.alias("ts"),
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")])


@reg.add("a2_normalize", f"WITH b AS ({RAW['hour']}) SELECT {OHLC} FROM b")
def _(spark, sf):
    b = tables.event_bars_raw(spark, sf)
    provider = b.select("symbol", *[F.col(c).alias(c.title()) for c in ("open", "high", "low", "close", "volume")],
                        F.col("ts").alias("Datetime"))
    return io.normalize(provider, F.col("symbol"), F.lit("1h"))


_NEW = "SELECT symbol, timeframe, ts, open, high, low, close * 2 AS close, volume + 1 AS volume FROM old WHERE ts >= TIMESTAMP '1999-01-04'"


def _newer(old):
    cut = F.lit("1999-01-04").cast("timestamp_ntz")
    return old.filter(F.col("ts") >= cut).withColumns({"close": F.col("close") * 2, "volume": F.col("volume") + 1})


_MERGED = f"""WITH old AS MATERIALIZED (SELECT {OHLC} FROM ({RAW['week']})), new AS ({_NEW})
SELECT {OHLC} FROM old WHERE ts < TIMESTAMP '1999-01-04' UNION ALL SELECT {OHLC} FROM new"""


@reg.add("a3_merge_bars", _MERGED)
def _(spark, sf):
    old = week(spark, sf).select(*COLS)
    return io.merge(old, _newer(old))


@reg.add("a4_upsert_bars", _MERGED)
def _(spark, sf):
    old = week(spark, sf).select(*COLS)
    path = table_path(spark, "bars")
    io.write_bars(old, path)
    io.upsert(_newer(old), path)
    return spark.read.parquet(path).select(*COLS)


_TARGET = "target AS MATERIALIZED (SELECT * FROM bars WHERE ts < TIMESTAMP '1998-01-01' AND symbol < 'S5')"
_CUT = "1998-01-01"


def month(spark, sf):
    return tables.indexed(spark, sf, "month")


def _target(spark, sf):
    return month(spark, sf).filter((F.col("ts") < F.lit(_CUT).cast("timestamp_ntz")) & (F.col("symbol") < "S5"))


@reg.add("a5_insert_if_absent", f"WITH {bars('month')}, {_TARGET} SELECT {OHLC} FROM bars b WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.symbol = b.symbol AND t.ts = b.ts)")
def _(spark, sf):
    return io.insert_if_absent(_target(spark, sf), month(spark, sf), ["symbol", "ts"]).select(*COLS)


@reg.add("a5_new_symbols", f"WITH {bars('month')}, {_TARGET} SELECT DISTINCT symbol FROM bars WHERE symbol NOT IN (SELECT symbol FROM target)")
def _(spark, sf):
    return io.new_symbols(_target(spark, sf).select("symbol").distinct(), month(spark, sf))


@reg.add("a6_fallback", f"WITH {bars('month')}, {_TARGET} SELECT {OHLC} FROM target UNION ALL SELECT {OHLC} FROM bars WHERE symbol NOT IN (SELECT symbol FROM target)")
def _(spark, sf):
    return io.with_fallback(_target(spark, sf).select(*COLS), month(spark, sf).select(*COLS))


@reg.add("a7_cache_first", f"WITH {bars('month')}, {_TARGET} SELECT symbol, ts, close, 'cache' AS origin FROM target UNION ALL SELECT symbol, ts, close, 'staging' FROM bars WHERE symbol NOT IN (SELECT symbol FROM target)")
def _(spark, sf):
    cols = ["symbol", "ts", "close"]
    return io.with_fallback(
        _target(spark, sf).select(*cols, F.lit("cache").alias("origin")),
        month(spark, sf).select(*cols, F.lit("staging").alias("origin")), ["symbol"])


@reg.add("a8_price_scan", f"WITH {bars('month')} SELECT {OHLC} FROM bars WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'")
def _(spark, sf):
    return io.scan_prices(month(spark, sf), "1996-01-01", "1999-12-31").select(*COLS)


@reg.add("a9_wide_long", f"WITH b AS ({RAW['hour']}) SELECT ts, symbol, close FROM b")
def _(spark, sf):
    b = tables.event_bars_raw(spark, sf)
    names = [row[0] for row in b.select("symbol").distinct().orderBy("symbol").collect()]
    return io.to_long(io.to_wide(b, names))


_EVALS = "ev AS (SELECT symbol, ts AS eval_ts FROM bars WHERE idx % 40 = 39)"


@reg.add("a10_as_of", f"WITH {bars('month')}, {_EVALS} SELECT symbol, eval_ts, count(*) AS bars, max(high) AS high, min(low) AS low FROM bars JOIN ev USING (symbol) WHERE ts <= eval_ts GROUP BY ALL")
def _(spark, sf):
    m = month(spark, sf)
    points = m.filter(F.pmod("idx", F.lit(40)) == 39).select("symbol", F.col("ts").alias("eval_ts"))
    return io.as_of_summary(m.select("symbol", "ts", F.col("high").alias("h"), F.col("low").alias("l")), points, {
        "bars": ("count", F.lit(True)), "high": ("max", F.col("h")), "low": ("min", F.col("l"))})


@reg.add("a11_resample_4h", f"""WITH b AS ({RAW['hour']}) SELECT symbol, '4h' AS timeframe, time_bucket(INTERVAL '4 hours', ts) AS ts, arg_min(open, ts) AS open,
max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM b GROUP BY symbol, time_bucket(INTERVAL '4 hours', ts)""")
def _(spark, sf):
    return io.resample(tables.event_bars_raw(spark, sf), "4 hours", "4h")


@reg.add("a12_weekly_last", f"WITH b AS ({RAW['day']}) SELECT symbol, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, arg_max(close, ts) AS close FROM b GROUP BY ALL")
def _(spark, sf):
    return io.last_per_week(tables.indexed(spark, sf, "day"), "close")


@reg.add("a13_parse_rankings", f"{RK} SELECT data_date, symbol, rank, daily_change, sector, long_short FROM rankings")
def _(spark, sf):
    df = tables.rankings(spark, sf)
    c = F.col("daily_change")
    raw = df.select(
        "data_date", F.concat(F.lit(" "), F.lower("symbol"), F.lit(" ")).alias("symbol"),
        F.concat(F.col("rank").cast("string"), F.lit(" ")).alias("rank"),
        F.when(c > 0, F.concat(F.lit("▲ "), c.cast("string"))).when(c < 0, F.concat(F.lit("▼"), (-c).cast("string")))
         .otherwise("New").alias("daily_change"),
        F.concat(F.lit(" "), "sector").alias("sector"), "industry", "long_short")
    blank = raw.limit(1).withColumn("symbol", F.lit("  "))
    return longs(rk.parse_rankings(raw.unionByName(blank)), "rank", "daily_change").drop("industry")


@reg.add("a14_parse_flows", f"""{RK} SELECT symbol, CAST(data_date AS DATE) AS flow_date, data_date AS week_start, CAST(data_date + INTERVAL 6 DAY AS DATE) AS week_end, direction, rank,
CAST(rank_total AS BIGINT) AS rank_total FROM rankings""")
def _(spark, sf):
    df = tables.rankings(spark, sf)
    span = F.concat_ws(" ~ ", F.col("data_date").cast("string"), F.date_add("data_date", 6).cast("string"))
    raw = df.select("symbol", span.alias("date"), F.lit("weekly").alias("period_type"), "direction", "long_short",
                    F.concat_ws("/", "rank", "rank_total").alias("rank"))
    bad = raw.limit(1).withColumns({"date": F.lit("soon ~ later"), "rank": F.lit("n/a")})
    out = rk.parse_flows(raw.unionByName(bad))
    return longs(out, "rank", "rank_total").drop("period_type", "long_short")


_HALF = "data_date < DATE '1998-06-01' OR (data_date = DATE '1998-06-01' AND sector < 'REGION_2')"


@reg.add("a15_idempotent_load", f"{RK} SELECT data_date, ranking_type, symbol FROM rankings WHERE NOT ({_HALF})")
def _(spark, sf):
    df = tables.rankings(spark, sf)
    day = F.lit("1998-06-01").cast("date")
    target = df.filter((F.col("data_date") < day) | ((F.col("data_date") == day) & (F.col("sector") < "REGION_2")))
    return rk.slices_to_load(target, df).select("data_date", "ranking_type", "symbol")


@reg.add("a16_universe", f"WITH {bars('month')} SELECT symbol, count(*) AS bars FROM bars WHERE ts BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1999-12-31' GROUP BY symbol HAVING count(*) >= 55")
def _(spark, sf):
    return rk.symbols_with_history(month(spark, sf), "1995-01-01", "1999-12-31", 55)


@reg.add("a17_coverage", f"""WITH {RANKINGS}, {bars('week')}, u AS (SELECT DISTINCT industry AS symbol FROM rankings), p AS (SELECT DISTINCT 'NATION_' || substr(symbol, 7) AS symbol FROM bars)
SELECT symbol, symbol IN (SELECT symbol FROM p) AS priced FROM u""")
def _(spark, sf):
    universe = tables.rankings(spark, sf).select(F.col("industry").alias("symbol")).distinct()
    priced = week(spark, sf).select(F.concat(F.lit("NATION_"), F.substring("symbol", 7, 9)).alias("symbol")).distinct()
    both = universe.intersect(priced).withColumn("priced", F.lit(True))
    return both.unionByName(universe.subtract(priced).withColumn("priced", F.lit(False)))


@reg.add("a18_missed_sessions", """WITH d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS date),
s(capture_session, due) AS (VALUES ('morning', '09:35'), ('midday', '12:30'), ('close', '16:05')),
seen AS (SELECT DISTINCT CASE WHEN hour(ts) < 11 THEN 'morning' WHEN hour(ts) < 14 THEN 'midday' ELSE 'close' END AS capture_session, CAST(ts AS DATE) AS date FROM events)
SELECT capture_session, date, due FROM d, s WHERE isodow(date) < 6 AND CAST(date || ' ' || due AS TIMESTAMP) <= TIMESTAMP '2024-02-05 13:00:00'
AND (capture_session, date) NOT IN (SELECT capture_session, date FROM seen)""")
def _(spark, sf):
    e = tables.read(spark, sf, "events")
    hour = F.hour("ts")
    snaps = e.select(F.when(hour < 11, "morning").when(hour < 14, "midday").otherwise("close").alias("capture_session"),
                     F.col("ts").cast("date").alias("data_date"))
    sessions = spark.createDataFrame([("morning", "09:35"), ("midday", "12:30"), ("close", "16:05")], "capture_session string, due string")
    days = io.trading_days(spark, "2024-01-01", "2024-02-05")
    return rk.missed_sessions(days, sessions, snaps, F.lit("2024-02-05 13:00:00").cast("timestamp_ntz"))


@reg.add("a19_trading_days", f"""WITH {RANKINGS}, e AS (SELECT min(data_date) AS a, max(data_date) AS b FROM rankings),
d AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM e)
SELECT date FROM d WHERE isodow(date) < 6 AND date NOT IN (SELECT data_date FROM rankings)""")
def _(spark, sf):
    df = tables.rankings(spark, sf)
    first, last = df.agg(F.min("data_date").cast("string"), F.max("data_date").cast("string")).first()
    return io.trading_days(spark, first, last, df.select(F.col("data_date").alias("date")).distinct())


@reg.add("a19_last_sessions", f"""WITH {RANKINGS}, e AS (SELECT min(data_date) AS a, max(data_date) AS b FROM rankings),
d AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM e)
SELECT date FROM d WHERE isodow(date) < 6 ORDER BY date DESC LIMIT 10""")
def _(spark, sf):
    first, last = tables.rankings(spark, sf).agg(F.min("data_date").cast("string"), F.max("data_date").cast("string")).first()
    return io.last_trading_days(io.trading_days(spark, first, last), 10)


@reg.add("a20_top_recent", f"{RK} SELECT symbol, captured_at, rank FROM rankings WHERE ranking_type = 'top100' ORDER BY captured_at DESC, rank, symbol LIMIT 25")
def _(spark, sf):
    known = tables.read(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"))
    return longs(rk.top_recent(tables.rankings(spark, sf), known, 25), "rank")


@reg.add("a21_export_trades", f"""{_S}, {_LATE}, {CURVE} SELECT symbol, eval_idx, exit_reason, {rnd('net_pnl')} AS net_pnl FROM trades""")
def _(spark, sf):
    t = _unlimited(spark, sf).select("symbol", "eval_idx", "exit_reason", "net_pnl", "confidence")
    out = io.write_and_read(io.write_and_read(t, "parquet", "trades"), "csv", "trades_csv", header="true")
    return pick(out, "symbol eval_idx exit_reason", net_pnl=4)


@reg.add("a22_journal", f"""{_PRE}, {signals_sql(0.5, 1.0)} SELECT strftime(ts, '%Y-%m-%d %H:%M') AS "Date", symbol AS "Symbol", CASE WHEN direction = 'LONG' THEN 'BUY' ELSE 'SELL' END AS "Side",
CAST(1 AS BIGINT) AS "Quantity", printf('%.2f', entry + 3e-6) AS "Entry Price", '' AS "Exit Price", '' AS "Commission",
printf('Confidence: %.2f | R:R: %.1f | SL: %.2f | TP: %.2f', confidence, abs(target - entry) / abs(entry - stop), stop + 3e-6, target + 3e-6) AS "Notes" FROM signals""")
def _(spark, sf):
    s = sg.choose(weekly_setups(spark, sf), F.lit(0.5), F.lit(1.0), True).withColumnRenamed("filter_rr", "rr_ratio")
    # move exact ties off the half cent: the two engines break them differently
    s = s.withColumns({c: F.col(c) + nudge(2) for c in ("entry", "stop", "target")})
    return longs(io.journal_rows(s), "Quantity")


@reg.add("a23_trade_log", f"""{_S}, {_LATE}, {CURVE} SELECT run_id, symbol, count(*) AS trades FROM trades, (VALUES ('first'), ('second')) t(run_id) GROUP BY ALL""")
def _(spark, sf):
    path = table_path(spark, "log")
    t = _unlimited(spark, sf).select("symbol", "eval_idx", "net_pnl")
    for run in ("first", "second"):
        io.append_log(t, run, path)
    return spark.read.parquet(path).groupBy("run_id", "symbol").agg(F.count(F.lit(1)).alias("trades"))
