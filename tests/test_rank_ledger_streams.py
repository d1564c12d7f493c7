import math

import numpy as np
import pandas as pd
import pytest
from conftest import SMOKE, random_bars, rows, to_spark
from pyspark.sql import functions as F

from candlemill.operators import ledger as lg
from candlemill.operators import rank_backtest as rb
from candlemill.operators import screen as sc
from candlemill.plans import catalog
from candlemill.sources import io, rankings as rk
from candlemill.streaming import flows


def test_change_and_fraction_texts(spark):
    cases = [("▲ 9", 9), ("▼ 5", -5), ("▲92", 92), ("0", 0), ("New", 0), ("", 0), ("-3", -3), ("+ 4", 4), ("x7", 0), ("12", 12)]
    df = spark.createDataFrame(cases, "t string, want int")
    assert all(r["g"] == r["want"] for r in df.select(rk.change(F.col("t")).alias("g"), "want").collect())
    fr = spark.createDataFrame([("1/1672", 1, 1672), ("7", 0, 0), ("a/b", 0, 0), ("1/2/3", 0, 0)], "t string, a int, b int")
    a, b = rk.fraction(F.col("t"))
    assert fr.filter((a != F.col("a")) | (b != F.col("b"))).count() == 0


def test_flow_rows(spark):
    raw = spark.createDataFrame([
        ("A", "2026-02-09", "daily", "+", "Long in", "1/10"), ("A", "2026-02-02 ~ 2026-02-08", "weekly", "-", "", "2/10"),
        ("A", "someday", "daily", "N", "", "3/10")],
        "symbol string, date string, period_type string, direction string, long_short string, rank string")
    out = rows(rk.parse_flows(raw), "rank")
    assert [str(d) for d in out["flow_date"]] == ["2026-02-09", "2026-02-02"] and str(out["week_end"].iloc[1]) == "2026-02-08"


def test_flow_run_ends_at_a_missing_direction(spark):
    df = spark.createDataFrame(
        [("A", f"2024-01-0{d}", "daily", x) for d, x in ((5, "+"), (4, "+"), (3, None), (2, "+"))] +
        [("B", f"2024-01-0{d}", "daily", "+") for d in range(1, 8)] + [("C", "2024-01-01", "daily", "-")],
        "symbol string, flow_date string, period_type string, direction string")
    out = sc.flow_state(df).toPandas().set_index("symbol")
    assert out["flow_run"].to_dict() == {"A": 2, "B": 5, "C": 0} and out.loc["C", "flow_direction"] == "-"


def test_screening_prefers_actionable_patterns(spark):
    names = spark.createDataFrame([("A", 1, 0.9, 0.1), ("B", 2, 0.9, 0.0)], "symbol string, rank int, strength double, sector_boost double")
    best = spark.createDataFrame([("A", "w_bottom", 0.9)], "symbol string, pattern_type string, confidence double")
    out = sc.composite(names, best).toPandas().set_index("symbol")
    assert math.isclose(out.loc["A", "composite"], 0.25 * 0.9 + 0.01 + 0.65 * 0.9, abs_tol=1e-4)
    assert out.loc["A", "recommendation"] == "strong_buy" and out.loc["B", "recommendation"] == "avoid"


def test_csv_bars_with_odd_headers(spark, tmp_path):
    (tmp_path / "MES_5m.csv").write_text("Datetime,Open,HIGH,low,Close\n2024-07-01 12:00:00,1,2,0.5,1.5\n2024-07-02 12:00:00,1,2,0.5,1.6\n")
    out = io.read_csv_bars(spark, str(tmp_path), end=F.lit("2024-07-02").cast("timestamp_ntz")).collect()
    assert len(out) == 1 and out[0]["symbol"] == "MES" and out[0]["timeframe"] == "5m" and out[0]["volume"] == 0.0
    assert str(out[0]["ts"]) == "2024-07-01 05:00:00"
    with pytest.raises(ValueError, match="missing"):
        io.by_lower_name(spark.createDataFrame([(1,)], "open int"))


def prices_and_rankings(spark, n_days=40, n_names=12, seed=0):
    rng = np.random.default_rng(seed)
    days = pd.bdate_range("2024-01-01", periods=n_days)
    px = pd.DataFrame([(f"N{k}", d.date(), *(rng.uniform(50, 150, 2)))
                       for k in range(n_names) for d in days if rng.random() > 0.03], columns=["symbol", "date", "open", "close"])
    rank = pd.DataFrame([(d.date(), f"N{k}", r + 1, "top100", "Long in" if rng.random() > 0.3 else "Short in", f"sec{k % 3}")
                         for d in days for r, k in enumerate(rng.permutation(n_names))],
                        columns=["data_date", "symbol", "rank", "ranking_type", "long_short", "sector"])
    return px, rank


@pytest.mark.parametrize("momentum,delay", [(0, 0), (3, 0), (0, 2)])
def test_rank_backtest_equals_a_loop(spark, momentum, delay):
    px, rank = prices_and_rankings(spark)
    run = rb.RankRun("r", top_n=4, hold=5, min_rank=1, max_rank=8, delay=delay, momentum=momentum)
    table = rb.run_table(spark, [run])
    picks = rb.selections(spark.createDataFrame(rank), table, 4)
    prices = spark.createDataFrame(px)
    done = rb.trades(picks, prices).cache()
    got = {(r["symbol"], r["data_date"]): r["return_pct"] for r in done.collect()}

    pool = rank[(rank.long_short == "Long in") & rank["rank"].between(1, 8)]
    dates = sorted(pool.data_date.unique())
    chosen = []
    for i, d in enumerate(dates):
        for r in pool[pool.data_date == d].nsmallest(4, "rank").itertuples():
            if momentum:
                if i < momentum:
                    continue
                before = pool[(pool.data_date == dates[i - momentum]) & (pool.symbol == r.symbol)]["rank"]
                if len(before) and r.rank >= before.iloc[0]:
                    continue
            chosen.append(r)
    used = sorted({r.data_date for r in chosen}) if momentum else dates
    days = sorted(px.date.unique())
    at = px.set_index(["symbol", "date"])
    want = {}
    for r in chosen:
        if r.data_date in used[:-5]:
            later = [i for i, d in enumerate(days) if d > r.data_date]
            if len(later) > delay:
                e = later[delay]
                x = min(e + 5, len(days) - 1)
                a, b = (r.symbol, days[e]), (r.symbol, days[x])
                if a in at.index and b in at.index:
                    want[(r.symbol, r.data_date)] = at.loc[b, "close"] / at.loc[a, "open"] - 1
    assert len(want) > 20 and got.keys() == want.keys()
    assert all(math.isclose(got[k], v, abs_tol=1e-12) for k, v in want.items())

    curve = rows(rb.equity_curve(done, prices), "pos")
    trades = done.toPandas()
    prev, eq, out = {}, 100_000.0, []
    for d in days[days.index(trades.sort_values("data_date")["entry_date"].iloc[0]):]:
        moves = []
        for t in trades[(trades.entry_date <= d) & (trades.exit_date >= d)].itertuples():
            if (t.symbol, d) in at.index:
                c = at.loc[(t.symbol, d), "close"]
                moves.append(c / prev.get((t.symbol, t.data_date), t.entry_price) - 1)
                prev[(t.symbol, t.data_date)] = c
        eq *= 1 + (np.mean(moves) if moves else 0.0)
        out.append(eq)
    np.testing.assert_allclose(curve["equity"], out, rtol=1e-9)


def ledger_loop(rank, bars, patterns, sc_):
    """Day-by-day ledger; ``patterns[(symbol, date)]`` lists (type, confidence, stop, target)."""
    own = rank[(rank.long_short == "Long in") & (rank["rank"] <= 20)]
    dates = [d for d in sorted(own.data_date.unique()) if d in set(bars.date)]
    at = bars.set_index(["symbol", "date"])
    count = bars.sort_values("date").groupby("symbol").cumcount()
    nth = {(s, d): c for s, d, c in zip(bars.sort_values("date").symbol, bars.sort_values("date").date, count)}
    days = sorted(bars.date.unique())
    cash, held, waiting, closed, equity = sc_.capital, [], [], [], []

    def worth(d):
        return cash + sum(h["shares"] * at.loc[(h["s"], d), "close"] for h in held if (h["s"], d) in at.index)

    def enter(c, price, d):
        nonlocal cash
        part = min(worth(d) / sc_.max_positions, cash)
        if part > 0:
            held.append({**c, "entry": price, "day": d, "shares": part / price,
                         "stop": price * (1 - sc_.hard_stop) if sc_.hard_stop else c["stop"]})
            cash -= part

    for d in dates:
        if not sc_.use_close:
            for c in waiting:
                if (c["s"], d) not in at.index:
                    continue
                p = at.loc[(c["s"], d), "open"]
                if c["target"] <= p or c["stop"] >= p:
                    continue
                if len(held) >= sc_.max_positions:
                    break
                enter(c, p, d)
            waiting = []
        keep = []
        for h in held:
            out = None
            if h["day"] != d and (h["s"], d) in at.index:
                b = at.loc[(h["s"], d)]
                if sc_.use_close:
                    if sc_.stop_limit and sc_.hard_stop and b.low <= h["stop"]:
                        out = (h["stop"], "stop_loss")
                    elif not sc_.stop_limit and sc_.hard_stop and b.close / h["entry"] - 1 <= -sc_.hard_stop:
                        out = (b.close, "stop_loss")
                    if out is None and b.close >= h["target"]:
                        out = (b.close, "target_hit")
                elif b.low <= h["stop"]:
                    out = (h["stop"], "stop_loss")
                elif b.high >= h["target"]:
                    out = (h["target"], "target_hit")
                if out is None and sc_.max_hold and days.index(d) - days.index(h["day"]) >= sc_.max_hold:
                    out = (b.close, "max_hold")
                if out is None and nth[(h["s"], d)] >= 9 and not any(
                        p[0] == h["type"] for p in patterns.get((h["s"], d), [])):
                    out = (b.close, "pattern_invalidated")
            if out:
                cash += h["shares"] * out[0]
                closed.append((h["s"], h["day"], d, out[1], h["shares"] * (out[0] - h["entry"])))
            else:
                keep.append(h)
        held = keep
        room = sc_.max_positions - len(held)
        if room > 0:
            names = {h["s"] for h in held}
            found = []
            for r in own[own.data_date == d].sort_values("rank").itertuples():
                best = patterns.get((r.symbol, d))
                if r.symbol not in names and best:
                    found.append({"s": r.symbol, "type": best[0][0], "conf": best[0][1], "stop": best[0][2], "target": best[0][3]})
            found.sort(key=lambda c: -c["conf"])
            for c in found[:min(sc_.top_n, room)]:
                if not sc_.use_close:
                    waiting.append(c)
                elif (c["s"], d) in at.index and c["target"] > at.loc[(c["s"], d), "close"] and len(held) < sc_.max_positions:
                    enter(c, at.loc[(c["s"], d), "close"], d)
        equity.append(worth(d))
    for h in held:
        if (h["s"], dates[-1]) in at.index:
            p = at.loc[(h["s"], dates[-1]), "close"]
            closed.append((h["s"], h["day"], dates[-1], "end_of_backtest", h["shares"] * (p - h["entry"])))
    return closed, equity


def test_ledger_equals_a_day_by_day_loop(spark):
    frames = [random_bars(110, 50 + k, f"N{k}", step=3) for k in range(9)]
    pdf = pd.concat(frames)
    pdf["date"] = pdf["ts"].dt.date
    rng = np.random.default_rng(4)
    rank = pd.DataFrame([(d, str(s), int(r) + 1, "top100", "Long in" if rng.random() > 0.2 else "Short in")
                         for d in sorted(pdf.date.unique())[20:] for r, s in enumerate(rng.permutation([f"N{k}" for k in range(9)]))],
                        columns=["data_date", "symbol", "rank", "ranking_type", "long_short"])
    bars = to_spark(spark, *frames)
    found = lg.patterns_as_of(bars).select(
        "symbol", "eval_idx", "pattern_type", "confidence", "stop", "target1", "detector", "start_idx", "end_idx").cache()
    scenarios = (lg.Scenario("intraday", max_positions=3), lg.Scenario("close", max_positions=3, hard_stop=0.05, use_close=True),
                 lg.Scenario("limit", max_positions=2, top_n=1, hard_stop=0.09, use_close=True, stop_limit=True),
                 lg.Scenario("hold", max_positions=4, max_hold=4))
    done = lg.run(spark.createDataFrame(rank), bars, scenarios, found=found).cache()
    date_of = {(r.symbol, i): r.date for _, g in pdf.groupby("symbol") for i, r in enumerate(g.sort_values("ts").itertuples())}
    seen = {}
    for r in found.toPandas().sort_values(["confidence", "detector", "start_idx", "end_idx"], ascending=[False, True, True, True]).itertuples():
        seen.setdefault((r.symbol, date_of[(r.symbol, r.eval_idx)]), []).append((r.pattern_type, r.confidence, r.stop, r.target1))
    for s in scenarios:
        closed, equity = ledger_loop(rank, pdf, seen, s)
        got = done.filter(F.col("scenario") == s.scenario)
        np.testing.assert_allclose(rows(got.filter("kind = 'equity'"), "lpos")["value"], equity, rtol=1e-9)
        trades = got.filter("kind = 'trade'").toPandas()
        assert len(closed) > 4
        assert sorted((t.symbol, t.date, t.exit_reason) for t in trades.itertuples()) == sorted((c[0], c[2], c[3]) for c in closed)
        assert math.isclose(trades["value"].sum(), sum(c[4] for c in closed), rel_tol=1e-9)
    res = lg.results(done, lg.scenario_table(spark, scenarios)).toPandas()
    assert len(res) == 4 and res["max_drawdown_pct"].between(0, 1).all()


def test_ledger_carries_equity_over_dates_without_bars(spark):
    bars = spark.createDataFrame([("A", pd.Timestamp(f"2024-01-0{d}").to_pydatetime()) for d in (2, 3, 5)], "symbol string, ts timestamp")
    days = [pd.Timestamp(f"2024-01-0{d}").date() for d in (1, 2, 4, 5)]  # no bars on the 1st and the 4th
    dates = lg.calendar(bars, spark.createDataFrame([(d,) for d in days], "data_date date"))
    assert [(r.date.day, r.day, r.pos, r.lpos, r.n_dates) for r in dates.orderBy("date").collect()] == [
        (1, 0, None, None, 2), (2, 1, 0, 0, 2), (4, 2, None, None, 2), (5, 3, 2, 1, 2)]
    row = {c.split()[0]: None for c in lg._OUT.split(", ")}
    played = spark.createDataFrame([
        row | {"scenario": "s", "kind": "equity", "lpos": 0, "value": 90.0}, row | {"scenario": "s", "kind": "equity", "lpos": 1, "value": 99.0},
        row | {"scenario": "s", "kind": "trade", "lpos": 1, "entry_lpos": 0, "exit_lpos": 1, "entry_price": 1.0, "exit_price": 2.0}], lg._OUT)
    table = lg.scenario_table(spark, [lg.Scenario("s")])
    done = lg.on_every_date(played, dates, table).cache()
    equity = [(r.date.day, r.lpos, r.value) for r in done.filter("kind = 'equity'").orderBy("lpos").collect()]
    assert equity == [(1, 0, 100.0), (2, 1, 90.0), (4, 2, 90.0), (5, 3, 99.0)]
    trade = done.filter("kind = 'trade'").first()
    assert (trade.date.day, trade.entry_lpos, trade.exit_lpos) == (5, 1, 3)
    ret = np.array([-0.1, 0.0, 0.1])
    sharpe = lg.results(done, table).first()["sharpe_ratio"]
    assert math.isclose(sharpe, ret.mean() / ret.std() * math.sqrt(252), abs_tol=1e-9)


def test_threshold_check_keeps_recent_values():
    check = flows.ThresholdCheck(history=3, warn=2, critical=4)
    assert check.evaluate(10, [1, 1]) is None and check.evaluate(2, [1, 1, 1]) is None
    assert check.evaluate(3, [1, 1, 1])[0] == "warning" and check.evaluate(9, [1, 1, 1])[0] == "critical"


def test_checks_carry_state_between_batches(spark, tmp_path):
    at = pd.date_range("2024-01-01", periods=8, freq="h")
    pdf = pd.DataFrame({"monitor": "m", "field": "f", "recorded_at": at, "value": [1.0, 1, 1, 1, 1, 5, 1, 1]})
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (pdf.iloc[:5], pdf.iloc[5:]):
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(src)
        stream = flows.read_stream(spark, src, spark.createDataFrame(part).schema)
        flows.write_alerts(flows.check_readings(stream, flows.ThresholdCheck()), out, str(tmp_path / "chk")).awaitTermination()
    got = spark.read.parquet(out).collect()
    assert [(r["severity"], r["value"]) for r in got] == [("critical", 5.0)]


def test_checks_read_equal_instants_by_their_ties(spark, tmp_path):
    n = 40
    pdf = pd.DataFrame({"monitor": "m", "field": "f", "recorded_at": pd.Timestamp("2024-01-01"), "seq": range(n),
                        "value": [1.0] * (n - 2) + [None, 3.0]})
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame(pdf.iloc[::-1])
    df.coalesce(1).write.parquet(src)
    stream = flows.read_stream(spark, src, df.schema)
    flows.write_alerts(
        flows.check_readings(stream, flows.ThresholdCheck(), ["seq"]), out, str(tmp_path / "chk")).awaitTermination()
    assert [(r["severity"], r["value"]) for r in spark.read.parquet(out).collect()] == [("warning", 3.0)]


def test_stream_checks_read_a_folder_of_files(spark, tmp_path):
    at = pd.Timestamp("2024-01-01").to_pydatetime()
    rows = [(k, at, "click", 1.0 if k % 7 else 9.0) for k in range(30)]
    df = spark.createDataFrame(rows[::-1], "event_id bigint, ts timestamp_ntz, event_type string, value double")
    df.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.queries()["s4_stream_checks"](spark, str(tmp_path)).collect()
    assert [(r["severity"], r["value"]) for r in got] == [("critical", 9.0)] * 4


def _load(spark, tmp_path, day, names):
    row = [((pd.Timestamp("2024-01-01") + pd.Timedelta(days=day)).to_pydatetime(), f"day {day}", "top", n, k) for k, n in enumerate(names)]
    df = spark.createDataFrame(row, "captured_at timestamp, data_date string, ranking_type string, symbol string, rank int")
    df = df.withColumn("captured_at", F.col("captured_at").cast("timestamp_ntz"))
    landing, table = str(tmp_path / "in"), str(tmp_path / "table")
    df.write.mode("append").parquet(landing)
    flows.load_rankings(flows.read_stream(spark, landing, df.schema), table, str(tmp_path / "chk")).awaitTermination()
    return sorted((r.data_date, r.symbol) for r in spark.read.parquet(table).collect())


def test_rankings_may_come_months_late_and_in_parts(spark, tmp_path):
    assert len(_load(spark, tmp_path, 200, "AB")) == 2
    assert len(_load(spark, tmp_path, 10, "AB")) == 4  # 190 days behind
    assert len(_load(spark, tmp_path, 10, "AC")) == 5  # one again, one new
    assert len(_load(spark, tmp_path, 200, "AB")) == 5


def test_a_table_that_cannot_be_read_is_left_alone(spark, tmp_path):
    table, landing = tmp_path / "table", str(tmp_path / "in")
    table.mkdir()
    (table / "part-0.parquet").write_bytes(b"not parquet")
    df = spark.createDataFrame(
        [("A", "1d", pd.Timestamp("2024-01-01").to_pydatetime(), 1.0, 1.0, 1.0, 1.0, 1.0, 0)],
        "symbol string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double, arrived int",
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(landing)
    query = flows.merge_bars(flows.read_stream(spark, landing, df.schema), str(table), str(tmp_path / "chk"))
    with pytest.raises(Exception):
        query.awaitTermination()
    assert [f.name for f in table.iterdir() if not f.name.startswith(".")] == ["part-0.parquet"]
    assert (table / "part-0.parquet").read_bytes() == b"not parquet"


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_as_of_summary_equals_the_slice(spark, block):
    rng = np.random.default_rng(3)
    days = pd.date_range("2020-01-01", periods=900)
    bars = pd.concat([pd.DataFrame({"symbol": s, "ts": rng.choice(days, n), "high": rng.normal(size=n), "low": rng.normal(size=n)})
                      for s, n in (("A", 700), ("B", 40), ("C", 3))])
    points = pd.DataFrame({"symbol": rng.choice(["A", "B", "C", "D"], 200), "eval_ts": rng.choice(days, 200)})
    b = spark.createDataFrame(bars).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    p = spark.createDataFrame(points).withColumn("eval_ts", F.col("eval_ts").cast("timestamp_ntz"))
    got = io.as_of_summary(b.select("symbol", "ts", F.col("high").alias("h")), p, {"bars": ("count", F.lit(True)), "high": ("max", F.col("h"))}, block)
    want = io.as_of(b, p.distinct()).groupBy("symbol", "eval_ts").agg(F.count("*").alias("bars"), F.max("high").alias("high"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_last_sessions_skip_weekends_and_holidays(spark):
    closed = spark.sql("SELECT DATE'2024-01-01' AS date")
    days = io.trading_days(spark, "2023-12-28", "2024-01-03", closed)
    assert [str(r.date) for r in io.last_trading_days(days, 3).collect()] == ["2024-01-03", "2024-01-02", "2023-12-29"]
    assert io.last_trading_days(days, 100).count() == 4


def test_composite_searches_listed_names_only(spark):
    from candlemill.operators import patterns, screen
    from candlemill.plans import queries_screen as qs

    sf = "/root/testdata/sf0.1"
    listed = {r.symbol for r in screen.long_list(qs.latest(spark, sf)).select("symbol").collect()}
    searched = {r.symbol for r in qs.listed_bars(spark, sf).select("symbol").distinct().collect()}
    every = {r.symbol for r in qs.month(spark, sf).select("symbol").distinct().collect()}
    assert listed and searched == listed & every and searched < every
    act = patterns.actionable(qs.month_patterns(spark, sf), qs.last_bars(qs.month(spark, sf)), max_bars=80, near=0.6)
    want = screen.composite(qs.boosted(spark, sf), screen.leading(act))
    columns = ["symbol", "pattern_type", "status", "confidence", "recommendation", "composite"]
    got = qs.scored(spark, sf).select(*columns).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want.select(*columns).collect())) and any(r.pattern_type for r in got)


def test_ledger_detects_patterns_only_where_they_matter(spark, monkeypatch):
    frames = [random_bars(110, 50 + k, f"N{k}", step=3) for k in range(9)]
    dates = sorted({d for f in frames for d in f["ts"].dt.date})
    rng = np.random.default_rng(6)
    rank = pd.DataFrame([(d, str(s), int(r) + 1, "top100", "Long in" if rng.random() > 0.9 else "Short in")
                         for d in dates[20:] for r, s in enumerate(rng.permutation([f"N{k}" for k in range(9)]))],
                        columns=["data_date", "symbol", "rank", "ranking_type", "long_short"])
    bars, rank = to_spark(spark, *frames), spark.createDataFrame(rank)
    scenarios = (lg.Scenario("intraday"), lg.Scenario("close", hard_stop=0.05, use_close=True, stop_limit=True),
                 lg.Scenario("hold", max_hold=4))
    every = lg.patterns_as_of(bars).cache()
    n_every = lg.en.prefixes(bars, lg.BacktestConfig(recompute_interval=1, warmup=lg.PatternConfig().min_bars - 1,
                                                     lookback=lg.ALL_BARS)).count()
    seen, detect = [], lg.pt.detect
    monkeypatch.setattr(lg.pt, "detect", lambda b, *a, **k: seen.append(b.count()) or detect(b, *a, **k))
    got = lg.run(rank, bars, scenarios)
    assert 0 < sum(seen) < n_every / 2
    want = lg.run(rank, bars, scenarios, found=every)
    order = ["scenario", "kind", "lpos", "symbol"]
    a, b = (x.toPandas().sort_values(order).reset_index(drop=True) for x in (got, want))
    assert (a["kind"] == "trade").sum() > 4
    pd.testing.assert_frame_equal(a[list(b.columns)], b)
    points = spark.createDataFrame([("N1", 60), ("N1", 90), ("N4", 75)], "symbol string, eval_idx bigint")
    some = lg.patterns_at(bars, points).drop("key_points").toPandas()
    full = every.join(points, ["symbol", "eval_idx"]).drop("key_points").toPandas()
    ids = ["symbol", "eval_idx", "pattern_type", "start_idx", "end_idx"]
    assert len(full) > 0
    pd.testing.assert_frame_equal(some[sorted(full.columns)].sort_values(ids).reset_index(drop=True),
                                  full[sorted(full.columns)].sort_values(ids).reset_index(drop=True))
