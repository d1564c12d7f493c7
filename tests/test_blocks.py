import numpy as np
import pandas as pd
import pytest
from conftest import random_bars, rows, to_spark
from pyspark.sql import Window
from pyspark.sql import functions as F

from candlemill.functions.asof import as_of_last
from candlemill.functions.blocks import Stage, blocked, running
from candlemill.functions.quantile import exact_median
from candlemill.functions.rank import rank_descending
from candlemill.functions.search import climb, depth, first_hit, range_extremes, tree
from candlemill.schemas import KEYS


@pytest.fixture(scope="module")
def bars(spark):
    return to_spark(spark, random_bars(500, 1), random_bars(37, 2, "B"), random_bars(1, 3, "C")).cache()


def test_index_counts_every_bar(bars):
    out = rows(bars, "symbol", "ts")
    for _, g in out.groupby("symbol"):
        assert list(g["idx"]) == list(range(len(g)))
        assert set(g["n_bars"]) == {len(g)}


@pytest.mark.parametrize("block", [1, 7, 64, 4096])
def test_blocked_windows_equal_whole_windows(bars, block):
    def apply(df, w):
        return df.withColumns({
            "m": F.avg("close").over(w.rowsBetween(-9, 0)), "nxt": F.max("high").over(w.rowsBetween(1, 4)),
            "lag": F.lag("close", 3).over(w)})

    def twice(df, w):
        return df.withColumn("m2", F.sum("m").over(w.rowsBetween(-5, 0)))

    got = rows(blocked(bars, KEYS, [Stage(9, 4, apply), Stage(5, 0, twice)], block=block), "symbol", "idx")
    w = Window.partitionBy(*KEYS).orderBy("idx")
    want = rows(twice(apply(bars, w), w), "symbol", "idx")
    assert len(got) == len(want)
    for c in ("m", "nxt", "lag", "m2"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-12)


@pytest.mark.parametrize("block", [3, 50, 4096])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_scans_equal_pandas(bars, block, inclusive):
    mark = F.when(F.pmod("idx", F.lit(13)) == 4, F.col("close"))
    out = rows(running(bars, KEYS, {
        "s": ("sum", F.col("volume")), "c": ("count", F.col("close") > F.col("open")), "hi": ("max", F.col("high")),
        "lo": ("min", F.col("low")), "la": ("last", mark)}, block=block, inclusive=inclusive), "symbol", "idx")
    for _, g in out.groupby("symbol"):
        shift = 0 if inclusive else 1
        x = g["close"].where(g["idx"] % 13 == 4).ffill().shift(shift)
        np.testing.assert_allclose(g["la"].astype(float), x)
        np.testing.assert_allclose(g["hi"].astype(float), g["high"].cummax().shift(shift))
        np.testing.assert_allclose(g["lo"].astype(float), g["low"].cummin().shift(shift))
        np.testing.assert_allclose(g["s"].astype(float), g["volume"].cumsum().shift(shift).fillna(0))
        assert list(g["c"]) == list((g["close"] > g["open"]).cumsum().shift(shift).fillna(0).astype(int))


@pytest.mark.parametrize("block", [4, 37, 1024])
def test_first_hit_equals_scan(spark, bars, block):
    pdf = rows(bars, "symbol", "idx")
    rng = np.random.default_rng(5)
    asks = pdf.sample(60, random_state=1)[["symbol", "timeframe", "idx"]].assign(
        level=rng.uniform(pdf.close.min(), pdf.close.max(), 60), ask=range(60)).rename(columns={"idx": "start"})
    hits = first_hit(
        spark.createDataFrame(asks), bars, KEYS, ["ask"], ["level"], "start", {"_hi": F.max("close")},
        F.col("_hi") > F.col("level"), F.col("close") > F.col("level"), F.struct("idx"), block=block)
    got = {r["ask"]: r["hit"]["idx"] for r in hits.collect()}
    for a in asks.itertuples():
        own = pdf[(pdf.symbol == a.symbol) & (pdf.idx >= a.start) & (pdf.close > a.level)]
        assert got.get(a.ask) == (None if own.empty else own.idx.min())


@pytest.mark.parametrize("block", [5, 64])
def test_range_extremes_equal_slices(spark, bars, block):
    pdf = rows(bars.filter("symbol = 'A'"), "idx")
    asks = pd.DataFrame([("A", "1d", i, i, min(i + s, 499)) for i in range(0, 480, 17) for s in (0, 3, 200)],
                        columns=["symbol", "timeframe", "ask", "a", "b"]).assign(ask=range(29 * 3))
    got = range_extremes(spark.createDataFrame(asks), bars, KEYS, ["ask"], "a", "b", block=block).toPandas()
    got = got.set_index("ask")
    for q in asks.itertuples():
        part = pdf.iloc[q.a:q.b + 1]
        assert got.loc[q.ask, "max_high"] == part.high.max() and got.loc[q.ask, "min_low"] == part.low.min()


@pytest.mark.parametrize(("block", "fan"), [(2, 2), (3, 4), (7, 16)])
def test_deep_trees_equal_scans(spark, bars, block, fan):
    pdf = rows(bars, "symbol", "idx")
    rng = np.random.default_rng(6)
    asks = pdf.sample(80, random_state=2)[["symbol", "timeframe", "idx"]].assign(
        level=rng.uniform(pdf.close.min(), pdf.close.max() + 5, 80), ask=range(80)).rename(columns={"idx": "a"})
    asks["b"] = asks.a + rng.integers(0, 400, 80)
    ends = pdf.groupby("symbol").idx.max()
    asks["b"] = np.minimum(asks.b, asks.symbol.map(ends))
    points = spark.createDataFrame(asks)
    assert depth(bars, block, fan) > 1
    hits = first_hit(
        points, bars, KEYS, ["ask"], ["level"], "a", {"_hi": F.max("close")},
        F.col("_hi") > F.col("level"), F.col("close") > F.col("level"), F.struct("idx"), block=block, fan=fan)
    hit = {r["ask"]: r["hit"]["idx"] for r in hits.collect()}
    got = range_extremes(points, bars, KEYS, ["ask"], "a", "b", block=block, fan=fan).toPandas().set_index("ask")
    for q in asks.itertuples():
        own = pdf[(pdf.symbol == q.symbol) & (pdf.idx >= q.a)]
        part = own[own.idx <= q.b]
        later = own[own.close > q.level]
        assert hit.get(q.ask) == (None if later.empty else later.idx.min())
        assert got.loc[q.ask, "max_high"] == part.high.max() and got.loc[q.ask, "min_low"] == part.low.min()


def test_rows_that_points_meet_grow_with_the_series(spark):
    met = []
    for n in (2_000, 8_000, 32_000):
        line = spark.range(n).select(F.lit("A").alias("symbol"), F.col("id").alias("idx"), F.rand(1).alias("close"))
        levels = depth(line, 8, 8)
        nodes = tree(line, ["symbol"], {"_hi": F.max("close")}, levels, 8, 8)
        asks = []
        for level in range(1, levels + 1):
            own = F.floor(F.col("idx") / 8**level)
            asks.append(F.struct(F.lit(level).alias("level"), (F.floor(own / 8) if level < levels else F.lit(0).cast("bigint")).alias("parent"),
                                 own.alias("lo"), F.lit(None).cast("bigint").alias("hi")))
        met.append(climb(line.select("symbol", "idx"), nodes, ["symbol"], asks, F.col("idx"), 4).count() / n)
    assert met[-1] <= 8 * depth(line, 8, 8) and met[-1] < 2.5 * met[0]  # a row per block would be sixteen times as many


def test_exact_median_of_skewed_groups(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": ["big"] * 3000 + ["small"] * 4 + ["one"], "v": rng.normal(0, 3, 3005)})
    got = exact_median(spark.createDataFrame(pdf), ["k"], "v", 0.5).toPandas().set_index("k")["median"]
    for k, v in pdf.groupby("k")["v"].median().items():
        assert abs(got[k] - v) < 1e-12


def test_as_of_last(spark):
    at = spark.createDataFrame(
        [("A", "2020-01-05", 1), ("A", "2020-01-09", 2), ("B", "2020-01-01", 3)], "symbol string, date string, v int")
    ask = spark.createDataFrame(
        [("A", "2020-01-04"), ("A", "2020-01-05"), ("A", "2020-02-01"), ("B", "2020-01-02")], "symbol string, date string")
    to_date = F.col("date").cast("date")
    out = as_of_last(ask.withColumn("date", to_date), at.withColumn("date", to_date), ["symbol"], "v", block=4)
    got = {(r["symbol"], str(r["date"])): r["v"] for r in out.collect()}
    assert got == {("A", "2020-01-04"): None, ("A", "2020-01-05"): 1, ("A", "2020-02-01"): 2, ("B", "2020-01-02"): 3}


def test_ranks_by_cells_equal_a_sort(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"k": ["a"] * 500 + ["b"] * 3, "v": np.round(rng.gamma(1, 50, 503)), "id": range(503)})
    out = rank_descending(spark.createDataFrame(pdf), ["k"], "v", ["id"], F.floor(F.log1p("v") * 4)).toPandas()
    want = pdf.sort_values(["k", "v", "id"], ascending=[True, False, True])
    want["rank"] = want.groupby("k").cumcount() + 1
    merged = out.merge(want, on="id")
    assert (merged["rank_x"] == merged["rank_y"]).all() and set(out[out.k == "b"]["size"]) == {3}
