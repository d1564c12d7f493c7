import numpy as np
import pytest
from conftest import from_closes, random_bars, rows, to_spark
from pyspark.sql import functions as F

from candlemill.config import AnalysisConfig
from candlemill.operators import analysis as an
from candlemill.operators import indicators as ind
from candlemill.operators import levels as lv
from candlemill.operators import structure as st
from candlemill.schemas import KEYS, TIMEFRAMES

CFG = AnalysisConfig(min_touches=2)


@pytest.fixture(scope="module")
def base(spark):
    bars = to_spark(spark, random_bars(600, 11), random_bars(300, 12, "B", wave=8))
    flagged = an.flag_bars(bars, CFG, list(KEYS), None).cache()
    return bars, flagged, lv.series_stats(flagged).cache()


def chain(values, dist):
    groups = [[values[0]]]
    for v in values[1:]:
        if v - groups[-1][-1] <= dist:
            groups[-1].append(v)
        else:
            groups.append([v])
    return groups


def test_clusters_equal_a_sorted_walk(base):
    bars, flagged, stats = base
    points = an._pivots(flagged, CFG, list(KEYS))
    got = rows(lv.horizontal_levels(points, stats, CFG.horizontal), "symbol", "price")
    pdf, st_ = rows(points, "symbol", "price"), stats.toPandas().set_index("symbol")
    want = []
    for symbol, g in pdf.groupby("symbol"):
        for c in chain(list(g["price"]), 0.5 * st_.loc[symbol, "avg_atr"]):
            if len(c) >= CFG.horizontal.min_touches:
                want.append((symbol, np.mean(c), len(c)))
    assert len(want) > 3
    assert [(s, t) for s, _, t in want] == list(zip(got["symbol"], got["touches"]))
    np.testing.assert_allclose(got["price"], [w[1] for w in want])


def test_pin_lines_sit_on_the_most_frequent_tick(base):
    bars, flagged, stats = base
    pins = an._pins(flagged)
    got = rows(lv.pin_bar_lines(pins, stats, CFG), "symbol", "price")
    pdf, st_ = rows(pins, "symbol", "tip"), stats.toPandas().set_index("symbol")
    want = []
    for symbol, g in pdf.groupby("symbol"):
        for c in chain(list(g["tip"]), 0.15 * st_.loc[symbol, "avg_atr"]):
            if len(c) >= 2:
                ticks = [round(x / 0.25) * 0.25 for x in c]
                want.append((symbol, max(dict.fromkeys(ticks), key=ticks.count), len(c)))
    assert list(zip(got["symbol"], got["price"], got["touches"])) == sorted(want)


def test_diagonals_keep_the_stronger_of_similar_lines(base):
    _, flagged, stats = base
    points = an._pivots(flagged, CFG, list(KEYS))
    lines = lv.diagonal_lines(points, stats, CFG.diagonal)
    got = lv.dedupe_diagonals(lines, stats, CFG.diagonal)
    pdf = lines.toPandas().sort_values(["symbol", "strength", "role", "i1", "anchor_idx"], ascending=[True, False, True, True, True])
    near = stats.toPandas().set_index("symbol")["avg_atr"] * 0.5
    want = []
    for symbol, g in pdf.groupby("symbol"):
        kept = []
        for x in g.itertuples():
            if not any(k.role == x.role and abs(k.slope - x.slope) < 0.05 and abs(k.price - x.price) < near[symbol] for k in kept):
                kept.append(x)
        want += [(symbol, k.role, k.i1, k.anchor_idx) for k in kept]
    assert {(r["symbol"], r["role"], r["i1"], r["anchor_idx"]) for r in got.collect()} == set(want)
    head = lv.dedupe_diagonals(lines, stats, CFG.diagonal, first=3)
    assert head.groupBy("symbol").count().agg(F.max("count")).first()[0] == 3


def test_timeframe_merge_equals_a_loop(spark):
    rng = np.random.default_rng(3)
    made = [(s, tf, i, "support", "horizontal", float(rng.uniform(90, 110)), 0.0, 0, float(round(rng.uniform(0.3, 0.95), 3)), int(rng.integers(2, 6)))
            for s in ("A", "B") for tf in ("1w", "1d", "4h") for i in range(8)]
    schema = ("symbol string, source_tf string, pos int, role string, sr_type string, price double, slope double,"
              " anchor_idx bigint, strength double, touches bigint")
    df = spark.createDataFrame(made, schema).withColumns(
        {"first_seen": F.lit("2020-01-01").cast("timestamp_ntz"), "last_tested": F.lit("2020-01-02").cast("timestamp_ntz")})
    near = spark.createDataFrame([("A", 1.5), ("B", 0.7)], "symbol string, _near double")
    got = rows(lv.merge_timeframes(df, near), "symbol", "pos")
    for symbol, dist in (("A", 1.5), ("B", 0.7)):
        own = sorted((m for m in made if m[0] == symbol), key=lambda m: (TIMEFRAMES.index(m[1]), -m[8], m[2]))
        kept = []
        for m in own:
            for k in kept:
                if abs(k["price"] - m[5]) <= dist:
                    if TIMEFRAMES.index(m[1]) > TIMEFRAMES.index(k["tf"]):
                        k["price"] = m[5]
                    k["strength"], k["touches"] = min(k["strength"] + 0.1, 1.0), k["touches"] + m[9]
                    break
            else:
                kept.append({"tf": m[1], "price": m[5], "strength": m[8], "touches": m[9]})
        part = got[got.symbol == symbol]
        assert list(part["source_tf"]) == [k["tf"] for k in kept]
        np.testing.assert_allclose(part["price"], [k["price"] for k in kept])
        np.testing.assert_allclose(part["strength"], [k["strength"] for k in kept])
        assert list(part["touches"]) == [k["touches"] for k in kept]


def test_analysis_does_not_depend_on_block_size(spark, base):
    bars, _, _ = base
    cols = ["symbol", "sr_type", "role", "price", "touches"]
    big = rows(an.analyze(bars, CFG).levels.select(*cols), *cols)
    small = rows(an.analyze(bars, CFG, block=40).levels.select(*cols), *cols)
    assert len(big) > 5
    assert big.drop(columns="price").equals(small.drop(columns="price"))
    np.testing.assert_allclose(big["price"], small["price"])


def test_trading_timeframe_takes_levels_from_coarser_ones(spark):
    day = random_bars(400, 13)
    week = random_bars(200, 13).assign(timeframe="1w")
    out = an.analyze_timeframes(to_spark(spark, day, week), "1d", CFG)
    tfs = {r[0] for r in out.levels.select("source_tf").distinct().collect()}
    assert tfs == {"1w"}
    assert out.pin_bars.select("timeframe").distinct().collect()[0][0] == "1d"


def test_one_bar_series_give_nothing(spark):
    assert an.analyze(to_spark(spark, from_closes([100.0])), CFG).levels.count() == 0


def test_round_numbers(spark):
    df = spark.createDataFrame([(100.0, 1.0), (50.0, 0.5), (125.0, 0.0), (112.5, 0.5), (99.0, 1.0)], "price double, want double")
    for r in df.select(lv.round_number_score("price").alias("got"), "want").collect():
        assert abs(r["got"] - r["want"]) < 1e-9


def test_neckline_drops_outliers(spark):
    points = spark.createDataFrame(
        [("A", "1d", i * 10, 100.0 + (30 if i == 3 else 0), True) for i in range(8)],
        "symbol string, timeframe string, idx bigint, price double, is_high boolean")
    out = lv.necklines(points, tolerance=0.1).first()
    assert out["slope"] == 0.0 and abs(out["price"] - 100.0) < 1e-9 and out["touches"] == 7


def test_bias_of_rising_structure(spark):
    wave = [100 + i * 0.8 + 12 * np.sin(i / 3) for i in range(120)]
    bars = to_spark(spark, from_closes(wave))
    assert st.bias(bars, st.pivots(bars)).first()["bias"] == "LONG"


def test_inside_bars_never_exceed_their_mother(base):
    bars, _, _ = base
    out = ind.inside_bars(bars).agg(F.max("compression")).first()[0]
    assert 0 <= out <= 1
