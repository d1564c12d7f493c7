import numpy as np
import pytest
from conftest import from_closes, random_bars, rows, to_spark
from pyspark.sql import functions as F

from candlemill.config import PatternConfig
from candlemill.operators import patterns as pt
from candlemill.schemas import KEYS

CFG = PatternConfig()


def line(*points):
    """Piecewise linear closes through (index, price) points."""
    xs, ys = zip(*points)
    return np.interp(np.arange(xs[-1] + 1), xs, ys)


W = line((0, 120), (10, 100), (18, 112), (26, 100.5), (40, 130))
M = 220 - W
FALSE_DOWN = line((0, 120), (10, 100), (18, 110), (26, 97), (29, 108), (40, 118))
BULL_FLAG = np.concatenate([line((0, 110), (8, 100), (18, 140)), [134, 130, 126, 123, 121], line((0, 124), (14, 170))])


def found(spark, closes, only=None, **kw):
    return rows(pt.detect(to_spark(spark, from_closes(closes)), CFG, only, **kw), "pattern_type", "start_idx")


def test_double_bottom_breaks_out(spark):
    out = found(spark, W, ["w_bottom"])
    assert len(out) == 1
    p = out.iloc[0]
    assert p["direction"] == "bullish" and p["status"] == "confirmed"
    assert (p["start_idx"], p["end_idx"]) == (10, 26) and p["breakout_idx"] > 26
    assert abs(p["neckline"] - 112 * 1.01) < 1e-9
    assert p["stop"] < p["entry"] < p["target1"] < p["target2"]


def test_double_top_mirrors_it(spark):
    p = found(spark, M, ["m_top"]).iloc[0]
    assert p["direction"] == "bearish" and p["stop"] > p["entry"] > p["target1"] > p["target2"]


def test_false_breakdown_is_confirmed_at_recovery(spark):
    p = found(spark, FALSE_DOWN, ["false_breakdown"]).iloc[0]
    assert p["status"] == "confirmed" and p["breakout_idx"] == p["end_idx"] > 26
    assert p["key_points"] if isinstance(p["key_points"], dict) else dict(p["key_points"])


def test_bull_flag_ends_at_the_first_fitting_bar(spark):
    out = found(spark, BULL_FLAG, ["bull_flag"])
    assert len(out) == 1
    p = out.iloc[0]
    top, low = 140 * 1.01, np.array(BULL_FLAG[19:24]) * 0.99
    height = top - 100 * 0.99
    first = next(j for j in range(2, 5) if 0.30 <= (top - low[j]) / height <= 0.60)
    assert p["start_idx"] == 8 and p["end_idx"] == 19 + first and p["status"] == "confirmed"


def test_bear_flag_mirrors_it(spark):
    p = found(spark, 300 - BULL_FLAG, ["bear_flag"]).iloc[0]
    assert p["direction"] == "bearish" and p["stop"] > 0 and p["target1"] < p["entry"]


def brute(df, cfg=CFG):
    """Swing, double-bottom and head-and-shoulders detectors as plain loops."""
    h, lo, c, n = df.high.to_numpy(), df.low.to_numpy(), df.close.to_numpy(), len(df)
    highs, lows = [], []
    for i in range(5, n - 2):
        a, b = i - 5, min(i + 6, n)
        if h[i] == h[a:b].max() and (h[a:b] == h[i]).sum() == 1:
            highs.append(i)
        if lo[i] == lo[a:b].min() and (lo[a:b] == lo[i]).sum() == 1:
            lows.append(i)
    out = set()

    def near(a, b, tol):
        return abs(a - b) / ((a + b) / 2) <= tol

    for a, b in zip(lows, lows[1:]):
        mid = [h[x] for x in highs if a < x < b]
        if near(lo[a], lo[b], 0.03) and 10 <= b - a <= 120 and mid:
            out.add(("w_bottom", a, b))
        rec = [j for j in range(b + 1, min(b + 6, n)) if c[j] > lo[a]]
        if lo[b] < lo[a] and rec:
            out.add(("false_breakdown", a, rec[0]))
            if 10 <= b - a <= 120 and mid:
                out.add(("false_breakdown_w_bottom", a, b))
    for a, b, d in zip(highs, highs[1:], highs[2:]):
        m1, m2 = [x for x in lows if a < x < b], [x for x in lows if b < x < d]
        if h[b] > h[a] and h[b] > h[d] and near(h[a], h[d], 0.05) and 10 <= d - a <= 120 and m1 and m2:
            out.add(("hs_top", a, d))
    for a, b in zip(highs, highs[1:]):
        if h[b] >= h[a]:
            continue
        inner = [x for x in lows if a <= x <= b + 5]
        if len(inner) >= 2 and lo[inner[-1]] > lo[inner[0]] and 10 <= max(b, inner[-1]) - a <= 120:
            out.add(("sym_triangle_top", a, max(b, inner[-1])))
    for a in lows[:-1]:
        top = next((x for x in highs if x > a), None)
        if top is None or h[top] <= lo[a]:
            continue
        s = top + 1
        for j in range(s + 2, min(s + 30, n)):
            if (np.diff(h[s:j + 1]) <= 0).all() and (np.diff(lo[s:j + 1]) <= 0).all():
                if 0.30 <= (h[top] - lo[s:j + 1].min()) / (h[top] - lo[a]) <= 0.60:
                    out.add(("bull_flag", a, j))
                    break
    return out


KINDS = ("w_bottom", "false_breakdown", "false_breakdown_w_bottom", "hs_top", "sym_triangle_top", "bull_flag")


@pytest.mark.parametrize("block", [50, None])
def test_detectors_equal_loops_on_random_bars(spark, block):
    frames = [random_bars(500, s, f"R{s}", step=1.5, wave=6) for s in range(4)]
    got = pt.detect(to_spark(spark, *frames), CFG, KINDS, block=block).select(
        "symbol", "pattern_type", "start_idx", "end_idx").collect()
    want = {(f"R{s}", *p) for s, f in enumerate(frames) for p in brute(f)}
    assert len(want) > 40 and {w[1] for w in want} >= set(KINDS) - {"bull_flag"}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_filter_and_unknown_names(spark):
    assert set(found(spark, W, ["w_bottom", "nonsense"])["pattern_type"]) == {"w_bottom"}
    with pytest.raises(ValueError):
        pt.detect(to_spark(spark, from_closes(W)), CFG, ["nonsense"])


def test_short_series_give_no_patterns(spark):
    assert pt.detect(to_spark(spark, from_closes(W[:9])), CFG).count() == 0


def test_scores_lie_in_the_unit_interval_and_order_is_total(spark):
    bars = to_spark(spark, *[random_bars(300, s, f"R{s}", wave=6) for s in range(3)])
    out = pt.detect(bars, CFG)
    lo, hi = out.agg(F.min("confidence"), F.max("confidence")).first()
    assert 0 <= lo <= hi <= 1
    assert pt.best_pattern(out, KEYS).groupBy("symbol").count().filter("count > 1").count() == 0


def test_as_of_stamp_is_never_before_the_pattern_can_be_seen(spark):
    out = pt.detect(to_spark(spark, random_bars(400, 3, wave=6)), CFG).withColumn("known", pt.known_idx(CFG))
    assert out.filter(F.col("known") < F.col("end_idx") + CFG.swing_lookback).count() == 0
