import numpy as np
import pytest
from conftest import from_closes, random_bars, rows, to_spark
from pyspark.sql import functions as F

from candlemill.operators import indicators as ind
from candlemill.operators import structure as st
from candlemill.schemas import KEYS, REGIMES, check_enum


def ewm(x, alpha):
    out = [x[0]]
    for v in x[1:]:
        out.append((1 - alpha) * out[-1] + alpha * v)
    return np.array(out)


def adx_loop(df, p):
    h, lo, c = (df[x].to_numpy() for x in ("high", "low", "close"))
    tr, plus, minus = [h[0] - lo[0]], [0.0], [0.0]
    for i in range(1, len(df)):
        tr.append(max(h[i] - lo[i], abs(h[i] - c[i - 1]), abs(lo[i] - c[i - 1])))
        up, dn = h[i] - h[i - 1], lo[i - 1] - lo[i]
        plus.append(up if up > dn and up > 0 else 0.0)
        minus.append(dn if dn > up and dn > 0 else 0.0)
    a, sp, sm = (ewm(np.array(x), 1 / p) for x in (tr, plus, minus))
    dx = np.zeros(len(df))
    for i in range(p - 1, len(df)):
        dip, dim = 100 * sp[i] / a[i], 100 * sm[i] / a[i]
        dx[i] = 100 * abs(dip - dim) / (dip + dim) if dip + dim else 0.0
    out = ewm(dx, 1 / p)
    out[:p - 1] = 0.0
    return out


@pytest.mark.parametrize("block", [1000, 4096])
def test_adx_equals_recurrence(spark, block):
    pdf = random_bars(3000, 4)
    out = rows(ind.with_adx(to_spark(spark, pdf), block=block), "idx")
    np.testing.assert_allclose(out["adx"], adx_loop(pdf, 14), atol=1e-8)
    assert out["adx"].between(0, 100).all()


@pytest.mark.parametrize("span", [2, 13, 50])
def test_ema_equals_recurrence_across_blocks(spark, span):
    pdf = random_bars(2600, 5)
    alpha = 2 / (span + 1)
    bars = to_spark(spark, pdf)
    want = ewm(pdf["close"].to_numpy(), alpha)
    got = rows(ind.compute(bars, ind.ema("close", alpha, "e"), block=min(700, ind.ema_block(alpha))), "idx")
    np.testing.assert_allclose(got["e"], want, rtol=1e-10)
    table = rows(ind.ema_table(bars, "close", F.lit(alpha), "e", KEYS), "idx")
    np.testing.assert_allclose(table["e"], want, rtol=1e-10)


def test_atr_percentile_and_volatility_equal_pandas(spark):
    pdf = random_bars(400, 6)
    out = rows(ind.compute(to_spark(spark, pdf), *ind.atr(), ind.percentile_rank("atr", 100, "p"),
                           *ind.volatility(), block=150), "idx")
    prev = pdf["close"].shift(1)
    tr = np.maximum(pdf.high - pdf.low, np.maximum((pdf.high - prev).abs(), (pdf.low - prev).abs()).fillna(0))
    atr = tr.rolling(14, min_periods=1).mean()
    np.testing.assert_allclose(out["atr"], atr)
    pct = atr.rolling(100, min_periods=1).apply(lambda x: x.rank(pct=True).iloc[-1], raw=False)
    np.testing.assert_allclose(out["p"], pct)
    vol = pdf["close"].pct_change().fillna(0).rolling(20, min_periods=1).std().fillna(0)
    np.testing.assert_allclose(out["rolling_volatility_20"], vol, atol=1e-12)


@pytest.mark.parametrize("block", [11, 4096])
def test_pivots_are_strict_unique_extremes(spark, block):
    pdf = random_bars(300, 7)
    got = rows(st.pivots(to_spark(spark, pdf), block=block), "idx", "is_high")
    want = []
    for i in range(5, 295):
        win = pdf.iloc[i - 5:i + 6]
        for low_side, x, best in ((False, win.low, win.low.min()), (True, win.high, win.high.max())):
            v = pdf.high[i] if low_side else pdf.low[i]
            if v == best and (x == v).sum() == 1:
                want.append((i, low_side))
    assert list(zip(got["idx"], got["is_high"])) == sorted(want)


def test_flat_bars_have_no_pivots_or_pins(spark):
    bars = to_spark(spark, from_closes([100.0] * 40))
    assert st.pivots(bars).count() == 0
    assert ind.pin_bars(bars).count() == 0


def test_short_series_have_no_pivots(spark):
    assert st.pivots(to_spark(spark, random_bars(10, 1))).count() == 0


def test_provisional_swings_reach_two_bars_from_the_end(spark):
    closes = [100, 99, 98, 97, 96, 95, 96, 97, 98, 99, 100, 104, 101, 99]
    out = rows(st.swing_points(to_spark(spark, from_closes(closes))), "idx")
    last = out[out.is_high].iloc[-1]
    assert last["idx"] == 11 and last["strength"] == 4


def test_regime_is_one_of_the_known(spark):
    bars = to_spark(spark, random_bars(300, 8), from_closes(np.linspace(100, 400, 300), "UP"))
    out = ind.with_regime(bars)
    assert {r[0] for r in out.select("regime").distinct().collect()} <= set(REGIMES)
    up = out.filter("symbol = 'UP' and idx > 100").select("regime").distinct().collect()
    assert [r[0] for r in up] == ["trending_up"]
    out.select(check_enum("regime", REGIMES)).collect()
    with pytest.raises(Exception, match="unexpected value"):
        out.select(check_enum("regime", ("range_bound",))).collect()


def test_last_forward_labels_are_null(spark):
    out = rows(ind.compute(to_spark(spark, random_bars(60, 9)), ind.forward_labels(), block=25), "idx")
    assert out["fwd_return_5d"].isna().sum() == 5 and out["fwd_return_20d"].isna().sum() == 20
    assert out["label_20d"].iloc[-20:].isna().all()


@pytest.mark.parametrize("block", [9, 4096])
def test_bars_since_swing_and_runs_equal_loops(spark, block):
    pdf = random_bars(260, 10)
    bars = to_spark(spark, pdf)
    piv = st.pivots(bars)
    out = rows(st.bars_since_swing(bars, piv, block=block), "idx")
    p = rows(piv, "idx")
    highs = list(p[p.is_high]["idx"])
    want = [i - max([h for h in highs if h <= i], default=i - 260) for i in range(260)]
    assert list(out["bars_since_swing_high"]) == want
    run = st.closing_runs(piv, block=block).first()
    for col, prices, up in (("consecutive_higher_highs", list(p[p.is_high].price), True),
                            ("consecutive_lower_lows", list(p[~p.is_high].price), False)):
        n = 0
        for a, b in zip(prices[::-1], prices[-2::-1]):
            if (a > b) == up and a != b:
                n += 1
            else:
                break
        assert run[col] == n
