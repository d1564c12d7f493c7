import numpy as np
import pandas as pd
import pytest
from conftest import random_bars, rows, to_spark
from pyspark.sql import functions as F

from candlemill.config import AnalysisConfig
from candlemill.operators import analysis as an
from candlemill.operators import features as fe
from candlemill.operators import hidden as hd
from candlemill.operators import learn as ln
from candlemill.schemas import REGIMES

CFG = ln.TrainConfig(max_iter=3, max_depth=3, n_folds=2, min_features=2, max_features=4, repeats=2)


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    n = 600
    x = rng.normal(size=(n, 5))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 0.3, n) > 0).astype(float)
    pdf = pd.DataFrame(x, columns=["sig_a", "sig_b", "noise_a", "noise_b", "noise_c"]).assign(
        label_5d=y, fwd_return_5d=np.where(y == 1, 0.03, -0.02), symbol=["A", "B"] * (n // 2), timeframe="1d",
        ts=np.repeat(pd.date_range("2020-01-01", periods=n // 2), 2), close=1.0, volume=1.0)
    return ln.numbered(spark.createDataFrame(pdf), CFG).cache()


def test_rows_are_numbered_in_time_order(frame):
    out = rows(frame, "row")
    assert list(out["row"]) == list(range(600)) and out["ts"].is_monotonic_increasing and set(out["n_rows"]) == {600}


def test_folds_are_anchored_and_end_at_the_last_row(frame):
    f = rows(ln.fold_ranges(frame, CFG), "fold")
    assert f["test_end"].iloc[-1] == 600 and list(f["train_end"]) == list(f["test_start"])
    assert list(f["test_start"].iloc[1:]) == list(f["test_end"].iloc[:-1])


def test_signal_outranks_noise(spark, frame):
    names = ["sig_a", "sig_b", "noise_a", "noise_b", "noise_c"]
    model = ln.classifier(names, CFG).fit(frame.filter("row < 400"))
    mdi = rows(ln.importances(model, names, spark), "score")
    mda = rows(ln.permutation_importance(model, frame.filter("row >= 400"), names, CFG), "score")
    assert mdi["feature"].iloc[-1] == "sig_a" and mda["feature"].iloc[-1] == "sig_a"
    assert mda.set_index("feature").loc["sig_a", "score"] > 0.1


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_every_repeat_is_a_permutation(spark, n):
    out = spark.range(n).select("id", *[ln.shuffled(F.col("id"), n, k).alias(f"k{k}") for k in (1, 2)]).toPandas()
    for k in ("k1", "k2"):
        assert sorted(out[k]) == list(range(n))
    if n >= 64:
        assert not out["k1"].equals(out["k2"]) and (out["k1"] == out["id"]).mean() < 0.1
        assert abs(np.corrcoef(out["id"], out["k1"])[0, 1]) < 0.4


def test_training_reports_folds_and_holdout(frame):
    _, m = ln.train(frame, CFG)
    out = m.toPandas().set_index("part")
    assert set(out.index) == {"fold_0", "fold_1", "holdout"} and out["accuracy"].min() > 0.7
    assert out.loc["holdout", "profit_factor"] > 1


def test_selection_marks_one_winner(frame):
    ranking, sweep = ln.select_features(frame, CFG)
    assert ranking.filter("stability between 0 and 1").count() == 5
    assert sweep.filter("best").count() == 1


def test_missing_features_score_as_zero(spark, frame):
    names = ["sig_a", "sig_b"]
    model = ln.classifier(names, CFG).fit(frame)
    out = ln.model_score(model, frame.drop("sig_b").limit(20), names)
    assert out.filter("score between 0 and 1").count() == 20


def test_feature_frame_is_complete(spark):
    bars = to_spark(spark, random_bars(220, 31), random_bars(150, 32, "B"))
    out = fe.extract(an.analyze(bars, AnalysisConfig(min_touches=2))).cache()
    assert out.count() == 370 and fe.null_count(out).first()["nulls"] == 0
    one_hot = sum((F.col(f"regime_{r}") for r in REGIMES), F.lit(0.0))
    assert out.filter(one_hot != 1.0).count() == 0
    frame = fe.training_frame(bars, AnalysisConfig(min_touches=2), min_bars=200)
    assert [r[0] for r in frame.select("symbol").distinct().collect()] == ["A"]
    p = fe.profile(frame).first()
    assert p["rows"] == 220 and p["features"] == len(fe.FEATURES) and p["feature_nulls"] == 0


def test_hidden_states_find_a_shift(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal((2, 0, 0), 0.3, (120, 3)), rng.normal((-2, 0, 0), 0.3, (120, 3))])
    path = hd.fit_states(x)
    first, second = np.bincount(path[:120]).argmax(), np.bincount(path[120:]).argmax()
    assert first != second and (path[:120] == first).mean() > 0.9
    bars = to_spark(spark, random_bars(260, 33))
    out = hd.to_regimes(hd.with_states(hd.observations(bars)), bars)
    assert out.count() == 260 and {r[0] for r in out.select("regime").distinct().collect()} <= set(REGIMES)


def test_regime_summary_counts_runs(spark):
    seq = ["a", "a", "b", "a", "c", "c", "c"]
    df = spark.createDataFrame([("S", "1d", i, r) for i, r in enumerate(seq)], "symbol string, timeframe string, idx bigint, regime string")
    out = hd.regime_summary(df, block=3).toPandas().set_index("regime")
    assert out.loc["a", "bars"] == 3 and out.loc["a", "runs"] == 2 and out.loc["c", "avg_duration"] == 3


def test_one_model_for_a_series_of_6000_bars(spark):
    rng = np.random.default_rng(2)
    n = 6000
    level = np.where((np.arange(n) // 1500) % 2 == 0, 2.0, -2.0)
    pdf = pd.DataFrame({"symbol": "S", "timeframe": "1d", "idx": np.arange(1, n + 1)})
    for k, name in enumerate(hd.OBSERVED):
        pdf[name] = rng.normal(0, 0.3, n) + (level if k == 0 else 0)
    out = rows(hd.with_states(spark.createDataFrame(pdf).repartition(5)), "idx")
    up, down = (np.bincount(out["state"][level == v]).argmax() for v in (2.0, -2.0))
    assert up != down  # the same state means the same before and after bar 5,000
    for part in (slice(0, 5000), slice(5000, n)):
        want = np.where(level[part] > 0, up, down)
        assert (out["state"].to_numpy()[part] == want).mean() > 0.8


@pytest.mark.parametrize("n", [3, 5, 17, 39, 60])
def test_feature_counts_are_even_and_reach_both_ends(n):
    sizes = ln.feature_counts(n)
    assert sizes[0] == min(5, n) and sizes[-1] == min(40, n) and sizes == sorted(set(sizes))
    gaps = np.diff(sizes)
    assert not len(gaps) or gaps.max() - gaps.min() <= 1


def test_saved_model_scores_alike(spark, frame, tmp_path):
    names = ["sig_a", "sig_b", "noise_a"]
    model = ln.classifier(names, CFG).fit(frame)
    ln.save_model(model, str(tmp_path / "m"), names, CFG)
    again, about = ln.load_model(spark, str(tmp_path / "m"))
    assert about["features"] == names and about["config"]["label"] == "label_5d"
    a, b = (rows(ln.model_score(m, frame, names).select("row", "score"), "row") for m in (model, again))
    assert a.equals(b)
    report = ln.evaluate_saved(str(tmp_path / "m"), frame.drop("noise_a")).collect()
    assert sum(r["support"] for r in report) == 600
