"""Features, labels, models and regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlemill.operators import features as fe
from candlemill.operators import hidden as hd
from candlemill.operators import indicators as ind
from candlemill.operators import learn as ln
from candlemill.operators import patterns as pt
from candlemill.plans.oracle import ATR, PINS, W, bars, rnd
from candlemill.plans.queries_bars import ADX, BIAS, INSIDE, PCT, REGIME, SWINGS, _fwd, _lag, week
from candlemill.plans.queries_levels import LEVELS, LEVFEAT, MATCH, flagged, weekly_analysis
from candlemill.plans.queries_patterns import ALL, all_patterns
from candlemill.plans.queries_signals import EXITS, SIMPLE, _LATE, _S, simple_trades
from candlemill.plans.registry import Registry, pick, r
from candlemill.schemas import KEYS, REGIMES
from candlemill.session import table_path
from candlemill.sources import tables

reg = Registry()
CFG = ln.TrainConfig(max_iter=8)
SMALL = ln.TrainConfig(max_iter=3, max_depth=3, n_folds=2, min_features=5, max_features=19, repeats=2)


def features(spark, sf):
    return tables.built(spark, sf, "features_week", lambda: fe.extract(weekly_analysis(spark, sf)))


def training(spark, sf):
    """Features with forward labels, built once: the feature store."""
    def build():
        labels = ind.compute(week(spark, sf), ind.forward_labels())
        names = [c for c in labels.columns if c.startswith(("fwd_return_", "label_"))]
        return features(spark, sf).join(labels.select(*KEYS, "idx", *names), [*KEYS, "idx"])

    return tables.built(spark, sf, "training_week", build)


H1 = f"""h1 AS (SELECT *, abs(close - open) AS body_size, high - low AS rng, (abs(close - open)) / nullif(high - low, 0) AS body_range_ratio,
  (close - low) / nullif(high - low, 0) AS close_position FROM bars)"""


@reg.add("h1_candle_features", f"WITH {bars()}, {H1} SELECT symbol, ts, {rnd('body_range_ratio', 6)} AS body_range_ratio, {rnd('close_position', 6)} AS close_position FROM h1")
def _(spark, sf):
    return pick(ind.candle(week(spark, sf)), "symbol ts", body_range_ratio=6, close_position=6)


@reg.add("h2_pin_inside_features", f"""WITH RECURSIVE {bars()}, {ATR}, {LEVELS}, {MATCH}, {INSIDE}
SELECT b.symbol, b.idx, CASE WHEN m.idx IS NULL THEN 0.0 ELSE 1.0 END AS is_pinbar, {rnd('coalesce(m.wick_ratio, 0.0)')} AS pinbar_wick_ratio, {rnd('coalesce(m.sr_distance, 1.0)', 6)} AS pinbar_sr_distance,
CASE WHEN i.idx IS NULL THEN 0.0 ELSE 1.0 END AS is_inside_bar, {rnd('coalesce(i.compression, 0.0)', 6)} AS inside_bar_compression
FROM bars b LEFT JOIN matched m USING (symbol, idx) LEFT JOIN inside i USING (symbol, idx)""")
def _(spark, sf):
    a = weekly_analysis(spark, sf)
    out = fe.pin_features(fe.bar_features(a.flagged), a.pin_bars)
    return pick(out, "symbol idx is_pinbar is_inside_bar", pinbar_wick_ratio=4, pinbar_sr_distance=6, inside_bar_compression=6)


_HOT = ", ".join(f"CASE WHEN regime = '{x}' THEN 1.0 ELSE 0.0 END AS regime_{x}" for x in REGIMES)


@reg.add("h3_regime_features", f"WITH {bars()}, {ATR}, {REGIME} SELECT symbol, idx, {rnd('atr_pct', 6)} AS atr_percentile, {rnd('adx')} AS adx, {_HOT} FROM regime")
def _(spark, sf):
    return pick(fe.regime_features(week(spark, sf)), "symbol idx " + " ".join(f"regime_{x}" for x in REGIMES), atr_percentile=6, adx=4)


@reg.add("h4_feature_frame", f"""WITH RECURSIVE {bars()}, {ATR}, {LEVELS}, {MATCH}, {INSIDE}, {BIAS}, {LEVFEAT}, {REGIME},
roll AS (SELECT symbol, timeframe, idx, volume / avg(volume) OVER ({W} ROWS 19 PRECEDING) AS volume_ratio, {_lag(5)} AS return_5bar FROM bars),
ar AS (SELECT symbol, idx, atr / avg(atr) OVER ({W} ROWS 19 PRECEDING) AS atr_ratio FROM atr)
SELECT b.symbol, b.idx, {rnd('atr')} AS atr_14, {rnd('ar.atr_ratio', 6)} AS atr_ratio, {rnd('volume_ratio', 6)} AS volume_ratio, {rnd('return_5bar', 6)} AS return_5bar,
{rnd('coalesce(m.lv_strength, 0.0)', 6)} AS pinbar_sr_strength, CASE pin_direction WHEN 'LONG' THEN 1.0 WHEN 'SHORT' THEN -1.0 ELSE 0.0 END AS pinbar_direction,
{rnd('f.dist_nearest_support', 6)} AS dist_nearest_support, {rnd('f.nearest_sr_touches', 1)} AS nearest_sr_touches, f.levels_within_1atr,
CASE bias WHEN 'LONG' THEN 1.0 WHEN 'SHORT' THEN -1.0 ELSE 0.0 END AS higher_tf_bias, {rnd('rg.adx')} AS adx,
CAST(coalesce(b.idx - (SELECT max(idx) FROM pivots p WHERE p.symbol = b.symbol AND p.idx <= b.idx AND is_high), b.n_bars) AS DOUBLE) AS bars_since_swing_high
FROM atr b JOIN roll USING (symbol, idx) JOIN ar USING (symbol, idx) JOIN levfeat f USING (symbol, idx) JOIN regime rg USING (symbol, idx) JOIN bias bi USING (symbol) LEFT JOIN matched m USING (symbol, idx)""".replace("b.symbol, b.idx, (round(atr +", "b.symbol, b.idx, (round(b.atr +"))
def _(spark, sf):
    return pick(features(spark, sf), "symbol idx pinbar_direction levels_within_1atr higher_tf_bias bars_since_swing_high",
                atr_14=4, atr_ratio=6, volume_ratio=6, return_5bar=6, pinbar_sr_strength=6, dist_nearest_support=6,
                nearest_sr_touches=1, adx=4)


@reg.add("h4_no_nulls", f"WITH {bars()} SELECT CAST(0 AS BIGINT) AS nulls, count(*) AS rows FROM bars")
def _(spark, sf):
    return fe.null_count(features(spark, sf))


@reg.add("h5_trade_labels", f"{_S}, {EXITS} SELECT symbol, eval_idx, CAST(CASE exit_reason WHEN 'take_profit' THEN 1 WHEN 'stop_loss' THEN 0 ELSE CAST(net_pnl > 0 AS INT) END AS BIGINT) AS label, exit_reason = 'end_of_data' AS is_soft_label FROM trades")
def _(spark, sf):
    out = fe.trade_labels(simple_trades(spark, sf), exclude_end=False)
    return out.select("symbol", "eval_idx", F.col("label").cast("bigint").alias("label"), "is_soft_label")


@reg.add("h5_label_summary", f"{_S}, {EXITS} SELECT count(*) AS total, count(*) FILTER (WHERE exit_reason = 'take_profit') AS positive, count(*) FILTER (WHERE exit_reason = 'stop_loss') AS negative, CAST(0 AS BIGINT) AS soft, {rnd('avg(CAST(exit_reason = $$take_profit$$ AS INT))', 6)} AS positive_rate FROM trades WHERE exit_reason <> 'end_of_data'")
def _(spark, sf):
    return pick(fe.label_summary(fe.trade_labels(simple_trades(spark, sf))), "total positive negative soft", positive_rate=6)


LABELS = f"""lab AS MATERIALIZED (SELECT symbol, timeframe, idx, ts, {_fwd(5)} AS fwd_return_5d, CASE WHEN {_fwd(5)} > 0.01 THEN 1.0 WHEN {_fwd(5)} < -0.01 THEN 0.0 END AS label_5d,
  {_fwd(10)} AS f10, {_fwd(20)} AS f20 FROM bars),
lrow AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ts, symbol, timeframe) - 1 AS row, count(*) OVER () AS n FROM lab WHERE label_5d IS NOT NULL)"""


@reg.add("h6_time_rows", f"WITH {bars()}, {LABELS} SELECT symbol, idx, row FROM lrow")
def _(spark, sf):
    return ln.numbered(training(spark, sf)).select("symbol", "idx", "row")


@reg.add("h6_folds", f"""WITH {bars()}, {LABELS}, p AS (SELECT max(n) AS n, CAST(floor(max(n) * 0.2 / 3) AS BIGINT) AS sz FROM lrow), f AS (SELECT *, unnest([0, 1, 2]) AS fold FROM p)
SELECT CAST(fold AS BIGINT) AS fold, n - (2 - fold) * sz - sz AS train_end, n - (2 - fold) * sz - sz AS test_start, n - (2 - fold) * sz AS test_end FROM f""")
def _(spark, sf):
    out = ln.fold_ranges(training(spark, sf).filter(F.col("label_5d").isNotNull()))
    return out.withColumn("fold", F.col("fold").cast("bigint"))


def rows(spark, sf):
    return tables.built(spark, sf, "training_rows", lambda: ln.numbered(training(spark, sf)))


def model(spark, sf):
    """A model fitted on the first four fifths of the rows, kept for the queries that use one."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        df = rows(spark, sf)
        names = list(fe.FEATURES)
        _MODELS[key] = ln.classifier(names, CFG).fit(df.filter(F.col("row") < F.col("n_rows") * 0.8))
    return _MODELS[key]


_MODELS: dict = {}


def holdout(spark, sf):
    return rows(spark, sf).filter(F.col("row") >= F.col("n_rows") * 0.8)


@reg.add("h7_train")
def _(spark, sf):
    _, metrics = ln.train(rows(spark, sf), CFG)
    return pick(metrics, "part tp fp fn tn", accuracy=6, precision=6, recall=6, f1=6, profit_factor=5)


@reg.add("h8_profit_factor", f"""WITH {bars()}, {LABELS}, q AS (SELECT l.*, CAST(b.close > b.open AS INT) AS prediction FROM lrow l JOIN bars b USING (symbol, idx))
SELECT symbol, {rnd('sum(fwd_return_5d) FILTER (WHERE prediction = 1 AND fwd_return_5d > 0) / abs(sum(fwd_return_5d) FILTER (WHERE prediction = 1 AND fwd_return_5d < 0))', 5)} AS profit_factor FROM q GROUP BY symbol""")
def _(spark, sf):
    pred = rows(spark, sf).withColumn("prediction", F.col("is_bullish"))
    return pick(ln.profit_factor(pred, "fwd_return_5d", ["symbol"]), "symbol", profit_factor=5)


@reg.add("h9_evaluate")
def _(spark, sf):
    path = table_path(spark, "model")
    ln.save_model(model(spark, sf), path, fe.FEATURES, CFG)
    return pick(ln.evaluate_saved(path, holdout(spark, sf)), "class support", precision=6, recall=6, f1=6)


@reg.add("h9_class_report", f"""WITH {bars()}, {LABELS}, q AS (SELECT label_5d AS y, CAST(b.close > b.open AS INT) AS p FROM lrow JOIN bars b USING (symbol, idx)),
c AS (SELECT k AS class, count(*) FILTER (WHERE y = k AND p = k) AS t, count(*) FILTER (WHERE p = k) AS np, count(*) FILTER (WHERE y = k) AS support FROM q, (VALUES (0), (1)) v(k) GROUP BY k)
SELECT CAST(class AS BIGINT) AS class, {rnd('t / np', 6)} AS precision, {rnd('t / support', 6)} AS recall, {rnd('2 * t / (np + support)', 6)} AS f1, support FROM c""")
def _(spark, sf):
    pred = rows(spark, sf).withColumn("prediction", F.col("is_bullish"))
    out = ln.class_report(ln.counts(pred, "label_5d")).withColumn("class", F.col("class").cast("bigint"))
    return pick(out, "class support", precision=6, recall=6, f1=6)


@reg.add("h10_impurity_importance")
def _(spark, sf):
    return pick(ln.importances(model(spark, sf), fe.FEATURES, spark), "feature", score=6)


@reg.add("h11_permutation_importance")
def _(spark, sf):
    return pick(ln.permutation_importance(model(spark, sf), holdout(spark, sf), list(fe.FEATURES), SMALL), "feature", score=6)


_SCORED = ("body_size", "close", "volume", "high", "low")


@reg.add("h12_stability", f"""WITH {bars()}, {LABELS}, j AS (SELECT l.*, b.open, b.high, b.low, b.close, b.volume, abs(b.close - b.open) AS body_size, l.row * 3 // l.n AS fold FROM lrow l JOIN bars b USING (symbol, idx)),
s AS ({" UNION ALL ".join(f"SELECT fold, 'a' AS method, '{c}' AS feature, avg({c} * (2 * label_5d - 1)) AS score FROM j GROUP BY fold UNION ALL SELECT fold, 'b', '{c}', avg({c} * fwd_return_5d) FROM j GROUP BY fold" for c in _SCORED)}),
k AS (SELECT *, row_number() OVER (PARTITION BY fold, method ORDER BY score DESC, feature) AS rk FROM s), m AS (SELECT fold, feature, avg(rk) AS rk FROM k GROUP BY ALL)
SELECT feature, {rnd('avg(CAST(rk <= 2 AS INT))', 6)} AS stability, {rnd('avg(rk)', 6)} AS mean_rank FROM m GROUP BY feature""")
def _(spark, sf):
    b = week(spark, sf).select(*KEYS, "idx", "high", "low")
    df = rows(spark, sf).join(b, [*KEYS, "idx"]).withColumn("fold", F.floor(F.col("row") * 3 / F.col("n_rows")))
    sign = 2 * F.col("label_5d") - 1
    both = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(c).alias("feature"), (F.col(c) * x).alias("v"))
                               for c in _SCORED for m, x in (("a", sign), ("b", F.col("fwd_return_5d")))]))
    scored = df.select("fold", both.alias("s")).groupBy("fold", "s.method", "s.feature").agg(F.avg("s.v").alias("score"))
    return pick(ln.stability(scored, len(_SCORED), ln.TrainConfig(max_features=1)), "feature", stability=6, mean_rank=6)


@reg.add("h13_select_features")
def _(spark, sf):
    _, sweep = ln.select_features(rows(spark, sf), SMALL)
    return pick(sweep, "n_features best", accuracy=6, profit_factor=5)


@reg.add("h14_hidden_regimes")
def _(spark, sf):
    b = week(spark, sf)
    states = tables.built(spark, sf, "states_week", lambda: hd.with_states(hd.observations(b)))
    return hd.to_regimes(states, b).select("symbol", "idx", "regime")


@reg.add("h15_regime_summary", f"""WITH {bars()}, {ATR}, {REGIME}, g AS (SELECT *, coalesce(regime <> lag(regime) OVER ({W}), true) AS st FROM regime)
SELECT symbol, regime, count(*) AS bars, count(*) FILTER (WHERE st) AS runs, {rnd('count(*) / sum(count(*)) OVER (PARTITION BY symbol)', 6)} AS share, {rnd('count(*) / count(*) FILTER (WHERE st)', 6)} AS avg_duration FROM g GROUP BY symbol, regime""")
def _(spark, sf):
    regimes = ind.with_regime(week(spark, sf)).select(*KEYS, "idx", "regime")
    return pick(hd.regime_summary(regimes), "symbol regime bars runs", share=6, avg_duration=6)


@reg.add("a24_feature_store", f"WITH {bars()}, {LABELS} SELECT symbol, count(*) AS rows, count(label_5d) AS labelled FROM lab GROUP BY symbol")
def _(spark, sf):
    path = table_path(spark, "store")
    fe.export(training(spark, sf), path)
    return spark.read.parquet(path).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.count("label_5d").alias("labelled"))


@reg.add("a25_profile", f"""WITH {bars()}, {LABELS} SELECT CAST(count(*) AS BIGINT) AS rows, count(DISTINCT symbol) AS symbols, CAST(0 AS BIGINT) AS feature_nulls, min(ts) AS first_ts, max(ts) AS last_ts,
{rnd('count(label_5d) / count(*)', 6)} AS label_5d_coverage, {rnd('avg(label_5d)', 6)} AS label_5d_positive FROM lab""")
def _(spark, sf):
    return pick(fe.profile(training(spark, sf)), "rows symbols feature_nulls first_ts last_ts", label_5d_coverage=6, label_5d_positive=6)


_RULE = " ".join(f"WHEN '{k}' THEN {v}" for k, v in ln.RULE_WEIGHTS.items())


@reg.add("e8_rule_score", f"""{ALL}, lv AS (SELECT symbol, idx, n_bars, volume / avg(volume) OVER ({W} ROWS 19 PRECEDING) AS vr FROM bars)
SELECT p.symbol, pattern_type, s_idx AS start_idx, e_idx AS end_idx, {rnd('''round(least(0.35 * CASE pattern_type ''' + _RULE + ''' ELSE 0.5 END + CASE WHEN volume_confirmed THEN 0.20 ELSE 0.0 END + CASE WHEN vr >= 1 THEN 0.05 ELSE 0.0 END
  + CASE WHEN neck > 0 THEN 0.15 ELSE 0.075 END + CASE WHEN rr_ratio >= 3 THEN 0.15 WHEN rr_ratio >= 2 THEN 0.10 WHEN rr_ratio >= 1.5 THEN 0.05 ELSE 0.0 END
  + CASE WHEN status = 'confirmed' THEN 0.10 ELSE 0.0 END, 1.0), 4)''', 4)} AS score FROM pat p JOIN lv ON lv.symbol = p.symbol AND lv.idx = lv.n_bars - 1""")
def _(spark, sf):
    last = features(spark, sf).filter(F.col("idx") == F.col("n_bars") - 1).select(*KEYS, "volume_ratio")
    out = all_patterns(spark, sf).join(last, list(KEYS)).withColumn(
        "score", pt.score(ln.RULE_WEIGHTS, F.col("volume_ratio") < 1))
    return pick(out, "symbol pattern_type start_idx end_idx", score=4)


@reg.add("e9_model_score")
def _(spark, sf):
    inputs = ln.pattern_inputs(all_patterns(spark, sf), features(spark, sf), KEYS)
    out = ln.model_score(model(spark, sf), inputs, fe.FEATURES)
    return pick(out, "symbol pattern_type start_idx end_idx", score=6)
