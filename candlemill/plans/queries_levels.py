"""Support and resistance levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlemill.config import AnalysisConfig
from candlemill.operators import analysis as an
from candlemill.operators import indicators as ind
from candlemill.operators import levels as lv
from candlemill.operators import structure as st
from candlemill.plans.oracle import ATR, PINS, PIVOTS, bars, rnd
from candlemill.plans.queries_bars import BIAS, SMA_BIAS, week
from candlemill.plans.registry import Registry, pick, r
from candlemill.session import materialize
from candlemill.sources import tables

reg = Registry()
CFG = AnalysisConfig()


def flagged(spark, sf):
    """Bars with every analysis flag; built once, like any table several plans read."""
    return tables.built(
        spark, sf, "flagged_week", lambda: an.flag_bars(week(spark, sf), CFG, ["symbol", "timeframe"], None)
    )


def parts(spark, sf):
    f = flagged(spark, sf)
    keys = ["symbol", "timeframe"]
    return f, an._pins(f), an._pivots(f, CFG, keys), lv.series_stats(f, keys)


STATS = """stats AS MATERIALIZED (SELECT symbol, timeframe, avg(atr) AS avg_atr, max(high) AS max_high,
  min(low) AS min_low, avg(volume) AS avg_volume, count(*) AS n_bars FROM atr GROUP BY ALL)"""

K = "PARTITION BY symbol, timeframe"
LINES = f"""tg AS (SELECT p.*, coalesce(tip - lag(tip) OVER (PARTITION BY p.symbol, p.timeframe ORDER BY tip), 0)
   > 0.15 * avg_atr AS brk FROM pins p JOIN stats USING (symbol, timeframe)),
tc AS (SELECT *, sum(CAST(brk AS INT)) OVER ({K} ORDER BY tip ROWS UNBOUNDED PRECEDING) AS cl,
   round_even(tip / 0.25, 0) * 0.25 AS tick FROM tg),
tk AS (SELECT symbol, timeframe, cl, tick, count(*) AS n FROM tc GROUP BY ALL),
tm AS (SELECT symbol, timeframe, cl, tick AS price FROM tk
   QUALIFY row_number() OVER (PARTITION BY symbol, timeframe, cl ORDER BY n DESC, tick) = 1),
lines AS MATERIALIZED (SELECT c.symbol, c.timeframe, m.price, count(*) AS touches,
   CASE WHEN count(*) FILTER (WHERE pin_direction = 'LONG') * 2 >= count(*) THEN 'support' ELSE 'resistance' END AS role,
   least(0.3 + count(*) * 0.15, 1.0) AS strength, min(ts) AS first_seen, max(ts) AS last_tested
   FROM tc c JOIN tm m USING (symbol, timeframe, cl) GROUP BY c.symbol, c.timeframe, cl, m.price HAVING count(*) >= 3)"""


@reg.add("c1_pin_bar_lines", f"""WITH {bars()}, {ATR}, {PINS}, {STATS}, {LINES}
SELECT symbol, price, touches, role, {rnd('strength', 6)} AS strength, first_seen, last_tested FROM lines""")
def _(spark, sf):
    _, pins, _, stats = parts(spark, sf)
    return pick(lv.pin_bar_lines(pins, stats, CFG), "symbol price touches role first_seen last_tested", strength=6)


def round_sql(p: str) -> str:
    return (f"least(greatest(0.0, 1.0 - least({p} % 100, 100 - {p} % 100) / 25.0)"
            f" + greatest(0.0, 1.0 - least({p} % 50, 50 - {p} % 50) / 12.5) * 0.5, 1.0)")


HORIZ = f"""hg AS (SELECT p.*, s.n_bars, s.avg_volume, coalesce(price - lag(price) OVER
   (PARTITION BY p.symbol, p.timeframe ORDER BY price), 0) > 0.5 * avg_atr AS brk
   FROM pivots p JOIN stats s USING (symbol, timeframe)),
hc AS (SELECT *, sum(CAST(brk AS INT)) OVER ({K} ORDER BY price ROWS UNBOUNDED PRECEDING) AS cl FROM hg),
ha AS (SELECT symbol, timeframe, cl, avg(price) AS price, count(*) AS touches,
   CASE WHEN count(*) FILTER (WHERE is_high) * 2 > count(*) THEN 'resistance' ELSE 'support' END AS role,
   max(idx) / (any_value(n_bars) - 1) AS recency, least(avg(volume) / any_value(avg_volume), 2.0) / 2.0 AS vol,
   min(ts) AS first_seen, max(ts) AS last_tested FROM hc GROUP BY ALL HAVING count(*) >= 3),
horiz AS MATERIALIZED (SELECT symbol, timeframe, price, touches, role, first_seen, last_tested,
   greatest(0.0, least(0.4 * least(touches / 5.0, 1.0) + 0.3 * recency + 0.2 * vol + 0.1 * {round_sql('price')}, 1.0)) AS strength
   FROM ha)"""


@reg.add("c2_horizontal_levels", f"""WITH {bars()}, {ATR}, {PIVOTS}, {STATS}, {HORIZ}
SELECT symbol, {rnd('price')} AS price, touches, role, {rnd('strength', 6)} AS strength, first_seen, last_tested FROM horiz""")
def _(spark, sf):
    _, _, points, stats = parts(spark, sf)
    return pick(lv.horizontal_levels(points, stats, CFG.horizontal), "symbol touches role first_seen last_tested",
                price=4, strength=6)


@reg.add("c3_round_number_score", f"WITH {bars()} SELECT symbol, ts, {rnd(round_sql('close'), 6)} AS score FROM bars")
def _(spark, sf):
    return week(spark, sf).select("symbol", "ts", r(lv.round_number_score("close"), 6).alias("score"))


DIAG = """rp AS (SELECT * FROM pivots QUALIFY row_number() OVER (PARTITION BY symbol, timeframe, is_high ORDER BY idx DESC) <= 20),
pr AS (SELECT a.symbol, a.timeframe, a.is_high, a.idx AS i1, b.idx AS i2, a.price AS p1, b.price AS p2, a.ts AS t1, b.ts AS t2,
   (b.price - a.price) / (b.idx - a.idx) AS slope FROM rp a JOIN rp b
   ON a.symbol = b.symbol AND a.timeframe = b.timeframe AND a.is_high = b.is_high AND a.idx < b.idx),
tch AS (SELECT pr.*, s.n_bars, (SELECT count(*) FROM pivots p WHERE p.symbol = pr.symbol AND p.is_high = pr.is_high
   AND abs(p.price - (pr.p1 + pr.slope * (p.idx - pr.i1))) <= 0.3 * s.avg_atr) AS touches
   FROM pr JOIN stats s USING (symbol, timeframe)),
diag AS MATERIALIZED (SELECT symbol, timeframe, CASE WHEN is_high THEN 'resistance' ELSE 'support' END AS role, i1, i2,
   p1 + slope * (i2 - i1) AS price, slope, touches, greatest(0.0, least(0.6 * least(touches / 5.0, 1.0) + 0.4 * (i2 / (n_bars - 1)), 1.0)) AS strength,
   t1 AS first_seen, t2 AS last_tested FROM tch WHERE touches >= 2)"""


@reg.add("c4_diagonal_lines", f"""WITH {bars()}, {ATR}, {PIVOTS}, {STATS}, {DIAG}
SELECT symbol, role, i1, i2 AS anchor_idx, {rnd('price')} AS price, {rnd('slope')} AS slope, touches,
{rnd('strength', 6)} AS strength FROM diag""")
def _(spark, sf):
    _, _, points, stats = parts(spark, sf)
    return pick(lv.diagonal_lines(points, stats, CFG.diagonal), "symbol role i1 anchor_idx touches",
                price=4, slope=4, strength=6)


def walk(source: str, order: str, clash: str, fields: str, name: str) -> str:
    """Greedy keep-first walk as a recursive query; ``clash`` compares kept ``k`` with ``x``."""
    return f"""{name}_o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {order}) AS rn FROM {source}),
{name}_w AS (SELECT symbol, rn, [{fields}] AS kept, true AS keep FROM {name}_o x WHERE rn = 1
  UNION ALL
  SELECT x.symbol, x.rn, CASE WHEN len(list_filter(w.kept, lambda k: {clash})) = 0 THEN list_append(w.kept, {fields}) ELSE w.kept END,
         len(list_filter(w.kept, lambda k: {clash})) = 0
  FROM {name}_w w JOIN {name}_o x ON x.symbol = w.symbol AND x.rn = w.rn + 1),
{name} AS MATERIALIZED (SELECT o.* FROM {name}_o o JOIN {name}_w w ON o.symbol = w.symbol AND o.rn = w.rn WHERE w.keep)"""


DIAG_KEPT = """dsrc AS (SELECT d.*, 0.5 * avg_atr AS near FROM diag d JOIN stats USING (symbol, timeframe)),
""" + walk(
    "dsrc", "strength DESC, role, i1, i2",
    "k.role = x.role AND abs(k.slope - x.slope) < 0.05 AND abs(k.price - x.price) < x.near",
    "{'role': x.role, 'slope': x.slope, 'price': x.price}", "dkept")


@reg.add("c5_diagonal_dedupe", f"""WITH RECURSIVE {bars()}, {ATR}, {PIVOTS}, {STATS}, {DIAG}, {DIAG_KEPT}
SELECT symbol, role, {rnd('price')} AS price, {rnd('slope')} AS slope, touches, {rnd('strength', 6)} AS strength FROM dkept""")
def _(spark, sf):
    _, _, points, stats = parts(spark, sf)
    out = lv.dedupe_diagonals(lv.diagonal_lines(points, stats, CFG.diagonal), stats, CFG.diagonal)
    return pick(out, "symbol role touches", price=4, slope=4, strength=6)


MERGED = """msrc AS (SELECT u.*, 0.3 * avg_atr AS near FROM (
  SELECT symbol, timeframe, price, touches, role, strength, first_seen, last_tested, 0 AS second FROM lines
  UNION ALL SELECT symbol, timeframe, price, touches, role, strength, first_seen, last_tested, 1 FROM horiz) u
  JOIN stats USING (symbol, timeframe)),
""" + walk("msrc", "second, strength DESC, price", "x.second = 1 AND abs(k.price - x.price) <= x.near",
           "{'price': x.price}", "merged")


@reg.add("c6_merge_levels", f"""WITH RECURSIVE {bars()}, {ATR}, {PIVOTS}, {PINS}, {STATS}, {LINES}, {HORIZ}, {MERGED}
SELECT symbol, {rnd('price')} AS price, touches, role, {rnd('strength', 6)} AS strength FROM merged""")
def _(spark, sf):
    _, pins, points, stats = parts(spark, sf)
    out = lv.merge_levels(lv.pin_bar_lines(pins, stats, CFG),
                          lv.horizontal_levels(points, stats, CFG.horizontal), stats)
    return pick(out, "symbol touches role", price=4, strength=6)


@reg.add("c7_merge_timeframes")
def _(spark, sf):
    f = tables.built(spark, sf, "flagged_multi", lambda: an.flag_bars(
        week(spark, sf).unionByName(tables.indexed(spark, sf, "day")), CFG, ["symbol", "timeframe"], None))
    stats = lv.series_stats(f)
    per_tf = an.own_levels(an._pins(f), an._pivots(f, CFG, ["symbol", "timeframe"]), stats, CFG)
    near = stats.filter(F.col("timeframe") == "1d").select("symbol", (F.col("avg_atr") * 0.5).alias("_near"))
    out = lv.merge_timeframes(per_tf.withColumn("source_tf", F.col("timeframe")), near)
    return pick(out, "symbol pos source_tf role touches", price=4, strength=6)


LEVELS = f"""{PIVOTS}, {PINS}, {STATS}, {LINES}, {HORIZ}, {MERGED}, {DIAG}, {DIAG_KEPT},
mtop AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY strength DESC, rn) AS pos FROM merged QUALIFY pos <= 10),
dtop AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY strength DESC, rn) AS pos FROM dkept QUALIFY pos <= 3),
csrc AS (SELECT m.* EXCLUDE (rn, near), (max_high + min_low) / 2 * 0.0015 AS near FROM mtop m JOIN stats s USING (symbol, timeframe)
  WHERE price BETWEEN min_low - (max_high - min_low) * 0.1 AND max_high + (max_high - min_low) * 0.1),
{walk("csrc", "touches DESC, pos", "abs(k.price - x.price) <= x.near", "{'price': x.price}", "flat")},
levels AS MATERIALIZED (SELECT symbol, timeframe, 'horizontal' AS sr_type, role, price, CAST(0.0 AS DOUBLE) AS slope, 0 AS anchor_idx, strength, touches, rn AS pos FROM flat
  UNION ALL SELECT d.symbol, d.timeframe, 'diagonal', role, price, slope, i2, strength, touches, pos + 1000000 FROM dtop d JOIN stats s USING (symbol, timeframe)
  WHERE price BETWEEN min_low - (max_high - min_low) * 0.1 AND max_high + (max_high - min_low) * 0.1)"""


@reg.add("c8_clip_levels", f"""WITH {bars()}, {ATR}, {PIVOTS}, {PINS}, {STATS}, {HORIZ}
SELECT symbol, {rnd('price')} AS price, role, touches FROM horiz JOIN stats s USING (symbol, timeframe)
WHERE price BETWEEN min_low - (max_high - min_low) * 0.1 AND max_high + (max_high - min_low) * 0.1""")
def _(spark, sf):
    _, _, points, stats = parts(spark, sf)
    out = lv.clip_to_range(lv.horizontal_levels(points, stats, CFG.horizontal), stats)
    return pick(out, "symbol role touches", price=4)


def weekly_analysis(spark, sf):
    """The weekly analysis, built once per session and folder."""
    lev = tables.built(spark, sf, "levels_week", lambda: an.analyze(week(spark, sf), CFG).levels)
    f, pins, points, stats = parts(spark, sf)
    return an.Analysis(points, lev, lv.match_pins(pins, lev, CFG.pin.proximity),
                       f.filter(F.col("compression").isNotNull()), st.bias(f, points), f)


@reg.add("c9_final_levels", f"""WITH RECURSIVE {bars()}, {ATR}, {LEVELS}
SELECT symbol, sr_type, role, {rnd('price')} AS price, {rnd('slope')} AS slope, {rnd('strength', 6)} AS strength, touches FROM levels""")
def _(spark, sf):
    return pick(an.analyze(week(spark, sf), CFG).levels, "symbol sr_type role touches", price=4, slope=4, strength=6)


MATCH = """mt AS (SELECT p.*, l.price AS lv_price, l.strength AS lv_strength, l.role AS lv_role, l.sr_type AS lv_sr_type, l.pos AS lv_pos,
  l.price + l.slope * (p.idx - l.anchor_idx) AS level_price,
  abs(p.tip - (l.price + l.slope * (p.idx - l.anchor_idx))) / p.close AS sr_distance
  FROM pins p JOIN levels l USING (symbol, timeframe)),
matched AS MATERIALIZED (SELECT * FROM mt WHERE sr_distance <= 0.005
  QUALIFY row_number() OVER (PARTITION BY symbol, timeframe, idx ORDER BY sr_distance, lv_pos) = 1)"""


@reg.add("c10_match_pin_bars", f"""WITH RECURSIVE {bars()}, {ATR}, {LEVELS}, {MATCH}
SELECT symbol, idx, pin_direction, lv_role, {rnd('level_price')} AS level_price, {rnd('sr_distance', 6)} AS sr_distance FROM matched""")
def _(spark, sf):
    return pick(weekly_analysis(spark, sf).pin_bars, "symbol idx pin_direction lv_role", level_price=4, sr_distance=6)


_AT = "(l.price + l.slope * (b.idx - l.anchor_idx))"
LEVFEAT = f"""bl AS MATERIALIZED (SELECT b.symbol, b.idx, b.close, b.atr, l.pos, l.role, l.strength, l.touches, {_AT} AS lp, abs(b.close - {_AT}) / b.close AS dist
  FROM atr b JOIN levels l USING (symbol, timeframe)),
bi AS (SELECT *, (role = 'support' AND close >= lp) OR (role = 'resistance' AND close <= lp) AS hit,
  min(CASE WHEN (role = 'support' AND close >= lp) OR (role = 'resistance' AND close <= lp) THEN dist END)
    OVER (PARTITION BY symbol, idx, role ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM bl),
bf AS (SELECT symbol, idx, min(dist) FILTER (WHERE hit AND role = 'support') AS s, min(dist) FILTER (WHERE hit AND role = 'resistance') AS r,
  arg_max(strength, pos) FILTER (WHERE hit AND (best IS NULL OR dist < best)) AS strength,
  arg_max(touches, pos) FILTER (WHERE hit AND (best IS NULL OR dist < best)) AS touches,
  count(*) FILTER (WHERE abs(close - lp) <= atr AND atr > 0) AS within,
  CAST(count(*) FILTER (WHERE abs(close - lp) <= close * 0.005) > 0 AS INT) AS tfs FROM bi GROUP BY ALL),
levfeat AS MATERIALIZED (SELECT b.symbol, b.timeframe, b.idx, coalesce(s, 0.1) AS dist_nearest_support, coalesce(r, 0.1) AS dist_nearest_resistance,
  coalesce(strength, 0.0) AS nearest_sr_strength, coalesce(touches, 0.0) AS nearest_sr_touches,
  coalesce(within, 0.0) AS levels_within_1atr, coalesce(tfs, 0.0) AS num_tf_confluence FROM atr b LEFT JOIN bf USING (symbol, idx))"""


def _levfeat(spark, sf):
    a = weekly_analysis(spark, sf)
    return lv.level_features(a.flagged, a.levels)


@reg.add("c11_nearest_levels", f"""WITH RECURSIVE {bars()}, {ATR}, {LEVELS}, {LEVFEAT} SELECT symbol, idx,
{rnd('dist_nearest_support', 6)} AS dist_nearest_support, {rnd('dist_nearest_resistance', 6)} AS dist_nearest_resistance,
{rnd('nearest_sr_strength', 6)} AS nearest_sr_strength, nearest_sr_touches FROM levfeat""")
def _(spark, sf):
    return pick(_levfeat(spark, sf), "symbol idx nearest_sr_touches", dist_nearest_support=6,
                dist_nearest_resistance=6, nearest_sr_strength=6)


@reg.add("c12_levels_within_atr", f"""WITH RECURSIVE {bars()}, {ATR}, {LEVELS}, {LEVFEAT}
SELECT symbol, idx, levels_within_1atr FROM levfeat""")
def _(spark, sf):
    return _levfeat(spark, sf).select("symbol", "idx", "levels_within_1atr")


@reg.add("c13_tf_confluence", f"""WITH RECURSIVE {bars()}, {ATR}, {LEVELS}, {LEVFEAT}
SELECT symbol, idx, num_tf_confluence FROM levfeat""")
def _(spark, sf):
    return _levfeat(spark, sf).select("symbol", "idx", "num_tf_confluence")


@reg.add("c14_next_level", f"""WITH RECURSIVE {bars()}, {ATR}, {LEVELS}, {MATCH}
SELECT m.symbol, m.idx, {rnd('''CASE WHEN pin_direction = 'LONG'
  THEN (SELECT min(l.price + l.slope * (m.idx - l.anchor_idx)) FROM levels l WHERE l.symbol = m.symbol AND l.price + l.slope * (m.idx - l.anchor_idx) > m.level_price)
  ELSE (SELECT max(l.price + l.slope * (m.idx - l.anchor_idx)) FROM levels l WHERE l.symbol = m.symbol AND l.price + l.slope * (m.idx - l.anchor_idx) < m.level_price) END''')} AS next_price
FROM matched m""")
def _(spark, sf):
    a = weekly_analysis(spark, sf)
    return pick(lv.next_level(a.pin_bars, a.levels, "level_price"), "symbol idx", next_price=4)


@reg.add("c15_necklines", f"""WITH {bars()}, {PIVOTS},
f1 AS (SELECT symbol, is_high, regr_slope(price, idx) AS a, regr_intercept(price, idx) AS b, avg(price) * 0.03 AS tol FROM pivots GROUP BY ALL HAVING count(*) >= 2),
k1 AS (SELECT p.*, tol FROM pivots p JOIN f1 USING (symbol, is_high)),
f2 AS (SELECT p.symbol, p.is_high, regr_slope(price, idx) AS a2, regr_intercept(price, idx) AS b2, avg(price) AS m FROM pivots p
  JOIN f1 USING (symbol, is_high) WHERE abs(price - (a * idx + b)) <= tol GROUP BY ALL HAVING count(*) >= 2)
SELECT symbol, is_high, {rnd('m', 3)} AS price, {rnd('CASE WHEN abs(a2) < 0.001 * m THEN 0.0 ELSE a2 END', 3)} AS slope, count(*) AS touches
FROM k1 JOIN f2 USING (symbol, is_high)
WHERE abs(price - CASE WHEN abs(a2) < 0.001 * m THEN m ELSE a2 * idx + b2 END) <= tol
GROUP BY symbol, is_high, m, a2 HAVING count(*) >= 2""")
def _(spark, sf):
    _, _, points, _ = parts(spark, sf)
    return pick(lv.necklines(points), "symbol is_high touches", price=3, slope=3)


@reg.add("c16_analyze", f"""WITH RECURSIVE {bars()}, {ATR}, {LEVELS}, {MATCH}, {BIAS}
SELECT s.symbol, s.n_bars, (SELECT count(*) FROM pivots p WHERE p.symbol = s.symbol) AS pivots,
 (SELECT count(*) FROM levels p WHERE p.symbol = s.symbol) AS levels,
 (SELECT count(*) FROM matched p WHERE p.symbol = s.symbol) AS pin_bars,
 (SELECT count(*) FROM (SELECT *, lag(high) OVER (PARTITION BY symbol ORDER BY idx) AS mh, lag(low) OVER (PARTITION BY symbol ORDER BY idx) AS ml FROM bars) i
   WHERE i.symbol = s.symbol AND high <= mh AND low >= ml AND mh <> ml) AS inside_bars, bias
FROM stats s LEFT JOIN bias b USING (symbol)""".replace(", " + BIAS, f", {BIAS}"))
def _(spark, sf):
    a = an.analyze(week(spark, sf), CFG)
    keys = ["symbol", "timeframe"]
    out = lv.series_stats(a.flagged).select(*keys, "n_bars")
    for name in ("pivots", "levels", "pin_bars", "inside_bars"):
        counts = getattr(a, name).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
        out = out.join(counts, keys, "left").fillna(0, [name])
    return out.join(a.bias, keys, "left").drop("timeframe")


@reg.add("c17_analyze_timeframes")
def _(spark, sf):
    both = week(spark, sf).unionByName(tables.indexed(spark, sf, "day"))
    out = an.analyze_timeframes(both, "1d", CFG).levels
    return pick(out, "symbol timeframe source_tf pos role touches", price=4, strength=6)
