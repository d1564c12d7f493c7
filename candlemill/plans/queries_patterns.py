"""Breakouts, chart patterns, targets and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlemill.config import PATTERN_WEIGHTS, PatternConfig
from candlemill.functions import targets as tg
from candlemill.operators import patterns as pt
from candlemill.operators import structure as st
from candlemill.plans.oracle import PIVOTS, W, bars, rnd
from candlemill.plans.queries_bars import SWINGS, VOLPRICE, week
from candlemill.plans.registry import Registry, pick, r
from candlemill.schemas import KEYS
from candlemill.sources import tables

reg = Registry()
CFG = PatternConfig()


def pbars(spark, sf):
    return tables.built(spark, sf, "pattern_bars_week", lambda: pt.pattern_bars(week(spark, sf), CFG))


def points(spark, sf):
    return tables.built(spark, sf, "swings_week", lambda: pt.swings(pbars(spark, sf), CFG))


def patterns(spark, sf, only=None):
    return pt.detect_from(pbars(spark, sf), points(spark, sf), CFG, only, list(KEYS))


CONTEXT = f"""bx AS MATERIALIZED (SELECT *, volume > 1.5 * coalesce(avg(volume) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), volume) AS loud,
  min(close) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS min3, max(close) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS max3 FROM bars)"""


def breakout_sql(source: str, name: str) -> str:
    """First breakout of each row of ``source`` (symbol, pid, lvl, bull, scan)."""
    return f"""{name} AS MATERIALIZED (SELECT c.symbol, c.pid, min(b.idx) AS bidx, arg_min(b.loud, b.idx) AS bloud,
  arg_min(coalesce(CASE WHEN c.bull THEN b.min3 < c.lvl ELSE b.max3 > c.lvl END, false), b.idx) AS bfalse
  FROM {source} c JOIN bx b ON b.symbol = c.symbol AND b.idx >= c.scan AND CASE WHEN c.bull THEN b.close > c.lvl ELSE b.close < c.lvl END
  GROUP BY c.symbol, c.pid)"""


@reg.add("d0_first_breakout", f"""WITH {bars()}, {PIVOTS}, {CONTEXT},
c AS (SELECT symbol, idx * 2 + CAST(is_high AS INT) AS pid, price AS lvl, is_high AS bull, idx + 1 AS scan FROM pivots),
{breakout_sql('c', 'bo')}
SELECT symbol, scan - 1 AS idx, bull AS is_high, bidx AS breakout_idx, bloud AS with_volume, bfalse AS false_breakout FROM c JOIN bo USING (symbol, pid)""")
def _(spark, sf):
    lv = st.pivots(week(spark, sf)).select(
        *KEYS, F.col("idx").alias("pivot_idx"), "is_high", F.col("price").alias("neckline"), (F.col("idx") + 1).alias("scan_from"),
        F.when(F.col("is_high"), "bullish").otherwise("bearish").alias("direction"))
    out = pt.first_breakouts(lv, pbars(spark, sf), ["pivot_idx", "is_high"])
    return out.select("symbol", F.col("pivot_idx").alias("idx"), "is_high", "breakout_idx", F.col("breakout_loud").alias("with_volume"),
                      F.col("breakout_false").alias("false_breakout"))


SEQ = SWINGS + """,
sw AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol, is_high ORDER BY idx) AS seq,
  count(*) OVER (PARTITION BY symbol, is_high) AS n_side,
  lag(idx) OVER g AS pi, lag(price) OVER g AS pp, lag(idx, 2) OVER g AS ppi, lag(price, 2) OVER g AS ppp
  FROM swings WINDOW g AS (PARTITION BY symbol, is_high ORDER BY idx)),
ch AS MATERIALIZED (SELECT s.*,
  CASE WHEN is_high THEN (SELECT min(price) FROM swings o WHERE o.symbol = s.symbol AND NOT o.is_high AND o.idx > s.pi AND o.idx < s.idx)
       ELSE (SELECT max(price) FROM swings o WHERE o.symbol = s.symbol AND o.is_high AND o.idx > s.pi AND o.idx < s.idx) END AS mid,
  CASE WHEN is_high THEN (SELECT min(price) FROM swings o WHERE o.symbol = s.symbol AND NOT o.is_high AND o.idx > s.ppi AND o.idx < s.pi)
       ELSE (SELECT max(price) FROM swings o WHERE o.symbol = s.symbol AND o.is_high AND o.idx > s.ppi AND o.idx < s.pi) END AS pmid,
  (SELECT min(idx) FROM bars b WHERE b.symbol = s.symbol AND b.idx BETWEEN s.idx + 1 AND s.idx + 5
     AND CASE WHEN s.is_high THEN b.close < s.pp ELSE b.close > s.pp END) AS rec,
  (SELECT count(*) FROM bars b WHERE b.symbol = s.symbol AND b.idx BETWEEN s.pi + 1 AND s.pi + 5 AND b.close < s.ppp) AS lost
  FROM sw s)"""

COLS = "symbol, pattern_type, bull, entry, stop, t1, t2, neck, scan, s_idx, e_idx, done"
_HS = "least(0.05, abs(ppp - price) / ((ppp + price) / 2)) = abs(ppp - price) / ((ppp + price) / 2) AND idx - ppi BETWEEN 10 AND 120 AND mid IS NOT NULL AND pmid IS NOT NULL"
_DB = "abs(pp - price) / ((pp + price) / 2) <= 0.03 AND idx - pi BETWEEN 10 AND 120 AND mid IS NOT NULL"
_N2 = "(pmid + mid) / 2"
SHAPES = {
    "w_bottom": f"SELECT symbol, 'w_bottom', true, mid, mid * 0.98, mid + (mid - (pp + price) / 2), mid + (mid - (pp + price) / 2) * 2, mid, idx, pi, idx, NULL FROM ch WHERE NOT is_high AND {_DB}",
    "m_top": f"SELECT symbol, 'm_top', false, mid, mid * 1.02, mid - ((pp + price) / 2 - mid), mid - ((pp + price) / 2 - mid) * 2, mid, idx, pi, idx, NULL FROM ch WHERE is_high AND {_DB}",
    "false_breakdown": "SELECT symbol, 'false_breakdown', true, pp, price * 0.98, pp + (pp - price) * 2, NULL, pp, NULL, pi, rec, rec FROM ch WHERE NOT is_high AND price < pp AND rec IS NOT NULL",
    "false_breakout": "SELECT symbol, 'false_breakout', false, pp, price * 1.02, pp - (price - pp) * 2, NULL, pp, NULL, pi, rec, rec FROM ch WHERE is_high AND price > pp AND rec IS NOT NULL",
    "false_breakdown_w_bottom": "SELECT symbol, 'false_breakdown_w_bottom', true, pp, price * 0.98, mid + (mid - price), mid + (mid - price) * 2, mid, rec, pi, idx, NULL FROM ch WHERE NOT is_high AND price < pp AND rec IS NOT NULL AND mid IS NOT NULL AND idx - pi BETWEEN 10 AND 120",
    "false_breakout_hs": f"SELECT symbol, 'false_breakout_hs', false, {_N2}, {_N2} * 1.02, {_N2} - abs({_N2} - pp), {_N2} - abs({_N2} - pp) * 2, {_N2}, idx, ppi, idx, NULL FROM ch WHERE is_high AND pp > ppp AND pp > price AND {_HS} AND lost > 0",
    "hs_bottom": f"SELECT symbol, 'hs_bottom', true, {_N2}, {_N2} * 0.98, {_N2} + abs({_N2} - pp), {_N2} + abs({_N2} - pp) * 2, {_N2}, idx, ppi, idx, NULL FROM ch WHERE NOT is_high AND pp < ppp AND pp < price AND {_HS}",
    "hs_top": f"SELECT symbol, 'hs_top', false, {_N2}, {_N2} * 1.02, {_N2} - abs({_N2} - pp), {_N2} - abs({_N2} - pp) * 2, {_N2}, idx, ppi, idx, NULL FROM ch WHERE is_high AND pp > ppp AND pp > price AND {_HS}",
}


def _flag(bull: bool) -> str:
    """Poles times every possible flag end; monotone when no bar after the first breaks."""
    kind = "bull_flag" if bull else "bear_flag"
    hi, cmp, sign = ("NOT s.is_high", "<=", 1) if bull else ("s.is_high", ">=", -1)
    opp = "o.is_high" if bull else "NOT o.is_high"
    turn, edge, pad = ("f.low", "f.high", 0.98) if bull else ("f.high", "f.low", 1.02)
    gap = f"({sign} * (p.end_price - {turn}))"
    return f"""{kind}_p AS MATERIALIZED (SELECT * FROM (SELECT s.symbol, s.idx AS pole_idx, s.price AS pole_price,
   (SELECT min(o.idx) FROM swings o WHERE o.symbol = s.symbol AND {opp} AND o.idx > s.idx) AS end_idx,
   (SELECT arg_min(o.price, o.idx) FROM swings o WHERE o.symbol = s.symbol AND {opp} AND o.idx > s.idx) AS end_price
   FROM sw s WHERE {hi} AND s.seq < s.n_side) WHERE {sign} * (end_price - pole_price) > 0),
{kind}_b AS MATERIALIZED (SELECT *, coalesce(NOT (high {cmp} lag(high) OVER ({W}) AND low {cmp} lag(low) OVER ({W})), true) AS brk FROM bars),
{kind}_c AS MATERIALIZED (SELECT * FROM (SELECT p.symbol, p.pole_idx, p.pole_price, p.end_idx, p.end_price, f.idx AS j, f.high, f.low,
   (SELECT count(*) FROM {kind}_b x WHERE x.symbol = p.symbol AND x.idx > p.end_idx + 1 AND x.idx <= f.idx AND x.brk) AS nb
   FROM {kind}_p p JOIN {kind}_b f ON f.symbol = p.symbol AND f.idx BETWEEN p.end_idx + 3 AND p.end_idx + 30 AND NOT f.brk
   WHERE {gap} / abs(p.end_price - p.pole_price) BETWEEN 0.30 AND 0.60) WHERE nb = 0
   QUALIFY row_number() OVER (PARTITION BY symbol, pole_idx ORDER BY j) = 1)""", (
        f"SELECT symbol, '{kind}', {str(bull).lower()}, end_price, {turn[2:]} * {pad}, {turn[2:]} + {sign} * abs(end_price - pole_price), NULL, {edge[2:]}, j, pole_idx, j, NULL FROM {kind}_c")


_BULL_CTE, _BULL = _flag(True)
_BEAR_CTE, _BEAR = _flag(False)
SHAPES["bull_flag"], SHAPES["bear_flag"] = _BULL, _BEAR
TRI = """tri0 AS (SELECT c.symbol, c.pi AS i1, c.pp AS h1, c.idx AS i2, c.price AS h2, count(*) AS n, min(l.idx) AS j1, max(l.idx) AS j2,
  arg_min(l.price, l.idx) AS l1, arg_max(l.price, l.idx) AS l2 FROM ch c JOIN swings l ON l.symbol = c.symbol AND NOT l.is_high AND l.idx BETWEEN c.pi AND c.idx + 5
  WHERE c.is_high AND c.price < c.pp GROUP BY ALL),
tri1 AS (SELECT *, (h2 - h1) / (i2 - i1) AS up, (l2 - l1) / (j2 - j1) AS dn FROM tri0 WHERE n >= 2 AND l2 > l1 AND greatest(i2, j2) - i1 BETWEEN 10 AND 120),
tri2 AS (SELECT *, (h1 - l1 + dn * j1 - up * i1) / (dn - up) - i1 AS len FROM tri1),
tri3 AS (SELECT *, CAST(trunc(i1 + len * 0.5) AS BIGINT) AS zone, (CAST(trunc(i1 + len * 0.5) AS BIGINT) + CAST(trunc(i1 + len * 0.75) AS BIGINT)) // 2 AS md,
  greatest(h1, h2) AS th, least(l1, l2) AS tl FROM tri2 WHERE len > 0),
tri AS MATERIALIZED (SELECT *, h1 + up * (md - i1) AS hi, l1 + dn * (md - j1) AS lo FROM tri3)"""
SHAPES["sym_triangle_bottom"] = "SELECT symbol, 'sym_triangle_bottom', true, hi, hi * 0.98, hi + (th - tl), NULL, hi, zone, i1, greatest(i2, j2), NULL FROM tri"
SHAPES["sym_triangle_top"] = "SELECT symbol, 'sym_triangle_top', false, lo, lo * 1.02, lo - (th - tl), NULL, lo, zone, i1, greatest(i2, j2), NULL FROM tri"

_TRI_NAMES = ("sym_triangle_bottom", "sym_triangle_top")


def detect_sql(names=pt.DETECTORS) -> str:
    """CTEs ending in ``pat``: scored patterns of the named detectors."""
    pre = ""
    if "bull_flag" in names:
        pre += _BULL_CTE + ",\n"
    if "bear_flag" in names:
        pre += _BEAR_CTE + ",\n"
    if set(names) & set(_TRI_NAMES):
        pre += TRI + ",\n"
    weights = " ".join(f"WHEN '{k}' THEN {v}" for k, v in PATTERN_WEIGHTS.items())
    order = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(pt.DETECTORS))
    return f"""{SEQ}, {CONTEXT}, {VOLPRICE}, {pre}cand0({COLS}) AS ({' UNION ALL '.join(SHAPES[n] for n in names)}),
cand AS MATERIALIZED (SELECT *, row_number() OVER () AS pid FROM cand0),
scan AS (SELECT symbol, pid, neck AS lvl, bull, scan FROM cand WHERE scan IS NOT NULL),
{breakout_sql('scan', 'bo')},
pat0 AS (SELECT c.*, coalesce(c.done, bidx) AS breakout_idx, CASE WHEN c.done IS NOT NULL OR (bidx IS NOT NULL AND NOT bfalse) THEN 'confirmed' ELSE 'forming' END AS status,
  coalesce(CASE WHEN c.done IS NOT NULL THEN (SELECT loud FROM bx WHERE bx.symbol = c.symbol AND bx.idx = c.done) ELSE bloud END, false) AS volume_confirmed,
  coalesce(abs(stop - entry) / nullif(abs(entry), 0), 0.0) AS risk_pct, coalesce(abs(t1 - entry) / nullif(abs(entry), 0), 0.0) AS reward_pct
  FROM cand c LEFT JOIN bo USING (symbol, pid)),
pat1 AS (SELECT *, coalesce(reward_pct / nullif(risk_pct, 0), 0.0) AS rr_ratio FROM pat0),
pat AS MATERIALIZED (SELECT p.*, CASE pattern_type {order} END AS detector, round(least(0.35 * CASE pattern_type {weights} ELSE 0.5 END + CASE WHEN volume_confirmed THEN 0.20 ELSE 0.0 END
  + CASE WHEN NOT vp_divergence THEN 0.05 ELSE 0.0 END + CASE WHEN neck > 0 THEN 0.15 ELSE 0.075 END
  + CASE WHEN rr_ratio >= 3 THEN 0.15 WHEN rr_ratio >= 2 THEN 0.10 WHEN rr_ratio >= 1.5 THEN 0.05 ELSE 0.0 END
  + CASE WHEN status = 'confirmed' THEN 0.10 ELSE 0.0 END, 1.0), 4) AS confidence
  FROM pat1 p JOIN vp ON vp.symbol = p.symbol AND vp.idx = vp.n_bars - 1)"""


_OUT = f"""SELECT symbol, pattern_type, CASE WHEN bull THEN 'bullish' ELSE 'bearish' END AS direction, status, {rnd('entry')} AS entry,
{rnd('stop')} AS stop, {rnd('t1')} AS target1, {rnd('t2')} AS target2, {rnd('neck')} AS neckline, s_idx AS start_idx, e_idx AS end_idx, breakout_idx,
volume_confirmed, {rnd('confidence', 4)} AS confidence FROM pat"""


def _show(df):
    return pick(df, "symbol pattern_type direction status start_idx end_idx breakout_idx volume_confirmed",
                entry=4, stop=4, target1=4, target2=4, neckline=4, confidence=4)


for _i, _name in enumerate(("w_bottom", "m_top", "false_breakdown", "false_breakout", "false_breakdown_w_bottom",
                            "false_breakout_hs", "bull_flag", "bear_flag", "hs_bottom", "hs_top",
                            "sym_triangle_bottom", "sym_triangle_top"), 1):
    reg.add(f"d{_i}_{_name}", f"WITH {bars()}, {detect_sql((_name,))} {_OUT}")(
        lambda spark, sf, n=_name: _show(patterns(spark, sf, [n])))


def _targets(spark, sf, plan):
    """Target formulas evaluated on every bar."""
    df = week(spark, sf).withColumns(plan).withColumns(tg.reward_risk())
    return pick(df, "symbol ts", entry=4, stop=4, target1=4, target2=4, rr_ratio=6)


def _targets_sql(entry: str, stop: str, t1: str, t2: str) -> str:
    return f"""WITH {bars()}, t AS (SELECT symbol, ts, {entry} AS entry, {stop} AS stop, {t1} AS target1, CAST({t2} AS DOUBLE) AS target2 FROM bars)
SELECT symbol, ts, {rnd('entry')} AS entry, {rnd('stop')} AS stop, {rnd('target1')} AS target1, {rnd('target2')} AS target2,
{rnd("coalesce((abs(target1 - entry) / nullif(abs(entry), 0)) / nullif(abs(stop - entry) / nullif(abs(entry), 0), 0), 0.0)", 6)} AS rr_ratio FROM t"""


_c = F.col
_PLANS = {
    "d13_double_bottom_target": (lambda: tg.double_bottom(_c("high"), _c("low"), _c("close")),
        ("high", "high * 0.98", "high + (high - (low + close) / 2)", "high + (high - (low + close) / 2) * 2")),
    "d13_double_top_target": (lambda: tg.double_top(_c("low"), _c("high"), _c("close")),
        ("low", "low * 1.02", "low - ((high + close) / 2 - low)", "low - ((high + close) / 2 - low) * 2")),
    "d14_head_shoulders_target": (lambda: tg.head_shoulders(_c("close"), _c("low"), True),
        ("close", "close * 0.98", "close + abs(close - low)", "close + abs(close - low) * 2")),
    "d15_flag_target": (lambda: tg.flag(_c("low"), _c("high"), _c("close"), True),
        ("high", "close * 0.98", "close + abs(high - low)", "NULL")),
    "d16_triangle_target": (lambda: tg.triangle(_c("high"), _c("low"), _c("close"), False),
        ("close", "close * 1.02", "close - (high - low)", "NULL")),
    "d17_false_breakdown_target": (lambda: tg.false_breakdown(_c("close"), _c("low"), _c("high")),
        ("close", "low * 0.98", "high + (high - low)", "high + (high - low) * 2")),
    "d17_false_breakout_target": (lambda: tg.false_breakout(_c("close"), _c("high")),
        ("close", "high * 1.02", "close - (high - close) * 2", "NULL")),
}
for _name, (_plan, _sql) in _PLANS.items():
    reg.add(_name, _targets_sql(*_sql))(lambda spark, sf, p=_plan: _targets(spark, sf, p()))


def all_patterns(spark, sf):
    """Every weekly pattern, built once."""
    return tables.built(spark, sf, "patterns_week", lambda: patterns(spark, sf))


ALL = f"WITH {bars()}, {detect_sql()}"


@reg.add("d18_pattern_score", f"{ALL} SELECT symbol, pattern_type, s_idx AS start_idx, e_idx AS end_idx, {rnd('risk_pct', 6)} AS risk_pct, {rnd('reward_pct', 6)} AS reward_pct, {rnd('rr_ratio', 5)} AS rr_ratio, {rnd('confidence', 4)} AS confidence FROM pat")
def _(spark, sf):
    return pick(all_patterns(spark, sf), "symbol pattern_type start_idx end_idx", risk_pct=6, reward_pct=6, rr_ratio=5, confidence=4)


@reg.add("d19_detect_patterns", f"{ALL} {_OUT}")
def _(spark, sf):
    return _show(pt.detect(week(spark, sf), CFG))


LAST = "last_bar AS MATERIALIZED (SELECT symbol, close, idx AS last_idx FROM bars WHERE idx = n_bars - 1)"
ACTION = f"""{LAST},
act0 AS (SELECT p.*, close, last_idx, CASE WHEN entry > 0 THEN entry ELSE neck END AS ref FROM pat p JOIN last_bar USING (symbol)
  WHERE CASE WHEN bull THEN close >= stop AND close < t1 ELSE close <= stop AND close > t1 END),
act AS MATERIALIZED (SELECT *, CASE WHEN status = 'forming' THEN 2.0 - abs(close - ref) / ref
  ELSE (1.0 - (last_idx - breakout_idx) / 10) * 0.6 + (1.0 - least(abs(close - entry) / entry, 1.0)) * 0.4 END AS priority FROM act0
  WHERE CASE WHEN status = 'forming' THEN ref > 0 AND abs(close - ref) / ref <= 0.05 AND CASE WHEN bull THEN close <= ref ELSE close >= ref END
        ELSE last_idx - breakout_idx <= 10 AND abs(close - entry) / entry <= 0.05 END)"""


def last_bars(df):
    return df.filter(F.col("idx") == F.col("n_bars") - 1).select(*KEYS, "close", F.col("idx").alias("last_idx"))


@reg.add("d20_actionable", f"{ALL}, {ACTION} SELECT symbol, pattern_type, status, s_idx AS start_idx, {rnd('priority', 6)} AS priority FROM act")
def _(spark, sf):
    out = pt.actionable(all_patterns(spark, sf), last_bars(week(spark, sf)))
    return pick(out, "symbol pattern_type status start_idx", priority=6)


@reg.add("d20_actionable_wide", f"{ALL}, {ACTION.replace('0.05', '0.6').replace('<= 10', '<= 80').replace('/ 10)', '/ 80)')} SELECT symbol, pattern_type, status, s_idx AS start_idx, {rnd('priority', 6)} AS priority FROM act")
def _(spark, sf):
    out = pt.actionable(all_patterns(spark, sf), last_bars(week(spark, sf)), max_bars=80, near=0.6)
    return pick(out, "symbol pattern_type status start_idx", priority=6)


@reg.add("d21_best_pattern", f"{ALL} SELECT symbol, pattern_type, s_idx AS start_idx, {rnd('confidence', 4)} AS confidence FROM pat QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY confidence DESC, detector, s_idx, e_idx) = 1")
def _(spark, sf):
    return pick(pt.best_pattern(all_patterns(spark, sf)), "symbol pattern_type start_idx", confidence=4)
