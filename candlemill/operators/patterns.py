"""Chart patterns over consecutive swing points, their breakouts and scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from candlemill.config import PatternConfig
from candlemill.functions import targets as tg
from candlemill.functions.blocks import Stage, blocked, running
from candlemill.functions.search import SEARCH_BLOCK, first_hit
from candlemill.operators import indicators as ind
from candlemill.operators.structure import extreme_flags
from candlemill.schemas import KEYS
from candlemill.session import materialize

SWING_BLOCK = 2048  # places of swings that are counted together
# Registration order; ties in score keep it.
DETECTORS = (
    "w_bottom", "m_top", "false_breakdown", "false_breakout", "false_breakdown_w_bottom",
    "false_breakout_hs", "bull_flag", "bear_flag", "hs_bottom", "hs_top", "sym_triangle_bottom",
    "sym_triangle_top",
)

def breakout_context(cfg: PatternConfig = PatternConfig()) -> list[Stage]:
    """Per bar: ``loud`` (volume breakout) and the closes just after it."""

    def volume(df: DataFrame, w: WindowSpec) -> DataFrame:
        mean = F.avg("volume").over(w.rowsBetween(-cfg.volume_window, -1))
        mean = F.coalesce(mean, F.col("volume"))
        return df.withColumn("loud", (mean > 0) & (F.col("volume") > cfg.volume_mult * mean))

    def after(df: DataFrame, w: WindowSpec) -> DataFrame:
        three, five = w.rowsBetween(1, 3), w.rowsBetween(1, cfg.recovery_bars)
        return df.withColumns({
            "min3": F.min("close").over(three), "max3": F.max("close").over(three),
            "next5": F.collect_list(F.struct("close", "loud")).over(five),
        })

    return [Stage(cfg.volume_window, 0, volume), Stage(0, cfg.recovery_bars, after)]


def pattern_bars(
    bars: DataFrame, cfg: PatternConfig = PatternConfig(), keys: Sequence[str] = KEYS,
    block: int | None = None,
) -> DataFrame:
    """Bars with everything the detectors read, from one shuffle."""
    stages = [extreme_flags(cfg.swing_lookback), *breakout_context(cfg),
              ind.volume_price(cfg.volume_window)]
    return blocked(bars.filter(F.col("n_bars") >= cfg.min_bars), keys, stages, block=block)


def swings(
    pbars: DataFrame, cfg: PatternConfig = PatternConfig(), keys: Sequence[str] = KEYS,
    min_right: int = 2, block: int | None = None,
) -> DataFrame:
    """Swing points with ``seq`` (position on their side) and ``opp`` (opposite ones before)."""
    keys = list(keys)
    seen = (F.col("idx") >= cfg.swing_lookback) & (F.col("idx") < F.col("n_bars") - min_right)
    sides = F.array_compact(F.array(
        F.when(F.col("_peak"), F.struct(F.lit(True).alias("is_high"), F.col("high").alias("price"))),
        F.when(F.col("_trough"), F.struct(F.lit(False).alias("is_high"), F.col("low").alias("price"))),
    ))
    points = pbars.filter(seen & (F.col("_peak") | F.col("_trough"))).select(
        *keys, "idx", "next5", (F.col("_peak") & F.col("_trough")).alias("both"), F.inline(sides)
    ).withColumn("_ord", F.col("idx") * 2 + F.col("is_high").cast("int"))
    span = None if block is None else block * 2
    points = running(
        points, keys, {"_h": ("count", F.col("is_high")), "_l": ("count", ~F.col("is_high"))},
        order="_ord", block=span or SWING_BLOCK, inclusive=False,
    )
    own = F.when(F.col("is_high"), F.col("_h")).otherwise(F.col("_l"))
    other = F.when(F.col("is_high"), F.col("_l") - F.col("both").cast("int")).otherwise(F.col("_h"))
    return points.withColumns({"seq": own, "opp": other}).drop("_ord", "_h", "_l")


def chains(
    points: DataFrame, keys: Sequence[str] = KEYS, block: int | None = None
) -> DataFrame:
    """Each swing with the two before it on its side and the extremes between them.

    ``p_``/``pp_`` are the previous and the one before; ``mid`` is the extreme opposite swing
    strictly between previous and current, ``p_mid`` between the two earlier ones.
    """
    keys = list(keys)
    side = [*keys, "is_high"]
    # An opposite swing belongs to the gap after the last own swing before it.
    between = (
        points.filter(~F.col("both") & (F.col("opp") > 0))
        .groupBy(*keys, (~F.col("is_high")).alias("is_high"), F.col("opp").alias("seq"))
        .agg(F.max("price").alias("_max"), F.min("price").alias("_min"))
    )
    linked = points.join(between, [*side, "seq"], "left").withColumn(
        "mid", F.when(F.col("is_high"), F.col("_min")).otherwise(F.col("_max"))
    ).drop("_max", "_min")

    def lags(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumns({
            "p_idx": F.lag("idx").over(w), "p_price": F.lag("price").over(w),
            "p_next5": F.lag("next5").over(w), "p_mid": F.lag("mid").over(w),
            "pp_idx": F.lag("idx", 2).over(w), "pp_price": F.lag("price", 2).over(w),
        })

    return blocked(linked, side, [Stage(2, 0, lags)], block=block, idx="seq")


def _near(a: Column, b: Column, tol: float) -> Column:
    mean = (a + b) / 2
    return F.coalesce(F.try_divide(F.abs(a - b), mean) <= tol, F.lit(False))


def _span(a: Column, b: Column, cfg: PatternConfig) -> Column:
    return (b - a).between(cfg.min_bars, cfg.max_bars)


def _candidate(
    kind: str, bullish: bool, plan: dict[str, Column], *, level: Column, start: Column | None,
    begin: Column, end: Column, points: dict[str, Column], done: Column | None = None,
    done_loud: Column | None = None,
) -> Column:
    """A candidate struct; ``start=None`` means the breakout is already known (``done``)."""
    none = F.lit(None).cast("bigint")
    named = [x for name, col in points.items() for x in (F.lit(name), col.cast("double"))]
    return F.struct(
        F.lit(kind).alias("pattern_type"), F.lit(DETECTORS.index(kind)).alias("detector"),
        F.lit("bullish" if bullish else "bearish").alias("direction"),
        *[c.alias(n) for n, c in plan.items()],
        level.alias("neckline"), (none if start is None else start.cast("bigint")).alias("scan_from"),
        begin.alias("start_idx"), end.cast("bigint").alias("end_idx"), F.create_map(*named).alias("key_points"),
        (none if done is None else done.cast("bigint")).alias("done_idx"),
        (F.lit(None).cast("boolean") if done_loud is None else done_loud).alias("done_loud"),
    )


def _first_after(next5: Column, test: Callable[[Column], Column]) -> Column:
    """1-based offset of the first following close that passes ``test``; 0 when none does."""
    return F.array_position(F.transform(next5, lambda b: test(b["close"])), True)


def _chain_candidates(chain: DataFrame, cfg: PatternConfig, keys: list[str], names: set[str]) -> DataFrame:
    """All detectors that read consecutive swings of one side, in one pass over the chains."""
    c = {n: F.col(n) for n in ("idx", "price", "mid", "p_idx", "p_price", "p_mid", "pp_idx",
                               "pp_price", "next5", "p_next5")}
    high, low = F.col("is_high"), ~F.col("is_high")
    pad = cfg.stop_buffer
    pair = c["p_idx"].isNotNull()
    double = (pair & _near(c["p_price"], c["price"], cfg.neckline_tol)
              & _span(c["p_idx"], c["idx"], cfg) & c["mid"].isNotNull())
    back = _first_after(c["next5"], lambda x: x > c["p_price"])
    down = _first_after(c["next5"], lambda x: x < c["p_price"])
    triple = (c["pp_idx"].isNotNull() & _near(c["pp_price"], c["price"], cfg.shoulder_tol)
              & _span(c["pp_idx"], c["idx"], cfg) & c["mid"].isNotNull() & c["p_mid"].isNotNull())
    top_head = (c["p_price"] > c["pp_price"]) & (c["p_price"] > c["price"])
    low_head = (c["p_price"] < c["pp_price"]) & (c["p_price"] < c["price"])
    neck2 = (c["p_mid"] + c["mid"]) / 2
    shoulders = {"left_shoulder": c["pp_price"], "head": c["p_price"],
                 "right_shoulder": c["price"], "neckline": neck2}
    head_lost = _first_after(c["p_next5"], lambda x: x < c["pp_price"]) > 0
    found: list[tuple[str, Column, Column]] = [
        ("w_bottom", low & double, _candidate(
            "w_bottom", True, tg.double_bottom(c["mid"], c["p_price"], c["price"], pad),
            level=c["mid"], start=c["idx"], begin=c["p_idx"], end=c["idx"],
            points={"left_bottom": c["p_price"], "right_bottom": c["price"], "neckline": c["mid"]})),
        ("m_top", high & double, _candidate(
            "m_top", False, tg.double_top(c["mid"], c["p_price"], c["price"], pad),
            level=c["mid"], start=c["idx"], begin=c["p_idx"], end=c["idx"],
            points={"left_top": c["p_price"], "right_top": c["price"], "neckline": c["mid"]})),
        ("false_breakdown", low & pair & (c["price"] < c["p_price"]) & (back > 0), _candidate(
            "false_breakdown", True, tg.false_breakdown(c["p_price"], c["price"], None, pad),
            level=c["p_price"], start=None, begin=c["p_idx"], end=c["idx"] + back,
            points={"prior_low": c["p_price"], "false_low": c["price"], "recovery_bar": c["idx"] + back},
            done=c["idx"] + back, done_loud=F.get(c["next5"], (back - 1).cast("int"))["loud"])),
        ("false_breakout", high & pair & (c["price"] > c["p_price"]) & (down > 0), _candidate(
            "false_breakout", False, tg.false_breakout(c["p_price"], c["price"], None, pad),
            level=c["p_price"], start=None, begin=c["p_idx"], end=c["idx"] + down,
            points={"prior_high": c["p_price"], "false_high": c["price"], "rejection_bar": c["idx"] + down},
            done=c["idx"] + down, done_loud=F.get(c["next5"], (down - 1).cast("int"))["loud"])),
        ("false_breakdown_w_bottom",
         low & pair & (c["price"] < c["p_price"]) & _span(c["p_idx"], c["idx"], cfg) & (back > 0)
         & c["mid"].isNotNull(),
         _candidate(
            "false_breakdown_w_bottom", True,
            tg.false_breakdown(c["p_price"], c["price"], c["mid"], pad),
            level=c["mid"], start=c["idx"] + back, begin=c["p_idx"], end=c["idx"],
            points={"first_bottom": c["p_price"], "false_low": c["price"], "neckline": c["mid"],
                    "recovery_bar": c["idx"] + back})),
        ("false_breakout_hs", high & triple & top_head & head_lost, _candidate(
            "false_breakout_hs", False, tg.head_shoulders(neck2, c["p_price"], False, pad),
            level=neck2, start=c["idx"], begin=c["pp_idx"], end=c["idx"], points=shoulders)),
        ("hs_bottom", low & triple & low_head, _candidate(
            "hs_bottom", True, tg.head_shoulders(neck2, c["p_price"], True, pad),
            level=neck2, start=c["idx"], begin=c["pp_idx"], end=c["idx"], points=shoulders)),
        ("hs_top", high & triple & top_head, _candidate(
            "hs_top", False, tg.head_shoulders(neck2, c["p_price"], False, pad),
            level=neck2, start=c["idx"], begin=c["pp_idx"], end=c["idx"], points=shoulders)),
    ]
    rows = [F.when(test, row) for name, test, row in found if name in names]
    return chain.select(*keys, F.inline(F.array_compact(F.array(*rows))))


def _flag_candidates(
    pbars: DataFrame, points: DataFrame, cfg: PatternConfig, keys: list[str], bullish: bool,
    block: int | None,
) -> DataFrame:
    """Poles followed by a monotone pullback that retraces 30 to 60 percent."""
    kind = "bull_flag" if bullish else "bear_flag"
    begin_high = not bullish  # a bear pole starts at a swing high
    start = points.filter(F.col("is_high") == begin_high)
    sizes = start.groupBy(*keys).agg((F.max("seq")).alias("_last"))
    opposite = points.filter(F.col("is_high") != begin_high).select(
        *keys, F.col("seq").alias("_next"), F.col("idx").alias("end_idx"), F.col("price").alias("end_price")
    )
    height = F.abs(F.col("end_price") - F.col("price"))
    rising = F.col("end_price") > F.col("price") if bullish else F.col("end_price") < F.col("price")
    poles = (
        start.join(sizes, keys).filter(F.col("seq") < F.col("_last"))
        # first opposite swing strictly after this one
        .withColumn("_next", F.col("opp") + F.col("both").cast("int"))
        .join(opposite, keys + ["_next"]).filter(rising)
        .select(*keys, F.col("idx").alias("pole_idx"), F.col("price").alias("pole_price"),
                "end_idx", "end_price", (F.col("end_idx") + 1).alias("_s"), height.alias("_height"))
    )
    reach = cfg.flag_bars - 1

    def runs(df: DataFrame, w: WindowSpec) -> DataFrame:
        ph, pl = F.lag("high").over(w), F.lag("low").over(w)
        on = ((F.col("high") <= ph) & (F.col("low") <= pl) if bullish
              else (F.col("high") >= ph) & (F.col("low") >= pl))
        df = df.withColumn("_on", F.coalesce(on, F.lit(False)))
        broke = F.max(F.when(~F.col("_on"), F.col("idx"))).over(w.rowsBetween(-reach, 0))
        return df.withColumns({"_prev_on": F.lag("_on").over(w), "_broke": broke})

    run = blocked(pbars.select(*keys, "idx", "high", "low"), keys, [Stage(reach + 1, 0, runs)], block)
    first = F.greatest(F.coalesce(F.col("_broke"), F.col("idx") - reach), F.col("idx") - reach, F.lit(0))
    ends = (
        run.filter(F.col("_on") & F.col("_prev_on") & (first <= F.col("idx") - 2))
        .select(*keys, F.col("idx").alias("flag_end"), "high", "low",
                F.explode(F.sequence(first, F.col("idx") - 2)).alias("_s"))
    )
    turn = F.col("low") if bullish else F.col("high")
    share = F.try_divide(F.abs(F.col("end_price") - turn), F.col("_height"))
    inner = (F.col("end_price") - turn if bullish else turn - F.col("end_price")) >= 0
    flags = (
        ends.join(poles, keys + ["_s"]).filter(inner & share.between(0.30, 0.60))
        .groupBy(*keys, "pole_idx")
        .agg(F.min_by(F.struct("pole_price", "end_price", "_s", "flag_end", "high", "low"),
                      "flag_end").alias("f"))
        .select(*keys, "pole_idx", "f.*")
    )
    level = F.col("high") if bullish else F.col("low")
    names = (("pole_bottom", "pole_top", "pullback_low") if bullish
             else ("pole_top", "pole_bottom", "pullback_high"))
    row = _candidate(
        kind, bullish, tg.flag(F.col("pole_price"), F.col("end_price"), turn, bullish, cfg.stop_buffer),
        level=level, start=F.col("flag_end"), begin=F.col("pole_idx"), end=F.col("flag_end"),
        points={names[0]: F.col("pole_price"), names[1]: F.col("end_price"), names[2]: turn,
                "flag_start": F.col("_s"), "flag_end": F.col("flag_end")},
    )
    return flags.select(*keys, F.inline(F.array(row)))


def _triangle_candidates(
    chain: DataFrame, points: DataFrame, cfg: PatternConfig, keys: list[str], names: set[str]
) -> DataFrame:
    """Falling highs against rising lows; both breakout directions of each triangle."""
    blk = 128  # at least the longest span, so a triangle touches two or three blocks
    highs = chain.filter(
        F.col("is_high") & (F.col("price") < F.col("p_price"))
        & (F.col("idx") - F.col("p_idx") <= cfg.max_bars)
    ).select(*keys, F.col("p_idx").alias("i1"), F.col("p_price").alias("h1"),
             F.col("idx").alias("i2"), F.col("price").alias("h2"))
    highs = highs.withColumn("_blk", F.explode(F.sequence(
        F.floor(F.col("i1") / blk), F.floor((F.col("i2") + cfg.swing_lookback) / blk))))
    lows = points.filter(~F.col("is_high")).select(
        *keys, F.floor(F.col("idx") / blk).alias("_blk"), "idx", "price"
    )
    met = highs.join(lows, keys + ["_blk"]).filter(
        F.col("idx").between(F.col("i1"), F.col("i2") + cfg.swing_lookback)
    )
    tri = met.groupBy(*keys, "i1", "h1", "i2", "h2").agg(
        F.count(F.lit(1)).alias("_n"), F.min("idx").alias("j1"), F.max("idx").alias("j2"),
        F.min_by("price", "idx").alias("l1"), F.max_by("price", "idx").alias("l2"),
    ).filter((F.col("_n") >= 2) & (F.col("l2") > F.col("l1")))
    i1, i2, j1, j2, h1, h2, l1, l2 = (F.col(x) for x in ("i1", "i2", "j1", "j2", "h1", "h2", "l1", "l2"))
    # filters and projections may be merged and reordered, so no division here may raise
    up, dn = F.try_divide(h2 - h1, i2 - i1), F.try_divide(l2 - l1, j2 - j1)
    apex = F.try_divide(h1 - l1 + dn * j1 - up * i1, dn - up)
    tri = tri.filter(_span(i1, F.greatest(i2, j2), cfg)).withColumns({
        "_up": up, "_dn": dn, "_len": apex - i1,
    }).filter(F.col("_len") > 0)
    zone = (i1 + F.col("_len") * 0.5).cast("bigint")
    mid = F.floor((zone + (i1 + F.col("_len") * 0.75).cast("bigint")) / 2)
    tri = tri.withColumns({
        "_zone": zone, "_top": F.greatest(h1, h2), "_bot": F.least(l1, l2),
        "_hi": h1 + F.col("_up") * (mid - i1), "_lo": l1 + F.col("_dn") * (mid - j1),
    })
    rows = []
    for name, bullish, level in (("sym_triangle_bottom", True, F.col("_hi")),
                                 ("sym_triangle_top", False, F.col("_lo"))):
        if name in names:
            rows.append(_candidate(
                name, bullish, tg.triangle(F.col("_top"), F.col("_bot"), level, bullish, cfg.stop_buffer),
                level=level, start=F.col("_zone"), begin=i1, end=F.greatest(i2, j2),
                points={"upper_start": h1, "upper_end": h2, "lower_start": l1, "lower_end": l2,
                        "triangle_high": F.col("_top"), "triangle_low": F.col("_bot")}))
    return tri.select(*keys, F.inline(F.array(*rows)))


def first_breakouts(
    cands: DataFrame, pbars: DataFrame, id_cols: Sequence[str], keys: Sequence[str] = KEYS,
    search_block: int = SEARCH_BLOCK,
) -> DataFrame:
    """First bar at or after ``scan_from`` that closes beyond ``neckline`` in ``direction``.

    The first later block whose close range passes the level is found in a tree of block summaries;
    only that block and the starting one are then searched bar by bar, by equal block number.
    """
    ids = list(id_cols)
    up = F.col("direction") == "bullish"
    level = F.col("neckline")
    undone = F.when(up, F.col("min3") < level).otherwise(F.col("max3") > level)
    hits = first_hit(
        cands.filter(F.col("scan_from").isNotNull()),
        pbars.select(*keys, "idx", "close", "loud", "min3", "max3"), keys, ids,
        ["neckline", "direction"], "scan_from",
        {"_hi": F.max("close"), "_lo": F.min("close")},
        F.when(up, F.col("_hi") > level).otherwise(F.col("_lo") < level),
        F.when(up, F.col("close") > level).otherwise(F.col("close") < level),
        F.struct(F.col("idx").alias("breakout_idx"), F.col("loud").alias("breakout_loud"),
                 F.coalesce(undone, F.lit(False)).alias("breakout_false")),
        block=search_block,
    )
    return hits.select(*keys, *ids, "hit.*")


def candidates(
    pbars: DataFrame, points: DataFrame, cfg: PatternConfig = PatternConfig(),
    only: Sequence[str] | None = None, keys: Sequence[str] = KEYS, block: int | None = None,
) -> DataFrame:
    """Shape matches of the chosen detectors, before any breakout is looked for."""
    keys, names = list(keys), set(only or DETECTORS)
    unknown = names - set(DETECTORS)
    names -= unknown
    chain = chains(points, keys, block)
    parts = []
    if names & set(DETECTORS) - {"bull_flag", "bear_flag", "sym_triangle_bottom", "sym_triangle_top"}:
        parts.append(_chain_candidates(chain, cfg, keys, names))
    for name, bullish in (("bull_flag", True), ("bear_flag", False)):
        if name in names:
            parts.append(_flag_candidates(pbars, points, cfg, keys, bullish, block))
    if names & {"sym_triangle_bottom", "sym_triangle_top"}:
        parts.append(_triangle_candidates(chain, points, cfg, keys, names))
    if not parts:
        raise ValueError(f"no known detector in {sorted(unknown)}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def detect(
    bars: DataFrame, cfg: PatternConfig = PatternConfig(), only: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS, block: int | None = None, staged: bool = True,
) -> DataFrame:
    """Scored patterns of every series. ``staged`` writes the shared inputs once."""
    keys = list(keys)
    stage = materialize if staged else (lambda df, name: df)
    pbars = stage(pattern_bars(bars, cfg, keys, block), "pattern_bars")
    points = stage(swings(pbars, cfg, keys, block=block), "swings")
    return detect_from(pbars, points, cfg, only, keys, block, stage)


def detect_from(
    pbars: DataFrame, points: DataFrame, cfg: PatternConfig, only: Sequence[str] | None,
    keys: list[str], block: int | None = None, stage: Callable = materialize,
) -> DataFrame:
    cands = stage(candidates(pbars, points, cfg, only, keys, block), "candidates")
    ids = ["pattern_type", "start_idx", "end_idx"]
    hits = first_breakouts(cands, pbars, ids, keys)
    last = pbars.filter(F.col("idx") == F.col("n_bars") - 1).select(*keys, "vp_divergence")
    known = F.col("done_idx").isNotNull()
    out = cands.join(hits, keys + ids, "left").withColumns({
        "status": F.when(known | (F.col("breakout_idx").isNotNull() & ~F.col("breakout_false")), "confirmed")
                   .otherwise("forming"),
        "volume_confirmed": F.coalesce(F.when(known, F.col("done_loud")).otherwise(F.col("breakout_loud")),
                                       F.lit(False)),
        "breakout_idx": F.coalesce("done_idx", "breakout_idx"),
    }).withColumns(tg.reward_risk()).join(last, keys)
    return (
        out.withColumn("confidence", score(cfg.weights, F.col("vp_divergence")))
        .drop("done_idx", "done_loud", "breakout_loud", "breakout_false", "scan_from", "vp_divergence")
    )


def score(weights: dict[str, float], divergence: Column, default: float = 0.5) -> Column:
    """Pattern confidence in 0..1 from weight, volume, shape, reward to risk and status."""
    pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]
    weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("pattern_type")), F.lit(default))
    rr = F.col("rr_ratio")
    total = (
        0.35 * weight
        + F.when(F.col("volume_confirmed"), 0.20).otherwise(0.0)
        + F.when(~divergence, 0.05).otherwise(0.0)
        + F.when(F.col("neckline") > 0, 0.075).otherwise(0.0)
        + F.when(F.size("key_points") > 0, 0.075).otherwise(0.0)
        + F.when(rr >= 3.0, 0.15).when(rr >= 2.0, 0.10).when(rr >= 1.5, 0.05).otherwise(0.0)
        + F.when(F.col("status") == "confirmed", 0.10).otherwise(0.0)
    )
    return F.round(F.least(total, F.lit(1.0)), 4)


def order_columns() -> list[Column]:
    """Best first; equal scores keep detector order, then order of appearance."""
    return [F.col("confidence").desc(), F.col("detector"), F.col("start_idx"), F.col("end_idx")]


def known_idx(cfg: PatternConfig = PatternConfig()) -> Column:
    """Earliest bar at which a pattern can be known: swings confirmed, breakout held."""
    held = F.when(F.col("status") == "confirmed", F.col("breakout_idx") + 3)
    return F.greatest(F.col("end_idx") + cfg.swing_lookback, F.coalesce(held, F.col("end_idx")))


def actionable(
    patterns: DataFrame, last_bars: DataFrame, keys: Sequence[str] = KEYS,
    max_bars: int = 10, near: float = 0.05,
) -> DataFrame:
    """Patterns still tradable at the last bar (``close``, ``last_idx``), with ``priority``."""
    p = patterns.join(last_bars, list(keys))
    price, bull = F.col("close"), F.col("direction") == "bullish"
    stopped = F.when(bull, price < F.col("stop")).otherwise(price > F.col("stop"))
    reached = F.when(bull, price >= F.col("target1")).otherwise(price <= F.col("target1"))
    ref = F.when(F.col("entry") > 0, F.col("entry")).otherwise(F.col("neckline"))
    away = F.try_divide(F.abs(price - ref), ref)
    early = (ref > 0) & (away <= near) & F.when(bull, price <= ref).otherwise(price >= ref)
    since = F.col("last_idx") - F.col("breakout_idx")
    dist = F.try_divide(F.abs(price - F.col("entry")), F.col("entry"))
    fresh = (since <= max_bars) & (dist <= near)
    rank = (1.0 - since / max_bars) * 0.6 + (1.0 - F.least(dist, F.lit(1.0))) * 0.4
    ok = F.when(F.col("status") == "forming", early).otherwise(fresh)
    return p.filter(~stopped & ~reached & ok).withColumn(
        "priority", F.when(F.col("status") == "forming", 2.0 - away).otherwise(rank)
    )


def best_pattern(patterns: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Highest confidence per series; the first in pattern order among equals."""
    w = Window.partitionBy(*keys).orderBy(*order_columns())
    return patterns.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
