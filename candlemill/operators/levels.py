"""Support and resistance: clustered lines, trendlines, merging and matching."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlemill.config import AnalysisConfig, DiagonalConfig, HorizontalConfig
from candlemill.functions.skew import salted_join
from candlemill.schemas import KEYS, timeframe_rank

LEVEL_COLUMNS = (
    "sr_type", "role", "price", "slope", "anchor_idx", "strength", "touches", "first_seen",
    "last_tested",
)


def price_at(idx: Column | str) -> Column:
    """Price of a level at a bar position."""
    idx = F.col(idx) if isinstance(idx, str) else idx
    return F.col("price") + F.col("slope") * (idx - F.col("anchor_idx"))


def series_stats(bars: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean ATR, price range and volume per series. ``bars`` needs ``atr``."""
    return bars.groupBy(*keys).agg(
        F.avg("atr").alias("avg_atr"), F.max("high").alias("max_high"),
        F.min("low").alias("min_low"), F.avg("volume").alias("avg_volume"),
        F.sum("volume").alias("sum_volume"), (F.max("idx") + 1).alias("n_bars"),
    )


def _cell(price: Column, dist: Column) -> Column:
    """Cells of half the chain distance: members of one cell always chain."""
    return F.when(dist > 0, F.floor(price * 2 / dist).cast("double")).otherwise(price)


def _chain(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Number the chains over per-cell price bounds ``_lo``/``_hi``; links span at most ``_dist``."""
    w = Window.partitionBy(*keys).orderBy("_cell")
    broken = F.coalesce(F.col("_lo") - F.lag("_hi").over(w) > F.col("_dist"), F.lit(False))
    return cells.withColumn("_new", broken.cast("int")).withColumn("_cluster", F.sum("_new").over(w))


def round_number_score(price: Column | str) -> Column:
    """1 at multiples of 100, fading over 25; half as much at multiples of 50, over 12.5."""
    price = F.col(price) if isinstance(price, str) else price

    def near(step: float) -> Column:
        rest = F.pmod(price, F.lit(step))
        return F.least(rest, step - rest)

    zero = F.lit(0.0)
    hundreds = F.greatest(zero, 1.0 - near(100.0) / 25.0)
    fifties = F.greatest(zero, 1.0 - near(50.0) / 12.5) * 0.5
    return F.least(hundreds + fifties, F.lit(1.0))


def _level_row(df: DataFrame, keys: list[str], kind: str) -> DataFrame:
    return df.select(
        *keys, F.lit(kind).alias("sr_type"), "role", "price", F.lit(0.0).alias("slope"),
        F.lit(0).cast("bigint").alias("anchor_idx"), "strength", "touches", "first_seen",
        "last_tested",
    )


def pin_bar_lines(
    pins: DataFrame, stats: DataFrame, cfg: AnalysisConfig = AnalysisConfig(),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Lines at the most frequent wick tip of each chain of tips.

    Tips are counted per (cell, tick) before any shuffle, so a long series costs one row per
    distinct price cell.
    """
    keys = list(keys)
    tips = pins.select(*keys, "tip", "pin_direction", "ts").join(
        stats.select(*keys, (F.col("avg_atr") * cfg.line_cluster_atr).alias("_dist")), keys
    )
    ticks = (
        tips.withColumn("_cell", _cell(F.col("tip"), F.col("_dist")))
        .withColumn("_tick", F.bround(F.col("tip") / cfg.tick_size) * cfg.tick_size)
        .groupBy(*keys, "_cell", "_tick")
        .agg(
            F.count(F.lit(1)).alias("_n"), F.count_if(F.col("pin_direction") == "LONG").alias("_up"),
            F.min("tip").alias("_lo"), F.max("tip").alias("_hi"), F.first("_dist").alias("_dist"),
            F.min("ts").alias("_t0"), F.max("ts").alias("_t1"),
        )
    )
    cells = ticks.groupBy(*keys, "_cell").agg(
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.first("_dist").alias("_dist")
    )
    owner = _chain(cells, keys).select(*keys, "_cell", "_cluster")
    per_tick = ticks.join(owner, keys + ["_cell"]).groupBy(*keys, "_cluster", "_tick").agg(
        *[F.sum(c).alias(c) for c in ("_n", "_up")],
        F.min("_t0").alias("_t0"), F.max("_t1").alias("_t1"),
    )
    lines = per_tick.groupBy(*keys, "_cluster").agg(
        F.max_by("_tick", F.struct("_n", -F.col("_tick"))).alias("price"),
        F.sum("_n").alias("touches"), F.sum("_up").alias("_up"),
        F.min("_t0").alias("first_seen"), F.max("_t1").alias("last_tested"),
    ).filter(F.col("touches") >= cfg.min_touches)
    lines = lines.withColumns({
        "role": F.when(F.col("_up") * 2 >= F.col("touches"), "support").otherwise("resistance"),
        "strength": F.least(0.3 + F.col("touches") * 0.15, F.lit(1.0)),
    })
    return _level_row(lines, keys, "horizontal")


def horizontal_levels(
    points: DataFrame, stats: DataFrame, cfg: HorizontalConfig = HorizontalConfig(),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Levels at the mean price of each chain of pivots, with a weighted strength."""
    keys = list(keys)
    own = stats.select(
        *keys, (F.col("avg_atr") * cfg.cluster_atr).alias("_dist"), "avg_volume", "sum_volume",
        (F.col("n_bars") - 1).alias("_last"),
    )
    cells = (
        points.select(*keys, "price", "is_high", "idx", "ts", "volume").join(own, keys)
        .withColumn("_cell", _cell(F.col("price"), F.col("_dist")))
        .groupBy(*keys, "_cell")
        .agg(
            F.min("price").alias("_lo"), F.max("price").alias("_hi"), F.first("_dist").alias("_dist"),
            F.sum("price").alias("_sp"), F.count(F.lit(1)).alias("_n"),
            F.count_if("is_high").alias("_nh"), F.max("idx").alias("_recent"),
            F.sum("volume").alias("_sv"), F.min("ts").alias("_t0"), F.max("ts").alias("_t1"),
        )
    )
    levels = _chain(cells, keys).groupBy(*keys, "_cluster").agg(
        (F.sum("_sp") / F.sum("_n")).alias("price"), F.sum("_n").alias("touches"),
        F.sum("_nh").alias("_nh"), F.max("_recent").alias("_recent"),
        (F.sum("_sv") / F.sum("_n")).alias("_pv"), F.min("_t0").alias("first_seen"),
        F.max("_t1").alias("last_tested"),
    ).filter(F.col("touches") >= cfg.min_touches).join(own, keys)
    recency = F.when(F.col("_last") == 0, 0.5).otherwise(F.try_divide("_recent", "_last"))
    loud = F.least(F.greatest(F.try_divide("_pv", "avg_volume"), F.lit(0.0)), F.lit(2.0)) / 2.0
    volume = F.when((F.col("sum_volume") == 0) | (F.col("avg_volume") == 0), 0.5).otherwise(loud)
    strength = (
        cfg.w_touches * F.least(F.col("touches") / 5.0, F.lit(1.0)) + cfg.w_recency * recency
        + cfg.w_volume * volume + cfg.w_round * round_number_score("price")
    )
    levels = levels.withColumns({
        "role": F.when(F.col("_nh") * 2 > F.col("touches"), "resistance").otherwise("support"),
        "strength": F.greatest(F.lit(0.0), F.least(strength, F.lit(1.0))),
    })
    return _level_row(levels, keys, "horizontal")


def diagonal_lines(
    points: DataFrame, stats: DataFrame, cfg: DiagonalConfig = DiagonalConfig(),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Lines through every pair of a side's latest pivots, with their touch counts.

    Pairs come from at most ``recent_points`` pivots per side; touches count all pivots, which
    are spread over salts against the few lines of their series.
    """
    keys = list(keys)
    side = [*keys, "is_high"]
    latest = Window.partitionBy(*side).orderBy(F.col("idx").desc())
    recent = (
        points.withColumn("_rn", F.row_number().over(latest))
        .filter(F.col("_rn") <= cfg.recent_points)
        .select(*side, "idx", "price", "ts")
    )
    a = recent.select(*side, F.col("idx").alias("i1"), F.col("price").alias("p1"),
                      F.col("ts").alias("t1"))
    b = recent.select(*side, F.col("idx").alias("i2"), F.col("price").alias("p2"),
                      F.col("ts").alias("t2"))
    pairs = a.join(b, side).filter(F.col("i1") < F.col("i2")).join(
        stats.select(*keys, (F.col("avg_atr") * cfg.tolerance_atr).alias("_tol"),
                     (F.col("n_bars") - 1).alias("_last")), keys
    ).withColumn("slope", F.try_divide(F.col("p2") - F.col("p1"), F.col("i2") - F.col("i1")))
    line = [*side, "i1", "i2", "p1", "t1", "t2", "slope", "_last"]
    off = F.abs(F.col("price") - (F.col("p1") + F.col("slope") * (F.col("idx") - F.col("i1"))))
    touched = (
        salted_join(points.select(*side, "idx", "price"), pairs.drop("p2"), side, "idx")
        .groupBy(*line).agg(F.count_if(off <= F.col("_tol")).alias("touches"))
        .filter(F.col("touches") >= cfg.min_touches)
    )
    recency = F.when(F.col("_last") > 0, F.try_divide("i2", "_last")).otherwise(0.5)
    strength = 0.6 * F.least(F.col("touches") / 5.0, F.lit(1.0)) + 0.4 * recency
    return touched.select(
        *keys, F.lit("diagonal").alias("sr_type"),
        F.when(F.col("is_high"), "resistance").otherwise("support").alias("role"),
        (F.col("p1") + F.col("slope") * (F.col("i2") - F.col("i1"))).alias("price"), "slope",
        F.col("i2").alias("anchor_idx"),
        F.greatest(F.lit(0.0), F.least(strength, F.lit(1.0))).alias("strength"),
        "touches", F.col("t1").alias("first_seen"), F.col("t2").alias("last_tested"), "i1",
    )


def greedy_keep(
    levels: DataFrame, keys: Sequence[str], order: Sequence[Column],
    clash: Callable[[Column, Column], Column], first: int | None = None,
) -> DataFrame:
    """Walk each series' levels in ``order`` and keep those that clash with none kept so far.

    ``first`` stops after that many are kept, for callers that want only the head.

    Works on one array per series; a series has at most its price range over the cluster
    distance many levels.
    """
    keys = list(keys)
    cols = [c for c in levels.columns if c not in keys]
    ranked = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    packed = levels.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*ranked, *cols))).alias("_all")
    )
    def full(acc: Column) -> Column:
        return F.lit(False) if first is None else F.size(acc) >= first

    kept = F.aggregate(
        "_all", F.slice("_all", 1, 0),
        lambda acc, x: F.when(full(acc), acc).when(F.exists(acc, lambda k: clash(k, x)), acc)
                        .otherwise(F.concat(acc, F.array(x))),
    )
    return (
        packed.select(*keys, F.posexplode(kept).alias("pos", "_l"))
        .select(*keys, "pos", *[F.col(f"_l.{c}").alias(c) for c in cols])
    )


def dedupe_diagonals(
    lines: DataFrame, stats: DataFrame, cfg: DiagonalConfig = DiagonalConfig(),
    keys: Sequence[str] = KEYS, first: int | None = None,
) -> DataFrame:
    """Keep the stronger of two lines of a role with near slope and near price."""
    own = stats.select(*keys, (F.col("avg_atr") * cfg.intercept_atr).alias("_near"))

    def clash(kept: Column, x: Column) -> Column:
        return (
            (kept["role"] == x["role"])
            & (F.abs(kept["slope"] - x["slope"]) < cfg.slope_tol)
            & (F.abs(kept["price"] - x["price"]) < x["_near"])
        )

    order = [-F.col("strength"), F.col("role"), F.col("i1"), F.col("anchor_idx")]
    return greedy_keep(lines.join(own, list(keys)), keys, order, clash, first).drop("_near")


def merge_levels(
    primary: DataFrame, secondary: DataFrame, stats: DataFrame, atr_mult: float = 0.3,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """All primary levels, then secondary ones not near anything merged before them."""
    own = stats.select(*keys, (F.col("avg_atr") * atr_mult).alias("_near"))
    both = primary.withColumn("_second", F.lit(False)).unionByName(
        secondary.withColumn("_second", F.lit(True)), allowMissingColumns=True
    ).join(own, list(keys))

    def clash(kept: Column, x: Column) -> Column:
        return x["_second"] & (F.abs(kept["price"] - x["price"]) <= x["_near"])

    order = [F.col("_second"), -F.col("strength"), F.col("price")]
    return greedy_keep(both, keys, order, clash).drop("_near", "_second")


def top_levels(levels: DataFrame, k: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The ``k`` strongest levels per series, earlier ``pos`` first among equals."""
    w = Window.partitionBy(*keys).orderBy(F.col("strength").desc(), "pos")
    return (
        levels.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
        .withColumn("pos", F.col("_rn") - 1).drop("_rn")
    )


def merge_timeframes(
    levels: DataFrame, dist: DataFrame, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Levels of several timeframes: a finer one near a coarser one is absorbed by it.

    The kept level takes the finer price, 0.1 strength (at most 1) and the touches.
    ``dist`` has ``_near`` per key.
    """
    keys = list(keys)
    cols = ["source_tf", "_tf", "role", "sr_type", "price", "slope", "anchor_idx", "strength",
            "touches", "first_seen", "last_tested"]
    packed = (
        levels.withColumn("_tf", timeframe_rank("source_tf"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct(
            F.col("_tf").alias("_o0"), (-F.col("strength")).alias("_o1"),
            F.col("pos").alias("_o2"), *cols))).alias("_all"))
        .join(dist, keys)
    )

    def absorb(old: Column, x: Column) -> Column:
        price = F.when(x["_tf"] > old["_tf"], x["price"]).otherwise(old["price"])
        changed = {"price": price, "strength": F.least(old["strength"] + 0.1, F.lit(1.0)),
                   "touches": old["touches"] + x["touches"]}
        names = ["_o0", "_o1", "_o2", *cols]
        return F.struct(*[changed.get(n, old[n]).alias(n) for n in names])

    def step(acc: Column, x: Column) -> Column:
        near = F.transform(acc, lambda k: F.abs(k["price"] - x["price"]) <= F.col("_near"))
        hit = F.array_position(near, True) - 1
        merged = F.transform(acc, lambda k, i: F.when(i == hit, absorb(k, x)).otherwise(k))
        return F.when(hit >= 0, merged).otherwise(F.concat(acc, F.array(x)))

    out = packed.select(
        *keys, F.posexplode(F.aggregate("_all", F.slice("_all", 1, 0), step)).alias("pos", "_l")
    )
    return out.select(*keys, "pos", *[F.col(f"_l.{c}").alias(c) for c in cols if c != "_tf"])


def clip_to_range(
    levels: DataFrame, stats: DataFrame, margin: float = 0.10, keys: Sequence[str] = KEYS
) -> DataFrame:
    own = stats.select(*keys, "max_high", "min_low")
    pad = (F.col("max_high") - F.col("min_low")) * margin
    return levels.join(own, list(keys)).filter(
        F.col("price").between(F.col("min_low") - pad, F.col("max_high") + pad)
    ).drop("max_high", "min_low")


def dedupe_by_touches(
    levels: DataFrame, stats: DataFrame, share: float = 0.0015, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Of levels within ``share`` of the mid price keep the one with most touches."""
    mid = (F.col("max_high") + F.col("min_low")) / 2
    own = stats.select(*keys, (mid * share).alias("_near"))

    def clash(kept: Column, x: Column) -> Column:
        return F.abs(kept["price"] - x["price"]) <= x["_near"]

    ranked = levels.withColumnRenamed("pos", "_rank").join(own, list(keys))
    return greedy_keep(
        ranked, keys, [-F.col("touches"), F.col("_rank")], clash
    ).drop("_near", "_rank")


def match_pins(
    pins: DataFrame, levels: DataFrame, proximity: float = 0.005, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Pin bars with their nearest level; those with none within ``proximity`` are dropped.

    ``levels`` holds the final few levels per series, so each pin bar meets only those.
    """
    keys = list(keys)
    side = levels.select(*keys, *[F.col(c).alias(f"lv_{c}") for c in (
        "pos", "price", "slope", "anchor_idx", "strength", "touches", "role", "sr_type")])
    at = F.col("lv_price") + F.col("lv_slope") * (F.col("idx") - F.col("lv_anchor_idx"))
    near = salted_join(pins, side, keys, "idx").withColumns({
        "level_price": at, "sr_distance": F.try_divide(F.abs(F.col("tip") - at), F.col("close")),
    }).filter(F.col("sr_distance") <= proximity)
    best = Window.partitionBy(*keys, "idx").orderBy("sr_distance", "lv_pos")
    return (
        near.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") == 1)
        .drop("_rn", "lv_slope", "lv_anchor_idx")
    )


def level_features(
    bars: DataFrame, levels: DataFrame, keys: Sequence[str] = KEYS, proximity: float = 0.005
) -> DataFrame:
    """Per bar: nearest support below, resistance above, levels within one ATR, confluence.

    ``nearest_sr_strength`` and ``nearest_sr_touches`` belong to the level that last improved
    either side when levels are taken in ``pos`` order.
    """
    keys = list(keys)
    packed = levels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        "pos", "price", "slope", "anchor_idx", "role", "strength", "touches",
        F.coalesce("source_tf", F.lit("_local")).alias("tf") if "source_tf" in levels.columns
        else F.lit("_local").alias("tf"),
    ))).alias("_lv"))
    df = bars.join(packed, keys, "left").withColumn(
        "_lv", F.coalesce("_lv", F.array().cast(packed.schema["_lv"].dataType))
    )
    close, idx = F.col("close"), F.col("idx")

    def at(x: Column) -> Column:
        return x["price"] + x["slope"] * (idx - x["anchor_idx"])

    far = F.lit(float("inf"))
    start = F.struct(far.alias("s"), far.alias("r"), F.lit(0.0).alias("strength"),
                     F.lit(0.0).alias("touches"))

    def step(acc: Column, x: Column) -> Column:
        dist = F.coalesce(F.try_divide(F.abs(close - at(x)), close), far)
        below = (x["role"] == "support") & (close >= at(x)) & (dist < acc["s"])
        above = (x["role"] == "resistance") & (close <= at(x)) & (dist < acc["r"])
        better = below | above
        return F.struct(
            F.when(below, dist).otherwise(acc["s"]).alias("s"),
            F.when(above, dist).otherwise(acc["r"]).alias("r"),
            F.when(better, x["strength"]).otherwise(acc["strength"]).alias("strength"),
            F.when(better, x["touches"].cast("double")).otherwise(acc["touches"]).alias("touches"),
        )

    df = df.withColumn("_n", F.aggregate("_lv", start, step))
    default = F.lit(0.1)
    within = F.size(F.filter("_lv", lambda x: F.abs(close - at(x)) <= F.col("atr")))
    tfs = F.size(F.array_distinct(F.transform(
        F.filter("_lv", lambda x: F.abs(close - at(x)) <= close * proximity), lambda x: x["tf"])))
    return df.withColumns({
        "dist_nearest_support": F.when(F.col("_n.s") == far, default).otherwise(F.col("_n.s")),
        "dist_nearest_resistance": F.when(F.col("_n.r") == far, default).otherwise(F.col("_n.r")),
        "nearest_sr_strength": F.col("_n.strength"),
        "nearest_sr_touches": F.col("_n.touches"),
        "levels_within_1atr": F.when(F.col("atr") > 0, within).otherwise(0).cast("double"),
        "num_tf_confluence": tfs.cast("double"),
    }).drop("_n", "_lv")


def next_level(
    points: DataFrame, levels: DataFrame, entry: str = "entry", direction: str = "pin_direction",
    keys: Sequence[str] = KEYS, out: str = "next_price",
) -> DataFrame:
    """Nearest level price beyond ``entry`` in trade direction; null when there is none."""
    keys = list(keys)
    packed = levels.groupBy(*keys).agg(
        F.collect_list(F.struct("price", "slope", "anchor_idx")).alias("_lv")
    )
    prices = F.transform(
        "_lv", lambda x: x["price"] + x["slope"] * (F.col("idx") - x["anchor_idx"])
    )
    up = F.array_min(F.filter(prices, lambda p: p > F.col(entry)))
    down = F.array_max(F.filter(prices, lambda p: p < F.col(entry)))
    return points.join(packed, keys, "left").withColumn(
        out, F.when(F.col(direction) == "LONG", up).otherwise(down)
    ).drop("_lv")


def necklines(
    points: DataFrame, tolerance: float = 0.03, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Least-squares line per (series, side), refitted without outliers.

    Three aggregates joined back to the points; every one combines map-side.
    """
    side = [*keys, "is_high"]
    x, y = F.col("idx").cast("double"), F.col("price")
    first = points.groupBy(*side).agg(
        F.regr_slope(y, x).alias("_a"), F.regr_intercept(y, x).alias("_b"),
        (F.avg(y) * tolerance).alias("_tol"), F.count(F.lit(1)).alias("_n"),
    ).filter(F.col("_n") >= 2)
    kept = points.join(first, side)
    inlier = F.abs(y - (F.col("_a") * x + F.col("_b"))) <= F.col("_tol")
    second = kept.filter(inlier).groupBy(*side).agg(
        F.regr_slope(y, x).alias("_a2"), F.regr_intercept(y, x).alias("_b2"),
        F.avg(y).alias("_mean"), F.count(F.lit(1)).alias("_n2"),
    ).filter(F.col("_n2") >= 2)
    flat = F.abs(F.col("_a2")) < 0.001 * F.col("_mean")
    fitted = F.when(flat, F.col("_mean")).otherwise(F.col("_a2") * x + F.col("_b2"))
    touch = F.abs(y - fitted) <= F.col("_tol")
    return (
        kept.join(second, side).filter(touch)
        .groupBy(*side, F.col("_mean").alias("price"),
                 F.when(flat, 0.0).otherwise(F.col("_a2")).alias("slope"))
        .agg(F.count(F.lit(1)).alias("touches"), F.min("idx").alias("first_touch"),
             F.max("idx").alias("last_touch"))
        .filter(F.col("touches") >= 2)
    )
