"""Forward searches along a series, through a tree of block summaries.

Level 1 summarises ``leaf`` bars a block, every further level ``fan`` blocks of the one below, up to a
level that has ``fan`` blocks at most. A point asks on every level for the blocks behind its own one
that share the parent with it, so it meets at most ``fan`` rows a level, however long the series is.
All of it are equi-joins on (series, level, parent).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEARCH_BLOCK = 128
FAN = 128


def depth(bars: DataFrame, leaf: int = SEARCH_BLOCK, fan: int = FAN) -> int:
    """Levels of the tree over ``bars``; reads the greatest ``idx``."""
    blocks = (bars.agg(F.max("idx")).first()[0] or 0) // leaf
    levels = 1
    while blocks >= fan:
        blocks, levels = blocks // fan, levels + 1
    return levels


def _block(idx: Column, level: int, leaf: int, fan: int) -> Column:
    return F.floor(idx / (leaf * fan ** (level - 1)))


def _parent(block: Column, level: int, levels: int, fan: int) -> Column:
    return F.floor(block / fan) if level < levels else F.lit(0).cast("bigint")


def _salts(bars: DataFrame) -> int:
    return max(1, int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def tree(
    bars: DataFrame, keys: Sequence[str], summary: dict[str, Column], levels: int, leaf: int, fan: int
) -> DataFrame:
    """``summary`` of every block: ``_level``, ``_node`` (its number) and ``_parent``.

    Blocks above the first level are few, but many points ask for each: they are there once per
    ``_salt``.
    """
    out = None
    for level in range(1, levels + 1):
        node = _block(F.col("idx"), level, leaf, fan)
        rows = (
            bars.groupBy(*keys, node.alias("_node")).agg(*[c.alias(n) for n, c in summary.items()])
            .withColumns({"_level": F.lit(level), "_parent": _parent(F.col("_node"), level, levels, fan)})
        )
        copies = F.sequence(F.lit(0), F.lit(_salts(bars) - 1)) if level > 1 else F.array(F.lit(0))
        rows = rows.withColumn("_salt", F.explode(copies))
        out = rows if out is None else out.unionByName(rows)
    return out


def _salt(level: Column, spread: Column, salts: int) -> Column:
    return F.when(level > 1, F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(0).cast("int")


def climb(
    want: DataFrame, nodes: DataFrame, keys: Sequence[str], asks: Sequence[Column], spread: Column, salts: int
) -> DataFrame:
    """``want`` met with the nodes that its ``asks`` name: structs of level, parent and the open range lo..hi."""
    on = [*keys, "_level", "_parent", "_salt"]
    asked = want.withColumn("_ask", F.explode(F.array_compact(F.array(*asks)))).withColumns({
        "_level": F.col("_ask.level"), "_parent": F.col("_ask.parent"), "_lo": F.col("_ask.lo"), "_hi": F.col("_ask.hi"),
        "_salt": _salt(F.col("_ask.level"), spread, salts),
    }).drop("_ask")
    return asked.withColumnsRenamed({"_lo": "_after", "_hi": "_before"}).join(nodes, on, "left")


def _ask(level: int, parent: Column, lo: Column, hi: Column) -> Column:
    return F.struct(
        F.lit(level).alias("level"), parent.cast("bigint").alias("parent"), lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi")
    )


def first_hit(
    points: DataFrame, bars: DataFrame, keys: Sequence[str], ids: Sequence[str],
    carry: Sequence[str], scan_from: str, summary: dict[str, Column], block_test: Column,
    bar_test: Column, hit: Column, block: int = SEARCH_BLOCK, fan: int = FAN, levels: int | None = None,
) -> DataFrame:
    """First bar at or after ``scan_from`` that passes ``bar_test``, as column ``hit``.

    ``block_test`` says from a block's ``summary`` whether a bar in it passes. The lowest level with
    such a block behind the point's own has the earliest one; it is followed down to a block of bars.
    Only that block and the starting one are read bar by bar, through an equi-join on the block number.
    """
    keys = list(keys)
    group = list(dict.fromkeys([*keys, *ids, *carry, scan_from]))
    levels = levels or depth(bars, block, fan)
    nodes, salts = tree(bars, keys, summary, levels, block, fan), _salts(bars)
    start = F.col(scan_from)
    asks = []
    for level in range(1, levels + 1):
        own = _block(start, level, block, fan)
        asks.append(_ask(level, _parent(own, level, levels, fan), own, F.lit(None)))
    behind = block_test & (F.col("_node") > F.col("_after"))
    spot = F.min(F.when(behind, F.struct(F.col("_level").alias("level"), F.col("_node").alias("node"))))
    found = climb(points.select(*group), nodes, keys, asks, start, salts).groupBy(*group).agg(spot.alias("_spot"))
    for level in range(levels, 1, -1):
        below = nodes.where(F.col("_level") == level - 1).drop("_level")
        here = F.col("_spot.level") == level
        child = F.min(F.when(block_test, F.col("_node")))
        found = (
            found.withColumns({"_parent": F.when(here, F.col("_spot.node")), "_salt": _salt(F.lit(level - 1), start, salts)})
            .join(below, [*keys, "_parent", "_salt"], "left").groupBy(*group, "_spot").agg(child.alias("_child"))
            .withColumn("_spot", F.when(
                F.col("_spot.level") == level, F.struct(F.lit(level - 1).alias("level"), F.col("_child").alias("node"))
            ).otherwise(F.col("_spot"))).drop("_child")
        )
    bars = bars.withColumn("_blk", F.floor(F.col("idx") / block))
    spots = found.select(*group, F.explode(F.array_compact(F.array(F.floor(start / block), F.col("_spot.node")))).alias("_blk"))
    return (
        spots.join(bars, keys + ["_blk"])
        .filter((F.col("idx") >= start) & bar_test)
        .groupBy(*keys, *ids).agg(F.min_by(hit, "idx").alias("hit"))
    )


def range_extremes(
    points: DataFrame, bars: DataFrame, keys: Sequence[str], ids: Sequence[str], first: str,
    last: str, block: int = SEARCH_BLOCK, fan: int = FAN, levels: int | None = None,
) -> DataFrame:
    """``max_high``/``min_low`` over bars ``first..last`` of each point.

    The two edge blocks are read bar by bar. Between them stand the blocks of the first level up to
    the ends of the edge blocks' parents, between these parents blocks of the second level, and so
    on up to the level where both ends have one parent.
    """
    keys = list(keys)
    levels = levels or depth(bars, block, fan)
    bars = bars.select(*keys, "idx", "high", "low", F.floor(F.col("idx") / block).alias("_blk"))
    nodes = tree(bars, keys, {"high": F.max("high"), "low": F.min("low")}, levels, block, fan)
    want = points.select(*keys, *ids, first, last)
    ends = F.array_distinct(F.array(F.floor(F.col(first) / block), F.floor(F.col(last) / block)))
    near = (
        want.withColumn("_blk", F.explode(ends)).join(bars, keys + ["_blk"])
        .filter(F.col("idx").between(F.col(first), F.col(last)))
    )
    asks, apart = [], F.lit(True)
    for level in range(1, levels + 1):
        b0, b1 = _block(F.col(first), level, block, fan), _block(F.col(last), level, block, fan)
        p0, p1 = _parent(b0, level, levels, fan), _parent(b1, level, levels, fan)
        none = F.lit(None).cast("bigint")
        asks.append(F.when(apart & (p0 == p1) & (b1 > b0 + 1), _ask(level, p0, b0, b1)))
        asks.append(F.when(apart & (p0 != p1), _ask(level, p0, b0, none)))
        asks.append(F.when(apart & (p0 != p1), _ask(level, p1, none, b1)))
        apart = apart & (p0 != p1)
    far = climb(want, nodes, keys, asks, F.col(first), _salts(bars)).filter(
        (F.col("_after").isNull() | (F.col("_node") > F.col("_after")))
        & (F.col("_before").isNull() | (F.col("_node") < F.col("_before")))
    )
    cols = [*keys, *ids, "high", "low"]
    return (
        near.select(*cols).unionByName(far.select(*cols)).groupBy(*keys, *ids)
        .agg(F.max("high").alias("max_high"), F.min("low").alias("min_low"))
    )
