"""Mixing sources to target weights with hash-random keys and distributed prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of runs of anything but blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``(source_key, source_size)`` to rows with ``target``.

    Every source gets ``level * weight``, but at most ``most`` times its size; ``level`` is the
    one at which the targets add up to all sizes. Sources are met in the order in which a rising
    level fills them, so the level follows from two running sums over one row per source.
    """
    order = Window.orderBy("source_key")
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    fill = Window.orderBy("fills", "source_key")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("fills", F.col("cap") / F.col("weight"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(rest))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    )
    # the first level that its own source can take; later ones are lower
    level = F.max(F.when(F.col("level") <= F.col("fills"), F.col("level"))).over(everything)
    level = F.coalesce(level, F.max("fills").over(everything))
    return ranked.withColumn(
        "target", F.least(F.col("cap").cast("double"), level * F.col("weight"))
    ).select("source_key", "source_size", "target")


def mix(
    docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id",
    weights: Sequence[float] = WEIGHTS, most: int = MOST_EPOCHS,
) -> DataFrame:
    """All rows of ``docs`` with ``size``, ``source_size``, ``target``, ``epochs``, ``part`` and ``taken``.

    Each source's budget is its rounded target. Whole epochs are ``budget // source_size``; what
    remains is cut from the documents in the order of a hash of id and text: a document gives
    ``part`` words more, all of them before the cut and none behind it. ``taken = epochs * size +
    part``. No source or document order is sorted in one task: documents fall into about sqrt(rows)
    ranges of the hash, range sums are scanned per source, and a range is sorted on its own.

    Nulls: a null source is a source, after all others; a null text has size 0. A null id only
    leaves the text to the hash. Equal rows are interchangeable. Empty input gives no rows. Columns
    of ``docs`` named like a result are replaced.
    """
    spread = max(1, int(docs.count() ** 0.5))
    key = F.md5(F.concat_ws(":", F.col(doc_id).cast("string"), F.md5(F.col(text))))
    sized = docs.drop("size", "source_size", "target", "epochs", "part", "taken").withColumns({
        "size": n_words(F.col(text)),
        "source_key": F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source))),
        "_key": key,
        "_range": F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * spread / (1 << 32)).cast("long"),
    })
    ranges = sized.groupBy("source_key", "_range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(
        ranges.groupBy("source_key").agg(F.sum("range_size").alias("source_size")), weights, most
    )
    scan = Window.partitionBy("source_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(scan), F.lit(0)))
        .join(targets, "source_key")
        .withColumn("budget", F.round("target").cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .drop("range_size", "budget")
    )
    inside = (
        Window.partitionBy("source_key", "_range").orderBy("_key", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    return (
        sized.join(starts, ["source_key", "_range"])
        .withColumn("part", part.cast("long"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
        .drop("source_key", "_key", "_range", "range_start", "rest")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, in the columns of ``docs``: every document once per epoch, and the part.

    The document at the cut is ended after ``part`` words. A document without words has nothing to
    give and takes no budget; it stays once.
    """
    text = options.get("text", "text")
    mixed = mix(docs, **options)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(
        F.col("epochs") + F.when(F.col("part") > 0, F.lit(1)).otherwise(F.lit(0))
    ).cast("int")
    copy = F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))
    cut = (F.col("_copy") > F.col("epochs")) & (F.col("part") < F.col("size"))
    pieces = F.zip_with(
        F.slice(F.split(F.col(text), WORD, -1), F.lit(1), F.col("part").cast("int")),
        F.slice(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.lit(1), F.col("part").cast("int")),
        lambda gap, word: F.concat(gap, word),
    )
    head = F.array_join(pieces, "")
    return (
        mixed.withColumn("_copy", F.explode(copy))
        .withColumn(text, F.when(cut, head).otherwise(F.col(text)))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
