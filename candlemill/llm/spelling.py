"""Spelling variants: words one edit apart, joined on asymmetric chunks.

Of two words one edit apart the longer one gives two disjoint chunks of half its length, and the edit
leaves one of them whole. The other word gives its grams of that length by position; the whole chunk is
one of them, moved by one place at most. A join on (length, chunk, place) therefore meets every pair,
and what is left and right of the common chunk still is within one edit. So a chunk that too many words
share is joined on chunks of that rest as well, and so on, until groups are small: nothing is left out
and no group is compared all against all.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.session import discard, materialize

LETTERS = "[A-Za-zÀ-ÿ]+"
_LOWER = {c: c + 32 for c in range(65, 91)}
FLUSH = 200_000  # words that a task counts before it hands them on
LEAST_LENGTH, LEAST_COUNT = 5, 3
GROUP = 256  # pairs of a chunk beyond which the rest is split as well


def count_words(
    docs: DataFrame, alter: int | None = None, least_length: int = LEAST_LENGTH, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``word, n``: occurrences of every run of ``LETTERS`` in whole texts, A-Z lowered.

    With ``alter``, a run whose crc32 behind ``<doc_id>:`` is divisible by it loses one code point, at
    the place crc32 modulo its length; such runs stand for misspellings. Words of fewer than
    ``least_length`` code points are left out. Null and empty texts have no words, a null id counts as
    an empty one, repeated rows count again, and an empty table gives no rows.
    """
    find = re.compile(LETTERS).findall

    def run(batches):
        counts: Counter = Counter()

        def flush():
            names = list(counts)
            batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[w] for w in names], pa.int64())], ["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seed = zlib.crc32(f"{'' if name is None else name}:".encode())
                for word, n in Counter(find((body or "").translate(_LOWER))).items():
                    if alter and (h := zlib.crc32(word.encode(), seed)) % alter == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least_length:
                        counts[word] += n
                if len(counts) >= FLUSH:
                    yield flush()
        yield flush()

    partial = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def _chunks(longer: DataFrame) -> DataFrame:
    """The two chunks of half of ``rest``, each with what it leaves."""
    q = F.floor(F.length("rest") / 2).cast("int")
    first = F.struct(
        F.lit("0").alias("slot"), F.left("rest", q).alias("chunk"), F.substring("rest", q + 1, F.length("rest")).alias("left_over")
    )
    second = F.struct(
        F.lit("1").alias("slot"), F.substring("rest", q + 1, q).alias("chunk"),
        F.concat(F.left("rest", q), F.substring("rest", 2 * q + 1, F.length("rest"))).alias("left_over"),
    )
    return _stepped(longer, first, second)


def _grams(other: DataFrame) -> DataFrame:
    """Grams of ``rest`` in the places where a chunk of a word longer by ``less`` can stand.

    A chunk can only keep its place or move to the left by one, since the longer word gives it. It moves
    if the lost code point stood before it. The second chunk in its own place needs no row where a code
    point is lost: the loss is behind it then, and the first chunk is whole too.
    """
    less = F.col("less")
    q = F.floor((F.length("rest") + less) / 2).cast("int")
    first = F.struct(
        F.lit("0").alias("slot"), F.left("rest", q).alias("chunk"), F.substring("rest", q + 1, F.length("rest")).alias("left_over")
    )
    second = F.struct(
        F.lit("1").alias("slot"), F.substring("rest", q - less + 1, q).alias("chunk"),
        F.concat(F.left("rest", q - less), F.substring("rest", 2 * q - less + 1, F.length("rest"))).alias("left_over"),
    )
    return _stepped(other, first, second)


def _stepped(df: DataFrame, *steps) -> DataFrame:
    rows = df.withColumn("_s", F.explode(F.array(*steps)))
    return rows.withColumns({
        "slots": F.concat("slots", "_s.slot"), "chunks": F.concat("chunks", "_s.chunk"), "rest": F.col("_s.left_over")
    }).drop("_s")


KEY = ["size", "slots", "chunks"]


def near_pairs(words: DataFrame, group: int = GROUP) -> DataFrame:
    """``a, a_n, b, b_n``: every pair of distinct words at one inserted, deleted or replaced code point, once.

    ``words`` has distinct ``word`` of two code points or more, and ``n``. The size of a group in the
    join is held under ``group`` pairs by splitting what the words have beside the common chunk; where
    nothing is left to split, all words of a group differ in one place only and its pairs are results.
    """
    start = words.select("word", "n", F.length("word").alias("size"), F.lit("").alias("slots"), F.lit("").alias("chunks"), F.col("word").alias("rest"))
    longer = _chunks(start)
    less = start.withColumn("less", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("size", F.col("size") + F.col("less"))
    other = _grams(less)
    found = []
    while True:
        sizes = (
            longer.select(*KEY, F.lit(1).alias("x"), F.lit(0).alias("y"), (F.length("rest") > 1).cast("int").alias("more"))
            .unionByName(other.select(*KEY, F.lit(0).alias("x"), F.lit(1).alias("y"), F.lit(0).alias("more")))
            .groupBy(*KEY).agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.max("more").alias("more"))
            .where((F.col("x") > 0) & (F.col("y") > 0))
        )
        full = (F.col("x") * F.col("y") > group) & (F.col("more") > 0)
        sizes = materialize(sizes.select(*KEY, full.alias("full")), "groups")
        small = sizes.where(~F.col("full")).select(*KEY)
        found.append(_verified(longer.join(small, KEY, "left_semi"), other))
        hot = sizes.where("full").select(*KEY)
        if hot.isEmpty():
            break
        longer = materialize(_chunks(longer.join(hot, KEY, "left_semi")), "chunks")
        other = materialize(_grams(other.join(hot, KEY, "left_semi")), "grams")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _verified(longer: DataFrame, other: DataFrame) -> DataFrame:
    a = longer.select(*KEY, F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = other.select(*KEY, F.col("word").alias("b"), F.col("n").alias("b_n"), "less")
    return (
        a.join(b, KEY)
        .where((F.col("less") == 1) | (F.col("a") < F.col("b")))
        .where(F.levenshtein("a", "b", 1) == 1)
        .select("a", "a_n", "b", "b_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of acyclic ``word, form`` rows: the end of each chain, by doubling the steps taken."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        then = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialize(now.join(then, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(now)
        now = moved
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def group_variants(counts: DataFrame, least_count: int = LEAST_COUNT, ratio: int = 2, group: int = GROUP) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word that occurs ``least_count`` times.

    ``counts`` has distinct ``word`` and ``n``; null words and words of one code point are left out. A
    word's form is its near word of largest ``n``, the smallest in code-point order of several, if it
    occurs ``ratio`` (at least 2) times as often; ``root`` is where the forms lead. An empty table gives
    no rows.
    """
    words = materialize(counts.where((F.col("n") >= least_count) & (F.length("word") > 1)).select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_pairs(words, group)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    )).alias("p")).select("p.*")
    alone = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("minus_n"), F.col("near").alias("near"))))
    table = materialize(
        both.unionByName(alone).groupBy("word", "n").agg(F.count("near").alias("n_near"), best.alias("best"))
        .withColumn("is_form", F.coalesce(-F.col("best.minus_n") >= ratio * F.col("n"), F.lit(False)))
        .select(
            "word", "n", "n_near", F.when(F.col("is_form"), F.col("best.near")).alias("form"),
            F.when(F.col("is_form"), -F.col("best.minus_n")).alias("form_n"),
        ),
        "variants",
    )
    ends = roots(table.where(F.col("form").isNotNull()).select("word", "form"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
