"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRAMS = (1, 2, 3)
PROFILE = 300  # n-grams kept per language and per document
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_BITS = 21  # a code point
_PIECE = 1_000_000  # characters counted at once
HELD = 500_000  # counts of single texts that a task holds before it adds them up


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Code points in lower case with every run of other characters than letters as one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    points = np.where(_letters()[points], points, np.uint32(32))
    edge = np.full(1, 32, np.uint32)
    points = np.concatenate([edge, points, edge])
    blank = points == 32
    return points[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]


def _merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(codes) == 1:
        return codes[0], counts[0]
    unique, place = np.unique(np.concatenate(codes), return_inverse=True)
    return unique, np.bincount(place, np.concatenate(counts)).astype(np.int64)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of letters and word ends, as numbers, with their counts."""
    codes, counts = [], []
    whole = _codes(text) if text and _LETTER.search(text) else np.zeros(0, np.uint32)
    for k in range(0, len(whole), _PIECE):
        points = whole[k : k + _PIECE + GRAMS[-1] - 1].astype(np.int64)
        grams = []
        for n in GRAMS:
            size = min(_PIECE, len(points) - n + 1)  # those that begin in this piece
            code = points[:size]
            for j in range(1, n):
                code = (code << _BITS) | points[j : size + j]
            grams.append(code if n > 1 else code[code != 32])
        found, number = np.unique(np.concatenate(grams), return_counts=True)
        codes.append(found)
        counts.append(number)
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _merge(codes, counts)


def top_grams(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order; equal counts by their number."""
    return codes[np.lexsort((codes, -counts))[:size]]


def counted(batches):
    """Per batch of ``lang, text`` the counts of its n-grams by language."""
    for batch in batches:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        held, waiting = {}, 0

        def add():
            for language, (codes, counts) in held.items():
                if language in sums:
                    codes, counts = [sums[language][0], *codes], [sums[language][1], *counts]
                sums[language] = _merge(codes, counts)
            held.clear()

        for language, whole in zip(*batch.columns, strict=True):
            codes, counts = gram_counts(whole.as_py())
            if len(codes):
                kept = held.setdefault(language.as_py(), ([], []))
                kept[0].append(codes)
                kept[1].append(counts)
                waiting += len(codes)
                if waiting > HELD:
                    add()
                    waiting = 0
        add()
        for language, (found, number) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(found), pa.string()), pa.array(found), pa.array(number)],
                ["lang", "gram", "n"],
            )


def learn_profiles(
    docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE
) -> dict[str, list[int]]:
    """Rank profile per language over all texts of ``docs`` with a language.

    N-grams are counted in every task, added up by language and n-gram, and the top ``size`` of
    each language are brought to the driver: languages times ``size`` rows. A task never holds more
    than ``HELD`` counts and one text's beside the sums of its batch.
    """

    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = (
        docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text)
        .mapInArrow(counted, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= size)
        .collect()
    )
    profiles: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Profiles:
    """Language profiles looked up by n-gram."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE) -> None:
        self.names = sorted(profiles)
        self.size = size
        grams = sorted({g for p in profiles.values() for g in p})
        self.grams = np.array(grams, np.int64)
        place = {g: k for k, g in enumerate(grams)}
        self.ranks = np.full((len(grams) + 1, len(self.names)), -1, np.int64)  # the last row: no such n-gram
        for k, name in enumerate(self.names):
            for rank, g in enumerate(profiles[name]):
                self.ranks[place[g], k] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language at the least out-of-place distance, and 1 minus that distance's share of the most."""
        codes, counts = gram_counts(text)
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        top = top_grams(codes, counts, self.size)
        at = np.searchsorted(self.grams, top)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == top, at, len(self.grams))
        ranks = self.ranks[at]
        away = np.abs(ranks - np.arange(len(top))[:, None])
        distance = np.where(ranks < 0, self.size, away).sum(0)
        best = int(distance.argmin())  # equal distances: the first name
        return self.names[best], float(1 - distance[best] / (self.size * len(top)))


def identify(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", size: int = PROFILE) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1), from whole texts.

    A text that is null or has no letter, and any text if nothing was learnt, is ``und`` with score
    0. Equal distances go to the first name. Repeated rows get equal answers. Columns named like a
    result are replaced. An empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "score")
    names, place = docs.columns, docs.columns.index(text)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    bundle = docs.sparkSession.sparkContext.broadcast(Profiles(profiles, size))  # languages x size numbers

    def predict(batches):
        learnt = bundle.value
        for batch in batches:
            found = [learnt.predict(t.as_py()) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*names, "lang_pred", "score"],
            )

    return docs.mapInArrow(predict, f"{kinds}, lang_pred string, score double")
