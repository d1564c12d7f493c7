"""Tables that every operator has to stand."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, items int, score string"


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join("w%d" % rng.randrange(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing extra columns."""
    rng = random.Random(5)
    long = prose(rng, 60_000, 5_000)
    rows = [
        (1, prose(rng, 120), "en", "a", 9, "x", 1, "s"), (1, prose(rng, 80), "en", "a", 9, "x", 1, "s"),
        (2, None, "en", "a", None, None, None, None), (3, "", None, "b", 0, "x", 1, "s"),
        (None, prose(rng, 90), "en", None, 1, "x", 1, "s"), (None, None, None, None, None, None, None, None),
        (4, long, "en", "b", 1, "x", 1, "s"), (5, "!!! 123 ???", "en", "b", 1, "x", 1, "s"),
        (6, "é", "fr", None, 1, "x", 1, "s"), (7, long + " tail", "en", "c", 1, "x", 1, "s"),
    ]
    rows += [(8, "one two three four five six seven", "en", "c", 1, "x", 1, "s")] * 3
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
