import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd import no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from candlemill.llm import collocations, queries

SF = "/root/testdata/sf0.001"


def brute(rows, least=30, top=2_000, share=80):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if a >= least}
        dropped = {
            p[i : i + k] for p in some for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * some[p] >= share * some[p[i : i + k]]
        }
        rows = []
        for p, a in some.items():
            if len(p) > 1 and p not in dropped:
                score, k = min((2_000_000 * a // (some[p[:k]] + some[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), some[p[:k]], some[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(2)
    words = ["the", "The", "of", "new", "york", "city", "é", "naïve", "漢", "a$", "x" * 40, "Émile", " "] + [f"w{k}" for k in range(30)]
    sets = ["new york city", "new york city hall", "in a\tnew york", "of the of the of", "to be or not"]
    rows = []
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(30)):
            parts.append(rng.choice(sets) if rng.random() < 0.3 else rng.choice(words[: rng.choice((4, 43))]))
            parts.append(rng.choice((" ", "  ", "\t", ". ", "!", "\n", "\r\n", " , ")) if rng.random() < 0.4 else " ")
        rows.append(("".join(parts), rng.choice(("en", "en", "fr", None))))
    return rows + [(None, "en"), ("", None), ("...", "de"), ("\t \t", "de")]


@pytest.mark.parametrize(
    "options", [{}, {"chunk": 2_000, "bits": 1, "dense": 3}, {"chunk": 500, "bits": 3, "dense": 20}, {"least": 2, "top": 7}, {"least": 5, "share": 50}]
)
def test_equal_to_brute_force(spark, phrases, options):
    df = spark.createDataFrame(phrases, "text string, lang string").repartition(3)
    rules = {k: v for k, v in options.items() if k in ("least", "top", "share")}
    assert got(collocations.collocations(df, **options)) == brute(phrases, **rules)


def test_documents(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(queries.op13_collocations(spark, SF)) == brute(rows)


def test_dense_sparse_and_far_tiles_count_alike():
    rng = np.random.default_rng(1)
    for top in (20, 3_000, 1 << 45):
        a, b = (rng.integers(0, 40, (2, 5_000)) ** 3 * (top // 64_000 + 1)) % top
        want = Counter(zip(a.tolist(), b.tolist(), strict=True))
        for dense in (1, 100, 10**9):
            found = Counter()
            for x, y, cells, counts in collocations.count_cells(a, b, bits=4, head=3, dense=dense):
                assert (np.diff(cells) > 0).all()
                left, right = collocations._pairs_of(x, y, cells, 4, 3)
                for u, v, n in zip(left.tolist(), right.tolist(), counts.tolist(), strict=True):
                    found[u, v] += n
            assert found == want


def test_tiles_a_chunk_do_not_grow_with_the_ids():
    rng = np.random.default_rng(3)
    most = (collocations.HEAD + collocations.BEYOND) ** 2
    for n in (1_000, 20_000, 400_000, 3_000_000, 1 << 30):
        a, b = rng.integers(0, n, (2, 40_000))
        wide = collocations.tile_bits(n)
        assert ((n - 1 - (collocations.HEAD << collocations.BITS)) >> wide) < collocations.BEYOND
        tiles = [(x, y, collocations._cells(collocations._packed(c)), k) for x, y, c, k in collocations.count_cells(a, b, wide=wide)]
        assert len(tiles) <= most
        found = Counter()
        for x, y, cells, counts in tiles:
            left, right = collocations._pairs_of(x, y, cells, collocations.BITS, wide=wide)
            found.update(dict(zip(zip(left.tolist(), right.tolist(), strict=True), counts.tolist(), strict=True)))
        assert found == Counter(zip(a.tolist(), b.tolist(), strict=True))


def test_many_ids_in_wider_tiles(spark):
    rng = random.Random(5)
    rows = [(" ".join(f"w{int(rng.random() ** 2 * 700)}" for _ in range(120)), "en") for _ in range(150)] * 2
    df = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    _, levels = collocations.count_phrases(df, least=2, chunk=3_000, bits=1)
    assert collocations.tile_bits(levels[1].count(), 1) > 1 + collocations.WIDER
    assert got(collocations.collocations(df, least=2, chunk=3_000, bits=1)) == brute(rows, least=2)


def test_sums_above_64_bits_are_exact(spark):
    big = 9 * 10**18
    df = spark.createDataFrame([(big, big, big), (big - 1, big, big), (10**18 + 7, 3 * 10**18, 5), (30, 30, 31)], "a long, l long, r long")
    for r in df.withColumn("s", collocations._score(F.col("a"), F.col("l"), F.col("r"))).collect():
        assert r.s == 2_000_000 * r.a // (r.l + r.r)


def test_odd_rows(odd_docs, no_docs):
    odd = odd_docs.withColumns({"id": F.lit(1), "word": F.lit("x"), "a": F.lit(1), "f": F.lit(2.0), "phrase": F.lit("x")})
    rows = [(r.text, r.lang) for r in odd.collect()]
    assert got(collocations.collocations(odd, least=3, chunk=10_000)) == brute(rows, least=3)
    assert collocations.collocations(no_docs).count() == 0
