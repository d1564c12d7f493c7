import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from odd import no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from candlemill.llm import queries, spelling

SMALL = "/root/testdata/sf0.001"


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def counted(rows, alter=97, least=5):
    n = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{word}".encode())
            if alter and h % alter == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least:
                n[word] += 1
    return n


def brute(counts, least=3, ratio=2):
    words = {w: n for w, n in counts.items() if n >= least and len(w) > 1}
    by_size = defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    out = {}
    for w, n in words.items():
        found = [u for k in (-1, 0, 1) for u in by_size[len(w) + k] if near(w, u)]
        best = min(found, key=lambda u: (-words[u], u), default=None)
        out[w] = (best if best is not None and words[best] >= ratio * n else None, n, len(found))
    rows = {}
    for w, (form, n, n_near) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows[w] = (form, root, n, n_near, words.get(form))
    return rows


def as_rows(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.fixture(scope="module")
def hot_words():
    """A third of all words share their first half, a third their second one; others are one or two edits apart."""
    rng = random.Random(3)

    def some(k):
        return "".join(rng.choice("abcd") for _ in range(k))

    counts = {}
    for k in range(250):
        n = rng.choice((3, 3, 4, 6, 7, 12, 50, 2))
        counts["internationalization" + some(rng.randrange(1, 6))] = n
        counts[some(rng.randrange(1, 5)) + "constantinopolitan"] = n + k % 3
        word = some(rng.randrange(2, 8))
        counts[word] = n
        at = rng.randrange(len(word))
        counts[word[:at] + rng.choice("xyzé") + word[at:]] = 3 * n
    return counts


@pytest.mark.parametrize("group", [1, 30, 100_000])
def test_groups_equal_brute_force(spark, hot_words, group):
    df = spark.createDataFrame(list(hot_words.items()), "word string, n long")
    assert as_rows(spelling.group_variants(df, group=group)) == brute(hot_words)


def test_every_pair_once(spark, hot_words):
    words = [w for w in hot_words if len(w) > 1]
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = sorted(tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(df, 20).collect())
    assert got == sorted(tuple(sorted((a, b))) for k, a in enumerate(words) for b in words[:k] if near(a, b))


def test_long_chains_end_at_their_root(spark):
    counts = {"a" * 5 + "b" * k: 3 * 2**k for k in range(12)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = as_rows(spelling.group_variants(df))
    assert got == brute(counts) and {r[1] for r in got.values()} == {"aaaaa" + "b" * 11}


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = as_rows(queries.op12_spelling_variants(spark, SMALL))
    assert got == brute(counted(docs)) and any(v[0] for v in got.values())


def test_odd_rows(odd_docs, no_docs):
    spark = odd_docs.sparkSession
    texts = [(None, "Straße STRASSE straße STRAßE straße"), (9, "×÷×÷× x"), (9, None), (9, ""), (10, "Straze " * 3)]
    docs = odd_docs.select("doc_id", "text", "score").unionByName(
        spark.createDataFrame(texts, "doc_id long, text string").withColumn("score", F.lit("word"))
    )
    for alter in (None, 2, 97):
        got = {r.word: r.n for r in spelling.count_words(docs, alter).collect()}
        assert got == dict(counted([(r.doc_id, r.text) for r in docs.collect()], alter))
    assert as_rows(spelling.group_variants(spelling.count_words(docs))) == brute(counted([(r.doc_id, r.text) for r in docs.collect()], None))
    assert spelling.group_variants(spelling.count_words(no_docs)).count() == 0
    loose = spark.createDataFrame([(None, 5), ("a", 5), ("ab", 5), ("ac", 20)], "word string, n long")
    assert as_rows(spelling.group_variants(loose)) == {"ab": ("ac", "ac", 5, 1, 20), "ac": (None, "ac", 20, 1, None)}
