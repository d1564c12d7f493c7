"""Language profiles and the quality classifier."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from odd import no_docs, odd_docs  # noqa: F401

from candlemill.llm import language, queries, quality
from candlemill.llm.text import slices

SMALL = "/root/testdata/sf0.001"


def test_gram_counts_equal_a_plain_count():
    text = "Ab, ab! é1x"
    codes, counts = language.gram_counts(text)
    blank = " ab ab é x "
    want = {}
    for n in (1, 2, 3):
        for i in range(len(blank) - n + 1):
            gram = blank[i : i + n]
            if n > 1 or gram != " ":
                want[gram] = want.get(gram, 0) + 1
    assert sorted(counts.tolist()) == sorted(want.values()) and len(codes) == len(want)


def test_pieces_of_a_long_text_count_alike(monkeypatch):
    text = "lorem ipsum dolor " * 40
    whole = dict(zip(*[x.tolist() for x in language.gram_counts(text)], strict=True))
    monkeypatch.setattr(language, "_PIECE", 18 * 7)
    assert dict(zip(*[x.tolist() for x in language.gram_counts(text)], strict=True)) == whole


def test_counts_of_few_texts_are_held_at_once(monkeypatch):
    texts = [f"some words of text {k:04} and {chr(97 + k % 26) * 5}{chr(97 + k % 7) * 3}" for k in range(400)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"] * 200, "text": texts})
    merge, most = language._merge, []
    monkeypatch.setattr(language, "HELD", 1000)
    monkeypatch.setattr(language, "_merge", lambda codes, counts: most.append(sum(map(len, codes))) or merge(codes, counts))
    got = {(n, g): k for b in language.counted([batch]) for n, g, k in zip(*b.to_pydict().values(), strict=True)}
    want = Counter()
    for name, text in zip(batch.column(0).to_pylist(), texts, strict=True):
        for g, k in zip(*language.gram_counts(text), strict=True):
            want[name, int(g)] += int(k)
    assert got == want
    assert max(most) < 1000 + len(want) + 100


def test_language_on_held_out_documents(spark):
    got = queries.op6_language_rank_order(spark, SMALL)
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(truth, "doc_id").collect()
    assert len(held) > 40
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in held)


def test_language_of_odd_rows(odd_docs, no_docs):
    profiles = language.learn_profiles(odd_docs)
    assert set(profiles) == {"en", "fr"}
    got = language.identify(odd_docs, profiles).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert (r.lang_pred == "und" and r.score == 0) == (not r.text or r.doc_id == 5)
    assert {r.lang_pred for r in language.identify(odd_docs, {}).collect()} == {"und"}
    assert language.learn_profiles(no_docs) == {} and language.identify(no_docs, profiles).count() == 0


def test_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(40, 8, replace=False)) + (0 if k % 2 else 20) for k in range(60)]
    y = np.array([1 if k % 2 else -1 for k in range(60)])
    scale = np.ones(quality.SLOTS)
    w = quality._descend(rows, y, scale, 400, 1.0)

    def loss(v):
        margins = np.array([v[x].sum() / np.sqrt(8) + v[-1] for x in rows])
        return 0.5 * v @ v + np.maximum(0, 1 - y * margins).sum()

    best = loss(w)
    for _ in range(50):
        step = np.zeros_like(w)
        step[rng.integers(0, 60, 5)] = rng.normal(0, 0.02, 5)
        assert loss(w + step) >= best - 1e-3


def test_quality_on_held_out_documents(spark):
    got = queries.op4_quality_nbsvm(spark, SMALL)
    truth = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality")
    held = got.where("held_out").join(truth, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.75
    assert got.count() == 200 and got.where("score < 0 or score > 1 or predicted <> cast(score >= 0.7 as int)").count() == 0


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(1, 1), (1, 1), (2, 0), (3, None), (None, 1), (4, 1), (8, 0), (7, 0), (7, 1)], "doc_id long, quality int"
    )
    sample = quality.labelled_sample(odd_docs, labels, "quality").collect()
    assert sorted(r.label for r in sample) == [0, 0, 1, 1]
    model = quality.learn(odd_docs, labels)
    got = quality.score(odd_docs, model)
    assert got.count() == odd_docs.count() and got.where("score is null").count() == 0
    assert got.where("doc_id = 8").select("score").distinct().count() == 1
    nothing = quality.learn(odd_docs, labels.where("false"))
    assert {r.score for r in quality.score(odd_docs, nothing).collect()} == {0.5}
    assert quality.score(no_docs, model).count() == 0
    assert quality.labelled_sample(odd_docs, labels, "quality", fit=2).count() == 2


def test_held_out_rule(spark):
    df = spark.range(8).withColumn("doc_id", F.when(F.col("id") > 0, F.col("id")))
    import zlib

    got = {r.id: r.h for r in df.select("id", queries.held_out("doc_id", 4, 2).alias("h")).collect()}
    assert got == {k: k > 0 and zlib.crc32(str(k).encode()) % 4 == 2 for k in range(8)}


def test_hash_is_stable():
    seen = np.zeros(quality.SLOTS, bool)
    rng = random.Random(1)
    text = "".join(rng.choice("abc é") for _ in range(500))
    assert (quality.indicators(text, seen) == quality.indicators(text, seen)).all() and not seen.any()


def test_slices_keep_every_row():
    batches = [pa.RecordBatch.from_pydict({"k": list(range(a, a + n))}) for a, n in ((0, 1201), (1201, 0), (1201, 3))]
    found = list(slices(batches))
    assert max(b.num_rows for b in found) <= 500 and [k for b in found for k in b.column(0).to_pylist()] == list(range(1204))
