"""Jaccard join, near vectors, and the components both rest on."""

import random
from itertools import combinations

import numpy as np
import pytest
from odd import no_docs, odd_docs, prose  # noqa: F401

from candlemill.llm import jaccard, pairs, vectors
from candlemill.llm.graph import components


def union(nodes, links):
    name = {n: n for n in nodes}
    for a, b in links:
        x, y = sorted((name[a], name[b]))
        name = {n: x if c == y else c for n, c in name.items()}
    return name


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 260)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union({n for ab in links if ab[0] != ab[1] for n in ab}, links)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_joins_what_is_linked():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = 30
        linked = np.triu(rng.random((n, n)) < 0.03, 1)
        every = np.arange(n)
        label = pairs.forest(linked, every, every, n)
        want = union(range(n), list(zip(*np.nonzero(linked), strict=True)))
        assert label.tolist() == [want[k] for k in range(n)]


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = "new%d" % rng.randrange(10**6)
    return " ".join(words)


def planted(rng):
    rows = []
    shared = prose(rng, 60, 10**6)
    for _ in range(25):
        base = prose(rng, rng.randrange(6, 200), 10**6)
        rows += [base] * rng.randrange(1, 4) + [edited(rng, base, rng.randrange(4)) for _ in range(rng.randrange(4))]
    rows += [prose(rng, rng.randrange(60, 100), 10**6) + " " + shared for _ in range(40)]
    dense = prose(rng, 150, 10**6)
    rows += [edited(rng, dense, 1) for _ in range(40)]
    rows += ["a", "a", "A!", "b c", None, "", "one two three four five six"]
    return list(enumerate(rows))


def test_jaccard_join_equals_brute_force(spark, monkeypatch):
    rows = planted(random.Random(3))
    sets = {k: set(jaccard.shingle_set(t).tolist()) for k, t in rows}
    links = [
        (a, b) for a, b in combinations(sets, 2)
        if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    ]
    name = union(sets, links)
    count = {k: 0 for k in sets}
    for ab in links:
        for k in ab:
            count[k] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for limit in (1000, 15):  # whole buckets, then splits, dense buckets and tiles
        monkeypatch.setattr(jaccard.split_buckets, "__defaults__", (limit, jaccard.DEPTH))
        monkeypatch.setattr(pairs.blocks, "__defaults__", (512 if limit == 1000 else 8,))
        got = jaccard.jaccard_join(df).collect()
        assert {r.doc_id: (r.n_links, r.class_id, r.kept) for r in got} == {
            k: (count[k], name[k], name[k] == k) for k in sets
        }
    left = jaccard.one_of_each(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(name.values()))


def test_jaccard_of_odd_rows(odd_docs, no_docs):  # noqa: F811
    got = jaccard.jaccard_join(odd_docs).collect()
    assert len(got) == odd_docs.count()
    of = {r.doc_id: r for r in got}
    assert of[7].class_id == 4 and not of[7].kept and of[4].n_links == 1
    assert of[8].n_links == 2 and of[8].class_id == 8 and of[3].n_links == 0
    assert all(r.class_id is None and r.kept for r in got if r.doc_id is None)
    kept = jaccard.one_of_each(odd_docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "4", "5", "6", "8", "None", "None"]
    assert jaccard.jaccard_join(no_docs).count() == 0 and jaccard.one_of_each(no_docs).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, node string"


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(40):
        base = rng.normal(size=16)
        rows += [(base + rng.normal(scale=s, size=16)) for s in rng.choice([0, 0.02, 0.1, 0.2], rng.integers(1, 5))]
    hot = rng.normal(size=16)
    rows += [hot + rng.normal(scale=0.04, size=16) for _ in range(150)]
    x = np.array(rows, np.float32)
    label = rng.integers(0, 2, len(x))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = (u @ u.T >= vectors.COSINE) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    name = union(range(len(x)), list(zip(*np.nonzero(near), strict=True)))
    df = spark.createDataFrame([(k, v.tolist(), int(l), "x") for k, (v, l) in enumerate(zip(x, label, strict=True))], VECTORS)
    got = vectors.near_vectors(df.repartition(3), neighbours=16).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {
        k: (int(near[k].sum()), name[k], name[k] == k) for k in range(len(x))
    }


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 2.0]
    rows = [
        (1, one, 1, "x"), (2, [2.0, 4.0], 1, "x"), (3, one, 2, "x"), (4, one, None, "x"), (5, None, 1, "x"), (6, [], 1, "x"),
        (7, [0.0, 0.0], 1, "x"), (8, [1.0, None], 1, "x"), (9, [nan, 1.0], 1, "x"), (10, [inf, 1.0], 1, "x"),
        (None, one, 1, "x"), (11, [1.0, 2.0, 0.0], 1, "x"), (12, one, 2, "x"), (12, one, 2, "x"), (13, [-1.0, -2.0], 1, "x"),
    ]
    got = vectors.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: r.component_id for r in got if r.vec_id != r.component_id} == {2: 1, 12: 3}
    assert {r.vec_id: r.n_links for r in got if r.n_links} == {1: 1, 2: 1, 3: 2, 12: 2}
    assert all(r.kept == (r.vec_id == r.component_id or r.vec_id is None) for r in got)
    assert vectors.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def pairs_in_a_cluster(n, planted, cosine, d=32, seed=9):
    """Unit vectors around one direction, any two at about ``cosine``, and partners at 0.981 for the first ``planted``."""
    rng = np.random.default_rng(seed)

    def unit(v):
        return v / np.linalg.norm(v, axis=-1, keepdims=True)

    middle = unit(rng.normal(size=d))
    x = unit(np.sqrt(cosine) * middle + np.sqrt(1 - cosine) * unit(rng.normal(size=(n, d))))
    some = x[:planted]
    away = rng.normal(size=some.shape)
    away = unit(away - (away * some).sum(1, keepdims=True) * some)
    return np.concatenate([x, 0.981 * some + np.sqrt(1 - 0.981**2) * away])


def test_pairs_in_a_dense_cluster_are_found(spark):
    n, planted = 2500, 200
    x = pairs_in_a_cluster(n, planted, 0.8)
    near = x @ x.T >= vectors.COSINE
    np.fill_diagonal(near, False)
    name = union(range(len(x)), list(zip(*np.nonzero(near), strict=True)))
    assert near.sum() >= 2 * planted
    df = spark.createDataFrame([(k, v.tolist(), 1, "x") for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int, node string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df.repartition(4)).collect()}
    asked = range(0, len(x), 20)  # queries against all rows
    assert sum(got[k][0] for k in asked) >= 0.99 * near[list(asked)].sum()
    assert sum(got[k] != (int(near[k].sum()), name[k]) for k in range(len(x))) <= 2


def test_rows_no_pass_can_part_are_compared_with_all(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MOST_PASSES", vectors.FIRST)
    x = pairs_in_a_cluster(700, 60, 0.97)
    near = x @ x.T >= vectors.COSINE
    np.fill_diagonal(near, False)
    name = union(range(len(x)), list(zip(*np.nonzero(near), strict=True)))
    df = spark.createDataFrame([(k, v.tolist(), 1, "x") for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int, node string")
    got = vectors.near_vectors(df.repartition(3), neighbours=8).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {k: (int(near[k].sum()), name[k]) for k in range(len(x))}


def test_passes_reach_the_recall():
    assert vectors.passes_for([]) == 0
    assert vectors.passes_for([(40, 10**9)]) == 1
    needed = [vectors.passes_for([(k, 10**6)]) for k in (8, 0, -8, -16)]
    assert needed == sorted(needed) and needed[-1] < vectors.MOST_PASSES
    assert vectors.passes_for([(None, 1), (8, 99)]) == vectors.MOST_PASSES  # one row in a hundred cannot be found
    assert jaccard.runs_for(1) == 5
