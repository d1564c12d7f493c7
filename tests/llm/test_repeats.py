"""Repeated substrings and near-duplicate passages."""

import random

import numpy as np
import pytest
from odd import no_docs, odd_docs, prose  # noqa: F401

from candlemill.llm import passages, substrings
from candlemill.llm.text import SEGMENT, gram_hashes, shingle_hashes, words


def test_order_is_sorted():
    rng = random.Random(1)
    for _ in range(200):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 40))]
        for shallow in (0, 8, 16):
            order = substrings.deep_shallow(strings, shallow)
            assert sorted(order) == list(range(len(strings))) and [strings[k] for k in order] == sorted(strings)


def removed(texts, least):
    """Ranges per text, from a count of every run."""
    count = {}
    data = [(t or "").encode() for t in texts]
    for d in data:
        for k in range(len(d) - least + 1):
            count[d[k : k + least]] = count.get(d[k : k + least], 0) + 1
    out = []
    for d in data:
        hit = np.zeros(len(d) + 2, bool)
        for k in range(len(d) - least + 1):
            if count[d[k : k + least]] > 1:
                hit[k + 1 : k + least + 1] = True
        edges = np.flatnonzero(hit[1:] != hit[:-1])
        out.append(list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)))
    return out


def repeats(rng):
    shared = [prose(rng, 30, 90) for _ in range(4)]
    texts = [None, "", "short", "z" * 900, "ab" * 300]
    for _ in range(60):
        parts = [prose(rng, rng.randrange(1, 30), 90)]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            parts += [s[a : a + rng.randrange(20, len(s))], prose(rng, rng.randrange(1, 20), 90)]
        texts.append(rng.choice(["é", " ", ""]).join(parts))
    return texts + texts[10:14] + texts[10:11]


@pytest.mark.parametrize("hot", [substrings.HOT, 2])
def test_removed_bytes_equal_brute_force(spark, hot):
    texts = repeats(random.Random(2))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in substrings.remove_repeats(df, least=90, hot=hot).collect()}
    for k, (t, want) in enumerate(zip(texts, removed(texts, 90), strict=True)):
        assert [(s.start, s.stop) for s in got[k].removed] == want, k
        data = (t or "").encode()
        cut = b"".join(data[a:b] for a, b in zip([0, *[e for _, e in want]], [*[s for s, _ in want], len(data)], strict=True))
        assert got[k].n_bytes == len(data) and bytes(got[k].kept) == cut


def test_anchors_of_pieces_are_those_of_the_whole(monkeypatch):
    rng = random.Random(3)
    data = prose(rng, 900, 40).encode()
    spread = lambda found: {(int(p), s) for p, _, a, b in found for p, a, b in zip(p, a, b, strict=True) for s in range(a, b + 1)}
    whole = spread(substrings.anchors(data))
    assert {s for _, s in whole} == set(range(len(data) - substrings.LEAST + 1))
    monkeypatch.setattr(substrings, "PIECE", 700)
    assert spread(substrings.anchors(data)) == whole


def test_odd_rows(odd_docs, no_docs):  # noqa: F811
    out = substrings.remove_repeats(odd_docs).collect()
    assert len(out) == odd_docs.count()
    of = {r.doc_id: r for r in out}
    assert [(s.start, s.stop) for s in of[4].removed] == [(0, of[4].n_bytes)]
    assert [(s.start, s.stop) for s in of[7].removed] == [(0, of[4].n_bytes)] and bytes(of[7].kept) == b" tail"
    assert of[8].removed == [] and of[2].n_bytes == 0 and of[5].removed == []
    assert substrings.remove_repeats(no_docs).count() == 0
    got = passages.near_passages(odd_docs).collect()
    assert {(r.doc_id, r.start, r.stop) for r in got} == {(4, 0, 60_000), (7, 0, 60_001)} or {
        (r.doc_id, r.start, r.stop) for r in got
    } == {(4, 0, 60_000), (7, 0, 60_000)}
    assert passages.near_passages(no_docs).count() == 0


def test_compact_windows_cover_every_long_run_once():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n, width = int(rng.integers(1, 60)), int(rng.integers(1, 20))
        hashes = rng.integers(0, 12, n).astype(np.uint64)
        found = passages.windows(hashes, width)
        for i in range(n):
            for j in range(i + width - 1, n):
                least = i + int(hashes[i : j + 1].argmin())
                assert sum(a <= i <= c <= j <= b and c == least for a, c, b in found) == 1


def test_long_texts_hash_like_short_ones(monkeypatch):
    tokens = words(prose(random.Random(5), 900))
    whole = shingle_hashes(tokens, 5)
    assert len(set(whole.tolist())) == len({tuple(tokens[k : k + 5]) for k in range(896)})
    monkeypatch.setattr("candlemill.llm.text.SEGMENT", 70)
    assert (shingle_hashes(tokens, 5) == whole).all() and SEGMENT > 70


def test_passages(spark):
    rng = random.Random(6)
    fresh = lambda n: prose(rng, n, 10**7)
    same, near, copy = fresh(60), fresh(120), fresh(70)
    changed = near.split()
    changed[60] = "other"
    rows = [
        (1, f"{fresh(100)} {same} {fresh(90)}"), (2, f"{same.upper()} {fresh(200)}"), (3, f"{fresh(30)} {same}"),
        (4, f"{fresh(80)} {near} {fresh(10)}"), (5, f"{fresh(9)} {' '.join(changed)} {fresh(70)}"),
        (6, copy), (7, copy), (8, fresh(300)), (9, f"{fresh(60)} {' '.join(same.split()[:40])} {fresh(60)}"),
        (10, None), (11, fresh(40)), (12, " ".join([fresh(55)] * 1)),
    ]
    rows += [(100 + k, f"{fresh(20)} {same} {fresh(20)}") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for group in (passages.GROUP, 8):
        got = {}
        for r in passages.near_passages(df, group=group).collect():
            got.setdefault(r.doc_id, []).append((r.start, r.stop))
        want = {1: (100, 160), 2: (0, 60), 3: (30, 90), 4: (80, 200), 5: (9, 129), 6: (0, 70), 7: (0, 70)}
        want |= {100 + k: (20, 80) for k in range(30)}
        assert got == {k: [v] for k, v in want.items()}


def test_passages_at_the_least_similarity_are_found(spark):
    rng = random.Random(8)
    fresh = lambda n: prose(rng, n, 10**7)
    rows = []
    for k in range(120):  # 41 of 51 n-grams in common: 0.804
        words_ = fresh(50).split()
        changed = words_[:25] + ["other%d" % k] + words_[26:]
        rows += [(2 * k, f"{fresh(20)} {' '.join(words_)} {fresh(20)}"), (2 * k + 1, f"{fresh(20)} {' '.join(changed)} {fresh(20)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.start, r.stop) for r in passages.near_passages(df).collect())
    assert got == [(k, 20, 70) for k in range(240)]
    assert 0.2 ** passages.functions_for() <= 1 - passages.RECALL


def test_passages_that_repeat_inside_are_found(spark):
    rng = random.Random(9)
    fresh = lambda n: prose(rng, n, 10**7)
    line = fresh(25).split()
    changed = line + line[:15] + ["other"] + line[16:]  # 25 of 30 distinct n-grams in common
    a, b = (shingle_hashes(words(" ".join(t)), 5) for t in (line * 2, changed))
    assert (len(a), len(set(a)), len(set(a) & set(b)), len(set(a) | set(b))) == (46, 25, 25, 30)
    rows = [(1, " ".join(line * 2)), (2, " ".join(changed)), (3, fresh(90))]
    got = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.start, r.stop) for r in got} == {(1, 0, 50), (2, 0, 50)}
    more = np.concatenate([a, b, a[:9]])
    assert passages.fewest(more, 46) == min(len(set(more[k : k + 46])) for k in range(len(more) - 45))


def test_the_floor_leaves_no_partner_out():
    rng = np.random.default_rng(10)
    for _ in range(60):
        least, base = 12, rng.integers(0, int(rng.choice([5, 9, 40])), 24)
        contexts = []
        for _ in range(8):
            c = np.where(rng.random(24) < 0.08, rng.integers(50, 99, 24), base)
            at = 12
            c[at] = 100
            contexts.append((c.astype(np.uint32), at))
        every = range(len(contexts))
        got = passages.similar_runs(contexts, [1] * len(contexts), least, 0.8)
        for k in every:
            near = any(passages.verified(*contexts[k], *contexts[o], least, 0.8) for o in every if o != k)
            assert got[k] or not near


def test_passages_with_an_edit_near_an_end_are_found(spark):
    rng = random.Random(11)
    fresh = lambda n: prose(rng, n, 10**7)
    rows, want = [], []
    for k in range(30):  # 43 of 49 n-grams in common
        words_, at = fresh(50).split(), 2 if k % 2 else 47
        changed = words_[:at] + ["other%d" % k] + words_[at + 1 :]
        rows += [(2 * k, f"{fresh(20)} {' '.join(words_)} {fresh(20)}"), (2 * k + 1, f"{fresh(20)} {' '.join(changed)} {fresh(20)}")]
        want += [(d, 23, 70) if k % 2 else (d, 20, 67) for d in (2 * k, 2 * k + 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((r.doc_id, r.start, r.stop) for r in passages.near_passages(df).collect()) == want


def test_windows_of_many_texts_are_those_of_each():
    rng = random.Random(12)
    texts = [" ".join("w%d" % rng.randrange(v) for _ in range(rng.randrange(120))) for v in [1, 2, 3, 30, 1000, 10**6] * 5]
    grams, bounds = gram_hashes(texts, 5)
    assert [len(set(grams[a:b].tolist())) for a, b in zip(bounds, bounds[1:], strict=False)] == [
        len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) for w in map(words, texts)
    ]
    for width in (2, 5, 12, 46):
        long = np.diff(bounds) >= width
        own = grams[np.repeat(long, np.diff(bounds))]
        ends = np.concatenate([[0], np.cumsum(np.diff(bounds)[long])])
        want = [
            (max(left, c - width) + a, c + a, min(right, c + width) + a)
            for a, b in zip(ends, ends[1:], strict=False) for left, c, right in passages.windows(own[a:b], width)
        ]
        assert list(zip(*passages.compact(own, ends, width), strict=True)) == want


def runs_of(a, at, b, bt, least, similarity):
    """Places that any two similar runs share, from all pairs of runs."""
    found = set()
    for i in range(at + 1):
        for j in range(max(at, i + least - 1), len(a)):
            for p in range(bt + 1):
                for q in range(max(bt, p + least - 1), len(b)):
                    x, y = set(a[i : j + 1]), set(b[p : q + 1])
                    if len(x & y) >= similarity * len(x | y) - 1e-9:
                        found |= {k for k in range(i, j + 1) if a[k] in y}
    return found


def test_runs_are_those_of_all_pairs_of_runs():
    rng, hits = np.random.default_rng(13), 0
    for trial in range(120):
        least, similarity, contexts = int(rng.integers(3, 7)), (0.6, 0.8)[trial % 2], []
        base = rng.integers(0, int(rng.choice([6, 12, 1000])), 2 * least + 2)
        for _ in range(int(rng.integers(2, 5))):
            c, at = base.tolist(), least + 1
            c[at] = 5000
            for _ in range(int(rng.integers(3))):  # words are replaced, put in, taken out, swapped
                k, other, kind = int(rng.integers(len(c))), int(rng.integers(len(c))), rng.integers(4)
                if k == at or other == at:
                    continue
                if kind == 1:
                    c.insert(k, int(rng.integers(6000, 9000)))
                    at += k <= at
                elif kind == 2 and len(c) > least + 2:
                    c.pop(k)
                    at -= k < at
                else:
                    c[k], c[other] = (c[other], c[k]) if kind == 3 else (int(rng.integers(6000, 9000)), c[other])
            low = max(0, at - least)
            contexts.append((np.array(c[low : at + least + 1], np.uint32), at - low))
        got = passages.similar_runs(contexts, [1] * len(contexts), least, similarity)
        for k, (a, at) in enumerate(contexts):
            near = set().union(*(
                runs_of(a.tolist(), at, b.tolist(), bt, least, similarity) for o, (b, bt) in enumerate(contexts) if o != k
            ))
            assert got[k] == ([(min(near) - at, max(near) - at)] if near else [])
            hits += bool(near)
    assert hits > 50


def test_equal_and_covered_windows_are_not_compared(spark, monkeypatch):
    rows, write = [], passages.materialize

    def kept(df, name="stage", *codec):
        out = write(df, name, *codec)
        if name == "windows":
            rows.append((out.count(), out.where("asking").count() if "asking" in out.columns else out.count()))
        return out

    monkeypatch.setattr(passages, "materialize", kept)
    rng = random.Random(15)
    texts = [prose(rng, 300, 10**7) for _ in range(4)] * 3
    texts = [f"{t} {prose(rng, 10, 10**7)}" for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.stop) for r in passages.near_passages(df).collect())
    assert got == [(k, 0, 300) for k in range(12)]
    assert rows[0][1] < rows[0][0] / 2  # only those that reach the different ends
    assert sum(r[1] for r in rows[1:]) < 2 * rows[0][0]  # of five functions


def test_tables_of_texts_and_places_are_small(spark, monkeypatch):
    seen, write = {}, substrings.materialize

    def kept(df, name="stage", *codec):
        out = write(df, name, *codec)
        seen[name] = (df.columns, [f.rsplit("-", 1)[-1].split(".", 1)[1] for f in out.inputFiles()])
        return out

    monkeypatch.setattr(substrings, "materialize", kept)
    texts = repeats(random.Random(3))
    substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), least=90).count()
    assert seen["anchors"][0] == ["node", "at", "gram"]  # a hash of node and place is not stored with them
    for name in ("anchors", "contexts"):
        assert seen[name][1] and all(f == "zstd.parquet" for f in seen[name][1])
