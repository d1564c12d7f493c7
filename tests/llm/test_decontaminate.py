import random

from odd import no_docs, odd_docs  # noqa: F401

from candlemill.llm import decontaminate as d


def brute(doc, items, window):
    hit, names = set(), set()
    for name, item in items:
        size = min(window, len(item))
        for i in range(len(item) - size + 1 if item else 0):
            for p in range(len(doc) - size + 1):
                if doc[p : p + size] == item[i : i + size]:
                    hit |= set(range(p, p + size))
                    names.add(name)
    return hit, names


def test_matches_equal_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        window, letters = rng.choice([2, 3, 4, 5]), rng.choice([2, 3, 4])
        items = [
            (str(i), [b"%d" % rng.randrange(letters) for _ in range(rng.randrange(9))]) for i in range(rng.randrange(1, 6))
        ]
        doc = [b"%d" % rng.randrange(letters + 1) for _ in range(rng.randrange(25))]
        spans, names, longest = d.Items(items, window).match(doc)
        hit, want = brute(doc, items, window)
        assert {x for a, b in spans for x in range(a, b)} == hit and names == want
        assert sum(b - a for a, b in spans) == len(hit)
        runs = {tuple(doc[i:j]) for i in range(len(doc)) for j in range(i, len(doc) + 1)}
        held = {tuple(s[i:j]) for _, s in items for i in range(len(s)) for j in range(i, len(s) + 1)}
        assert longest == max(map(len, runs & held), default=0)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice("ABcd") for _ in range(rng.randrange(30)))) for i in range(12)]
    docs = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(60)))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    one = d.find_contamination(df, bench, window=4)
    monkeypatch.setattr(d, "BLOCK_WORDS", 40)
    monkeypatch.setattr(d, "PIECE_WORDS", 7)
    many = d.find_contamination(df, bench, window=4).select(*one.columns)
    one, many = one.drop("longest_match"), many.drop("longest_match")  # pieces are shorter than items
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    assert {r.doc_id: r.n_hit for r in one.collect()} == {
        i: len(brute(t.split(), [(str(k), s.lower().split()) for k, s in items], 4)[0]) for i, t in docs
    }


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame(
        [(1, None), (2, ""), (None, "one two three four five six seven"), (3, "!!"), (4, "SEVEN"), (4, "ONE two")],
        "item_id long, text string",
    )
    got = d.find_contamination(odd_docs, bench).collect()
    assert len(got) == odd_docs.count()
    eight = [r for r in got if r.doc_id == 8]
    assert len(eight) == 3 and all(r.n_hit == 7 and r.items == ["4"] and r.contaminated for r in eight)
    assert all(r.n_words == 0 and not r.contaminated for r in got if not r.text)
    assert d.find_contamination(no_docs, bench).count() == 0
    clean = d.drop_contaminated(odd_docs, bench.where("false"))
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count()
    assert d.drop_contaminated(odd_docs, bench).where("doc_id = 8").count() == 0


def test_removed_spans(spark):
    docs = spark.createDataFrame([(1, "keep this a b c d, and this"), (2, "nothing Here")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "A b C d")], "item_id long, text string")
    out = d.remove_spans(d.find_contamination(docs, bench, window=3)).collect()
    assert {r.doc_id: r.clean_text for r in out} == {1: "keep this and this", 2: "nothing Here"}
