import collections
import random
import re


from odd import no_docs, odd_docs, prose  # noqa: F401

from candlemill.llm import mixing


def fill(sizes, weights, most):
    """Targets by resharing what is above the caps, again and again."""
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(most * sizes[k] for k in capped)
        weight = sum(w for k, w in enumerate(weights) if k not in capped)
        targets = [most * s if k in capped else rest * weights[k] / weight for k, s in enumerate(sizes)]
        more = {k for k, t in enumerate(targets) if k not in capped and t > most * sizes[k]}
        if not more:
            return targets
        capped |= more


def test_targets_and_budgets(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng, rng.randrange(0, 60)), f"s{rng.choice([0] * 12 + list(range(9)))}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    size = collections.Counter()
    for _, text, source in rows:
        size[source] += len(text.split())
    names = sorted(size)
    want = dict(zip(names, fill([size[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 3), strict=True))
    taken = collections.Counter()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == size[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == round(want[s]) for s in names)
    assert sum(taken.values()) - sum(size.values()) in range(-9, 10)
    again = mixing.mix(df.repartition(7)).select("doc_id", "taken").collect()
    assert sorted(again) == sorted((r.doc_id, r.taken) for r in got)


def test_mixed_documents_give_the_words_taken(spark):
    rng = random.Random(2)
    rows = [(k, "  ".join([prose(rng, 5), prose(rng, rng.randrange(40))]) + "\n", f"s{k % 7 % 3}", k) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")
    taken = {r.doc_id: r.taken for r in mixing.mix(df).select("doc_id", "taken").collect()}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    given = collections.Counter()
    texts = {r[0]: r[1] for r in rows}
    for r in out.collect():
        given[r.doc_id] += len(r.text.split())
        assert texts[r.doc_id].startswith(r.text)
        assert re.sub(r"\s", "", r.text) in re.sub(r"\s", "", texts[r.doc_id])
    assert given == {k: v for k, v in taken.items() if v}


def test_odd_rows(odd_docs, no_docs):
    got = mixing.mix(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r.size == 0 and r.taken == 0 for r in got if not r.text)
    assert {r.source_size for r in got if r.source is None} == {91}
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
    empty = mixing.mix(odd_docs.where("text is null"))
    assert [r.target for r in empty.collect()] == [0.0, 0.0]
    assert mixing.mixed_documents(odd_docs).columns == odd_docs.columns
