import corpus_pipeline
from odd import no_docs, odd_docs  # noqa: F401

import __spark_entry__ as entry
from candlemill.llm import decontaminate, jaccard, language, mixing
from candlemill.llm.queries import table

SMALL = "/root/testdata/sf0.001"


def test_stages_and_registration():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights",
        "token-ID / binary output",
    ]
    names = set(entry.queries())
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert {"op1_decontaminate", "op3_mix_sources"} <= set(entry.oracle_sql()) and "pipeline" not in entry.oracle_sql()


def test_stages_on_documents(spark):
    docs = table(spark, SMALL, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, docs = docs, stage(spark, docs, SMALL).cache()
        assert docs.columns == before.columns and docs.schema.simpleString() == before.schema.simpleString()
        kept[name] = (before, docs)
    before, after = kept["language ID"]
    assert before.exceptAll(after.select(*before.columns)).count() < 200
    before, after = kept["n-gram Jaccard join"]
    joined = jaccard.jaccard_join(before)
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in joined.collect() if r.kept}
    before, after = kept["benchmark decontamination"]
    bad = decontaminate.find_contamination(before, table(spark, SMALL, "benchmark")).where("contaminated")
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == {r.doc_id for r in bad.collect()}
    before, after = kept["mixing sources to target weights"]
    words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert words(after) == sum(r.taken for r in mixing.mix(before).collect())
    last = corpus_pipeline.STAGES[4][1](spark, docs, SMALL)
    assert last.count() == docs.count()


def test_odd_rows(spark, odd_docs, no_docs):  # noqa: F811
    for docs, left in ((odd_docs, {1, 4, 6, 8, None}), (no_docs, set())):
        for _, stage in corpus_pipeline.STAGES[:3]:
            docs = stage(spark, docs, SMALL)
        assert {r.doc_id for r in docs.collect()} == left
    assert language.learn_profiles(no_docs) == {}
