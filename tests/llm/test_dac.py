import random
import zlib

import numpy as np
import pytest
from odd import no_docs, odd_docs, prose  # noqa: F401

from candlemill.llm import dac
from candlemill.llm.queries import tokenizer_path


@pytest.mark.parametrize("ids", [
    [], [0], [255, 256, 65535, 65536, 2**32 - 1], list(range(0, 70_000, 13)), [300] * 1500, [1, 2, 3] * 700,
])
def test_round_trip_and_access(ids):
    chunks, more, ranks = dac.encode(np.array(ids, np.uint32))
    assert dac.decode(chunks, more).tolist() == ids
    some = range(len(ids)) if len(ids) < 2000 else random.Random(1).sample(range(len(ids)), 500)
    assert all(dac.access(chunks, more, ranks, i) == ids[i] for i in some)


ODD = [
    "Hello, World.!? it's can't.. foo,.bar  x y\x1cz ÄÖ. Éa., İstanbul ΣΑΣ. <|endoftext|>. <|ENDOFTEXT|> é. ...a.,",
    "", "   ", "a.\n,b\r\n c.\t", "é. ñ,", "don't. 'll 's.' 12,3. x1.", "漢字, かな。 ١٢", " a b.\u0085c", None,
]


@pytest.mark.parametrize("cache", [3, dac.CACHE])
def test_words_give_the_ids_of_whole_texts(spark, cache):
    rng = random.Random(2)
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    words = dac.Words(tokenizer_path(), cache)
    for _ in range(2):
        got = [np.frombuffer(c, "<u4").tolist() for k in range(0, len(texts), 40) for c in words.ids(texts[k : k + 40])]
        want = [words.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert got == want
        rng.shuffle(texts)


def test_known_words_are_not_learnt_again(monkeypatch):
    words = dac.Words(tokenizer_path())
    first = words.ids(["some words. here", "more"])
    monkeypatch.setattr(words, "_learn", lambda names: pytest.fail(f"learnt {names}"))
    assert words.ids(["some words. here", "more"]) == first


def truth(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows]


def test_files(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k * 3 % 101, prose(rng, rng.randrange(120))) for k in range(101)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = str(tmp_path / "ids")
    dac.write_ids(df, path, tokenizer_path(), segment=500)
    rows.sort()
    ids = truth(rows)
    got = {r.doc_id: r for r in dac.read_documents(spark, path).collect()}
    start = 0
    for (name, _), own in zip(rows, ids, strict=True):
        r = got[name]
        crc = zlib.crc32(np.array(own, "<u4").tobytes())
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), crc)
        start += len(own)
    flat = [i for own in ids for i in own]
    asked = [0, 1, 499, 500, len(flat) - 1, *random.Random(4).sample(range(len(flat)), 20)]
    found = dac.read_tokens(spark, path, [*asked, len(flat), -1])
    assert all(found[p] == flat[p] for p in asked) and found[len(flat)] is None and found[-1] is None


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):  # noqa: F811
    path = str(tmp_path / "odd")
    dac.write_ids(odd_docs, path, tokenizer_path())
    got = dac.read_documents(spark, path).collect()
    assert len(got) == odd_docs.count()
    assert sorted(r.start for r in got)[0] == 0 and {r.n_tokens for r in got if r.doc_id in (2, 3)} == {1}
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert sorted(got, key=lambda r: r.start)[0].doc_id is None
    dac.write_ids(no_docs, str(tmp_path / "none"), tokenizer_path())
    assert dac.read_documents(spark, str(tmp_path / "none")).count() == 0
