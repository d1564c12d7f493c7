import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from odd import no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from candlemill.llm import bpe, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH, PATTERN, cache=300)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=encoder.ranks.ranks, special_tokens={})


def texts(seed, n):
    rng = random.Random(seed)
    parts = ["a", "b", "ab", "\n", " ", "  ", "\t", "é", "漢", "字", "'s", "aa", "00", "1", "$$", "the", "ing", "​", "😀", "a" * 50, "İ", "ß"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(150))) for _ in range(n)]
    out += ["".join(chr(rng.randrange(1, 0x3000)) for _ in range(80)) for _ in range(n // 5)]
    return [*out, "", "a" * 20_000, "ab" * 9_999, " " * 3_333 + "x", "<|endoftext|>"]


def test_ids_equal_the_library(encoder, library):
    for seed in range(3):  # the second and third time with remembered words
        got = encoder.encode(texts(seed % 2, 1_000)).to_pylist()
        assert got == library.encode_ordinary_batch(texts(seed % 2, 1_000))


def test_replay_equals_word_by_word(encoder, library):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzéàèß"
    words = ["".join(rng.choice(letters[: rng.choice((2, 3, 30))]) for _ in range(rng.randrange(1, 40))).encode() for _ in range(6_000)]
    for word, ids in zip(words, encoder.ranks.replay(words), strict=True):
        assert ids.tolist() == encoder.ranks.word(word).tolist() == library.encode_ordinary(word.decode())


def test_order_of_places_matters_where_a_merge_makes_a_lower_rank(tmp_path):
    """Here the pair that a merge makes goes before the merge's own other places."""
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"bcab", b"bca", b"ab", b"cab", b"abc"]
    rng = random.Random(1)
    for k in range(12):
        rng.shuffle(order := list(range(256, len(tokens))))
        ranks = {t: r for t, r in zip(tokens, [*range(256), *order], strict=True)}
        path = tmp_path / f"{k}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
        own = bpe.Ranks(str(path))
        library = tiktoken.Encoding("own", pat_str="[a-z]+", mergeable_ranks=ranks, special_tokens={})
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 25))).encode() for _ in range(400)]
        for word, ids in zip(words, own.replay(words), strict=True):
            assert ids.tolist() == library.encode_ordinary(word.decode()) == own.word(word).tolist()


def test_query_digests(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op11_byte_bpe(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_odd_rows(odd_docs, no_docs, library):
    clashing = odd_docs.withColumns({"ids": F.lit("x"), "decoded": F.lit(1)})
    for together in (1, 1 << 20):
        rows = bpe.decode(bpe.encode(clashing, PATH, PATTERN, together=together), PATH).collect()
        assert len(rows) == odd_docs.count()
        for r in rows:
            assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.digests(bpe.decode(bpe.encode(no_docs, PATH, PATTERN), PATH)).count() == 0
    null = bpe.decode(spark_row(odd_docs.sparkSession), PATH).first()
    assert null.decoded is None


def spark_row(spark):
    return spark.createDataFrame([(None,)], "ids array<int>")
