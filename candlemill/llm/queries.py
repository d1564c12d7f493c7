"""The registered queries of the operators in this subpackage, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlemill.llm import (
    bpe, collocations, dac, decontaminate, jaccard, language, mixing, passages, quality, secrets, spelling, substrings, vectors,
)
from candlemill.plans.registry import Registry
from candlemill.session import table_path

reg = Registry()


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CONTAMINATION_SQL = r"""
WITH dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), iw AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), m AS (
  SELECT doc_id, p, win.n, item_id FROM grams JOIN win ON grams.g = win.g AND grams.n = win.n
), hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS pos FROM m) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM m) GROUP BY doc_id
)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id
"""


@reg.add("op1_decontaminate", CONTAMINATION_SQL)
def op1_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@reg.add("op2_jaccard_join")
def op2_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(concat_ws(':', CAST(doc_id AS VARCHAR), md5(text))) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source COLLATE C) - 1) % 3]::DOUBLE AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 3 * source_size AS cap, 3 * source_size / w AS fills FROM s
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM s)
             - coalesce(sum(cap) OVER (ORDER BY fills, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(w) OVER (ORDER BY fills, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM r
), t AS (
  SELECT source, source_size,
         least(cap::DOUBLE, (SELECT max(lev) FROM l WHERE lev <= fills) * w) AS target
  FROM l
), b AS (
  SELECT source, source_size, target, round(target)::BIGINT AS budget,
         CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs
  FROM t
)
SELECT d.doc_id, d.size, b.source_size, b.target,
       (epochs * size + greatest(0, least(size, budget - epochs * b.source_size
         - coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""


@reg.add("op3_mix_sources", MIX_SQL.replace(" COLLATE C", ""))
def op3_mix_sources(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def held_out(doc_id, parts, rest):
    """Whether crc32 of the id as text leaves ``rest``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == rest, F.lit(False))


@reg.add("op4_quality_nbsvm")
def op4_quality_nbsvm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = docs.where(~held_out("doc_id", 4, 2))
    model = quality.learn(seen, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.withColumn("held_out", held_out("doc_id", 4, 2)), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@reg.add("op6_language_rank_order")
def op6_language_rank_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    seen = docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id", 3, 1))
    profiles = language.learn_profiles(seen)
    asked = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "text")
    return language.identify(asked, profiles).drop("text")


@reg.add("op5_near_passages")
def op5_near_passages(spark, sf_dir):
    found = passages.near_passages(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.col("start").alias("start_word"), F.col("stop").alias("stop_word"),
        (F.col("stop") - F.col("start")).alias("n_words"),
    )


@reg.add("op7_near_vectors")
def op7_near_vectors(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@reg.add("op10_token_dac")
def op10_token_dac(spark, sf_dir):
    path = table_path(spark, "dac")
    dac.write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return dac.read_documents(spark, path)


@reg.add("op8_substring_repeats")
def op8_substring_repeats(spark, sf_dir):
    found = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("removed")
    return found.select(
        "doc_id", "n_bytes",
        F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]).alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@reg.add("op9_secret_scan")
def op9_secret_scan(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.concat(base, "markov")).alias("spans"),
        F.size("markov").cast("long").alias("n_markov"),
    )


@reg.add("op11_byte_bpe")
def op11_byte_bpe(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode(encoded.drop("text"), path))


@reg.add("op12_spelling_variants")
def op12_spelling_variants(spark, sf_dir):
    counts = spelling.count_words(table(spark, sf_dir, "documents"), alter=97)
    return spelling.group_variants(counts)


PHRASE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents WHERE text IS NOT NULL)
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), f AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS p, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3), (4)) AS t(k) WHERE len(w) >= k)
  GROUP BY ALL HAVING count(*) >= 30
), inside AS (
  SELECT DISTINCT lang, part FROM (
    SELECT lang, f, array_to_string(string_split(p, ' ')[i : i + m - 1], ' ') AS part
    FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2))
  ) AS s JOIN (SELECT lang, p AS part, f AS a FROM f) AS c USING (lang, part) WHERE 100 * s.f >= 80 * c.a
), cuts AS (
  SELECT lang, p, f AS a, cut, array_to_string(string_split(p, ' ')[1 : cut], ' ') AS x, array_to_string(string_split(p, ' ')[cut + 1 : k], ' ') AS y
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1)
), best AS (
  SELECT c.lang, c.p, c.a, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score,
         row_number() OVER (PARTITION BY c.lang, c.p ORDER BY 2000000::HUGEINT * c.a // (x.f + y.f), cut) AS place
  FROM cuts AS c JOIN f AS x ON c.lang = x.lang AND c.x = x.p JOIN f AS y ON c.lang = y.lang AND c.y = y.p
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, p) AS rank
  FROM best AS b LEFT JOIN inside ON b.lang = inside.lang AND b.p = inside.part
  WHERE place = 1 AND inside.part IS NULL
)
SELECT lang, rank, p AS phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@reg.add("op13_collocations", PHRASE_SQL)
def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))
