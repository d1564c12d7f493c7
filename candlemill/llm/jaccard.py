"""Jaccard join of word n-gram sets by chosen paths."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.llm.graph import components
from candlemill.llm.pairs import blocks, cell_links, forest
from candlemill.llm.text import groups, mix, shingle_hashes, slices, words
from candlemill.session import materialize

SHINGLE = 5  # words
SIMILARITY = 0.8
RECALL = 0.9999  # of a pair at the least similarity
BRANCH = 2.0  # shared tokens that such a pair is expected to choose at each split
DEPTH = 3  # splits after which a bucket is compared in tiles
BUCKET = 1000  # nodes of a bucket that are compared at once
SKETCH = 128  # min-hashes per set
NEAR = 0.65  # similarity of sketches from which the sets themselves are compared

_RNG = np.random.default_rng(20240517)
_MIN = (_RNG.integers(0, 1 << 62, SKETCH).astype(np.uint64) * np.uint64(2) + np.uint64(1))[:, None]


def runs_for(depth: int, recall: float = RECALL, branch: float = BRANCH) -> int:
    """Runs after which a pair has met with probability ``recall`` if buckets are split ``depth`` times."""
    meets = (1 - math.exp(-branch)) ** depth
    return math.ceil(math.log(1 - recall) / math.log(1 - meets))


RUNS = runs_for(DEPTH)
_TURNS = _RNG.integers(0, 1 << 62, (DEPTH, RUNS)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words of a whole text, in lower case."""
    return np.unique(shingle_hashes(words(text.lower() if text else None), n))


def node_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def sketch(tokens: np.ndarray) -> bytes:
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(tokens), 4096):
        least = np.minimum(least, mix(tokens[None, k : k + 4096] * _MIN).min(1))
    return least.astype(np.uint16).tobytes()


def paths(tokens: np.ndarray, similarity: float) -> list[list[int]]:
    """Chosen tokens by split and run: each token with a probability that shrinks with the set.

    A pair at the least similarity or above is expected to choose ``BRANCH`` shared tokens at least,
    whatever its sizes: the choice depends on the token alone, up to the threshold.
    """
    share = min(1.0, BRANCH / (similarity * len(tokens)))
    most = np.uint64(min(int(share * 2.0**64), (1 << 64) - 1))
    out = []
    for depth in range(DEPTH):
        for run in range(RUNS):
            turned = mix(tokens ^ _TURNS[depth, run])
            out.append(turned[turned <= most].view(np.int64).tolist())
    return out


def prepared(docs: DataFrame, text: str, doc_id: str, similarity: float, n: int) -> DataFrame:
    """``id, node, size, sketch, paths`` of the rows with an id and at least a word."""

    def run(batches):
        for batch in slices(batches):
            out = []
            for name, whole in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                tokens = shingle_set(whole, n)
                if len(tokens):
                    out.append((name, node_of(tokens), len(tokens), sketch(tokens), paths(tokens, similarity)))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "node", "size", "sketch", "paths"]
            )

    return docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long"), text).mapInArrow(
        run, "id long, node binary, size long, sketch binary, paths array<array<long>>"
    )


def split_buckets(nodes: DataFrame, limit: int = BUCKET, depth: int = DEPTH) -> tuple[DataFrame, DataFrame | None]:
    """Buckets ``bucket, node, tile`` of nodes to be compared, and links ``a, b`` found on the way.

    Every split sends the nodes of a bucket that is too large on to the buckets of the tokens that
    they choose next. A bucket full of near copies would not shrink: its nodes are held against its
    least node first, and if few are unlike it, these alone are compared with all. Otherwise the
    unlike nodes are split on, with those near nodes that can be near one of them (``_against_least``).
    Runs are added until the recall holds at the depth that was needed. What is still too large
    after the last split is compared in tiles, all of them, so nothing is dropped.
    """
    done = links = None
    runs, first, needed = range(runs_for(1)), True, 1
    while True:
        level = None
        for k in range(depth):
            chosen = nodes.select(
                "node", F.explode(F.array(*[
                    F.struct(F.lit(r).alias("run"), F.element_at("paths", k * RUNS + r + 1).alias("tokens")) for r in runs
                ])).alias("p"),
            ).select("node", "p.run", F.explode("p.tokens").alias("token"))
            if level is None:
                rows = chosen.select("node", "run", F.xxhash64("run", "token").alias("bucket"))
            else:
                rows = materialize(level.join(chosen, ["node", "run"]).select(
                    "node", "run", F.xxhash64("bucket", "token").alias("bucket")
                ), "split")
            sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
            sized = materialize(rows.join(sizes, "bucket"), "buckets")
            small = sized.where(F.col("n") <= limit).select("bucket", "node", F.lit(0).alias("tile"))
            done = small if done is None else done.unionByName(small)
            level = sized.where(F.col("n") > limit)
            if level.isEmpty():
                break
            probed = materialize(_against_least(level, nodes), "probed")
            near = probed.where("near").select(F.col("node").alias("a"), F.col("least").alias("b"))
            links = near if links is None else links.unionByName(near)
            rest = probed.where("not near").groupBy("bucket").agg(
                F.count("*").alias("unlike"), F.min("apart").alias("nearest")
            )
            open_ = probed.join(rest, "bucket").where(F.col("apart") >= F.col("nearest") - int((1 - NEAR) * SKETCH))
            few = open_.where(F.col("unlike") <= 2 * limit)
            tiles = F.ceil(F.col("n") / limit).cast("int")
            own = F.pmod(F.xxhash64("node"), tiles).cast("int")
            done = done.unionByName(few.withColumn(
                "tile", F.explode(F.when(F.col("near"), F.array(own)).otherwise(F.sequence(F.lit(0), tiles - 1)))
            ).select("bucket", "node", "tile"))
            level = open_.where(F.col("unlike") > 2 * limit).select("bucket", "node", "run", "n")
            if level.isEmpty():
                break
            needed = max(needed, k + 2)
        else:
            tiles = F.ceil(F.col("n") / (limit // 2)).cast("int")
            own = F.pmod(F.xxhash64("node"), tiles).cast("int")
            cells = level.withColumn("_own", own).withColumn("_with", F.explode(F.sequence(F.lit(0), tiles - 1)))
            done = done.unionByName(cells.select(
                "bucket", "node", (F.least("_own", "_with") * tiles + F.greatest("_own", "_with") + 1).alias("tile")
            ))
        if not first or runs_for(min(needed, depth)) <= len(runs):
            return done, links
        first, runs = False, range(len(runs), runs_for(min(needed, depth)))


def _against_least(level: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of large buckets with their bucket's ``least`` node, how far ``apart`` they are and whether ``near``.

    ``apart`` counts the places where two sketches differ, which obeys the triangle inequality. So a
    node can only be near one that is unlike the least node if it is itself far enough from that node.
    """
    held = level.select("bucket", "node", "run", "n").join(nodes.select("node", "sketch"), "node")
    least = level.groupBy("bucket").agg(F.min("node").alias("least"))
    sketches = least.join(nodes.select(F.col("node").alias("least"), F.col("sketch").alias("_other")), "least")

    def run(batches):
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, SKETCH) for k in (5, 6)
            )
            apart = (a != b).sum(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(apart, pa.int32()), pa.array(SKETCH - apart >= NEAR * SKETCH)],
                ["bucket", "node", "run", "n", "least", "apart", "near"],
            )

    return held.join(sketches, "bucket").select("bucket", "node", "run", "n", "least", "sketch", "_other").mapInArrow(
        run, "bucket long, node binary, run int, n long, least binary, apart int, near boolean"
    )


def alike(sketches: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of rows may be similar, from sizes and sketches."""
    n = len(sketches)
    out = np.zeros((n, n), bool)
    for k in range(0, n, 32):  # a few rows at once: their comparison takes most of the memory
        some, own = sketches[k : k + 32], sizes[k : k + 32, None]
        near = (some[:, None, :] == sketches[None, :, :]).sum(2, dtype=np.int16) >= NEAR * SKETCH
        out[k : k + 32] = near & (np.minimum(own, sizes) >= similarity * np.maximum(own, sizes))
    return out


def candidates(nodes: DataFrame, buckets: DataFrame, similarity: float) -> DataFrame:
    """Links ``a, b`` of possibly similar nodes, as a forest per bucket."""

    def run(batches):
        for _, rows in groups(batches, ["bucket", "tile"]):
            if len(rows) < 2:
                continue
            near = alike(
                np.array([np.frombuffer(r["sketch"], np.uint16) for r in rows]),
                np.array([r["size"] for r in rows]), similarity,
            )
            every = np.arange(len(rows))
            label = forest(near, every, every, len(rows))
            moved = np.flatnonzero(label != every)
            if len(moved):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([rows[i]["node"] for i in moved], pa.binary()),
                        pa.array([rows[i]["node"] for i in label[moved]], pa.binary()),
                    ],
                    ["a", "b"],
                )

    return (
        buckets.join(nodes.select("node", "size", "sketch"), "node")
        .select("bucket", "tile", "node", "size", "sketch")
        .repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", "node")
        .mapInArrow(run, "a binary, b binary")
    )


def similar(left: list[bytes], right: list[bytes], similarity: float) -> np.ndarray:
    """Which sets of ``left`` and ``right`` have at least the Jaccard similarity."""
    a = [np.frombuffer(x, np.uint64) for x in left]
    b = [np.frombuffer(x, np.uint64) for x in right]
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    shared = np.zeros((len(a), len(b)))
    if len(a) * len(b) <= 64:
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                shared[i, j] = np.isin(x, y, assume_unique=True).sum()
    else:
        known, place, count = np.unique(np.concatenate(a + b), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(a) + len(b)), np.concatenate([n, m]))
        keep = count[place] > 1
        row, place = row[keep], (np.cumsum(count > 1) - 1)[place[keep]]
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        width = 4096
        for k in range(0, int(place[-1]) + 1 if len(place) else 0, width):
            at = slice(*np.searchsorted(place, [k, k + width]))
            holds = np.zeros((len(a) + len(b), width), np.float32)
            holds[row[at], place[at] - k] = 1
            shared += holds[: len(a)] @ holds[len(a) :].T
    return shared >= similarity * (n[:, None] + m[None, :] - shared) - 1e-9


def jaccard_join(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, n: int = SHINGLE,
) -> DataFrame:
    """One row per document: ``doc_id, n_links, class_id, kept``.

    Two documents link if their sets of word ``n``-grams have the Jaccard similarity or more;
    ``class_id`` is the smallest id reachable by links, ``n_links`` counts a document's links.
    Documents of equal sets are one node with a weight, so copies are never paired. Chosen paths and
    sketches find candidates; their components are compared set by set in blocks, so that all links
    inside a component are found, and classes are the components of verified links.

    A null or empty text, and a text without words, links with nothing; fewer than ``n`` words make
    one n-gram. A row without id has a null class and is kept. Rows of one id have one class. Ties
    are settled by the smallest id. An empty table gives no rows. Other columns are not looked at.
    """
    rows = materialize(prepared(docs, text, doc_id, similarity, n), "sets")
    nodes = materialize(
        rows.groupBy("node").agg(
            F.min("id").alias("least"), F.count("*").alias("weight"),
            *[F.first(c).alias(c) for c in ("size", "sketch", "paths")],
        ),
        "nodes",
    )
    buckets, links = split_buckets(nodes)
    found = candidates(nodes, buckets, similarity)
    clusters = materialize(components(found if links is None else found.unionByName(links)), "clusters")

    def sets(batches):
        for batch in slices(batches):
            out = []
            for node, weight, whole in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                tokens = shingle_set(whole, n)
                if node_of(tokens) == node:  # another text of the same id is another node
                    out.append((node, weight, tokens.tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.binary()), strict=True)],
                ["node", "weight", "payload"],
            )

    wanted = clusters.select("node").join(nodes.select("node", "least", "weight"), "node")
    held = (
        docs.select(F.col(doc_id).cast("long").alias("least"), F.col(text).alias("text")).join(wanted, "least")
        .select("node", "weight", "text").mapInArrow(sets, "node binary, weight long, payload binary")
        .dropDuplicates(["node"])
    )
    cells = blocks(clusters.select("node", F.col("component").alias("cluster")))
    linked = materialize(
        cell_links(cells.join(held, "node"), lambda a, b: similar(a, b, similarity), "binary"), "verified"
    )
    counts = linked.groupBy("node").agg(F.sum("n_links").alias("_links"))
    found = materialize(
        components(linked.where(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b"))),
        "classes",
    )
    named = found.join(nodes.select("node", "least"), "node")
    names = named.groupBy("component").agg(F.min("least").alias("_name"))
    part = found.join(names, "component").select("node", "_name")
    per_node = nodes.select("node", "least", "weight").join(part, "node", "left").join(counts, "node", "left").select(
        "node", F.coalesce("_name", "least").alias("_class"),
        (F.coalesce("_links", F.lit(0)) + F.col("weight") - 1).alias("_links"),
    )
    answer = rows.select(F.col("id").alias("doc_id"), "node").join(per_node, "node").groupBy("doc_id").agg(
        F.max("_links").alias("_links"), F.min("_class").alias("_class")
    )
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id")).join(answer, "doc_id", "left")
    name = F.coalesce("_class", "doc_id")
    return out.select(
        "doc_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), name.alias("class_id"),
        F.coalesce(F.col("doc_id") == name, F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stand for their class, in its columns; rows without id stay.

    Of repeated rows of one id one stays.
    """
    joined = jaccard_join(docs, doc_id=doc_id, **options)
    kept = joined.where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept")).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.where(F.col(doc_id).isNotNull()).join(kept, F.col(doc_id).cast("long") == F.col("_kept"), "left_semi")
    return named.dropDuplicates([doc_id]).select(*columns).unionByName(docs.where(F.col(doc_id).isNull()).select(*columns))
