"""Near-duplicate embeddings by sorted projection passes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlemill.functions.skew import salted_join
from candlemill.llm.graph import components
from candlemill.llm.pairs import BLOCK, blocks, cell_links, forest
from candlemill.llm.text import groups
from candlemill.session import materialize

COSINE = 0.98
NEIGHBOURS = 64  # rows behind a row in a pass's order that it is compared with
STRETCH = 512  # rows of a pass's order that one comparison takes
RECALL = 0.9999  # of pairs at the least cosine
BITS = 62  # random hashes concatenated in one pass
FIRST = 8  # passes whose orders tell how many are needed
MOST_PASSES = 512  # rows that would need more are compared with every row of their label
_SURE = 1 - 1e-13  # chance to find a row's partner where a pass cannot miss it
_STEPS = 8  # buckets per doubling in which the driver sees those chances


def passes_for(odds: list[tuple[int | None, int]], recall: float = RECALL) -> int:
    """Passes after which pairs at the least cosine have met with probability ``recall``.

    ``odds`` are (bucket, rows) of ``row_odds``. The answer is ``MOST_PASSES`` if no less will do.
    """
    rows = sum(n for _, n in odds)
    if not rows:
        return 0
    rate = np.array([0.0 if k is None else 2.0 ** (k / _STEPS) for k, _ in odds])
    share = np.array([n for _, n in odds]) / rows
    for passes in range(1, MOST_PASSES):
        if (share * np.exp(-passes * rate)).sum() <= 1 - recall:
            return passes
    return MOST_PASSES


def _unit(payloads: list[bytes]) -> np.ndarray:
    x = np.array([np.frombuffer(p, np.float64) for p in payloads])
    return x / np.sqrt((x * x).sum(1))[:, None]


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """``id, node, place, payload``: rows that can link.

    ``node`` stands for equal vectors of one label, ``place`` for label and dimension.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for name, vector, group in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if vector is None or group is None or name is None or not vector or any(v is None for v in vector):
                    continue
                x = np.array(vector, np.float64)
                if not np.isfinite(x).all() or not x.any():
                    continue
                x = x + 0.0  # -0 to 0
                x = x / np.abs(x).max() if not 1e-100 < np.abs(x).max() < 1e100 else x
                rows.append((name, f"{group}:{len(x)}", x.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([hashlib.blake2b(r[1].encode() + b"|" + r[2], digest_size=16).digest() for r in rows], pa.binary()),
                    pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary()),
                ],
                ["id", "node", "place", "payload"],
            )

    return vectors.select(
        F.col(vec_id).cast("long"), F.col(embedding).cast("array<double>"), F.col(label).cast("string")
    ).mapInArrow(run, "id long, node binary, place string, payload binary")


def centres(nodes: DataFrame) -> DataFrame:
    """``place, centre``: the mean of the unit vectors of every label and dimension."""

    def run(batches):
        for batch in batches:
            at: dict[str, list[bytes]] = {}
            for place, payload in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                at.setdefault(place, []).append(payload)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(at), pa.string()), pa.array([len(v) for v in at.values()], pa.int64()),
                    pa.array([_unit(v).sum(0).tolist() for v in at.values()], pa.list_(pa.float64())),
                ],
                ["place", "n", "total"],
            )

    sums = nodes.select("place", "payload").mapInArrow(run, "place string, n long, total array<double>")
    means = sums.select("place", "n", F.posexplode("total").alias("pos", "part")).groupBy("place", "pos").agg(
        (F.sum("part") / F.sum("n")).alias("mean"))
    parts = F.sort_array(F.collect_list(F.struct("pos", "mean")))  # as long as a vector
    return means.groupBy("place").agg(F.transform(parts, lambda p: p["mean"]).alias("centre"))


def hashed(nodes: DataFrame, middle: DataFrame, first: int, end: int) -> DataFrame:
    """``node, place, spread, orders``: sort keys of the passes from ``first`` up to ``end``.

    Each pass has ``BITS`` random directions of its own; the signs of the projections of a vector's
    distance from its label's centre, concatenated, are its key. ``spread`` is that distance squared.
    """

    def run(batches):
        planes: dict[tuple[int, int], np.ndarray] = {}
        power = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            node, place, payload, centre = [c.to_pylist() for c in batch.columns]
            size = np.array([len(c) for c in centre])
            for d in np.unique(size).tolist():
                some = np.flatnonzero(size == d)
                x = _unit([payload[k] for k in some]) - np.array([centre[k] for k in some])
                keys = []
                for turn in range(first, end):
                    if (d, turn) not in planes:
                        planes[d, turn] = np.random.default_rng([17, d, turn]).standard_normal((d, BITS))
                    keys.append((x @ planes[d, turn] > 0) @ power)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([node[k] for k in some], pa.binary()), pa.array([place[k] for k in some], pa.string()),
                        pa.array((x * x).sum(1)), pa.array(np.array(keys).T.tolist(), pa.list_(pa.int64())),
                    ],
                    ["node", "place", "spread", "orders"],
                )

    return salted_join(nodes.select("node", "place", "payload"), middle, ["place"], "node").select(
        "node", "place", "payload", "centre"
    ).mapInArrow(run, "node binary, place string, spread double, orders array<long>")


def _ranked(keys: DataFrame) -> DataFrame:
    """``keys`` with ``rank``, their place in one total order, from a range partitioning."""
    n = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["turn", "place", "bits", "node"]
    held = materialize(
        keys.repartitionByRange(n, *order).sortWithinPartitions(*order)
        .withColumn("_task", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "order",
    )
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy("_task").agg(F.count("*").alias("_n")).select(  # one row per task
        "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    return held.join(starts, "_task").withColumn("rank", F.col("_start") + F.col("_row")).drop("_task", "_row", "_start")


def window_links(
    keys: DataFrame, nodes: DataFrame, cosine: float = COSINE, neighbours: int = NEIGHBOURS, stretch: int = STRETCH
) -> DataFrame:
    """``a, b, meet``: links between rows at most ``neighbours`` apart in a pass's order, as forests.

    The order of every pass is cut into stretches; each has the ``neighbours`` rows before and behind it
    too, so that no neighbour is lost at a cut or between tasks. Besides, each row and pass gives a row
    without ``b``: ``meet`` is the chance that a partner of ``a`` at the least cosine is among its
    neighbours. It is if it has one bit more in common with ``a`` than the rows at both ends of the
    window. An end row that is itself linked with ``a`` sets no such condition, because links lead on.
    """
    ranked = _ranked(keys.select(F.posexplode("orders").alias("turn", "bits"), "place", "node", "spread"))
    first, last = F.floor((F.col("rank") - neighbours) / stretch), F.floor((F.col("rank") + neighbours) / stretch)
    cut = ranked.withColumn("_at", F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("long"), last.cast("long"))))

    def run(batches):
        for _, rows in groups(batches, ["_at"]):
            rank = np.array([r["rank"] for r in rows])
            lead = (rank // stretch) == rows[0]["_at"]
            side = {}
            kind = np.array([side.setdefault((r["turn"], r["place"]), len(side)) for r in rows])
            linked = np.zeros((len(rows), len(rows)), bool)
            for k in range(len(side)):
                at = np.flatnonzero(kind == k)
                x = _unit([rows[i]["payload"] for i in at])
                linked[np.ix_(at, at)] = x @ x.T >= cosine
            led = np.flatnonzero(lead)
            if not len(led):
                continue  # only rows that reach over from the last stretch
            common = np.full(len(rows), -1)
            for i in led:
                for k in (i - neighbours, i + neighbours):
                    if 0 <= k < len(rows) and kind[k] == kind[i] and not linked[i, k]:
                        common[i] = max(common[i], BITS - (rows[i]["bits"] ^ rows[k]["bits"]).bit_length())
            spread = np.maximum([r["spread"] for r in rows], 1e-300)
            agree = 1 - np.arccos(np.maximum(-1.0, 1 - (1 - cosine) / spread)) / np.pi
            meet = np.minimum(agree ** (common + 1.0), _SURE)
            away = rank[None, :] - rank[:, None]
            linked &= (away > 0) & (away <= neighbours) & lead[:, None]
            every = np.arange(len(rows))
            label = forest(linked, every, every, len(rows))
            moved = np.flatnonzero(label != every)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i]["node"] for i in moved] + [rows[i]["node"] for i in led], pa.binary()),
                    pa.array([rows[i]["node"] for i in label[moved]] + [None] * len(led), pa.binary()),
                    pa.array([None] * len(moved) + meet[led].tolist(), pa.float64()),
                ],
                ["a", "b", "meet"],
            )

    return (
        cut.join(nodes.select("node", "payload"), "node")
        .select("_at", "rank", "turn", "place", "bits", "spread", "node", "payload")
        .repartition("_at").sortWithinPartitions("_at", "rank")
        .mapInArrow(run, "a binary, b binary, meet double")
    )


def row_odds(links: DataFrame) -> DataFrame:
    """``node, rate``: minus the log of the chance that a pass misses a partner of the node at the least cosine."""
    meet = F.least(F.avg("meet"), F.lit(_SURE))
    return links.where("b is null").groupBy(F.col("a").alias("node")).agg((-F.log1p(-meet)).alias("rate"))


def links_with_all(hard: DataFrame, nodes: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` of the nodes ``hard`` with every node of their place, as forests of blocks."""
    sizes = nodes.groupBy("place").agg(F.count("*").alias("_n")).join(
        hard.groupBy("place").agg(F.count("*").alias("_h")), "place"
    ).select("place", F.ceil(F.col("_n") / block).cast("int").alias("_n"), F.ceil(F.col("_h") / block).cast("int").alias("_h"))

    def side(df, own, of, other, to):
        return salted_join(df.select("node", "place", "payload"), sizes, ["place"], "node").select(
            "place", F.pmod(F.xxhash64("node"), F.col(of)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(to) - 1)).alias(other), "node", "payload")

    cells = side(hard, "_i", "_h", "_j", "_n").withColumn("_hard", F.lit(True)).unionByName(
        side(nodes, "_j", "_n", "_i", "_h").withColumn("_hard", F.lit(False)))

    def run(batches):
        for _, rows in groups(batches, ["place", "_i", "_j"]):
            left, right = [r for r in rows if r["_hard"]], [r for r in rows if not r["_hard"]]
            if not left or not right:
                continue
            names = sorted({r["node"] for r in rows})
            at = {n: k for k, n in enumerate(names)}
            linked = _unit([r["payload"] for r in left]) @ _unit([r["payload"] for r in right]).T >= cosine
            label = forest(linked, np.array([at[r["node"]] for r in left]), np.array([at[r["node"]] for r in right]), len(names))
            moved = np.flatnonzero(label != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[k] for k in moved], pa.binary()), pa.array([names[k] for k in label[moved]], pa.binary())],
                ["a", "b"],
            )

    return (
        cells.select("place", "_i", "_j", "_hard", "node", "payload")
        .repartition("place", "_i", "_j").sortWithinPartitions("place", "_i", "_j")
        .mapInArrow(run, "a binary, b binary")
    )


def pass_links(nodes: DataFrame, cosine: float, neighbours: int, recall: float) -> DataFrame:
    """Links ``a, b`` of all passes. The first ones tell from every row how many follow."""
    middle = materialize(centres(nodes), "centres")

    def turns(first, end):
        keys = materialize(hashed(nodes, middle, first, end), "keys")
        return materialize(window_links(keys, nodes, cosine, neighbours), "near")

    seen = turns(0, FIRST)
    odds = materialize(row_odds(seen), "odds")
    bucket = F.when(F.col("rate") > 0, F.floor(F.log2("rate") * _STEPS)).cast("int")  # null where no pass helps
    passes = passes_for([tuple(r) for r in odds.groupBy(bucket.alias("k")).count().collect()], recall)  # a few hundred rows
    links = seen.where("b is not null").select("a", "b")
    if passes > FIRST:
        links = links.unionByName(turns(FIRST, passes).where("b is not null").select("a", "b"))
    if passes == MOST_PASSES:
        hard = odds.where(F.exp(-F.col("rate") * passes) > 1 - recall)
        links = links.unionByName(links_with_all(materialize(nodes.join(hard, "node", "left_semi"), "hard"), nodes, cosine))
    return links


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    cosine: float = COSINE, neighbours: int = NEIGHBOURS, recall: float = RECALL,
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors of one label link at a cosine of at least ``cosine``, in double precision. Equal vectors
    count as one node with a weight. Sorted passes give verified links, in as many passes as the recall
    takes on these vectors, however they are spread; their union gives components;
    inside each component every pair is then compared in blocks, so that ``n_links`` has no limit
    from the windows.

    Null ids and labels, and vectors that are null, empty, zero or hold null or non-finite parts,
    link with nothing; so do vectors of different length. A row without id has a null component and
    is kept. Rows of one id count as vectors of their own and have one component. An empty table
    gives no rows. Other columns are not looked at.
    """
    rows = materialize(usable(vectors, vec_id, embedding, label), "vectors")
    nodes = materialize(
        rows.groupBy("node").agg(
            F.min("id").alias("least"), F.count("*").alias("weight"),
            F.first("place").alias("place"), F.first("payload").alias("payload"),
        ),
        "nodes",
    )
    found = materialize(components(pass_links(nodes, cosine, neighbours, recall)), "clusters")
    cells = blocks(found.select("node", F.col("component").alias("cluster")))

    def compare(left, right):
        return _unit(left) @ _unit(right).T >= cosine

    linked = cell_links(cells.join(nodes.select("node", "weight", "payload"), "node"), compare, "binary")
    counts = linked.groupBy("node").agg(F.sum("n_links").alias("_links"))
    named = found.join(nodes.select("node", "least"), "node")
    names = named.groupBy("component").agg(F.min("least").alias("_name"))
    part = found.join(names, "component").select("node", "_name")
    per_node = nodes.select("node", "least", "weight").join(part, "node", "left").join(counts, "node", "left").select(
        "node", F.coalesce("_name", "least").alias("_component"),
        (F.coalesce("_links", F.lit(0)) + F.col("weight") - 1).alias("_links"),
    )
    # by id, so that a row that cannot link finds its own id
    answer = rows.select("id", "node").join(per_node, "node").groupBy("id").agg(
        F.max("_links").alias("_links"), F.min("_component").alias("_component")
    )
    out = vectors.select(F.col(vec_id).cast("long").alias("vec_id")).join(
        answer.withColumnRenamed("id", "vec_id"), "vec_id", "left"
    )
    component = F.coalesce("_component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
