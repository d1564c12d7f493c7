"""Exact links inside clusters of candidates, compared in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.llm.text import groups

BLOCK = 512  # nodes of a cluster in a block


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` rows the least row reachable by links; ``linked[i, j]`` joins ``left[i]`` and ``right[j]``."""
    label = np.arange(n, dtype=np.int32)
    while True:
        before = label.copy()
        back = np.full(len(right), n, np.int32)
        for k in range(0, len(left), 128):  # a few rows at once, for memory
            some, own = linked[k : k + 128], left[k : k + 128]
            across = np.where(some, label[right], np.int32(n)).min(1, initial=n)
            label[own] = np.minimum(label[own], across)
            back = np.minimum(back, np.where(some, label[own][:, None], np.int32(n)).min(0, initial=n))
        label[right] = np.minimum(label[right], back)
        label = label[label]
        if (label == before).all():
            return label


def blocks(clusters: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(node, cluster)`` with ``_i, _j``: the cells in which a node is compared.

    A cluster of ``g`` nodes has ``k = ceil(g / block)`` blocks and ``k (k + 1) / 2`` cells; every
    pair of nodes meets in one cell.
    """
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("_g"))
    k = F.ceil(F.col("_g") / block).cast("int")
    return (
        clusters.join(sizes, "cluster")
        .withColumn("_blocks", k)
        .withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
        .withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("_i", F.least("_own", "_with")).withColumn("_j", F.greatest("_own", "_with"))
        .select("node", "cluster", "_own", "_i", "_j")
    )


def cell_links(
    members: DataFrame, compare: Callable[[list, list], np.ndarray], node_type: str
) -> DataFrame:
    """``node, n_links, other`` from rows ``node, weight, payload, cluster, _own, _i, _j``.

    ``compare`` gives the links between two lists of payloads as a matrix. ``n_links`` adds up the
    weights of a node's links in a cell, ``other`` is the least node of its part of the cell's
    links, null for that node itself.
    """
    kind = pa.binary() if node_type == "binary" else pa.int64()

    def run(batches):
        for (_, i, j), rows in groups(batches, ["cluster", "_i", "_j"]):
            rows.sort(key=lambda r: r["node"])
            nodes = [r["node"] for r in rows]
            own = np.array([r["_own"] for r in rows])
            weight = np.array([r["weight"] for r in rows], np.int64)
            left = np.flatnonzero(own == i)
            right = np.flatnonzero(own == j)
            if not len(left) or not len(right):
                continue
            linked = compare([rows[k]["payload"] for k in left], [rows[k]["payload"] for k in right])
            count = np.zeros(len(rows), np.int64)
            if i == j:
                np.fill_diagonal(linked, False)
                count[left] = linked @ weight[right]
            else:
                count[left] = linked @ weight[right]
                count[right] = linked.T @ weight[left]
            label = forest(linked, left, right, len(rows))
            kept = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([nodes[k] for k in kept], kind), pa.array(count[kept]),
                    pa.array([None if label[k] == k else nodes[label[k]] for k in kept], kind),
                ],
                ["node", "n_links", "other"],
            )

    return (
        members.select("cluster", "_i", "_j", "_own", "node", "weight", "payload")
        .repartition("cluster", "_i", "_j").sortWithinPartitions("cluster", "_i", "_j")
        .mapInArrow(run, f"node {node_type}, n_links long, other {node_type}")
    )
