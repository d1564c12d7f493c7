"""Repeated byte substrings, found at sampled suffixes that are ordered by deep-shallow sorting.

Of every run of ``least`` bytes the position whose next ``GRAM`` bytes have the smallest hash is an
anchor; equal runs have their anchors in equal places. So a run that occurs twice gives two anchors
of equal grams, and only suffixes at anchors whose gram is not unique have to be ordered.

For anchors of one gram, ``lcp`` is how far their suffixes agree and ``lcs`` how far the texts before
them do. A run that begins ``x`` bytes before the anchor occurs again if another anchor agrees on
``x`` bytes before and ``least - x`` bytes behind. Both orders, suffixes and reversed texts before,
give classes of equal strings at every length by their neighbours' common lengths alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.llm.text import _BYTE, _powers, groups, mix
from candlemill.session import discard, materialize

LEAST = 400  # bytes
GRAM = 64  # bytes hashed at an anchor
SHALLOW = 64  # bytes behind the gram that the multikey quicksort looks at
HOT = 20_000  # contexts of one gram that are ordered in a task
CODEC = "zstd"  # contexts overlap; on check_s it takes a third off what snappy leaves of them
PIECE = 1 << 22  # bytes searched for anchors at once


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class _Trie:
    """Blind trie: inner nodes know a depth and the next byte of each branch, leaves their strings."""

    def __init__(self, first: int, strings: list[bytes]) -> None:
        self.strings = strings
        self.root: list = [first]  # a leaf is a list of equal strings' numbers

    def add(self, k: int) -> None:
        s = self.strings[k]
        node = self.root
        while isinstance(node, dict):  # blindly: bytes between depths are not compared
            branch = s[node["depth"]] if node["depth"] < len(s) else -1
            node = node["next"].get(branch) or next(iter(node["next"].values()))
        other = self.strings[node[0]]
        depth = common(s, other)
        if depth == len(s) == len(other):
            node.append(k)
            return
        above, node = None, self.root
        while isinstance(node, dict) and node["depth"] < depth:
            above, node = (node, s[node["depth"]]), node["next"][s[node["depth"]]]
        own = s[depth] if depth < len(s) else -1
        if isinstance(node, dict) and node["depth"] == depth:
            node["next"][own] = [k]
            return
        split = {"depth": depth, "next": {own: [k], (other[depth] if depth < len(other) else -1): node}}
        if above is None:
            self.root = split
        else:
            above[0]["next"][above[1]] = split

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, dict):
                stack += [node["next"][b] for b in sorted(node["next"], reverse=True)]
            else:
                out += node
        return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Numbers of ``strings`` in their order.

    A multikey quicksort splits on eight bytes at a time down to ``shallow``; strings that still
    agree there are put into a blind trie, whose walk is their order.
    """
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        some, depth = stack.pop()
        if len(some) == 1:
            out += some
        elif depth >= shallow:
            trie = _Trie(some[0], strings)
            for k in some[1:]:
                trie.add(k)
            out += trie.order()
        else:
            pivot = strings[some[len(some) // 2]][depth : depth + 8]
            less, same, more = [], [], []
            for k in some:
                key = strings[k][depth : depth + 8]
                (same if key == pivot else less if key < pivot else more).append(k)
            if more:
                stack.append((more, depth))
            if len(pivot) < 8:  # all of them end here and are equal
                stack += [([k], depth) for k in reversed(same)]
            else:
                stack.append((same, depth + 8))
            if less:
                stack.append((less, depth))
    return out


def _classes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``strings`` and each one's common length with the one before it."""
    order = deep_shallow(strings)
    shared = [-1] + [common(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]
    return np.array(order), np.array(shared)


def repeated(
    contexts: list[tuple[bytes, int]], weights: list[int], least: int = LEAST
) -> list[list[tuple[int, int]]]:
    """For contexts ``(bytes, place of the anchor)`` of one gram, the ranges of ``x`` that occur again.

    A context holds the runs of ``least`` bytes that chose its anchor; ``x`` is how far before the
    anchor a run begins. ``weights`` says how often a context occurs.
    """
    left = np.array([at for _, at in contexts])
    right = np.array([len(s) - at for s, at in contexts])
    first = least - right  # smallest x of each
    if len(contexts) == 1:
        return [[(int(first[0]), int(left[0]))] if weights[0] > 1 else []]
    behind, ends = _classes([s[at:] for s, at in contexts])
    before, heads = _classes([s[:at][::-1] for s, at in contexts])
    low, high = int(first.min()), int(left.max())
    cuts = np.unique(np.concatenate([least - ends, heads + 1, first, left + 1, [low, high + 1]]))
    cuts = cuts[(cuts >= low) & (cuts <= high + 1)]
    often = np.array(weights) > 1
    side = np.empty((2, len(contexts)), np.int64)
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for x, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        # between two cuts neither the classes nor the contexts that have such runs change
        member = np.flatnonzero((first <= x) & (left >= x))
        if not len(member):
            continue
        side[0, behind] = np.cumsum(ends < least - x)
        side[1, before] = np.cumsum(heads < x)
        both = side[0, member] * (len(contexts) + 1) + side[1, member]
        _, place, count = np.unique(both, return_inverse=True, return_counts=True)
        for k in member[(count[place] > 1) | often[member]].tolist():
            if out[k] and out[k][-1][1] == x - 1:
                out[k][-1] = (out[k][-1][0], stop - 1)
            else:
                out[k].append((x, stop - 1))
    return out


def anchors(data: bytes, least: int = LEAST, gram: int = GRAM) -> list[tuple[np.ndarray, ...]]:
    """``(position, hash, first start, last start)`` arrays of the anchors of the runs of ``least`` bytes."""
    whole = np.frombuffer(data, np.uint8)
    width = least - gram + 1
    out = []
    for k in range(0, len(data) - least + 1, PIECE):
        piece = whole[k : k + PIECE + least - 1]
        power, inverse = _powers(len(piece) + 1)
        prefix = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE[piece] * power[: len(piece)], out=prefix[1:])
        h = mix((prefix[gram:] - prefix[:-gram]) * inverse[: len(piece) - gram + 1])
        place, span = np.arange(len(h)), 1
        while span < width:  # the leftmost least hash of ever longer spans
            step = min(span, width - span)
            a, b = place[: len(place) - step], place[step:]
            place = np.where(h[a] <= h[b], a, b)
            span += step
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        ends = np.concatenate([starts[1:] - 1, [len(place) - 1]])
        at = place[starts]
        out.append((at + k, h[at].view(np.int64), starts + k, ends + k))
    return out


def _rows(docs: DataFrame, text: str) -> DataFrame:
    """``node``, a digest of the text, and the text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.unhex(F.md5(whole)).alias("node"), whole.alias("text"))


def repeated_ranges(docs: DataFrame, text: str = "text", least: int = LEAST, hot: int = HOT) -> DataFrame:
    """``node, ranges``: byte ranges of each different text that are covered by repeated runs.

    Copies of a whole text are not looked at here: their text is one node.
    """
    texts = _rows(docs, text).where(F.octet_length("text") >= least)

    def sample(batches):
        for batch in batches:
            for node, whole in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for at, h, _, _ in anchors(whole.encode("utf-8", "replace"), least):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([node] * len(at), pa.binary()), pa.array(at), pa.array(h)], ["node", "at", "gram"]
                    )

    found = materialize(texts.mapInArrow(sample, "node binary, at long, gram long"), "anchors", CODEC)
    place = F.xxhash64("node", "at")
    often = found.groupBy("gram").agg(F.min(place).alias("_a"), F.max(place).alias("_b")).where("_a <> _b")
    wanted = (
        found.select("node", "at", "gram").join(often.select("gram"), "gram")
        .groupBy("node").agg(F.collect_set("at").alias("ats"))  # anchors of one text
    )

    def cut(batches):
        for batch in batches:
            rows: dict[tuple, list] = {}
            for node, ats, whole in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data, ats = whole.encode("utf-8", "replace"), set(ats)
                for at, h, first, last in anchors(data, least):
                    for p, gram, a, b in zip(at.tolist(), h.tolist(), first.tolist(), last.tolist(), strict=True):
                        if p in ats:
                            context = data[a : b + least]
                            key = hashlib.blake2b(context + b"%d" % (p - a), digest_size=16).digest()
                            rows.setdefault((node, key), [gram, p - a, context, set()])[3].add(p)
            columns = [[] for _ in range(6)]
            for (node, key), (gram, left, context, places) in rows.items():
                for c, v in zip(columns, (node, key, gram, left, context, sorted(places)), strict=True):
                    c.append(v)
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["node", "key", "gram", "at", "context", "places"],
            )

    one_text = texts.join(wanted, "node").dropDuplicates(["node"])
    held = materialize(
        one_text.select("node", "ats", "text")
        .mapInArrow(cut, "node binary, key binary, gram long, at int, context binary, places array<long>"),
        "contexts", CODEC,
    )
    discard(found)
    different = held.groupBy("gram", "key").agg(
        F.sum(F.size("places")).alias("weight"), F.first("at").alias("at"), F.first("context").alias("context")
    )
    sizes = held.groupBy("gram").agg(F.count_distinct("key").alias("n")).where(F.col("n") > hot)
    span = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))

    def order(batches):
        for _, rows in groups(batches, ["gram"]):
            ranges = repeated([(r["context"], r["at"]) for r in rows], [r["weight"] for r in rows], least)
            kept = [(r["key"], [{"x": x, "y": y} for x, y in v]) for r, v in zip(rows, ranges, strict=True) if v]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in kept], pa.binary()), pa.array([k[1] for k in kept], span)], ["key", "spans"]
            )

    shape = "key binary, spans array<struct<x:int,y:int>>"
    any_hot = not sizes.isEmpty()
    cool = different.join(sizes, "gram", "left_anti") if any_hot else different
    spans = cool.repartition("gram").sortWithinPartitions("gram", "key").mapInArrow(order, shape)
    runs = None
    if any_hot:
        hot_spans, runs = _hot_spans(different.join(sizes.select("gram"), "gram"), least)
        spans = spans.unionByName(hot_spans)
    ranges = materialize((
        held.select("node", "key", F.explode("places").alias("p")).join(spans, "key")
        .select("node", "p", F.explode("spans").alias("s"))
        .select("node", F.struct(
            (F.col("p") - F.col("s.y")).alias("start"), (F.col("p") - F.col("s.x") + least).alias("stop")
        ).alias("r"))
        .groupBy("node").agg(F.collect_list("r").alias("ranges"))  # anchors of one text
    ), "ranges")
    for read in (held, runs):
        if read is not None:
            discard(read)
    return ranges


def _hot_spans(contexts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The same answer for grams of very many contexts, and the table it reads: runs are counted by their digests."""

    def runs(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n = len(r["context"]) - least + 1
                digest = [hashlib.blake2b(r["context"][k : k + least], digest_size=16).digest() for k in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["key"]] * n, pa.binary()), pa.array([r["at"] - k for k in range(n)], pa.int32()),
                        pa.array(digest, pa.binary()), pa.array([r["weight"]] * n, pa.int64()),
                    ],
                    ["key", "x", "run", "weight"],
                )

    every = materialize(contexts.select("key", "at", "context", "weight").mapInArrow(
        runs, "key binary, x int, run binary, weight long"
    ), "runs")
    often = every.groupBy("run").agg(F.sum("weight").alias("n")).where("n > 1").select("run")
    return every.join(often, "run").groupBy("key").agg(F.collect_set("x").alias("xs")).select(
        "key", F.transform("xs", lambda x: F.struct(x.alias("x"), x.alias("y"))).alias("spans")
    ), every


def remove_repeats(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, hot: int = HOT
) -> DataFrame:
    """``docs`` with ``n_bytes, removed, kept``: texts as UTF-8 without their repeated bytes.

    A byte goes if a run of ``least`` bytes around it also starts anywhere else, in the same text or
    another one; ``removed`` are the maximal ranges, ``kept`` the bytes that stay. Runs are judged
    on the input, so all occurrences go.

    Null and empty texts stay empty, texts under ``least`` bytes as they are. Repeated rows are
    copies of each other and go as a whole. An empty table gives no rows. Columns named like a
    result are replaced. Ties between equal hashes go to the leftmost place.
    """
    docs = docs.drop("n_bytes", "removed", "kept")
    whole = F.coalesce(F.col(text), F.lit(""))
    node = F.unhex(F.md5(whole))
    copies = docs.select(node.alias("_node")).groupBy("_node").agg(F.count("*").alias("_copies")).where("_copies > 1")
    ranges = repeated_ranges(docs, text, least, hot)
    about = materialize(copies.join(ranges.withColumnRenamed("node", "_node"), "_node", "full"), "repeats")
    discard(ranges)
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        place = names.index(text)
        for batch in batches:
            out = []
            texts, many, found = (batch.column(k).to_pylist() for k in (place, len(names), len(names) + 1))
            for s, copied, spans in zip(texts, many, found, strict=True):
                data = (s or "").encode("utf-8", "replace")
                spans = [(r["start"], r["stop"]) for r in spans or []]
                if copied and len(data) >= least:
                    spans = [(0, len(data))]
                joined: list[list[int]] = []
                for a, b in sorted(spans):
                    if joined and joined[-1][1] >= a:
                        joined[-1][1] = max(joined[-1][1], b)
                    else:
                        joined.append([a, b])
                cuts = [0, *[v for ab in joined for v in ab], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                out.append((len(data), [{"start": a, "stop": b} for a, b in joined], kept))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(names)],
                    *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), span, pa.binary()), strict=True)],
                ],
                [*names, "n_bytes", "removed", "kept"],
            )

    return (
        docs.withColumn("_node", node).join(about, "_node", "left")
        .select(*[F.col(f"`{c}`") for c in names], "_copies", "ranges")
        .mapInArrow(run, f"{kinds}, n_bytes long, removed array<struct<start:long,stop:long>>, kept binary")
    )
