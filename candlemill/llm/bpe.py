"""Byte-level BPE by replaying merges over all words of a corpus at once.

A task takes its texts some megabytes at a time. The distinct words of these texts stand in one flat
array of tokens, in which an inverted index leads from the rank of a token pair to all places where
the pair stands. Ranks are applied in order, each to all its places together, and only the pairs next
to a merged one are looked up again. Words do not touch each other, so every word gets the merges
that it would get alone; nothing is shuffled.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

TOGETHER = 4 << 20  # bytes of texts whose words are replayed together, or one longer text
CACHE = 150_000  # words whose ids a worker process remembers, twice
LONGEST = 64  # bytes of a word that is remembered
_NONE = np.int64(1 << 62)
_FAR = np.int32((1 << 31) - 1)  # the rank of pairs that do not merge


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one token (base64) and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def by_rank(ranks: dict[bytes, int]) -> list[bytes | None]:
    tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


class Ranks:
    """Tokens of a rank file and the pairs that merge. Ids are ranks."""

    def __init__(self, path: str) -> None:
        self.ranks = read_ranks(path)
        self.tokens = by_rank(self.ranks)
        self.size = len(self.tokens)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs.append((a * self.size + b, rank))
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs] + [_NONE], np.int64)
        self.merged = np.array([p[1] for p in pairs] + [_FAR], np.int32)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens; ``_FAR`` where they do not merge or one is -1."""
        key = np.where((a < 0) | (b < 0), -1, a * np.int64(self.size) + b)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], _FAR)

    def word(self, word: bytes) -> np.ndarray:
        """Ids of one word: of its pairs with the least rank the leftmost is merged, until none merges."""
        if word in self.ranks:
            return np.array([self.ranks[word]], np.int64)
        token = [self.ranks[bytes([b])] for b in word]
        n = len(token)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        ranks, tokens = self.ranks, self.tokens

        def pair(p: int) -> int | None:
            return None if after[p] < 0 else ranks.get(tokens[token[p]] + tokens[token[after[p]]])

        heap = [(r, p) for p in range(n) if (r := pair(p)) is not None]
        heapq.heapify(heap)
        while heap:
            r, p = heapq.heappop(heap)
            if token[p] < 0 or pair(p) != r:
                continue
            gone = after[p]
            token[p], token[gone], after[p] = r, -1, after[gone]
            if after[p] >= 0:
                before[after[p]] = p
            for q in (before[p], p):
                if q >= 0 and (new := pair(q)) is not None:
                    heapq.heappush(heap, (new, q))
        return np.array([t for t in token if t >= 0], np.int64)

    def replay(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of every word; no word is empty. A word that is a token itself is that token, whatever its merges give."""
        whole = [self.ranks.get(w) for w in words]
        merged = iter(self._replay([w for w, r in zip(words, whole, strict=True) if r is None]))
        return [next(merged) if r is None else np.array([r], np.int64) for r in whole]

    def _replay(self, words: list[bytes]) -> list[np.ndarray]:
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        n = int(sizes.sum())
        token = np.append(self.byte[np.frombuffer(b"".join(words), np.uint8)], -1)  # the last place stands for none
        kind = np.int32 if n < 1 << 31 else np.int64
        after, before = np.arange(1, n + 2, dtype=kind), np.arange(-1, n, dtype=kind)
        after[starts + sizes - 1], after[n] = n, n
        before[starts], before[n] = n, n
        rank = np.append(self.rank_of(token[:n], token[after[:n]]), _FAR)

        index: dict[int, list] = {}
        order = np.argsort(rank[:n], kind="stable")
        order = order[: np.searchsorted(rank[order], _FAR)]
        edges = np.flatnonzero(np.diff(rank[order])) + 1
        for places in np.split(order, edges) if len(order) else []:
            index[int(rank[places[0]])] = [places]
        queue = sorted(index)
        apart: set[int] = set()  # words whose merges depend on the order of places
        while queue:
            r = heapq.heappop(queue)
            found = index.pop(r)
            places = np.unique(np.concatenate([np.atleast_1d(np.asarray(x, np.int64)) for x in found]))
            places = places[rank[places] == r]
            if not len(places):
                continue
            left = places
            if len(places) > 1:
                touching = after[places[:-1]] == places[1:]
                if touching.any():  # of places in a row, every second one is merged
                    heads = np.flatnonzero(np.append(True, ~touching))
                    run = np.arange(len(places)) - np.repeat(heads, np.diff(np.append(heads, len(places))))
                    left = places[run % 2 == 0]
            right = after[left]
            beyond = after[right]
            token[left], after[left] = r, beyond
            before[beyond] = left
            before[n] = n
            rank[right], token[right] = _FAR, -1
            changed = np.concatenate([left, before[left]])
            changed = changed[changed < n]
            new = self.rank_of(token[changed], token[after[changed]])
            rank[changed] = new
            lower = changed[new < r]
            if len(lower):  # a pair that now goes first: with other places in its word, order matters
                holds = np.searchsorted(starts, places, "right") - 1
                several = holds[1:][holds[1:] == holds[:-1]]
                apart.update(np.intersect1d(np.searchsorted(starts, lower, "right") - 1, several).tolist())
            some = new < _FAR
            for value, place in zip(new[some].tolist(), changed[some].tolist(), strict=True):
                if value in index:
                    index[value].append(place)
                else:
                    index[value] = [place]
                    heapq.heappush(queue, value)
        kept = token[:n] >= 0
        counts = np.add.reduceat(kept, starts)
        out = np.split(token[:n][kept], np.cumsum(counts)[:-1])
        for k in apart:
            out[k] = self.word(words[k])
        return out


class _Numbered(dict):
    """Numbers keys in the order in which they are asked for first."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Encoder:
    """Whole texts to ids; ids of words are remembered in two generations of ``cache`` at most."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE) -> None:
        self.ranks = Ranks(path)
        self.find = regex.compile(pattern).findall
        self.cache = cache
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _codes(self, words: list[str]) -> list[bytes]:
        if len(self.young) > self.cache:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        codes = [young.get(w) or old.get(w) for w in words]
        fresh = [k for k, c in enumerate(codes) if c is None]
        raw = [words[k].encode() for k in fresh]
        for k, ids in zip(fresh, self.ranks.replay(raw), strict=True):
            codes[k] = ids.astype("<i4").tobytes()
        for w, c in zip(words, codes, strict=True):
            if len(w) <= LONGEST:
                young[w] = c
        return codes

    def encode(self, texts: list[str | None]) -> pa.Array:
        """One list of ids per text."""
        number = _Numbered()
        places = [np.fromiter(map(number.__getitem__, found), np.int32, len(found)) for found in map(self.find, (t or "" for t in texts))]
        codes = self._codes(list(number))
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(codes), "<i4")
        bounds, values = np.zeros(len(texts) + 1, np.int64), []
        for k, place in enumerate(places):
            length = sizes[place]
            ends = np.cumsum(length)
            total = int(ends[-1]) if len(ends) else 0
            values.append(flat[np.repeat(starts[place] - (ends - length), length) + np.arange(total)])
            bounds[k + 1] = bounds[k] + total
        return pa.ListArray.from_arrays(bounds.astype(np.int32), np.concatenate(values) if values else np.zeros(0, np.int32))


_SHARED: dict[tuple, Encoder] = {}


def shared_encoder(path: str, pattern: str) -> Encoder:
    """The worker process's own encoder, warm for its later tasks."""
    if (path, pattern) not in _SHARED:
        _SHARED.clear()
        _SHARED[path, pattern] = Encoder(path, pattern)
    return _SHARED[path, pattern]


def _with(schema: StructType, name: str, kind) -> StructType:
    return StructType([*[f for f in schema.fields if f.name != name], StructField(name, kind)])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", together: int = TOGETHER) -> DataFrame:
    """``docs`` with ``ids``: array of int, the byte-level BPE of every whole text.

    Every match of ``pattern`` is encoded on its own; there are no special tokens. Null and empty texts
    give an empty array. Repeated rows are encoded alike and kept. Other columns pass; one that is named
    like the result is replaced. An empty table gives no rows. Every worker reads the rank file at
    ``path``, which must hold all 256 single bytes.
    """
    out = _with(docs.schema, ids, ArrayType(IntegerType()))
    kept = out.names[:-1]

    def run(batches):
        encoder = shared_encoder(path, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
            edges = [0, *(np.flatnonzero(np.diff(size // together)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(edges, edges[1:], strict=False):
                part = batch.slice(start, stop - start)
                codes = encoder.encode(texts[start:stop].to_pylist())
                columns = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, codes], [*kept, ids])

    return docs.mapInArrow(run, out)


def decode(encoded: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of its ids, one token after the other.

    Null ids give null, an empty array gives no bytes. An id that the file at ``path`` lacks is an error.
    Bytes need not be valid UTF-8 if the ids do not come from whole texts. A column that is named like
    the result is replaced.
    """
    out = _with(encoded.schema, decoded, BinaryType())
    kept = out.names[:-1]

    def run(batches):
        tokens = pa.array(by_rank(read_ranks(path)), pa.large_binary())
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            data = tokens.take(pc.list_flatten(lists))
            ends = np.concatenate([[0], pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).cumsum()])
            offsets = np.frombuffer(data.buffers()[1], np.int64)[: len(data) + 1] if len(data) else np.zeros(1, np.int64)
            whole = data.buffers()[2]
            cuts = offsets[ends]
            values = [
                None if null else (whole[a:b].to_pybytes() if b > a else b"")
                for null, a, b in zip(pc.is_null(lists).to_pylist(), cuts.tolist(), cuts[1:].tolist(), strict=False)
            ]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.binary())], [*kept, decoded])

    return encoded.mapInArrow(run, out)


def digests(decoded: DataFrame, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``n_tokens, ids_sha256, decoded_sha256`` instead of the ids and bytes."""
    return decoded.withColumns({
        "n_tokens": F.size(ids).cast("long"),
        "ids_sha256": F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256),
        "decoded_sha256": F.sha2(data, 256),
    }).drop(ids, data)
