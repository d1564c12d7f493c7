"""Phrases counted by direct addresses in tiles of frequency-ranked ids.

A *chunk* is some megabytes of texts of one language as a sequence of word ids, with breaks between
pieces. Words that are frequent enough get ids by descending frequency. A pair of neighbours is a cell
of a matrix that is cut into a bounded number of tiles, small ones for the most frequent ids; common tiles at this head are
counted densely with ``bincount``, all others as sorted cells with run lengths. Tiles of all chunks are added up, in two
steps so that no tile gathers all chunks at once, and cells below the least count go.

The pairs that are left are ranked by frequency anew, every chunk learns the ids of its own pairs, and
its sequence of pairs is counted in tiles like the sequence of words before: neighbouring pairs are
phrases of three words, neighbouring phrases of three are phrases of four. A phrase can be frequent only
if both its neighbouring parts are. No dictionary is broadcast: a chunk is sent what it holds.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlemill.session import discard, materialize

CHUNK = 8 << 20  # bytes of texts in a chunk, all languages of a task together, or one longer text
BITS = 10  # a tile of the most frequent ids has 2^BITS of them a side
WIDER = 3  # any other tile has at least 2^WIDER times as many
HEAD = 16  # tiles of the most frequent ids a side
BEYOND = 16  # other tiles a side at most; they widen with the ids, so that a chunk has no more rows in a larger corpus
DENSE = 1 << 15  # occurrences in a tile from which it is counted densely
LEAST = 30
LONGEST = 4
UNKNOWN = "und"
# A-Z to lower case, tab to space, marks that end a piece to a newline
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if chr(b) in ".,;:!?\n\v\f\r" else b for b in range(256)
)


def sequences(docs: DataFrame, chunk: int = CHUNK, text: str = "text", lang: str = "lang") -> DataFrame:
    """``chunk, lang, n_words, words, counts, seq``: texts as places in their chunk's own word list, -1 between pieces."""

    def run(batches):
        held: dict[str, list[bytes]] = {}
        size, number = 0, TaskContext.get().partitionId() << 32

        def flush():
            nonlocal number
            for name, parts in held.items():
                yield _sequence(number, name, b"\n".join(parts))
                number += 1
            held.clear()

        for batch in batches:
            for body, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (body or "").encode("utf-8", "replace").translate(_TABLE)
                held.setdefault(name, []).append(raw)
                size += len(raw) + 1
                if size >= chunk:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select(F.col(text).alias("text"), F.coalesce(lang, F.lit(UNKNOWN)).alias("lang")).mapInArrow(
        run, "chunk long, lang string, n_words long, words array<string>, counts array<long>, seq binary"
    )


def _sequence(number: int, lang: str, data: bytes) -> pa.RecordBatch:
    split = pc.split_pattern(pa.array([data.replace(b"\n", b" \n ")], pa.large_binary()), b" ").values.dictionary_encode()
    place = split.indices.to_numpy()
    names = split.dictionary
    count = np.bincount(place, minlength=len(names))
    is_word = np.array([n not in (b"", b"\n") for n in names.to_pylist()], bool)
    local = np.where(is_word, np.cumsum(is_word) - 1, -1).astype(np.int32)
    empty = pc.index(names, pa.scalar(b"", pa.large_binary())).as_py()
    seq = local[place if empty < 0 else place[place != empty]]
    words = names.filter(pa.array(is_word)).cast(pa.string())
    columns = [
        pa.array([number], pa.int64()), pa.array([lang], pa.string()), pa.array([int(count[is_word].sum())], pa.int64()),
        pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
        pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(count[is_word], pa.int64())),
        pa.array([_linked(seq).astype("<i4").tobytes()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["chunk", "lang", "n_words", "words", "counts", "seq"])


def _linked(seq: np.ndarray) -> np.ndarray:
    """``seq`` without what has no neighbour; one -1 behind every run."""
    linked = (seq[:-1] >= 0) & (seq[1:] >= 0)
    keep = np.zeros(len(seq) + 1, bool)
    keep[:-2] |= linked
    keep[1:-1] |= linked
    last = keep.copy()
    last[:-2] &= ~linked
    keep[1:] |= last[:-1]
    return np.append(seq, -1)[keep]


def ranked(rows: DataFrame, *ties: str) -> DataFrame:
    """``rows`` with ``id``: their place, from 0, by descending ``f`` and then ``ties``."""
    order = [F.desc("f"), *ties]
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = materialize(
        rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
        .withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)}),
        "ranked",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select(  # one row per partition
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    return materialize(placed.join(starts, "_part").withColumn("id", F.col("_start") + F.col("_at")).drop("_part", "_start", "_at"), "ids")


def _fields(row_lists, name: str) -> np.ndarray:
    return row_lists.field(name).to_numpy(zero_copy_only=False)


def word_ids(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """``chunk, seq`` with the ids of ``words`` (``lang, word, id``) as 64-bit numbers."""
    held = chunks.select("chunk", "lang", F.posexplode("words").alias("local", "word")).join(words.select("lang", "word", "id"), ["lang", "word"])
    told = held.groupBy("chunk").agg(F.collect_list(F.struct("local", "id")).alias("told"))  # at most a chunk's words

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                seq = np.frombuffer(batch.column(1)[k].as_py(), "<i4")
                told = batch.column(2)[k].values
                table = np.full(int(seq.max(initial=-1)) + 2, -1, np.int64)  # the last place is for breaks
                local, ids = _fields(told, "local"), _fields(told, "id")
                inside = local < len(table) - 1
                table[local[inside]] = ids[inside]
                yield _one(batch.column(0)[k].as_py(), _linked(table[seq]))

    return chunks.select("chunk", "seq").join(told, "chunk").mapInArrow(run, "chunk long, seq binary")


def _one(chunk: int, seq: np.ndarray) -> pa.RecordBatch:
    """One row; its last byte is the width of the ids before it."""
    width = 4 if seq.max(initial=0) < 1 << 31 else 8
    data = seq.astype(f"<i{width}").tobytes() + bytes([width])
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([data], pa.binary())], ["chunk", "seq"])


def _ids(data: bytes) -> np.ndarray:
    return np.frombuffer(memoryview(data)[:-1], f"<i{data[-1]}").astype(np.int64)


def tile_bits(n: int, bits: int = BITS, head: int = HEAD) -> int:
    """Bits of the wider tiles for ``n`` ids."""
    return max(bits + WIDER, (max(0, n - (head << bits) - 1) // BEYOND).bit_length())


def _packed(cells: np.ndarray) -> bytes:
    """Ascending cells as steps, of 32 bits unless one is longer; the last byte is their width."""
    steps = np.diff(cells.astype(np.int64), prepend=0)
    width = 4 if steps.max(initial=0) < 1 << 32 else 8
    return steps.astype(f"<u{width}").tobytes() + bytes([width])


def _cells(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(memoryview(data)[:-1], f"<u{data[-1]}"), dtype=np.int64)


def _place(ids: np.ndarray, bits: int, head: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Tile number and place in the tile of ids."""
    beyond = ids - (head << bits)
    far = beyond >= 0
    return np.where(far, head + (beyond >> wide), ids >> bits), np.where(far, beyond & ((1 << wide) - 1), ids & ((1 << bits) - 1))


def _pairs_of(ta, tb, cells: np.ndarray, bits: int, head: int = HEAD, wide: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of cells, whose tiles are numbers or arrays."""
    ta, tb, cells = np.asarray(ta), np.asarray(tb), cells.astype(np.int64)
    wide = wide or bits + WIDER
    shift = np.where((ta < head) & (tb < head), bits, wide)
    first, second = (np.where(t < head, t << bits, (head << bits) + ((t - head) << wide)) for t in (ta, tb))
    return first + (cells >> shift), second + (cells & ((1 << shift) - 1))


def count_cells(a: np.ndarray, b: np.ndarray, bits: int = BITS, head: int = HEAD, dense: int = DENSE, wide: int | None = None):
    """(tile row, tile column, cells, counts) of every tile that holds one of the pairs; cells ascend."""
    wide = wide or bits + WIDER
    (ta, oa), (tb, ob) = _place(a, bits, head, wide), _place(b, bits, head, wide)
    near = (ta < head) & (tb < head)
    cell = np.where(near, (oa << bits) | ob, (oa << wide) | ob)
    tile = np.where(near, ta * head + tb, 0)
    full = np.flatnonzero(np.bincount(tile[near], minlength=head * head) >= dense)
    is_full = np.zeros(head * head, bool)
    is_full[full] = True
    densely = near & is_full[tile]
    for t in full.tolist():
        counts = np.bincount(cell[densely & (tile == t)], minlength=1 << (2 * bits))
        cells = np.flatnonzero(counts)
        yield t // head, t % head, cells, counts[cells]
    ta, tb, cell = ta[~densely], tb[~densely], cell[~densely]
    if not len(cell):
        return
    width, shift = int(tb.max()) + 1, 2 * wide
    if (int(ta.max()) + 1) * width < 1 << (62 - shift):
        key = np.sort(((ta * width + tb) << shift) | cell)
        tile, cell = key >> shift, key & ((1 << shift) - 1)
        ta, tb = tile // width, tile % width
    else:
        order = np.lexsort((cell, tb, ta))
        ta, tb, cell = ta[order], tb[order], cell[order]
    moved = (np.diff(ta) != 0) | (np.diff(tb) != 0)
    first = np.flatnonzero(np.append(True, moved | (np.diff(cell) != 0)))
    counts = np.diff(np.append(first, len(cell)))
    edges = np.searchsorted(first, [0, *(np.flatnonzero(moved) + 1).tolist(), len(cell)]).tolist()
    cells, ta, tb = cell[first], ta[first], tb[first]
    for s, e in zip(edges, edges[1:], strict=False):
        yield int(ta[s]), int(tb[s]), cells[s:e], counts[s:e]


def tiles(seqs: DataFrame, salts: int, bits: int = BITS, dense: int = DENSE, wide: int | None = None) -> DataFrame:
    """``ta, tb, salt, chunk, cells, counts``: the tiles of every chunk's neighbours."""

    def run(batches):
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seq = _ids(data)
                a, b = seq[:-1], seq[1:]
                both = (a >= 0) & (b >= 0)
                rows = [
                    (x, y, _packed(cells), counts.astype("<u4").tobytes())
                    for x, y, cells, counts in count_cells(a[both], b[both], bits, dense=dense, wide=wide)
                ]
                if rows:
                    x, y, cells, counts = zip(*rows, strict=True)
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array([chunk] * n, pa.int64()),
                            pa.array(cells, pa.binary()), pa.array(counts, pa.binary()),
                        ],
                        ["ta", "tb", "chunk", "cells", "counts"],
                    )

    out = seqs.mapInArrow(run, "ta long, tb long, chunk long, cells binary, counts binary")
    return out.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)))


def _added(cells: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cells with the sums of their counts."""
    cell, count = np.concatenate(cells), np.concatenate(counts)
    order = np.argsort(cell, kind="stable")
    cell, count = cell[order], count[order].astype(np.int64)
    first = np.flatnonzero(np.append(True, np.diff(cell) != 0))
    return cell[first], np.add.reduceat(count, first)


class _Tile:
    """Sum of one tile: sorted cells, in the head of the matrix an array of all cells once they are many."""

    def __init__(self, full: int | None) -> None:
        self.cells, self.counts, self.size, self.full, self.all = [], [], 0, full, None
        self.most = 1 << 20  # cells that wait to be added up

    def add(self, cells: np.ndarray, counts: np.ndarray) -> None:
        if self.all is not None:
            self.all[cells] += counts
            return
        self.cells.append(cells)
        self.counts.append(counts)
        self.size += len(cells)
        if self.full and self.size >= self.full // 4:
            self.all = np.zeros(self.full, np.int64)
            for c, n in zip(self.cells, self.counts, strict=True):
                self.all[c] += n
            self.cells, self.counts = [], []
        elif self.size >= self.most:
            cell, count = _added(self.cells, self.counts)
            self.cells, self.counts, self.size = [cell], [count], len(cell)
            self.most = max(self.most, 2 * self.size)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        if self.all is not None:
            cells = np.flatnonzero(self.all)
            return cells, self.all[cells]
        return _added(self.cells, self.counts)


def _summed(batches, keys: list[str], kind: str, bits: int):
    """(key, cells, sums) of each run of rows with equal ``keys``."""
    last, tile = None, None
    for batch in batches:
        names = list(zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys], strict=True))
        cells, counts = (batch.column(batch.schema.get_field_index(c)) for c in ("cells", "counts"))
        for k, key in enumerate(names):
            if key != last:
                if tile is not None:
                    yield last, *tile.sums()
                last, tile = key, _Tile(1 << (2 * bits) if key[0] < HEAD and key[1] < HEAD else None)
            tile.add(_cells(cells[k].as_py()), np.frombuffer(counts[k].as_py(), kind))
    if tile is not None:
        yield last, *tile.sums()


def frequent_cells(parts: DataFrame, least: int, bits: int = BITS, wide: int | None = None) -> DataFrame:
    """``a, b, f`` of all cells whose counts add up to ``least`` or more."""

    def some(batches):
        for (ta, tb, _), cells, sums in _summed(batches, ["ta", "tb", "salt"], "<u4", bits):
            columns = [pa.array([ta], pa.int64()), pa.array([tb], pa.int64())]
            columns += [pa.array([x], pa.binary()) for x in (_packed(cells), sums.astype("<i8").tobytes())]
            yield pa.RecordBatch.from_arrays(columns, ["ta", "tb", "cells", "counts"])

    def all_of_them(batches):
        for (ta, tb), cells, sums in _summed(batches, ["ta", "tb"], "<i8", bits):
            kept = sums >= least
            columns = [*_pairs_of(ta, tb, cells[kept], bits, wide=wide), sums[kept]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "f"])

    salted = ["ta", "tb", "salt"]
    half = parts.repartition(*salted).sortWithinPartitions(*salted).mapInArrow(some, "ta long, tb long, cells binary, counts binary")
    return half.repartition("ta", "tb").sortWithinPartitions("ta", "tb").mapInArrow(all_of_them, "a long, b long, f long")


def pair_ids(
    seqs: DataFrame, parts: DataFrame, pairs: DataFrame, salts: int, bits: int = BITS, wide: int | None = None
) -> DataFrame:
    """``chunk, seq`` of the ids of ``pairs`` (``a, b, id``) at the places where neighbours are one of them.

    A tile's pairs are packed into one row, which is sent to each of the tile's salts ahead of the chunks'
    own cells there; every chunk gets back the ids of the cells that it asked for.
    """
    head, wide = HEAD << bits, wide or bits + WIDER

    def pack(batches):
        last, held = None, []

        def row():
            cells, ids = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64()), pa.array([_packed(np.array(cells))], pa.binary()),
                 pa.array([np.array(ids, "<i8").tobytes()], pa.binary())],
                ["ta", "tb", "cells", "ids"],
            )

        for batch in batches:
            for ta, tb, cell, name in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (ta, tb) != last:
                    if held:
                        yield row()
                    last, held = (ta, tb), []
                held.append((cell, name))
        if held:
            yield row()

    def tile_of(x: Column) -> Column:
        return F.when(x < head, F.shiftright(x, bits)).otherwise(HEAD + F.shiftright(x - head, wide))

    def place_of(x: Column) -> Column:
        return F.when(x < head, x.bitwiseAND((1 << bits) - 1)).otherwise((x - head).bitwiseAND((1 << wide) - 1))

    a, b = F.col("a"), F.col("b")
    shifted = F.when((a < head) & (b < head), F.shiftleft(place_of(a), bits)).otherwise(F.shiftleft(place_of(a), wide))
    packed = (
        pairs.select(tile_of(a).alias("ta"), tile_of(b).alias("tb"), (shifted + place_of(b)).alias("cell"), "id")
        .repartition("ta", "tb").sortWithinPartitions("ta", "tb", "cell")
        .mapInArrow(pack, "ta long, tb long, cells binary, ids binary")
        .select("ta", "tb", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")).alias("salt"),
                F.lit(-1).cast("long").alias("chunk"), "cells", "ids")
    )

    def answer(batches):
        at, known, ids = None, None, None
        for batch in batches:
            for ta, tb, salt, chunk, cells, found in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                cells = _cells(cells)
                if chunk < 0:
                    at, known, ids = (ta, tb, salt), cells, np.frombuffer(found, "<i8")
                elif at == (ta, tb, salt):
                    place = np.minimum(np.searchsorted(known, cells), len(known) - 1)
                    hit = known[place] == cells
                    if hit.any():
                        columns = [pa.array([x], pa.int64()) for x in (chunk, ta, tb)]
                        columns += [pa.array([x], pa.binary()) for x in (_packed(cells[hit]), ids[place[hit]].tobytes())]
                        yield pa.RecordBatch.from_arrays(columns, ["chunk", "ta", "tb", "cells", "ids"])

    asked = parts.select("ta", "tb", "salt", "chunk", "cells", F.lit(None).cast("binary").alias("ids"))
    told = (
        packed.unionByName(asked).repartition("ta", "tb", "salt").sortWithinPartitions("ta", "tb", "salt", "chunk")
        .mapInArrow(answer, "chunk long, ta long, tb long, cells binary, ids binary")
        .groupBy("chunk").agg(F.collect_list(F.struct("ta", "tb", "cells", "ids")).alias("told"))  # at most a chunk's pairs
    )

    def renumber(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                seq = _ids(batch.column(1)[k].as_py())
                told = batch.column(2)[k].values
                cells = [_cells(c) for c in told.field("cells").to_pylist()]
                sizes = [len(c) for c in cells]
                left, right = _pairs_of(
                    np.repeat(_fields(told, "ta"), sizes), np.repeat(_fields(told, "tb"), sizes),
                    np.concatenate(cells), bits, wide=wide,
                )
                names = np.frombuffer(b"".join(told.field("ids").to_pylist()), "<i8")
                # a chunk has few ids of its own, so a pair of their places fits one number
                own, place = np.unique(seq, return_inverse=True)
                width = len(own)
                key = np.searchsorted(own, left) * width + np.searchsorted(own, right)
                order = np.argsort(key)
                key, names = key[order], names[order]
                want = place[:-1] * width + place[1:]
                at = np.minimum(np.searchsorted(key, want), len(key) - 1)
                yield _one(batch.column(0)[k].as_py(), _linked(np.where(key[at] == want, names[at], -1)))

    return seqs.join(told, "chunk").mapInArrow(renumber, "chunk long, seq binary")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(2,000,000 a / (left + right)) in decimals of 38 digits."""
    wide = a.cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)")
    both = (left.cast("decimal(19,0)") + right.cast("decimal(19,0)")).cast("decimal(20,0)")
    return ((wide - wide % both) / both).cast("long")


def count_phrases(
    docs: DataFrame, least: int = LEAST, chunk: int = CHUNK, bits: int = BITS, dense: int = DENSE, text: str = "text", lang: str = "lang"
) -> tuple[DataFrame, list[DataFrame]]:
    """``lang, n`` and, for phrases of 1 to ``LONGEST`` words that occur ``least`` times, a table each.

    The first table has ``id, lang, word, f``, each other one ``id, a, b, f`` with the ids of the two parts
    that lack the last and the first word.
    """
    chunks = materialize(sequences(docs, chunk, text, lang), "chunks")
    salts = max(1, math.isqrt(chunks.count()))
    totals = materialize(chunks.groupBy("lang").agg(F.sum("n_words").alias("n")), "totals")
    words = (
        chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
        .groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f")).where(F.col("f") >= least)
    )
    levels = [ranked(words, "lang", "word")]
    seqs = materialize(word_ids(chunks, levels[0]), "seqs")
    discard(chunks)
    for length in range(2, LONGEST + 1):
        wide = tile_bits(levels[-1].count(), bits)
        parts = tiles(seqs, salts, bits, dense, wide)
        levels.append(ranked(frequent_cells(parts, least, bits, wide), "a", "b"))
        if length < LONGEST:
            then = materialize(pair_ids(seqs, parts, levels[-1], salts, bits, wide), "seqs")
            discard(seqs)
            seqs = then
    discard(seqs)
    return totals, levels


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = 2_000, share: int = 80,
    chunk: int = CHUNK, bits: int = BITS, dense: int = DENSE, text: str = "text", lang: str = "lang",
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of 2 to 4 words of each language.

    A phrase that occurs ``a`` times, ``least`` or more, is scored by its lowest-scoring cut in two parts
    with ``l`` and ``r`` occurrences: floor(2,000,000 a / (l + r)); ``n`` counts the language's words. It
    is left out if ``share`` percent of its occurrences stand in one longer phrase of the same kind: since
    a longer phrase is no more frequent than its parts, one word more decides.

    A null language is ``und``. Null and empty texts have no words, repeated rows count again, ties are
    ordered by the phrase's bytes, other columns do not matter, and an empty table gives no rows.
    """
    totals, (words, pairs, triples, quads) = count_phrases(docs, least, chunk, bits, dense, text, lang)

    def parts(table: DataFrame, of: DataFrame, columns: list[str]) -> DataFrame:
        """``table`` with the ``columns`` of both its parts, named a_... and b_..."""
        for side in ("a", "b"):
            table = table.join(of.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
        return table

    def swallowed(table: DataFrame, longer: DataFrame) -> DataFrame:
        widest = longer.select(F.explode(F.array("a", "b")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("widest"))
        return table.join(widest, "id", "left").where(F.col("widest").isNull() | (100 * F.col("widest") < share * F.col("f"))).drop("widest")

    two = materialize(parts(pairs, words, ["lang", "word", "f"]).select(
        "id", "a", "b", "f", F.col("a_lang").alias("lang"), F.col("a_f").alias("first_f"), F.col("b_f").alias("last_f"),
        F.col("a_word").alias("first"), F.concat_ws(" ", "a_word", "b_word").alias("phrase"), F.col("b_word").alias("last"),
    ), "two")
    inner = ["lang", "f", "first_f", "last_f", "phrase", "last", "a", "b"]
    three = materialize(parts(triples, two, inner).select(
        "id", "a", "b", "f", F.col("a_lang").alias("lang"), "a_f", "b_f", F.col("a_first_f").alias("first_f"), F.col("b_last_f").alias("last_f"),
        F.concat_ws(" ", "a_phrase", "b_last").alias("phrase"), F.col("b_last").alias("last"),
    ), "three")
    four = parts(quads, three, ["lang", "f", "a_f", "b_f", "first_f", "last_f", "phrase", "last"]).select(
        "id", "f", F.col("a_lang").alias("lang"), "a_f", "b_f", "a_first_f", "b_last_f", "a_a_f", "b_b_f",
        F.concat_ws(" ", "a_phrase", "b_last").alias("phrase"),
    )

    def cuts(table: DataFrame, *sides: tuple[str, str]) -> DataFrame:
        """The lowest-scoring of the cuts, which come by the length of the first part."""
        options = [
            F.struct(_score(F.col("f"), F.col(x), F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r"))
            for k, (x, y) in enumerate(sides)
        ]
        best = F.least(*options) if len(options) > 1 else options[0]
        return table.withColumn("best", best).select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "best.score")

    found = (
        cuts(swallowed(two, triples), ("first_f", "last_f"))
        .unionByName(cuts(swallowed(three, quads), ("first_f", "b_f"), ("a_f", "last_f")))
        .unionByName(cuts(four, ("a_first_f", "b_f"), ("a_a_f", "b_b_f"), ("a_f", "b_last_f")))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
        .join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
