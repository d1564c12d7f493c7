"""Token ids in directly addressable codes.

An id is split into chunks of ``CHUNK`` bits. Level 0 holds the lowest chunk of every id; a bitmap
says for each whether it goes on, and level 1 holds the next chunk of those that do, and so on. The
place of an id's next chunk is the number of set bits before it, which a directory of counts at
every ``STRIDE`` bits gives with one short popcount. So any token is read without decoding others.

A segment holds whole documents in order of their ids, in one Parquet row: level arrays, bitmaps,
directories, and where each document begins. Spark writes and reads the files, so they can be in
any store that Spark reaches.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 8
STRIDE = 512
SEGMENT = 1 << 16  # ids after which a segment is closed; a document is never divided
CACHE = 150_000  # words whose ids a worker process remembers, twice
TOGETHER = 1 << 22  # bytes of texts that are encoded at once, or one longer text
END = 2
_LETTER = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")  # lower-case letters that are one character in every form
_LATIN = re.compile("[\0-\u012f\u0131-\u024f]*")  # lower case has one character for one
FILE = (
    "part int, segment int, first long, n_ids long, "
    "chunks array<binary>, more array<binary>, ranks array<binary>, doc_ids array<long>, doc_starts array<long>"
)


def encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels of chunks, continuation bitmaps and rank directories of unsigned 32-bit ids."""
    chunks, more, ranks = [], [], []
    rest = np.asarray(ids, np.uint32)
    while True:
        chunks.append((rest & 0xFF).astype(np.uint8).tobytes())
        rest = rest >> CHUNK
        goes_on = rest > 0
        more.append(np.packbits(goes_on, bitorder="little").tobytes())
        counts = np.concatenate([[0], np.cumsum(goes_on)])[:: STRIDE]
        ranks.append(counts.astype("<u4").tobytes())
        rest = rest[goes_on]
        if not len(rest):
            return chunks, more, ranks


def decode(chunks: list[bytes], more: list[bytes]) -> np.ndarray:
    """All ids of a segment."""
    levels = []
    for k, level in enumerate(chunks):
        size = len(level)
        bits = np.unpackbits(np.frombuffer(more[k], np.uint8), count=size, bitorder="little").astype(bool)
        levels.append((np.frombuffer(level, np.uint8).astype(np.uint32), bits))
    out = np.zeros(0, np.uint32)
    for value, bits in reversed(levels):
        whole = value.copy()
        whole[bits] |= out << np.uint32(CHUNK)
        out = whole
    return out


def access(chunks: list[bytes], more: list[bytes], ranks: list[bytes], i: int) -> int:
    """The ``i``-th id alone: one chunk, one bit and one rank per level."""
    value = 0
    for level in range(len(chunks)):
        value |= chunks[level][i] << (CHUNK * level)
        bits = more[level]
        if not (bits[i >> 3] >> (i & 7)) & 1:
            return value
        block = i // STRIDE
        start = block * STRIDE
        before = int.from_bytes(bits[start >> 3 : (i >> 3) + 1], "little") & ((1 << (i - start)) - 1)
        i = int.from_bytes(ranks[level][4 * block : 4 * block + 4], "little") + before.bit_count()
    return value


class Words:
    """Whole texts to ids through the tokenizers library, remembering the ids of words.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its
    words in order; and stops behind a letter are tokens of their own. Words are remembered in two
    generations of ``cache`` at most, and those that come again move to the younger one.
    """

    def __init__(self, tokenizer_path: str, cache: int = CACHE) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.cache = cache
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.bytes = {c: split(chr(c))[0][0] for c in range(0xC0, 0x250) if _PLAIN.fullmatch(chr(c))}

    def _learn(self, words: list[str]) -> None:
        """Put ``words`` into the young generation."""
        young, old = self.young, self.old
        new: set[str] = set()
        stopped: list[tuple[str, str, str]] = []
        for word in words:
            code = old.get(word)
            if code is not None:
                young[word] = code
            elif word[-1] in ".,":
                core = word.rstrip(".,")
                if _LETTER.match(core[-1:]):
                    tail = word[len(core) :]
                    stopped.append((word, core, tail))
                    new.add(core)
                    new.add(tail)
                else:
                    new.add(word)
            else:
                new.add(word)
        fresh = []
        for part in new:
            if part not in young:
                code = old.get(part)
                if code is None:
                    fresh.append(part)
                else:
                    young[part] = code
        self._encode(fresh)
        for word, core, tail in stopped:
            young[word] = young[core] + young[tail]

    def _encode(self, fresh: list[str]) -> None:
        """Lower-case words of letters go to the tokenizer's model, all others through all its steps.

        To such a word the steps before the model do nothing but write its bytes as characters, for
        which ``self.bytes`` has the tokenizer's own answers.
        """
        young, tokenize, table, plain = self.young, self.tokenizer.model.tokenize, self.bytes, _PLAIN.fullmatch
        rest = []
        for word in fresh:
            if plain(word):
                ids = [t.id for t in tokenize(word if word.isascii() else word.translate(table))]
                young[word] = pack(f"<{len(ids)}I", *ids)
            else:
                rest.append(word)
        for k in range(0, len(rest), 5_000):
            some = rest[k : k + 5_000]
            for word, code in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                young[word] = pack(f"<{len(code.ids)}I", *code.ids)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text.

        Words are looked up once for all texts; the rest is array work.
        """
        plain = []
        for text in texts:
            text = text or ""
            if "<|" not in text and _LATIN.fullmatch(text):  # lowering must not make a special token
                text = text.lower()
            plain.append(text.replace("\n", " "))
        split = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        bounds = split.offsets.to_numpy()
        found = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        place, names = found.indices.to_numpy(), found.dictionary.to_pylist()
        if len(self.young) > self.cache:
            self.old, self.young = self.young, {}
        self.young[""] = b""
        known = self.young
        codes = list(map(known.get, names))
        if None in codes:
            self._learn([n for n, code in zip(names, codes, strict=True) if code is None])
            codes = list(map(known.__getitem__, names))
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        starts = np.cumsum(sizes) - sizes
        length = sizes[place]
        ends = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat(starts[place] - ends[:-1], length)
        at += np.arange(ends[-1])
        ids = np.frombuffer(b"".join(codes), "<u4")[at]
        cuts = ends[bounds - bounds[0]].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


_SHARED: dict[str, Words] = {}


def shared_words(tokenizer_path: str) -> Words:
    """The worker process's own ``Words``: loaded once, and warm for its later tasks."""
    if tokenizer_path not in _SHARED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        _SHARED.clear()
        _SHARED[tokenizer_path] = Words(tokenizer_path)
    return _SHARED[tokenizer_path]


def write_ids(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END,
    text: str = "text", doc_id: str = "doc_id", segment: int = SEGMENT,
) -> None:
    """Write the ids of every whole text, each with ``end_id`` behind it, in ascending ``doc_id`` order.

    Null texts are empty and give the end id alone. Null ids come first. Rows of one id follow each
    other in the order of a hash of their texts; equal rows are kept. Documents are range-partitioned
    by id and hash, so no id is too frequent for a task. An empty table gives no segments.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words = shared_words(tokenizer_path)
        part, number, first = TaskContext.get().partitionId(), 0, 0
        names, starts, held, size = [], [], [], 0

        def close():
            chunks, more, ranks = encode(np.frombuffer(b"".join(held), "<u4"))
            row = [part, number, first, size, chunks, more, ranks, names, starts]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.binary())] * 3, *[pa.list_(pa.int64())] * 2]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds, strict=True)],
                ["part", "segment", "first", "n_ids", "chunks", "more", "ranks", "doc_ids", "doc_starts"],
            )

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            size_of = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
            edges = [0, *(np.flatnonzero(np.diff(size_of // TOGETHER)) + 1).tolist(), len(ids)]
            for k, stop in zip(edges, edges[1:], strict=False):
                for name, code in zip(ids[k:stop], words.ids(texts[k:stop].to_pylist()), strict=True):
                    names.append(name)
                    starts.append(size)
                    held += (code, end)
                    size += len(code) // 4 + 1
                    if size >= segment:
                        yield close()
                        number, first = number + 1, first + size
                        names, starts, held, size = [], [], [], 0
        if names:
            yield close()

    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_h"))
        .repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h")
        .select("doc_id", "text").mapInArrow(run, FILE)
        .write.parquet(path)
    )


def part_starts(files: DataFrame) -> DataFrame:
    """``part, part_start``: ids in all parts before; one row per part."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("part_start")
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    files = spark.read.schema(FILE).parquet(path)

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                data = decode(r["chunks"], r["more"]).astype("<u4")
                stops = [*r["doc_starts"][1:], len(data)]
                for name, a, b in zip(r["doc_ids"], r["doc_starts"], stops, strict=True):
                    rows.append((r["part"], name, r["first"] + a, b - a, zlib.crc32(data[a:b].tobytes())))
            kinds = [pa.int32(), *[pa.int64()] * 4]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["part", "doc_id", "first", "n_tokens", "ids_crc32"],
            )

    decoded = files.select("part", "first", "chunks", "more", "doc_ids", "doc_starts").mapInArrow(
        run, "part int, doc_id long, first long, n_tokens long, ids_crc32 long"
    )
    return decoded.join(part_starts(files), "part").select(
        "doc_id", (F.col("part_start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_tokens(spark: SparkSession, path: str, positions: list[int]) -> dict[int, int | None]:
    """Single tokens by their position among all ids; only the segments that hold them are read.

    A position outside the files gives None.
    """
    files = spark.read.schema(FILE).parquet(path)
    wanted = sorted(set(positions))
    holds = F.lit(False)
    start = F.col("part_start") + F.col("first")
    for p in wanted:
        holds = holds | ((start <= p) & (start + F.col("n_ids") > p))
    out: dict[int, int | None] = dict.fromkeys(positions)
    rows = files.join(part_starts(files), "part").where(holds).select(start.alias("start"), "n_ids", "chunks", "more", "ranks")
    for r in rows.toLocalIterator():
        for p in wanted[bisect_right(wanted, r["start"] - 1) :]:
            if p >= r["start"] + r["n_ids"]:
                break
            out[p] = access(r["chunks"], r["more"], r["ranks"], p - r["start"])
    return out
