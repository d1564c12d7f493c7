"""Benchmark decontamination with a generalised suffix automaton over the words of the test items."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.llm.text import words

WINDOW = 13  # words
COVERAGE = 20  # contaminated if a twentieth of the words is hit
BLOCK_WORDS = 200_000  # words of test items in one automaton
PIECE_WORDS = 50_000  # longer items are cut into pieces that overlap by a window less a word
RESULT = (
    "n_words long, n_hit long, longest_match long, items array<string>, "
    "spans array<struct<start:int,stop:int>>, contaminated boolean"
)


class Automaton:
    """Suffix automaton of several word sequences.

    State 0 is the empty string. ``step[s]`` maps a word number to the next state, ``link[s]`` is
    the state of the longest suffix outside ``s``'s class, ``length[s]`` its longest string.
    """

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _copy(self, parent: int, word: int, old: int) -> int:
        """A state for the strings that reach ``old`` from ``parent`` or shorter ones."""
        new = len(self.length)
        self.step.append(dict(self.step[old]))
        self.link.append(self.link[old])
        self.length.append(self.length[parent] + 1)
        self.link[old] = new
        while parent >= 0 and self.step[parent].get(word) == old:
            self.step[parent][word] = new
            parent = self.link[parent]
        return new

    def add(self, sequence: Iterable[bytes]) -> None:
        last = 0
        for token in sequence:
            word = self.number.setdefault(token, len(self.number))
            to = self.step[last].get(word)
            if to is not None:  # an earlier sequence holds this string
                last = to if self.length[to] == self.length[last] + 1 else self._copy(last, word, to)
                continue
            new = len(self.length)
            self.step.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            at = last
            while at >= 0 and word not in self.step[at]:
                self.step[at][word] = new
                at = self.link[at]
            if at >= 0:
                to = self.step[at][word]
                self.link[new] = to if self.length[to] == self.length[at] + 1 else self._copy(at, word, to)
            last = new

    def walk(self, numbers: list[int], window: int) -> Iterable[tuple[int, int]]:
        """State and matching length behind each word; words the items don't have are negative."""
        step, link, length = self.step, self.link, self.length
        state = size = 0
        for w in numbers:
            if w < 0:
                state = size = 0
            else:
                to = step[state].get(w)
                while to is None and state:
                    state = link[state]
                    size = length[state]
                    to = step[state].get(w)
                if to is None:
                    size = 0
                else:
                    state = to
                    size += 1
            yield state, size


class Items:
    """The windows of one block of test items, found through an automaton.

    An item's windows are all runs of ``window`` words, or the whole item if it is shorter.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.auto = auto = Automaton()
        for _, sequence in items:
            auto.add(sequence)
        # Which items have a window in a state: all strings of a state occur in the same items.
        self.holders: dict[tuple[int, int], set[str]] = {}
        self.short: dict[int, set[int]] = {}  # state: lengths of short items that end there
        for name, sequence in items:
            if not sequence:
                continue
            least = min(window, len(sequence))
            for state, size in auto.walk([auto.number[t] for t in sequence], window):
                if size >= least:
                    at = self._state(state, least)
                    held = self.holders.setdefault((at, least), set())
                    if name is not None:
                        held.add(name)
                    if least < window:
                        self.short.setdefault(at, set()).add(least)
        # the nearest state, up the suffix links, in which a short item ends
        self.next_short = [0] * len(auto.length)
        for s in sorted(range(1, len(auto.length)), key=auto.length.__getitem__):
            up = auto.link[s]
            self.next_short[s] = s if s in self.short else self.next_short[up] if up > 0 else 0

    def _state(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of a match in ``state``."""
        link, length = self.auto.link, self.auto.length
        while length[link[state]] >= size:
            state = link[state]
        return state

    def match(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit runs of word positions, the items with occurring windows, the longest matching length."""
        number = self.auto.number.get
        window, next_short, link, length = self.window, self.next_short, self.auto.link, self.auto.length
        hits: list[list[int]] = []
        names: set[str] = set()
        done: set[tuple[int, int]] = set()
        longest = 0
        any_short = bool(self.short)

        def mark(start: int, stop: int) -> None:
            while hits and hits[-1][1] >= start:
                start = min(start, hits.pop()[0])
            hits.append([start, stop])

        for k, (state, size) in enumerate(self.auto.walk([number(t, -1) for t in tokens], window)):
            if size > longest:
                longest = size
            if size >= window:
                at = self._state(state, window)
                mark(k + 1 - window, k + 1)
                if (at, window) not in done:
                    done.add((at, window))
                    names |= self.holders.get((at, window), set())
            if any_short and size:
                at = next_short[state]
                while at > 0:
                    # a state of short items may hold longer strings than the match
                    for least in self.short[at]:
                        if least <= size:
                            mark(k + 1 - least, k + 1)
                            if (at, least) not in done:
                                done.add((at, least))
                                names |= self.holders[at, least]
                    up = link[at]
                    at = next_short[up] if up > 0 else 0
        return [(a, b) for a, b in hits], names, longest


def item_blocks(benchmark: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW):
    """Lists of (item, words) of about ``BLOCK_WORDS`` words each, one list at a time.

    Items come to the driver in blocks, so that memory depends on ``BLOCK_WORDS`` and the longest
    item, not on the size of the benchmark.
    """
    held: list[tuple[str | None, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.col(item_id).cast("string").alias("name"), F.col(text).alias("text"))
    for r in rows.toLocalIterator():
        tokens = words(r["text"])
        for k in range(0, max(1, len(tokens) - window + 1), PIECE_WORDS):
            piece = tokens[k : k + PIECE_WORDS + window - 1]
            if piece:
                held.append((r["name"], piece))
                size += len(piece)
            if size >= BLOCK_WORDS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _one_block(docs: DataFrame, text: str, items: Items, coverage: int) -> DataFrame:
    docs = docs.drop("n_words", "n_hit", "longest_match", "items", "spans", "contaminated")
    place, names = docs.columns.index(text), docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    bundle = docs.sparkSession.sparkContext.broadcast(items)  # ``BLOCK_WORDS`` words at most, or one item piece more
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        found = bundle.value
        for batch in batches:
            out = []
            for whole in batch.column(place).to_pylist():
                tokens = words(whole)
                hits, held, longest = found.match(tokens)
                n_hit = sum(b - a for a, b in hits)
                out.append((
                    len(tokens), n_hit, longest, sorted(held), [{"start": a, "stop": b} for a, b in hits],
                    n_hit > 0 and coverage * n_hit >= len(tokens),
                ))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), span, pa.bool_()]
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                [*names, "n_words", "n_hit", "longest_match", "items", "spans", "contaminated"],
            )

    return docs.mapInArrow(run, f"{kinds}, {RESULT}")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id",
    window: int = WINDOW, coverage: int = COVERAGE,
) -> DataFrame:
    """``docs`` with the words that test items share with them.

    ``spans`` are maximal runs of hit words, ``n_hit`` their words, ``items`` the items with
    occurring windows, ``longest_match`` the longest run shared with an item (or a piece of one
    longer than ``PIECE_WORDS``), ``contaminated`` whether hits reach one word in ``coverage``. Documents stream past one automaton per block of
    items; no shuffle. With several blocks the blocks' spans are united.

    Null and empty texts have no words and are clean; null and empty items have no windows. An item
    without id counts for hits but is not listed; items of one id count once. An empty benchmark
    leaves every document clean, an empty table gives no rows. Repeated rows get equal answers.
    Columns named like a result are replaced.
    """
    out = None
    for block in item_blocks(benchmark, item_text, item_id, window):
        if out is None:
            out = _one_block(docs, text, Items(block, window), coverage)
            continue
        before = out.withColumnsRenamed({"items": "_items", "spans": "_spans", "longest_match": "_longest"})
        found = _one_block(before.drop("n_words", "n_hit", "contaminated"), text, Items(block, window), coverage)
        out = _united(found, coverage)
    return out if out is not None else _one_block(docs, text, Items([], window), coverage)


def _united(found: DataFrame, coverage: int) -> DataFrame:
    """Results of two blocks of items as one."""
    start = F.array().cast("array<struct<start:int,stop:int>>")

    def add(acc, s):
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["stop"] >= s["start"])
        joined = F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))),
        )
        return F.when(joins, joined).otherwise(F.concat(acc, F.array(s)))

    spans = F.aggregate(F.array_sort(F.concat("_spans", "spans")), start, add)
    return (
        found.withColumns({
            "items": F.array_sort(F.array_union("_items", "items")), "spans": spans,
            "longest_match": F.greatest("_longest", "longest_match"),
        })
        .withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["stop"] - s["start"])))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(coverage) * F.col("n_hit") >= F.col("n_words")))
        .drop("_items", "_spans", "_longest")
    )


def remove_spans(found: DataFrame, text: str = "text", longest: int = WINDOW) -> DataFrame:
    """``found`` with ``clean_text``: the words of a contaminated document outside its spans.

    Spans of at least ``longest`` words go from every document, shorter ones from contaminated
    documents alone. A document that loses nothing keeps its text as it is; else its lowered words
    are joined by blanks.
    """
    names, place = found.columns, [found.columns.index(c) for c in (text, "spans", "contaminated")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)

    def run(batches):
        for batch in batches:
            out = []
            for whole, spans, bad in zip(*[batch.column(k).to_pylist() for k in place], strict=True):
                spans = [s for s in spans or [] if bad or s["stop"] - s["start"] >= longest]
                if spans:
                    tokens = words(whole)
                    keep = np.ones(len(tokens), bool)
                    for s in spans:
                        keep[s["start"] : s["stop"]] = False
                    whole = b" ".join([t for t, k in zip(tokens, keep, strict=True) if k]).decode()
                out.append(whole)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*names, "clean_text"])

    return found.mapInArrow(run, f"{kinds}, clean_text string")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, in its columns and as they are."""
    return find_contamination(docs, benchmark, **options).where(~F.col("contaminated")).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
