"""Words, hashes and n-grams of whole texts as numpy arrays; used inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 200_000  # words hashed at once, so that a very long text needs bounded memory

# ASCII letters to lower case, other ASCII but digits to a space, bytes of other characters kept
_WORD = bytes(
    (b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32)
    for b in range(256)
)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other non-ASCII characters, A-Z lowered."""
    return text.encode("utf-8", "replace").translate(_WORD).split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every bit over the whole number."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def _span_hashes(tokens: list[bytes], n: int) -> np.ndarray:
    joined = np.frombuffer(b" ".join(tokens), np.uint8)
    power, inverse = _powers(len(joined) + 1)
    prefix = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_BYTE[joined] * power[: len(joined)], out=prefix[1:])
    spaces = np.flatnonzero(joined == 32)
    starts = np.concatenate([[0], spaces + 1])
    ends = np.concatenate([spaces, [len(joined)]])
    s, e = starts[: len(starts) - n + 1], ends[n - 1 :]
    return mix((prefix[e] - prefix[s]) * inverse[s] + (e - s).astype(np.uint64))


def shingle_hashes(tokens: list[bytes], n: int = 5) -> np.ndarray:
    """64-bit hash of every run of ``n`` words, in order; all words make one run if there are fewer."""
    if not tokens:
        return np.zeros(0, np.uint64)
    n = min(n, len(tokens))
    if len(tokens) <= SEGMENT:
        return _span_hashes(tokens, n)
    return np.concatenate([
        _span_hashes(tokens[k : k + SEGMENT + n - 1], n) for k in range(0, len(tokens) - n + 1, SEGMENT)
    ])


def word_hashes(data: bytes, segment: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words between spaces, and where they start; about ``segment`` bytes at once."""
    found, places, k = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while k < len(data):
        stop = data.find(b" ", k + segment)
        piece = np.frombuffer(data, np.uint8, (stop if stop >= 0 else len(data)) - k, k)
        edges = np.flatnonzero(np.diff(np.concatenate([[True], piece == 32, [True]])))
        s, e = edges[::2], edges[1::2]
        power, inverse = _powers(len(piece) + 1)
        prefix = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE[piece] * power[: len(piece)], out=prefix[1:])
        found.append(mix((prefix[e] - prefix[s]) * inverse[s] + (e - s).astype(np.uint64)))
        places.append(s + k)
        k += len(piece)
    return np.concatenate(found), np.concatenate(places)


def gram_hashes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every run of ``n`` words of many texts in lower case, one text after the other.

    Those of text ``k`` are ``[bounds[k], bounds[k + 1])``; a text of fewer words has none.
    """
    parts = [t.lower().encode("utf-8", "replace").translate(_WORD) for t in texts]
    hashes, places = word_hashes(b" ".join(parts))
    first = np.searchsorted(places, np.cumsum([0] + [len(p) + 1 for p in parts]))
    count = np.maximum(np.diff(first) - n + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(count)])
    if len(hashes) < n:
        return np.zeros(0, np.uint64), bounds
    power, _ = _powers(n)
    grams = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        grams += hashes[k : len(hashes) - n + 1 + k] * power[k]
    return mix(grams[np.repeat(first[:-1] - bounds[:-1], count) + np.arange(bounds[-1])]), bounds


class Spans:
    """Hashes of stretches ``[start, stop)`` of a sequence of 64-bit numbers."""

    def __init__(self, values: np.ndarray) -> None:
        power, self._inverse = _powers(len(values) + 1)
        self._prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[: len(values)], out=self._prefix[1:])

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self._prefix[stop] - self._prefix[start]) * self._inverse[start])


def slices(batches: Iterator, rows: int = 500) -> Iterator:
    """Arrow batches of ``rows`` rows at most, for work that makes much more of a row than its text."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def pieces(batches: Iterator, column: int, size: int = 1 << 20) -> Iterator:
    """Arrow batches whose texts in ``column`` have about ``size`` bytes, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        k = 0
        while k < batch.num_rows:
            stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + size, "right")))
            yield batch.slice(k, stop - k)
            k = stop


def groups(batches: Iterator, keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of equal ``keys`` in Arrow batches sorted by them, each as a list of rows."""
    last, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != last and held:
                yield last, held
                held = []
            last = key
            held.append(row)
    if held:
        yield last, held


def whole_groups(batches: Iterator, keys: list[str]) -> Iterator:
    """Arrow batches sorted by integer ``keys``, dealt anew so that none ends within a group."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        differs = np.zeros(batch.num_rows, bool)  # rows that another group begins with
        for k in keys:
            values = batch.column(k).to_numpy()
            differs[1:] |= values[1:] != values[:-1]
            differs[0] |= bool(held) and held[-1].column(k)[-1].as_py() != values[0]
        if (starts := np.flatnonzero(differs)).size:
            yield pa.Table.from_batches([*held, batch.slice(0, starts[-1])]).combine_chunks().to_batches()[0]
            held = []
            batch = batch.slice(starts[-1])
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
