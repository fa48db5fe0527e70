"""Words of many texts at once: byte spans and 64-bit hashes over Arrow batches, as numpy arrays.

A word is a run of bytes outside a separator set.  Both separator sets in use hold ASCII bytes only, so
cutting UTF-8 bytes gives the same words as cutting characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts are taken in slices of about this many bytes (at least one text), which bounds a worker's memory.
SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.ones(256, bool)  # keeps digits, ASCII letters and every byte of a character beyond ASCII
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x41:0x5B] = NOT_ALNUM[0x61:0x7B] = NOT_ALNUM[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, SLICE_BYTES + (SLICE_BYTES >> 2)), _BASE if kind == "up" else _BASE_INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches whose texts take about SLICE_BYTES, each with its texts: the field ``text`` of the struct ``row``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.column("row")
        texts = rows.flatten()[rows.type.get_field_index(text)].cast(pa.large_string())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
            yield batch.slice(start, stop - start), texts.slice(start, stop - start)
            start = stop


class Words:
    """The words of a column of texts.

    ``start`` and ``end`` are byte places in ``data``; ``first`` has, for each text and one beyond the last,
    the number of its first word.
    """

    def __init__(self, texts: pa.Array, separator: np.ndarray, lower: bool = False) -> None:
        texts = texts.cast(pa.large_binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        values = texts.buffers()[2]
        data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        self.data = LOWER[data] if lower else data
        n = len(data)
        inside = ~separator[data]
        border = np.zeros(n + 1, bool)
        border[offsets] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | border[1:n]
        ends[:-1] &= ~inside[1:] | border[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.offsets = offsets
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word that depends on its bytes alone."""
        if not len(self.start):
            return np.empty(0, np.uint64)
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power("up", n), out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * _power("down", n)[self.start])

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def sequence_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` words that start at each place; the last ``length - 1`` places are left out."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(length):
        total = total * _BASE + words[k : k + n]
    return mix(total)


def inside_text(first: np.ndarray, length: int) -> np.ndarray:
    """The places at which ``length`` words of one text start, in order."""
    fits = np.maximum(np.diff(first) - length + 1, 0)
    return np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(fits)[:-1])), fits) + np.arange(fits.sum())
