"""Word and shingle hashes of whole Arrow text columns, vectorised over the bytes of many documents.

Words are the maximal runs of characters other than blank, tab, line feed, vertical tab, form feed and
carriage return. All six are single bytes in UTF-8, so words are cut on bytes. Hashes have 64 bits and
depend on the content alone, never on the batch, slice or position that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Slices of a column are handled one by one, so that temporary arrays stay small; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every input bit."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = mix(np.arange(1 << 12, dtype=np.uint64)) | np.uint64(1)


def factors(n: int) -> np.ndarray:
    """Odd multipliers of positions 0 to n - 1."""
    global _FACTORS
    if n > len(_FACTORS):
        _FACTORS = mix(np.arange(1 << n.bit_length(), dtype=np.uint64)) | np.uint64(1)
    return _FACTORS[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column one after another, and where each row starts (one more than rows)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


class Words:
    """The words of some texts: byte spans, the number of each document's first word, and hashes."""

    def __init__(self, column: pa.Array, lower: bool = False):
        raw, self.rows = text_bytes(column)
        self.raw = LOWER[raw] if lower else raw
        inside = ~SEPARATOR[self.raw]
        first = np.zeros(len(raw) + 1, dtype=bool)
        first[self.rows] = True
        before = np.empty(len(raw), dtype=bool)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty(len(raw), dtype=bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & (~before | first[:-1]))
        self.end = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.first = np.searchsorted(self.start, self.rows)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self._inside = inside

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        begin = np.cumsum(size) - size
        within = np.arange(int(size.sum())) - np.repeat(begin, size)
        value = (self.raw[self._inside].astype(np.uint64) + np.uint64(1)) * factors(int(size.max()))[within]
        return mix(np.add.reduceat(value, begin) + size.astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, those across documents included: callers leave these out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    weights = factors(k)
    out = words[:n] * weights[0]
    for j in range(1, k):
        out = out + words[j : j + n] * weights[j]
    return mix(out)


class Spans:
    """Hashes of arbitrary word runs in constant time each, from prefix sums."""

    def __init__(self, words: np.ndarray):
        power = np.ones(len(words) + 1, np.uint64)
        power[1:] = _BASE
        power = np.cumprod(power)
        self.back = np.ones(len(words) + 1, np.uint64)
        self.back[1:] = _INVERSE
        self.back = np.cumprod(self.back)
        self.total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * power[:-1], out=self.total[1:])

    def hashes(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix((self.total[start + size] - self.total[start]) * self.back[start] + size.astype(np.uint64))


def shingle_sets(column: pa.Array, k: int, lower: bool = True) -> list[np.ndarray]:
    """Each document's distinct ``k``-word shingles as sorted 64-bit hashes.

    A document of fewer than ``k`` words has its whole sequence as one shingle; without words the set is empty.
    """
    words = Words(column, lower)
    hashes = words.hashes()
    grams = gram_hashes(hashes, k)
    out = []
    for at, n in zip(words.first[:-1].tolist(), words.count.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(grams[at : at + n - k + 1]))
        elif n:
            part = hashes[at : at + n] * factors(n)
            out.append(mix(part.sum(keepdims=True, dtype=np.uint64) + np.uint64(n << 32)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
