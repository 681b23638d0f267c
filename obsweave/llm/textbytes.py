"""Words, n-grams and their hashes for whole Arrow text columns at once.

Everything works on the UTF-8 bytes of many texts laid end to end: a table lookup lower-cases A-Z, a
comparison finds word borders, and prefix sums of a polynomial give the hash of any byte range, so no
Python loop runs over words. Slices bound the memory to a few times ``SLICE_BYTES`` (or one text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
U = np.uint64
_RATIO, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240117).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        ratio = _RATIO if kind == "up" else pow(_RATIO, -1, _MASK + 1)
        steps = np.full(max(n, SLICE_BYTES + 4096), ratio, np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.cumprod(steps)
    return have[:n]


class Texts:
    """Some texts laid end to end: ``data`` (uint8), ``off`` (start of each text, and the end)."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off, self.n = data, off, len(off) - 1

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        column = pc.fill_null(column, "")
        wide = pa.types.is_large_string(column.type)
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        return cls(raw[off[0]:off[-1]], off - off[0])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and how many words precede each text (and the end)."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)
        ink = ~SPACE[self.data]
        first, last = ink.copy(), ink.copy()
        cut = np.zeros(len(ink) + 1, bool)
        cut[self.off] = True
        first[1:] &= ~ink[:-1] | cut[1:-1]
        last[:-1] &= ~ink[1:] | cut[1:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return start, end, np.searchsorted(start, self.off)

    def sums(self, table: np.ndarray = LOWER) -> np.ndarray:
        s = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_TABLE[table[self.data]] * _power("up", len(self.data)), out=s[1:])
        return s

    def hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte range; equal bytes (after the table) give equal hashes."""
        back = _power("down", len(sums))
        return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def slices(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Consecutive row ranges of a batch whose texts together hold about SLICE_BYTES."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
        part = batch.slice(at, to - at)
        yield part, Texts.of(part.column(text))
        at = to


def shingle_sets(texts: Texts, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``width`` words.

    A text with fewer words gives one hash of the whole sequence, a text without words none.
    """
    start, end, before = texts.words()
    h = texts.hashes(texts.sums(), start, end) if len(start) else np.zeros(0, np.uint64)
    runs = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width):
        runs = mix(runs * U(0xD6E8FEB86659FD93) + h[k:k + len(runs)])
    for i in range(texts.n):
        a, b = before[i], before[i + 1]
        if b - a >= width:
            yield np.unique(runs[a:b - width + 1])
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                short = mix(short * U(0xA0761D6478BD642F) + h[k:k + 1])
            yield short
        else:
            yield np.zeros(0, np.uint64)
