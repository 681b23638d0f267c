"""Elias-Fano sequences and an n-gram trie made of them, read from one memory map.

A sequence of n ascending numbers below U keeps log2(U / n) low bits of each in packed form and the
rest in unary, about 2 bits more. Reads are vectorised: they take and give arrays.
"""

from __future__ import annotations

import mmap

import numpy as np

U = np.uint64
#: Counts up to this are exact in a code; above it codes grow by a fourth root of two.
EXACT = 128


def quantise(count: np.ndarray, total: int) -> np.ndarray:
    """One byte for the log-probability count / total; 0 stands for none.

    Codes 1 to EXACT are small multiples of 1 / total, the others a geometric scale above.
    """
    up = EXACT + np.rint(4 * np.log2(np.maximum(count, 1) / EXACT))
    return np.where(count <= EXACT, count, np.clip(up, EXACT, 255)).astype(np.uint8)


def log_probabilities(total: int) -> np.ndarray:
    """log10 of the probability that each code stands for."""
    code = np.arange(256.0)
    mass = np.where(code <= EXACT, code, EXACT * 2.0 ** ((code - EXACT) / 4))
    with np.errstate(divide="ignore"):
        return np.log10(mass) - np.log10(max(total, 1))


#: Place of the one of each rank in each byte.
_IN_BYTE = np.array([[next((k for k in range(8) if byte >> k & 1 and (byte & ((1 << k) - 1)).bit_count() == rank), 0) for rank in range(8)] for byte in range(256)], np.int64)


def _select(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the one that has ``rank`` ones before it in each word."""
    rank, at = rank.astype(np.int64), np.zeros(len(word), np.int64)
    for width in (32, 16, 8):
        below = np.bitwise_count(word & U((1 << width) - 1)).astype(np.int64)
        on = rank >= below
        rank -= below * on
        step = on * width
        word = word >> step.view(np.uint64)
        at += step
    return at + _IN_BYTE[(word & U(255)).astype(np.int64), rank]


class EliasFano:
    """``parts`` = [n and number of low bits, low words, high words, ones before each high word]."""

    def __init__(self, parts: list[np.ndarray]):
        (self.n, self.bits), self.low, self.high, self.ones = (int(x) for x in parts[0]), *parts[1:]
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    @staticmethod
    def build(values: np.ndarray) -> list[np.ndarray]:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(int(np.log2(max(top, 1) / max(n, 1))), 0) if top > n else 0
        place = np.arange(bits, dtype=np.uint64)
        packed = np.packbits(((values[:, None] >> place) & U(1)).astype(np.uint8), bitorder="little") if bits else np.zeros(0, np.uint8)
        low = np.zeros(-(-len(packed) // 8) + 2, np.uint64)
        low.view(np.uint8)[:len(packed)] = packed
        mark = np.zeros(-(-(n + (top >> bits) + 2) // 64) * 64, np.uint8)
        mark[(values >> U(bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(mark, bitorder="little").view(np.uint64)
        ones = np.zeros(len(high) + 1, np.int64)
        np.cumsum(np.bitwise_count(high), out=ones[1:])
        return [np.array([n, bits], np.int64), low, high, ones]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        both = (self.low[word] >> shift) | np.where(shift > 0, self.low[word + 1] << ((U(64) - shift) & U(63)), U(0))
        return both & U((1 << self.bits) - 1)

    def _find(self, k: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        word = np.searchsorted(before, k, "right") - 1
        bits = self.high[word]
        return word * 64 + _select(~bits if flip else bits, k - before[word])

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values at places."""
        return ((self._find(i, self.ones, False) - i).astype(np.uint64) << U(self.bits)) | self._lows(i)

    def successor(self, x: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place in [first, end) whose value is not below x, and whether it is x."""
        h = np.minimum((x >> U(self.bits)).astype(np.int64), int(self.zeros[-1]) - 1)
        upto = self._find(h, self.zeros, True) - h
        below = np.where(h > 0, self._find(np.maximum(h - 1, 0), self.zeros, True) - (h - 1), 0)
        lo, hi, want = np.maximum(first, below), np.minimum(end, upto), x & U((1 << self.bits) - 1)
        stop = hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._lows(mid) < want[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        hit = lo < stop
        hit[hit] = (self._lows(lo[hit]) == want[hit]) & ((x[hit] >> U(self.bits)).astype(np.int64) == h[hit])
        return lo, hit


def _relative(ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Numbers of each range on top of the last one of the range before, so that all ascend."""
    last = ids[start[1:] - 1].astype(np.uint64)
    base = np.concatenate([np.zeros(1, np.uint64), np.cumsum(last, dtype=np.uint64)[:-1]]) if len(last) else last
    return ids.astype(np.uint64) + np.repeat(base, np.diff(start))


class NgramTrie:
    """Words, pairs and triples in three levels; a node's children lie between two monotone pointers.

    Numbers on a level are relative to the context: a child's number counts from the last number of the
    context before, and is found by successor search between its context's pointers.
    """

    def __init__(self, buffer):
        head = np.frombuffer(buffer, np.int64, 1)[0]
        sizes = np.frombuffer(buffer, np.int64, head, 8)
        at, parts = 8 + 8 * int(head), []
        for k, size in enumerate(sizes.tolist()):
            kind = np.uint8 if k >= 20 else np.int64 if k % 4 in (0, 3) else np.uint64
            parts.append(np.frombuffer(buffer, kind, size // np.dtype(kind).itemsize, at))
            at += -(-size // 8) * 8
        self.words, self.to_pairs, self.pairs, self.to_triples, self.triples = (EliasFano(parts[4 * k:4 * k + 4]) for k in range(5))
        self.pair_code, self.triple_code = parts[20:]

    @classmethod
    def build(cls, pair: np.ndarray, pair_count: np.ndarray, context: np.ndarray, word: np.ndarray, count: np.ndarray, total: int) -> NgramTrie:
        """From ascending pairs (first << 32 | second) and triples (index of their pair, word), in an anonymous memory map."""
        first = pair >> U(32)
        heads, start = np.unique(first, return_index=True)
        to_pairs = np.append(start, len(pair))
        to_triples = np.searchsorted(context, np.arange(len(pair) + 1))
        # pairs without triples take no numbers of the third level
        some = np.flatnonzero(np.diff(to_triples))
        parts = [EliasFano.build(heads), EliasFano.build(to_pairs.astype(np.uint64)), EliasFano.build(_relative(pair & U(0xFFFFFFFF), to_pairs)),
                 EliasFano.build(to_triples.astype(np.uint64)), EliasFano.build(_relative(word, np.append(to_triples[some], len(word))))]
        arrays = [*[a for p in parts for a in p], quantise(pair_count, total), quantise(count, total)]
        sizes = [a.nbytes for a in arrays]
        room = mmap.mmap(-1, 8 + 8 * len(sizes) + sum(-(-s // 8) * 8 for s in sizes))
        room.write(np.array([len(sizes), *sizes], np.int64).tobytes())
        for a in arrays:
            room.write(a.tobytes() + bytes(-a.nbytes % 8))
        return cls(room)

    def _child(self, level: EliasFano, pointers: EliasFano, node: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, end = pointers.at(node).astype(np.int64), pointers.at(node + 1).astype(np.int64)
        base = np.zeros(len(node), np.uint64)
        base[first > 0] = level.at(first[first > 0] - 1)
        return level.successor(base + number.astype(np.uint64), first, end)

    def look_up(self, pair: np.ndarray, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of pairs (first << 32 | second) and of triples (index of their pair, word); 0 where the trie has none."""
        pair_code, triple_code = np.zeros(len(pair), np.uint8), np.zeros(len(word), np.uint8)
        if not self.words.n or not len(pair):
            return pair_code, triple_code
        node = np.full(len(pair), -1, np.int64)
        heads, back = np.unique(pair >> U(32), return_inverse=True)
        i, hit = self.words.successor(heads, np.zeros(len(heads), np.int64), np.full(len(heads), self.words.n, np.int64))
        some = np.flatnonzero(hit[back])
        j, hit = self._child(self.pairs, self.to_pairs, i[back[some]], pair[some] & U(0xFFFFFFFF))
        node[some[hit]] = j[hit]
        pair_code[some[hit]] = self.pair_code[j[hit]]
        if self.triples.n:
            some = np.flatnonzero(node[context] >= 0)
            j, hit = self._child(self.triples, self.to_triples, node[context[some]], word[some])
            triple_code[some[hit]] = self.triple_code[j[hit]]
        return pair_code, triple_code
