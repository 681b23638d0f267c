"""Runs of repeated words in observation texts, by string synchronising sets.

A run is a stretch of consecutive words with smallest period q that repeats at least four times and
that neither neighbour extends. Small periods are found directly, by comparing each word with the one
q places on. Larger ones come from synchronising sets at the dyadic scales t = 8, 16, 32 ...: of all
windows of t words, each hashed, a position is selected when the least hash among the windows that
begin in the next t + 1 places lies at either end. Selection depends on 2t words alone, so equal
contexts are selected alike, and every stretch of 3t - 1 words holds a selected position among its
first t unless it is highly periodic (period at most t / 4). Those stretches are left out of the
hashing; they are runs of smaller scales and known by then.

A run of period t <= q < 2t therefore has selected positions all along, each followed q places on by
one of equal context, and no equal context between: neighbours in the sorted list of (context,
position) propose the periods. Proposals of one period that overlap are one stretch, which is extended
word by word's hash to its ends and kept when it is long enough. The number of proposals is about
2n / t a scale, whatever the text repeats.

Many texts are worked on as one array with separators that equal nothing; at each scale only texts
that can hold a run of it remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsweave.llm.common import fields, small_batches
from obsweave.llm.textbytes import U, mix

#: Periods below this are compared directly; the synchronising scales begin here (a power of two).
DIRECT = 8
#: Repetitions, and words, that make a run.
TIMES, SHORTEST = 4, 6
SLICE_WORDS = 1 << 17
_NONE = np.uint64(2**64 - 1)


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each stretch of true values."""
    edge = np.diff(np.concatenate([[0], same.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window of ``width`` = a power of two plus one."""
    out, have = h, 1
    while have < width - 1:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:-1], out[1:])


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, end: int, back: bool) -> np.ndarray:
    """How many words from a and from b on (or before them) are equal, by the hashes of 1, 2, 4 ... words."""
    got = np.zeros(len(a), np.int64)

    def step(k: int, live: np.ndarray) -> np.ndarray:
        width, h = 1 << k, levels[k]
        x, y = (a[live] - got[live] - width, b[live] - got[live] - width) if back else (a[live] + got[live], b[live] + got[live])
        inside = (x >= 0) if back else (y + width <= end)
        good = np.zeros(len(live), bool)
        good[inside] = h[x[inside]] == h[y[inside]]
        got[live[good]] += width
        return live[good]

    top, live = len(levels) - 1, np.arange(len(a))
    while len(live):
        live = step(top, live)
    for k in range(top - 1, -1, -1):
        step(k, np.arange(len(a)))
    return got


def _synchronising(h: np.ndarray, covered: np.ndarray, t: int) -> np.ndarray:
    """Selected positions: the least uncovered window hash of the next t + 1 places is at either end."""
    key = np.where(covered, _NONE, h)
    if len(key) <= t:
        return np.zeros(0, np.int64)
    low = _least(key, t + 1)
    return np.flatnonzero((low != _NONE) & ((low == key[:len(low)]) | (low == key[t:t + len(low)])))


def _proposals(h: np.ndarray, context: np.ndarray, covered: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and periods t <= q < 2t of neighbouring selected positions of equal context."""
    at = _synchronising(h, covered, t)
    at = at[at < len(context)]
    order = np.lexsort((at, context[at]))
    at, c = at[order], context[at[order]]
    q = at[1:] - at[:-1]
    good = (c[1:] == c[:-1]) & (q >= t) & (q < 2 * t)
    return at[:-1][good], q[good]


def _joined(at: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches [a, b) in which proposals [at, at + width) of one period overlap or touch."""
    order = np.lexsort((at, q))
    at, q = at[order], q[order]
    new = np.ones(len(at), bool)
    new[1:] = (q[1:] != q[:-1]) | (at[1:] > at[:-1] + width)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    return at[first], at[last] + width, q[first]


def runs_of(words: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Runs (start, end, period) of an array of word numbers that holds several texts.

    ``off`` gives the start of each text, and the end; texts stand longest first, and the word that ends
    each is a separator that occurs nowhere else. Rows are sorted by start and period.
    """
    found: list[np.ndarray] = []
    size = np.diff(off) - 1

    def active(q: int) -> int:
        """End of the texts that are long enough for a run of period q."""
        return int(off[np.searchsorted(-size, -max(SHORTEST, TIMES * q), "right")])

    for q in range(1, DIRECT):
        end = active(q)
        if end <= q:
            break
        a, b = _stretches(words[:end - q] == words[q:end])
        long = b - a + q >= max(SHORTEST, TIMES * q)
        found.append(np.stack([a[long], b[long] + q, np.full(long.sum(), q)], axis=1))

    t, levels = 1, [mix(words.astype(np.uint64) + U(0x9E3779B97F4A7C15))]
    while active(max(t, DIRECT)):
        end = active(max(t, DIRECT))
        levels = [h[:end] for h in levels]
        h = levels[-1]
        # hashes of 2t words: the contexts of this scale and the windows of the next
        context = mix(h[:-t] * U(0xD6E8FEB86659FD93) + h[t:]) if len(h) > t else h[:0]
        if t >= DIRECT:
            known = np.concatenate(found)
            deep = known[(known[:, 2] * 4 <= t) & (known[:, 1] - known[:, 0] >= t) & (known[:, 1] <= end)]
            mark = np.zeros(end + 1, np.int64)
            np.add.at(mark, deep[:, 0], 1)
            np.add.at(mark, deep[:, 1] - t + 1, -1)
            at, q = _proposals(h, context, np.cumsum(mark)[:len(h)] > 0, t)
            a, b, q = _joined(at, q, 2 * t)
            left = _common(levels, a, a + q, end, True)
            right = _common(levels, b, b + q, end, False)
            a, b = a - left, b + right + q
            long = b - a >= TIMES * q
            found.append(np.stack([a[long], b[long], q[long]], axis=1))
        levels.append(context)
        t *= 2
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    # a stretch whose period is a multiple of its smallest one is the same stretch again
    rows = np.unique(rows, axis=0)
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[keep]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Consecutive texts as words, together about SLICE_WORDS (or one text)."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        held.append((text or "").encode().split())
        size += len(held[-1])
        if size >= SLICE_WORDS:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _collapse(texts: list[list[bytes]]) -> tuple[list[np.ndarray], list[str]]:
    """Runs of each text, counted from its first word, and each text without repetitions."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    number: dict[bytes, int] = {}
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(texts[i]) + 1 for i in order], out=off[1:])
    words = np.empty(off[-1], np.int64)
    for k, i in enumerate(order):
        words[off[k]:off[k + 1] - 1] = [number.setdefault(w, len(number)) for w in texts[i]]
        words[off[k + 1] - 1] = -1 - k
    rows = runs_of(words, off)
    mark = np.zeros(off[-1] + 1, np.int64)
    np.add.at(mark, rows[:, 0] + rows[:, 2], 1)
    np.add.at(mark, rows[:, 1], -1)
    keep = np.cumsum(mark[:-1]) == 0
    edge = np.searchsorted(rows[:, 0], off)
    runs: list = [None] * len(texts)
    left: list = [None] * len(texts)
    for k, i in enumerate(order):
        mine = rows[edge[k]:edge[k + 1]]
        runs[i] = np.stack([mine[:, 0] - off[k], mine[:, 1] - mine[:, 0], mine[:, 2]], axis=1)
        kept = keep[off[k]:off[k + 1] - 1]
        left[i] = (b" ".join(texts[i]) if kept.all() else b" ".join([w for w, x in zip(texts[i], kept, strict=True) if x])).decode()
    return runs, left


def _find(batches):
    for batch in batches:
        column = batch.column("text").to_pylist()
        for first, texts in _slices(column):
            runs, left = _collapse(texts)
            offsets = np.zeros(len(texts) + 1, np.int32)
            np.cumsum([len(r) for r in runs], out=offsets[1:])
            rows = np.concatenate(runs)
            one = pa.StructArray.from_arrays([pa.array(rows[:, k], pa.int64()) for k in range(3)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(texts)), pa.array([len(x) for x in texts], pa.int64()),
                                              pa.ListArray.from_arrays(pa.array(offsets), one), pa.array(left, pa.string())], names=["id", "n_words", "runs", "collapsed"])


def periodic_runs(observations: DataFrame, obs_id: str = "obs_id", text: str = "text") -> DataFrame:
    """Runs of repeated words in each observation text, and the text without the repetitions.

    Words are runs of anything but blank and 0x09-0x0D. Returns obs_id, n_words, runs (start, length,
    period; by start, then period) and collapsed: the words, joined by one blank, but for those that some
    run holds after its first ``period`` words. A run repeats its period at least four times, holds six
    words or more, has no smaller period and ends where its neighbours break the period.

    One row per row; nulls, empty texts and blanks have no words, no runs and an empty text. Repeated rows
    and ids, and null ids, each keep their row. Other columns are ignored; an empty table gives an empty
    result. Texts are read whole and none is moved; memory is a slice of about SLICE_WORDS words or one
    text. Words are compared by number; longer stretches by 64-bit hashes built from them.
    """
    small_batches(observations.sparkSession)
    rows = fields(observations, id=obs_id, text=text)
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    shape = T.StructType([rows.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(_find, shape).withColumnRenamed("id", obs_id)


def strongest_run(runs):
    """The run that repeats its period most often; of equal ones the first."""
    more = lambda b, r: b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"])
    return F.aggregate(runs, F.get(runs, 0), lambda b, r: F.when(more(b, r), r).otherwise(b))
