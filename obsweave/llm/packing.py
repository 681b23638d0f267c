"""Packing observation texts into fixed token windows by minimum bin slack.

A text is its token ids and one end id. Whole windows are cut from long texts; what remains of each
text is an item. Items are dealt into groups by a hash, and each group fills its windows one by one:
the longest item left goes in, and a subset-sum table over the multiset of the other lengths (one
bitset of reachable sums per length and power of two of its count) says which filling comes closest
to the window; walking the table back gives how many items of each length to take. What the last
windows of a group hold is too little to fill one; it is cut into lengths that are powers of two,
which need no padding.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsweave.llm.common import fields, small_batches

#: Texts of one group on average; a group is the unit of packing and of memory.
GROUP_TEXTS = 1024
#: Equal pieces of one task that may share a group.
EQUAL_PIECES = 64


def load_encoder(ranks_file: str, pattern: str, tokenizer_file: str | None = None):
    """Function from a text to its ids: byte-level BPE from a file of ranks.

    ``tokenizer_file`` is the tokenizer's own file: the tokens that it adds to the vocabulary are cut out of
    a text first and become their one id, as that tokenizer does; without it they are ordinary text.
    """
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    added = {}
    if tokenizer_file is not None:
        with open(tokenizer_file, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}
    if not added:
        return encode
    cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")")

    def split(text: str) -> list[int]:
        return [i for k, part in enumerate(cut.split(text)) for i in ([added[part]] if k % 2 else encode(part))]

    # most texts hold none of them
    return lambda text: split(text) if cut.search(text) else encode(text)


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many items of each length to take so that their sum comes as close to capacity as can be.

    Subset sums over a multiset: each count is split into powers of two, each part shifts the bitset of
    reachable sums once. Lengths are tried from the longest, and as soon as the capacity itself is
    reached the rest of the table is not needed.
    """
    full = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if 0 < x <= capacity), reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            part *= 2
        if reach >> capacity & 1:
            break
    at = reach.bit_length() - 1
    out: dict[int, int] = defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out[length] += take
            at -= length * take
    return dict(out)


def fill_windows(counts: dict[int, int], window: int) -> Iterator[tuple[dict[int, int], int]]:
    """Fillings (length -> number) and how often each is used, until no item is left."""
    left = {k: v for k, v in counts.items() if v > 0}
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        use = closest_fill(rest, window - longest)
        use[longest] = use.get(longest, 0) + 1
        # the same filling again while there are items for it
        times = max(1, min(left[k] // n for k, n in use.items()))
        yield use, times
        for k, n in use.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]


def _pieces(window: int, ranks_file: str, pattern: str, tokenizer_file: str | None, end_id: int):
    """Rows (obs_id, start, length, obs_tokens, ids, turn): the whole windows of each text and its remainder.

    ``turn`` goes up by one with every ``EQUAL_PIECES`` equal pieces of a task, so that rows that repeat very often are dealt over groups.
    """
    def run(batches):
        encode = load_encoder(ranks_file, pattern, tokenizer_file)
        seen: dict[tuple, int] = defaultdict(int)
        for batch in batches:
            rows, starts, lengths, totals, ids, turns, held = [], [], [], [], [], [], 0

            def part():
                return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                                                   pa.array(totals, pa.int64()), pa.array(ids, pa.binary()), pa.array(turns, pa.int64())], names=["obs_id", "start", "length", "obs_tokens", "ids", "turn"])
            for i, text in enumerate(batch.column("text")):
                got = encode(text.as_py() or "")
                got.append(end_id)
                # ids below 2**16 travel in two bytes each
                wide = np.array(got, "<u4")
                blob = (wide.astype("<u2") if wide.max() < 1 << 16 else wide).tobytes()
                step = len(blob) // len(got)
                name = batch.column("id")[i].as_py()
                for at in range(0, len(got), window):
                    piece = blob[step * at:step * (at + window)]
                    same = (name, at, zlib.crc32(piece))
                    turns.append(seen[same] // EQUAL_PIECES)
                    seen[same] += 1
                    rows.append(i)
                    starts.append(at)
                    lengths.append(len(piece) // step)
                    totals.append(len(got))
                    ids.append(piece)
                held += len(blob)
                if held > 8 << 20:
                    yield part()
                    rows, starts, lengths, totals, ids, turns, held = [], [], [], [], [], [], 0
            if rows:
                yield part()
    return run


def _wide(blob: bytes, length: int) -> np.ndarray:
    """Ids of a piece, which come in two or four bytes each."""
    return np.frombuffer(blob, f"<u{len(blob) // length}").astype("<u4")


def _pack_group(window: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("obs_id", "ascending"), ("start", "ascending"), ("ids", "ascending")]).combine_chunks()
        lengths = group["length"].to_pylist()
        out: list[tuple] = []  # (row, cut from, cut to, sequence, offset)
        sequence = 0
        by_length: dict[int, list[int]] = defaultdict(list)
        for row, length in enumerate(lengths):
            by_length[length].append(row)
        for rows in by_length.values():
            rows.reverse()
        tail: list[int] = []
        for use, times in fill_windows({k: len(v) for k, v in by_length.items()}, window):
            total = sum(k * n for k, n in use.items())
            for _ in range(times):
                rows = [by_length[k].pop() for k, n in sorted(use.items(), reverse=True) for _ in range(n)]
                if total < window and total & (total - 1):
                    tail += rows
                    continue
                at = 0
                for row in rows:
                    length = lengths[row]
                    out.append((row, 0, length, sequence, at))
                    at += length
                sequence += 1
        # the tail end to end, in whole windows and then in powers of two, which are never padded
        rest, room, at = sum(lengths[r] for r in tail), 0, 0
        for row in tail:
            start, length = 0, lengths[row]
            while start < length:
                if not room:
                    room = window if rest >= window else 1 << (rest.bit_length() - 1)
                    at = 0
                take = min(length - start, room)
                out.append((row, start, start + take, sequence, at))
                start, at, room, rest = start + take, at + take, room - take, rest - take
                if not room:
                    sequence += 1
        row, a, b, seq, offset = (np.array(x, np.int64) for x in zip(*out, strict=True))
        whole = group.take(pa.array(row))
        ids = [_wide(x, n)[i:j].tobytes() for x, n, i, j in zip(whole["ids"].to_pylist(), whole["length"].to_pylist(), a, b, strict=True)]
        return pa.table({"obs_id": whole["obs_id"], "start": pa.array(whole["start"].to_numpy() + a), "length": pa.array(b - a), "obs_tokens": whole["obs_tokens"],
                         "sequence_id": pa.array((group["grp"][0].as_py() << 32) + seq), "offset": pa.array(offset), "ids": pa.array(ids, pa.binary())})
    return run


def pack_windows(observations: DataFrame, ranks_file: str, pattern: str, obs_id: str = "obs_id", text: str = "text", window: int = 2048,
                 end_id: int = 1, group_texts: int = GROUP_TEXTS, tokenizer_file: str | None = None) -> DataFrame:
    """Pack the token ids of all observation texts into sequences of at most ``window`` ids.

    Returns one row per piece: obs_id, start (ids of its text before it), length, obs_tokens (ids of
    its text with the end id), sequence_id, offset (place in the sequence, gapless from 0) and ids
    (unsigned 32-bit little-endian). Every id of a text lies in exactly one piece. A sequence is full
    or its length is a power of two.

    Null and empty texts are the end id alone. Repeated rows are packed as often as they come; a null
    obs_id is carried along. Other columns are ignored. An empty table gives an empty result. A piece
    never exceeds a window, so a very long text costs one row's memory and then spreads over groups.
    ``ranks_file`` and ``tokenizer_file`` (whose added tokens count as one id each) must be readable on
    every executor; they are part of the tokenizer's installation. Equal pieces spread over groups too.
    """
    kind = observations.schema[obs_id].dataType
    small_batches(observations.sparkSession)
    rows = fields(observations, id=obs_id, text=text)
    groups = max(1, -(-observations.count() // group_texts))
    fit = T.StructType([T.StructField("obs_id", kind), *[T.StructField(c, T.LongType()) for c in ("start", "length", "obs_tokens")], T.StructField("ids", T.BinaryType()), T.StructField("turn", T.LongType())])
    pieces = rows.mapInArrow(_pieces(window, ranks_file, pattern, tokenizer_file, end_id), fit)
    out = T.StructType([T.StructField("obs_id", kind), *[T.StructField(c, T.LongType()) for c in ("start", "length", "obs_tokens", "sequence_id", "offset")],
                        T.StructField("ids", T.BinaryType())])
    return (pieces.withColumn("grp", F.pmod(F.xxhash64("obs_id", "start", F.crc32("ids"), "turn"), F.lit(groups))).drop("turn")
            .groupBy("grp").applyInArrow(_pack_group(window), out))
