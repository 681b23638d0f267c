"""Evaluation texts found again in observation texts, with errors: pigeonhole pieces and Myers' distance.

An evaluation text of L characters may differ in k = floor(rate * L) edits. Split into k + 1 pieces, at
least one piece must occur unchanged; all pieces of a block of evaluation texts go into one automaton
that reads each observation text once. Around the hits of an evaluation text the least edit distance
comes from Myers' bit-parallel recurrence, one big integer per column.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from obsweave.llm.common import fields, small_batches

_GAP = re.compile(r"[\W_]+")
#: Characters of evaluation texts that one automaton holds, on average.
BLOCK_CHARS = 4_000_000


def normalise(text: str) -> str:
    """Lower-case letters and digits, one blank for each run of anything else, a blank at both ends."""
    return f" {_GAP.sub(' ', text.lower()).strip()} "


def places(text: str) -> list[int] | None:
    """Where each character of ``normalise(text)`` comes from; None where lower-casing depends on the context."""
    chars, at = [" "], [0]
    for i, c in enumerate(text):
        for x in c.lower():
            x = " " if _GAP.match(x) else x
            if x != " " or chars[-1] != " ":
                chars.append(x)
                at.append(i)
    if chars[-1] != " ":
        chars.append(" ")
        at.append(len(text))
    return at if "".join(chars) == normalise(text) else None


def pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of as equal length as can be."""
    n = budget + 1
    cuts = [i * len(text) // n for i in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def nearest(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of the text, and where the first such part ends."""
    m, masks = len(pattern), {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, d = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = vn | (full & ~(xh | vp))
        hn = vp & xh
        if hp & top:
            d += 1
        elif hn & top:
            d -= 1
        hp, hn = (hp << 1) & full, (hn << 1) & full
        vp = hn | (full & ~(xv | hp))
        vn = hp & xv
        if d < best:
            best, end = d, j
    return best, end


class Index:
    """The pieces of a block of evaluation texts in one automaton."""

    def __init__(self, items: list[tuple], rate: float):
        import ahocorasick

        self.items, words = [], {}
        for item, text in items:
            norm = normalise(text or "")
            if norm.strip():
                # a text that must match exactly matches whole words
                budget = int(rate * len(norm.strip()))
                norm = norm.strip() if budget else norm
                self.items.append((item, norm, budget))
                for at, piece in pieces(norm, budget):
                    words.setdefault(piece, []).append((len(self.items) - 1, at + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in words.items():
            self.automaton.add_word(piece, where)
        if words:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple]:
        """(item, start, end, distance) in the normalised text, one for each place."""
        starts: dict[int, set[int]] = {}
        for end, where in (self.automaton.iter(text) if self.items else ()):
            for n, behind in where:
                starts.setdefault(n, set()).add(end + 1 - behind)
        out = []
        for n, found in starts.items():
            item, pattern, budget = self.items[n]
            found, regions = sorted(found), []
            for s in found:
                a, b = max(0, s - budget), s + len(pattern) + budget
                # places closer than the error budget are one
                if regions and s - regions[-1][2] <= max(budget, 1):
                    regions[-1][1:] = [b, s]
                else:
                    regions.append([a, b, s])
            hits = []
            for a, b, _ in regions:
                d, end = nearest(pattern, text[a:b])
                if d <= budget:
                    back = nearest(pattern[::-1], text[a:a + end][::-1])[1]
                    hits.append((d, a + end - back, a + end))
            # hits of one item that overlap are one place, that of the least distance (of equal ones the first)
            taken: list[tuple[int, int]] = []
            for d, a, b in sorted(hits):
                k = bisect.bisect(taken, (a, b))
                if (not k or taken[k - 1][1] <= a) and (k == len(taken) or b <= taken[k][0]):
                    taken.insert(k, (a, b))
                    out.append((item, a, b, d))
        return out


def _search(items: list[tuple], rate: float, item_kind: pa.DataType):
    def run(batches):
        index = Index(items, rate)
        for batch in batches:
            rows, found = [], []
            for i, value in enumerate(batch.column("text")):
                text = value.as_py()
                hits = index.find(normalise(text)) if text else []
                where = places(text) if hits else None
                for item, a, b, d in hits:
                    span = (where[a], where[b - 1] + 1) if where else (None, None)
                    rows.append(i)
                    found.append((item, *span, d))
            if rows:
                item, a, b, d = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(item, item_kind), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                                                  pa.array(d, pa.int64())], names=["id", "item", "start", "end", "distance"])
    return run


def _clean(items: list[tuple], rate: float):
    """Rows in whose text no item comes back."""
    def run(batches):
        index = Index(items, rate)
        for batch in batches:
            yield batch.filter(pa.array([not (text and index.find(normalise(text))) for text in (v.as_py() for v in batch.column("text"))], pa.bool_()))
    return run


def _blocks_of(wanted: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    """The incidents (item, text) by blocks of about so many characters; one block at a time goes through the driver."""
    blocks = max(-(-(wanted.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) // block_chars), 1)
    for b in range(blocks):
        yield [(r["item"], r["text"]) for r in wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()]


def uncontaminated(observations: DataFrame, incidents: DataFrame, text: str = "text", incident_id: str = "incident_id", incident_text: str = "text",
                   rate: float = 0.05, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The observation rows, whole and where they are, in whose text no incident comes back (`contaminated` says where).

    Each row is judged by its own text; null and empty texts stay. Nothing is shuffled.
    """
    small_batches(observations.sparkSession)
    out = observations.withColumnRenamed(text, "text")
    for items in _blocks_of(fields(incidents, item=incident_id, text=incident_text), block_chars):
        out = out.mapInArrow(_clean(items, rate), out.schema)
    return out.withColumnRenamed("text", text)


def contaminated(observations: DataFrame, incidents: DataFrame, obs_id: str = "obs_id", text: str = "text", incident_id: str = "incident_id",
                 incident_text: str = "text", rate: float = 0.05, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Where evaluation incidents come back in observation texts.

    Returns one row per place: obs_id, incident_id, start, end (code points of the observation text,
    end exclusive; null where lower-casing moves characters) and distance (edits between the
    normalised texts, at most ``rate`` of the incident's characters). Letters' case, punctuation and
    white space do not count.

    Overlapping hits of one incident are one place: the nearest, of equally near ones the first.
    Null and empty texts on either side match nothing. Incidents too short for an edit must come as
    whole words. A repeated row gives its rows again; a repeated incident gives a row each. Null ids
    are carried along. Other columns are ignored. An empty table gives an empty result. Each
    observation text is read whole, once for each block of about ``block_chars`` characters of
    incidents; only such a block goes through the driver, so a large evaluation set takes more
    passes and not more memory.
    """
    small_batches(observations.sparkSession)
    rows, wanted = fields(observations, id=obs_id, text=text), fields(incidents, item=incident_id, text=incident_text)
    kind, item_kind = rows.schema["id"].dataType, wanted.schema["item"].dataType
    shape = f"id {kind.simpleString()}, item {item_kind.simpleString()}, start bigint, end bigint, distance bigint"
    out = None
    for items in _blocks_of(wanted, block_chars):
        part = rows.mapInArrow(_search(items, rate, to_arrow_type(item_kind)), shape)
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("id").alias(obs_id), F.col("item").alias(incident_id), "start", "end", "distance")
