"""Near copies among observation texts: an n-gram Jaccard join that ends in groups.

Method: word n-grams ordered rare first, prefix filter, length filter, positional filter, suffix
filter, and one verification per pair on the whole sets. How it stays linear where many texts are
alike:

* Texts with equal sets are one class; only its first id joins.
* The order comes from a count of all n-grams in ``2**sketch_bits`` counters. Any fixed order gives
  right results; the counts only make prefixes rare. The counters are the one thing broadcast, and
  their size is a parameter, not a function of the data.
* The result is groups, so a pair inside one group adds nothing. In each prefix n-gram all texts meet
  the bucket's middle first (a star); of what is then still apart, texts outside a bucket's largest
  group meet the others of the bucket. Every pair that passes the filters is either verified or
  already inside one group, so no group is missed, and a large group of near copies costs its size
  and not its square.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsweave.llm.common import cut, fields, small_batches
from obsweave.llm.textbytes import U, mix, shingle_sets, slices
from obsweave.operators.components import component_labels

BLOCK = 1 << 16
SEGMENTS = 16
FLUSH = 1 << 20
#: Bits of the map of wanted ids.
BITMAP = 1 << 22


def prefix_length(n: int, percent: int) -> int:
    """Any set that shares percent % with this one shares one of its first so many n-grams."""
    return n - -(-percent * n // 100) + 1


def _profile(width: int, bits: int):
    """Per text: size, signature and segment counts of its set; per task: n-gram counts by block."""
    def run(batches):
        counts, held, size = None, [], 0

        def flush():
            nonlocal counts, held, size
            if held:
                got = np.bincount(np.concatenate(held) >> U(64 - bits), minlength=1 << bits)
                counts = got if counts is None else counts + got
            held, size = [], 0

        for batch in batches:
            for part, texts in slices(batch, "text"):
                n, hi, lo, seg = [], [], [], []
                for s in shingle_sets(texts, width):
                    n.append(len(s))
                    hi.append(int(np.bitwise_xor.reduce(mix(s + U(1)), initial=U(0)).astype(np.int64)))
                    lo.append(int(np.add.reduce(mix(s ^ U(0x5851F42D4C957F2D)), initial=U(0)).astype(np.int64)))
                    seg.append(np.bincount((s >> U(20)).astype(np.int64) % SEGMENTS, minlength=SEGMENTS).astype(np.int32).tobytes())
                    held.append(s)
                    size += len(s)
                    if size >= FLUSH:
                        flush()
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int32()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
                                                  pa.array(seg, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())],
                                                 names=["id", "n", "hi", "lo", "seg", "block", "counts"])
        flush()
        if counts is not None:
            parts = [zlib.compress(counts[k:k + BLOCK].astype(np.uint32).tobytes(), 1) for k in range(0, len(counts), BLOCK)]
            k = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, part.column("id").type), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
                                              pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())],
                                             names=["id", "n", "hi", "lo", "seg", "block", "counts"])
    return run


def _add_up(last: bool):
    """Sum the counters of one block over some tasks; at last, one byte of logarithm each remains."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64) for x in f["counts"])
        blob = np.ceil(np.log2(total + 1.0) * 2).astype(np.uint8).tobytes() if last else zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)
        return pd.DataFrame({"block": f["block"].iloc[:1], "counts": [blob]})
    return run


def _prefixes(width: int, percent: int, bits: int, level):
    """Rows (gram, id, n, at): the rarest n-grams of each text, enough for the prefix filter."""
    def run(batches):
        rare = np.frombuffer(level.value, np.uint8)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                grams, rows, sizes, at = [], [], [], []
                for i, s in enumerate(shingle_sets(texts, width)):
                    if len(s):
                        p = prefix_length(len(s), percent)
                        first = s[np.lexsort((mix(s), rare[s >> U(64 - bits)]))[:p]]
                        grams.append(first)
                        rows.append(np.full(p, i))
                        sizes.append(np.full(p, len(s), np.int32))
                        at.append(np.arange(p, dtype=np.int32))
                if grams:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), part.column("id").take(pa.array(np.concatenate(rows))),
                                                      pa.array(np.concatenate(sizes)), pa.array(np.concatenate(at))], names=["gram", "id", "n", "at"])
    return run


def _overlap(percent: int):
    """Least number of shared n-grams of two sets of these sizes."""
    return F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / F.lit(100 + percent))


def _within_reach(percent: int):
    """Length filter, and positional filter for one common n-gram.

    Before it no more can match than the n-grams that the text with fewer such has there in any
    bucket, after it no more than the shorter rest.
    """
    return ((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
            & (F.least("before_a", "before_b") + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= _overlap(percent)))


def _candidates(met: DataFrame, percent: int) -> DataFrame:
    """One row per pair; the positional filter again with all common prefix n-grams of the pair."""
    pair = met.where(_within_reach(percent)).groupBy("a", "b", "n_a", "n_b").agg(
        F.count(F.lit(1)).alias("c"), F.max("at_a").alias("at_a"), F.max("at_b").alias("at_b"))
    return pair.where(F.col("c") + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) - 1 >= _overlap(percent)).select("a", "b", "n_a", "n_b")


@F.pandas_udf(T.IntegerType())
def _apart(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sum of the differences of segment counts: no more than the size of the symmetric difference."""
    x = np.frombuffer(b"".join(a), np.int32).reshape(-1, SEGMENTS)
    y = np.frombuffer(b"".join(b), np.int32).reshape(-1, SEGMENTS)
    return pd.Series(np.abs(x - y).sum(axis=1).astype(np.int32))


def _suffix_filter(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Drop pairs whose sets differ too much in some segments of the n-gram space."""
    a, b = sets.select(F.col("id").alias("a"), F.col("seg").alias("seg_a")), sets.select(F.col("id").alias("b"), F.col("seg").alias("seg_b"))
    near = F.col("n_a") + F.col("n_b") - 2 * _overlap(percent)
    return pairs.join(a, "a").join(b, "b").where(_apart("seg_a", "seg_b") <= near).select("a", "b")


def _in_order(met: DataFrame) -> DataFrame:
    """Each pair with the lesser id first."""
    turn = F.col("a") > F.col("b")
    one = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x)).alias(x)
    return met.where("a <> b").select(*[one(f"{c}a", f"{c}b") for c in ("", "n_", "at_", "before_")], *[one(f"{c}b", f"{c}a") for c in ("", "n_", "at_", "before_")])


def marked(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows with ``_maybe``: false where the row's key is surely none of ``ids`` (column ``id``).

    A bitmap of hashed ids, of BITMAP / 64 rows whatever the data, which bounds the broadcast.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP))
    bits = (ids.where("id is not null").select(place("id").alias("p")).groupBy((F.col("p") / 64).cast("int").alias("_word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("_bits")))
    d = rows.withColumn("_p", place(key)).withColumn("_word", (F.col("_p") / 64).cast("int")).join(F.broadcast(bits), "_word", "left")
    hit = F.coalesce(F.getbit("_bits", (F.col("_p") % 64).cast("int")) == 1, F.lit(False)) & F.col(key).isNotNull()
    return d.withColumn("_maybe", hit).drop("_p", "_word", "_bits")


def one_of_each(observations: DataFrame, groups: DataFrame, obs_id: str = "obs_id", text: str = "text") -> DataFrame:
    """One observation of each group of near copies: the one of least id, and of rows of that id the one of least text.

    Rows without an id are groups of their own. Only rows whose id is one of those that go, or that comes
    more than once, are shuffled (and the few that share a bit of the bitmap with them).
    """
    gone = groups.where(f"component_id <> `{obs_id}`").select(F.col(obs_id).alias("id"), F.lit(True).alias("_gone"))
    again = groups.where(f"`{obs_id}` is not null").groupBy(F.col(obs_id).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit(False).alias("_gone"))
    special = cut(gone.unionByName(again).groupBy("id").agg(F.max("_gone").alias("_gone")))
    d = marked(observations, special, obs_id)
    sure = d.where("not _maybe").drop("_maybe")
    rest = d.where("_maybe").drop("_maybe").join(special, d[f"`{obs_id}`"] == special["id"], "left").drop("id")
    first = W.partitionBy(obs_id).orderBy(F.xxhash64(text), text)
    kept = rest.where("_gone is null").drop("_gone").unionByName(
        rest.where("not _gone").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_gone"))
    return sure.unionByName(kept)


def _texts_of(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts that some pair asks for; `marked` keeps most other texts out of the shuffle."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    maybe = marked(rows, ids).where("_maybe").select("id", "text")
    return cut(cut(maybe).join(ids, "id", "left_semi").dropDuplicates(["id", "text"]))


def _verify(width: int, percent: int):
    def run(batches):
        for batch in batches:
            for part, x in slices(batch, "text_a"):
                y = type(x).of(part.column("text_b"))
                good = []
                for s, t in zip(shingle_sets(x, width), shingle_sets(y, width), strict=True):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    good.append(100 * both >= percent * (len(s) + len(t) - both) and both > 0)
                keep = part.filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([keep.column("a"), keep.column("b")], names=["a", "b"])
    return run


def _links(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose whole sets share enough."""
    kind = pairs.schema["a"].dataType.simpleString()
    both = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"))
    return both.mapInArrow(_verify(width, percent), f"a {kind}, b {kind}")


def near_copy_groups(observations: DataFrame, obs_id: str = "obs_id", text: str = "text", width: int = 4, percent: int = 85,
                     sketch_bits: int = 21) -> DataFrame:
    """Group observations whose texts share at least ``percent`` % of their word n-grams, directly or through others.

    Words are runs of anything but blank and 0x09-0x0D, with A-Z in lower case. A text's set holds its
    distinct runs of ``width`` words; a shorter text is one run. Two texts are linked when
    100 * intersection >= percent * union. Returns obs_id, n_shingles (size of the set) and
    component_id (least obs_id reachable by links), one row per input row.

    Null and empty texts have no n-grams and stay alone. Equal texts share a class. A repeated row gives a repeated row; rows of
    one obs_id with several texts count as one node with several sets. Null obs_id: kept, alone
    (component_id null). Other columns are ignored. An empty table gives an empty result. Memory: a
    slice of texts or one text, and the counters (``2**sketch_bits`` bytes).
    """
    spark = observations.sparkSession
    small_batches(spark)
    rows = fields(observations, id=obs_id, text=text)
    kind = rows.schema["id"].dataType.simpleString()
    got = cut(rows.mapInArrow(_profile(width, sketch_bits), f"id {kind}, n int, hi bigint, lo bigint, seg binary, block int, counts binary"))
    sets = got.where("block is null").drop("block", "counts")
    kept = "block int, counts binary"
    some = got.where("block is not null").groupBy("block", F.pmod(F.hash("counts"), 64)).applyInPandas(_add_up(False), kept)
    level = some.groupBy("block").applyInPandas(_add_up(True), kept)
    # one byte for each counter: its size is fixed by sketch_bits
    rare = {r["block"]: bytes(r["counts"]) for r in level.collect()}
    blocks = max((1 << sketch_bits) // BLOCK, 1)
    counters = spark.sparkContext.broadcast(b"".join(rare.get(b, bytes(min(BLOCK, 1 << sketch_bits))) for b in range(blocks)))

    full = sets.where("n > 0 and id is not null")
    classes = cut(full.groupBy("hi", "lo", "n").agg(F.min("id").alias("rep"), F.first("seg").alias("seg")))
    reps = classes.select(F.col("rep").alias("id"), "seg").dropDuplicates(["id", "seg"])
    grams = cut(rows.where("id is not null").mapInArrow(_prefixes(width, percent, sketch_bits, counters), f"gram bigint, id {kind}, n int, at int"))

    # buckets: prefix n-grams of two texts or more; how many of them a text has, and how many before each
    common = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    found = cut(grams.join(cut(common), "gram"))
    own = W.partitionBy("id")
    shared = cut(found.join(reps.select("id").distinct(), "id", "left_semi")
                 .withColumn("before", F.row_number().over(own.orderBy("at")) - 1).withColumn("degree", F.count(F.lit(1)).over(own)))
    # the middle of each bucket is the text with the fewest n-grams of its own
    side = lambda k: [F.col("id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "at", "before")]]
    hubs = shared.groupBy("gram").agg(F.min(F.struct(-F.col("degree"), "id", "n", "at", "before")).alias("hub")).select("gram", "hub.*")
    hub = shared.select("gram", *side("b")).join(hubs.select("gram", *side("a")), "gram").drop("gram")
    tried = cut(_suffix_filter(_candidates(_in_order(hub), percent), reps, percent))
    links = cut(_links(tried, _texts_of(tried, rows), width, percent))
    labels = cut(component_labels(links))

    # what is still apart: texts outside the largest group of a bucket meet the others of the bucket
    named = shared.drop("degree").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    parts = named.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = parts.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.max_by("label", F.struct("c", "label")).alias("major")).where("k > 1").drop("k")
    # the counts of the segments, which come as four bytes each, lowest first
    byte = lambda k, b: F.substring("hex", 8 * k + 2 * b + 1, F.lit(2))
    counts = F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), lambda k: F.conv(F.concat(*[byte(k, b) for b in (3, 2, 1, 0)]), 16, 10).cast("int"))
    apart = cut(named.join(mixed, "gram").join(reps.withColumn("hex", F.hex("seg")).select("id", counts.alias("seg")), "id"))
    x = apart.where("label <> major").select("gram", *side("a"), F.col("label").alias("label_a"), F.col("seg").alias("seg_a"))
    y = apart.select("gram", *side("b"), F.col("label").alias("label_b"), "major", F.col("seg").alias("seg_b"))
    # the suffix filter goes first here: texts that share a frequent passage and little else never make a row
    differ = F.aggregate(F.zip_with("seg_a", "seg_b", lambda p, q: F.abs(p - q)), F.lit(0), lambda total, d: total + d)
    near = differ <= F.col("n_a") + F.col("n_b") - 2 * _overlap(percent)
    rest = x.join(y, (x["gram"] == y["gram"]) & (x["label_a"] != y["label_b"]) & ((y["label_b"] == y["major"]) | (x["a"] < y["b"])) & _within_reach(percent) & near)
    more = _candidates(_in_order(rest), percent)
    more = cut(_suffix_filter(more.join(tried, ["a", "b"], "left_anti"), reps, percent))
    if not more.isEmpty():
        links = cut(_links(more, _texts_of(more, rows), width, percent))
        labels = cut(component_labels(links.unionByName(labels.select(F.col("id").alias("a"), F.col("label").alias("b")))))

    out = (sets.join(classes.drop("seg"), ["hi", "lo", "n"], "left")
           .join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left"))
    return out.select(F.col("id").alias(obs_id), F.col("n").cast("long").alias("n_shingles"),
                      F.when(F.col("id").isNotNull(), F.coalesce("label", "rep", "id")).alias("component_id"))
