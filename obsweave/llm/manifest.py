"""Merkle manifest of the observation log, with octopus multiproofs.

Every observation is a leaf, every source a tree whose nodes have up to ``arity`` children, and the
sources' roots are the leaves of one more tree. Leaves are numbered by a range sort and per-partition
counts, so no source is ever sorted in one task; a level is a group-by of at most ``arity`` rows.

Proofs come by the octopus method: each run of leaves that lie next to each other (a leaf partition)
works out, level by level, which nodes its leaves' paths need and it cannot derive itself; the union
of these coordinates is fetched once, by one join; the partition then derives the interiors its leaves
share and expands the proof of every single leaf.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from obsweave.llm.common import cut

ARITY = 16
#: Leaves of one leaf partition.
PART_LEAVES = 4096
#: Nodes from this level on are wanted by many partitions; each is kept in so many copies.
HIGH_LEVEL, COPIES = 2, 8
#: The tree over the sources' roots.
TOP = -1
#: What an observation's leaf covers, in this order.
COLUMNS = ("obs_id", "source_id", "obs_type", "modality", "cell_id", "occurred_start", "occurred_end", "text")


class Manifest(NamedTuple):
    """leaves (id, source, leaf, tree, pos, n, part, carried columns), nodes (tree, level, idx, hash), number of sources."""

    leaves: DataFrame
    nodes: DataFrame
    n_sources: int
    arity: int
    carry: tuple[str, ...]


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 of the values as text, each with its number of UTF-8 bytes before it, or ``-`` for null."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c), F.lit(":"), c), F.lit("-")) for c in text]), 256)


def _numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Leaves with ``at`` = number of the range they fell into and their place in it, in the order given."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    return cut(leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))


def _places(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs (range, source) with the number of leaves before them in their tree, and sources with tree and size.

    Both tables have at most one row per source and per range; the windows run over the ranges of a
    source, over the sources that begin in a range, and over the ranges.
    """
    runs = leaves.groupBy(F.shiftright("at", 33).alias("rng"), "source").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first"))
    runs = cut(runs.withColumn("before", F.coalesce(F.sum("c").over(W.partitionBy("source").orderBy("rng").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    sources = runs.groupBy("source").agg(F.sum("c").alias("n"), F.min("first").alias("first")).withColumn("rng", F.shiftright("first", 33))
    starts = sources.groupBy("rng").agg(F.count(F.lit(1)).alias("s"))
    # one row per range that a source begins in: the number of ranges, not of rows, bounds this window
    ahead = starts.select("rng", (F.sum("s").over(W.orderBy("rng")) - F.col("s")).alias("ahead"))
    trees = sources.join(ahead, "rng").withColumn("tree", F.col("ahead") + F.row_number().over(W.partitionBy("rng").orderBy("first")) - 1)
    return runs, cut(trees.select("source", "n", "tree"))


def _levels(level: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """Node tables of all levels above, and the roots (tree, hash). Rows: tree, level, idx, n, hash."""
    out, roots = [], level.where("n = 1").select("tree", "hash")
    while True:
        level = level.where("n > 1")
        children = F.array_sort(F.collect_list(F.struct("idx", "hash")))
        up = (level.groupBy("tree", (F.col("level") + 1).alias("level"), F.floor(F.col("idx") / arity).alias("up"), F.ceil(F.col("n") / arity).alias("n"))
              .agg(F.sha2(F.array_join(F.transform(children, lambda s: s["hash"]), ""), 256).alias("hash")))
        level = cut(up.select("tree", "level", F.col("up").alias("idx"), "n", "hash"))
        if level.isEmpty():
            return out, roots
        out.append(level)
        roots = roots.unionByName(level.where("n = 1").select("tree", "hash"))


def observation_manifest(observations: DataFrame, obs_id: str = "obs_id", source_id: str = "source_id", columns: tuple[str, ...] = COLUMNS,
                         carry: dict[str, Column] | None = None, arity: int = ARITY, part_leaves: int = PART_LEAVES) -> Manifest:
    """Hash an observation log into one tree per source and a tree over the sources.

    A leaf covers ``columns`` in their order. The leaves of a source ascend by obs_id (then by leaf, so
    repeated rows and ids lie in a fixed order); the sources ascend bytewise. Nulls come first and are a
    source and an id like others. While a tree has several nodes, every ``arity`` of them in a row
    become one; a tree of one leaf is that leaf. ``carry`` adds columns to the leaves. Other columns are
    ignored, an empty log gives a manifest without nodes. Long texts are hashed in the scan and never moved.
    """
    named = observations.select(F.col(f"`{obs_id}`").alias("id"), F.col(f"`{source_id}`").cast("string").alias("source"),
                                leaf_digest(*[observations[f"`{c}`"] for c in columns]).alias("leaf"), *[c.alias(k) for k, c in (carry or {}).items()])
    extra = tuple(carry or {})
    ordered = _numbered(cut(named), ["source", "id", "leaf", *extra])
    runs, trees = _places(ordered)
    tree = trees.select(F.col("source").alias("of"), "n", "tree")
    places = (runs.join(tree, F.col("source").eqNullSafe(F.col("of")))
              .select(F.col("rng").alias("run"), "of", "n", "tree", (F.col("before") - F.col("first")).alias("shift")))
    found = ordered.withColumn("rng", F.shiftright("at", 33)).join(places, (F.col("rng") == F.col("run")) & F.col("source").eqNullSafe(F.col("of")))
    chunk = F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / part_leaves)
    leaves = found.select("id", "source", "leaf", "tree", (F.col("at") + F.col("shift")).alias("pos"), "n", (F.shiftleft("rng", 24) + chunk).alias("part"), *extra)
    leaves = cut(leaves)
    inner, roots = _levels(leaves.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), "n", F.col("leaf").alias("hash")), arity)
    n_sources = trees.count()
    roots = cut(roots)
    top = roots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), F.lit(n_sources).cast("long").alias("n"), "hash")
    upper, _ = _levels(top, arity)
    nodes = leaves.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), F.col("leaf").alias("hash"))
    for level in [*inner, top, *upper]:
        nodes = nodes.unionByName(level.select("tree", "level", "idx", "hash"))
    return Manifest(leaves, nodes, n_sources, arity, extra)


def missing_nodes(places: np.ndarray, n: int, arity: int) -> Iterator[tuple[int, np.ndarray]]:
    """Level by level, the nodes that the paths of some leaves need and that do not follow from the leaves."""
    have, level = np.unique(places), 0
    while n > 1:
        parents = np.unique(have // arity)
        children = (parents[:, None] * arity + np.arange(arity)).ravel()
        yield level, np.setdiff1d(children[children < n], have, assume_unique=True)
        have, n, level = parents, -(-n // arity), level + 1


def _octopus(n_sources: int, arity: int):
    """Coordinates (part, tree, level, idx) that a leaf partition has to fetch."""
    def run(part: pa.Table) -> pa.Table:
        tree, pos, n = (part[c].to_numpy() for c in ("tree", "pos", "n"))
        kinds, first = np.unique(tree, return_index=True)
        want = [(t, level, idx) for t, k in zip(kinds, first, strict=True) for level, idx in missing_nodes(pos[tree == t], int(n[k]), arity)]
        want += [(TOP, level, idx) for level, idx in missing_nodes(kinds, n_sources, arity)]
        sizes = [len(idx) for _, _, idx in want]
        return pa.table({"part": pa.array(np.full(sum(sizes), part["part"][0].as_py(), np.int64)), "tree": pa.array(np.repeat([t for t, _, _ in want], sizes).astype(np.int64)),
                         "level": pa.array(np.repeat([lv for _, lv, _ in want], sizes).astype(np.int32)),
                         "idx": pa.array(np.concatenate([np.zeros(0, np.int64), *[idx for _, _, idx in want]]).astype(np.int64))})
    return run


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _climb(known: dict[tuple[int, int], str], places: np.ndarray, n: int, arity: int) -> tuple[str, list[dict[int, tuple[str, str]]]]:
    """Root of a tree, and per level the siblings left and right of every node on the way, shared interiors derived once."""
    steps, have, level = [], np.unique(places), 0
    while n > 1:
        parents, beside = np.unique(have // arity), {}
        mine = set(have.tolist())
        for p in parents.tolist():
            run = [known[level, i] for i in range(p * arity, min((p + 1) * arity, n))]
            for k in range(len(run)):
                if p * arity + k in mine:
                    beside[p * arity + k] = ("".join(run[:k]), "".join(run[k + 1:]))
            known[level + 1, p] = _digest("".join(run))
        steps.append(beside)
        have, n, level = parents, -(-n // arity), level + 1
    return known[level, 0], steps


def _expand(n_sources: int, arity: int, names: tuple[str, ...], out: pa.Schema):
    """Proof of each leaf of one leaf partition from its leaves and the nodes fetched for it."""
    def run(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        if not leaves.num_rows:
            return out.empty_table()
        tree, pos, n = (leaves[c].to_numpy() for c in ("tree", "pos", "n"))
        known: dict[int, dict[tuple[int, int], str]] = defaultdict(dict)
        for t, level, idx, h in zip(*[fetched[c].to_pylist() for c in ("tree", "level", "idx", "hash")], strict=True):
            known[t][level, idx] = h
        for t, p, h in zip(tree.tolist(), pos.tolist(), leaves["leaf"].to_pylist(), strict=True):
            known[t][0, p] = h
        kinds, first = np.unique(tree, return_index=True)
        below = {}
        for t, k in zip(kinds.tolist(), first.tolist(), strict=True):
            root, steps = _climb(known[t], pos[tree == t], int(n[k]), arity)
            below[t] = (root, steps)
            known[TOP][0, t] = root
        root, above = _climb(known[TOP], kinds, n_sources, arity)
        left, right, offsets, subroots = [], [], [0], []
        for t, p in zip(tree.tolist(), pos.tolist(), strict=True):
            subroot, steps = below[t]
            for place, way in ((p, steps), (t, above)):
                for beside in way:
                    a, b = beside[place]
                    left.append(a)
                    right.append(b)
                    place //= arity
            offsets.append(len(left))
            subroots.append(subroot)
        pair = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["left", "right"])
        return pa.Table.from_arrays([*[leaves[c] for c in ("id", "source", "leaf", *names)], pa.array(subroots, pa.string()), pa.array([root] * len(subroots), pa.string()),
                                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pair)], names=["id", "source", "leaf", *names, "subroot", "root", "proof"])
    return run


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and the siblings of its path."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_text(proof: Column) -> Column:
    """All siblings of a proof, level by level, from left to right."""
    return F.array_join(F.flatten(F.transform(proof, lambda s: F.array(s["left"], s["right"]))), "")


def membership_proofs(manifest: Manifest, obs_id: str = "obs_id", source_id: str = "source_id") -> DataFrame:
    """Proof of every observation of a manifest: obs_id, source_id, leaf, carried columns, subroot, root, proof.

    ``proof`` has one entry per level, up to the source's root and on to the root of all, with the
    digests left and right of the path, each side as one text (empty where a node has no sibling).
    One row per row of the log; repeated rows have a proof each. Of an empty log nothing comes out.
    A partition of leaves is bounded by ``part_leaves``, what it fetches by ``2 * arity`` nodes a level.
    """
    leaves, extra = manifest.leaves, manifest.carry
    want = leaves.select("part", "tree", "pos", "n").groupBy("part").applyInArrow(_octopus(manifest.n_sources, manifest.arity), "part bigint, tree bigint, level int, idx bigint")
    # nodes that very many partitions ask for are kept in several copies
    high = (F.col("tree") == TOP) | (F.col("level") >= HIGH_LEVEL)
    copies = F.when(high, F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0)))
    want = want.withColumn("copy", F.when(high, F.pmod(F.hash("part"), F.lit(COPIES))).otherwise(0))
    fetched = want.join(manifest.nodes.withColumn("copy", F.explode(copies)), ["tree", "level", "idx", "copy"]).select("part", "tree", "level", "idx", "hash")
    own = leaves.select("part", "id", "source", "leaf", "tree", "pos", "n", *extra)
    pair = T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])
    shape = T.StructType([*[own.schema[c] for c in ("id", "source", "leaf", *extra)], T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType()),
                          T.StructField("proof", T.ArrayType(pair))])
    got = own.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(_expand(manifest.n_sources, manifest.arity, extra, to_arrow_schema(shape)), shape)
    return got.withColumnsRenamed({"id": obs_id, "source": source_id})


#: Levels that the SQL spells out: sources of up to 16**SQL_LEVELS leaves, and as many sources.
SQL_LEVELS = 5
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sql() -> str:
    """The same manifest, proofs and folded roots for the documents table, with every level spelt out."""
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')"
                                                for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce([4294967295::BIGINT] || {bits}, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"
    steps = [f"""leaves AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src, {leaf("text")} AS leaf,
        CASE WHEN {crc} % 5 = 0 THEN {leaf(f"translate(text, '{CAPITALS}', '{SMALL}')")} ELSE {leaf("text")} END AS claim,
        row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents)"""]
    path = "SELECT *, claim AS f, '' AS proof FROM leaves"
    walk = []
    for tree, base, at in (("s", "SELECT src AS t, pos AS i, n, leaf AS h FROM leaves", "pos"), ("r", f"SELECT 0 AS t, t AS i, count(*) OVER () AS n, h FROM s{SQL_LEVELS}", "src")):
        steps.append(f"{tree}0 AS ({base})")
        for k in range(SQL_LEVELS):
            steps.append(f"{tree}{k + 1} AS (SELECT t, i // {ARITY} AS i, CASE WHEN any_value(n) > 1 THEN (any_value(n) + {ARITY - 1}) // {ARITY} ELSE 1 END AS n, "
                         f"CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {tree}{k} GROUP BY t, i // {ARITY})")
            steps.append(f"{tree}p{k} AS (SELECT a.t, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, "
                         f"coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r, any_value(a.n) > 1 AS up "
                         f"FROM {tree}{k} a JOIN {tree}{k} b ON a.t = b.t AND a.i // {ARITY} = b.i // {ARITY} GROUP BY a.t, a.i)")
            walk.append((f"{tree}p{k}", "src" if tree == "s" else "0", f"{at} // {ARITY ** k}"))
    for k, (p, t, i) in enumerate(walk):
        steps.append(f"w{k} AS ({path})")
        path = (f"SELECT w{k}.* EXCLUDE (f, proof), CASE WHEN up THEN sha256(l || f || r) ELSE f END AS f, proof || l || r AS proof "
                f"FROM w{k} JOIN {p} ON {p}.t = {t} AND {p}.i = {i}")
    body = ",\n".join([*steps, f"w AS ({path})"])
    return (f"WITH {body}\nSELECT doc_id, leaf, s{SQL_LEVELS}.h AS subroot, r{SQL_LEVELS}.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, "
            f"f = r{SQL_LEVELS}.h AS verified FROM w JOIN s{SQL_LEVELS} ON s{SQL_LEVELS}.t = src, r{SQL_LEVELS}")
