"""Merkle manifest against a plain version: nulls, repeats, lone sources, empty logs, clashing names, many partitions."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from obsweave.llm import manifest

LOG = "obs_id bigint, source_id string, text string, leaf string, tree int, part string, pos int"
COLUMNS = ("obs_id", "source_id", "text")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows, arity):
    """Leaf, subroot, root and siblings (level by level) of every row, in the order of the tree."""
    leaf = lambda r: h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))

    def tree(nodes):
        proofs, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, place in enumerate(at):
                run = place // arity * arity
                proofs[k].append(("".join(nodes[run:place]), "".join(nodes[place + 1:run + arity])))
            nodes = [h("".join(nodes[i:i + arity])) for i in range(0, len(nodes), arity)]
            at = [i // arity for i in at]
        return nodes[0], proofs

    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subs, ways, leaves = [], [], []
    for s in sources:
        mine = sorted(by_source[s], key=lambda x: x[:3])
        root, proofs = tree([x[2] for x in mine])
        subs.append(root)
        ways.append(proofs)
        leaves.append([x[2] for x in mine])
    root, above = tree(subs)
    return sorted((leaf, subs[k], root, tuple(way + above[k])) for k in range(len(sources)) for leaf, way in zip(leaves[k], ways[k], strict=True))


def rows_of():
    rows = [(i, f"s{i % 3}", f"Text {i} é") for i in range(230)] + [(500 + i, "big", "x" * i) for i in range(300)]
    rows += [(None, "s0", "no id"), (None, "s0", None), (7, None, "no source"), (8, None, ""), (900, "lone", "one"), (900, "s1", "again"), (900, "s1", "again"), (901, "s1", "long " * 20000)]
    return rows + [(2000 + i, f"z{i:03d}é", "t") for i in range(40)]


@pytest.mark.parametrize(("arity", "part"), [(16, 37), (4, 4096)])
def test_manifest_equals_the_plain_tree(spark, arity, part):
    rows = rows_of()
    log = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], LOG).repartition(5)
    got = manifest.membership_proofs(manifest.observation_manifest(log, columns=COLUMNS, arity=arity, part_leaves=part)).collect()
    assert sorted((r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.proof)) for r in got) == plain(rows, arity)
    assert sorted((r.obs_id is None, r.obs_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)


def test_a_changed_record_does_not_verify(spark):
    rows = rows_of()
    log = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], LOG)
    claim = manifest.leaf_digest(F.col("obs_id"), F.col("source_id"), F.lower("text"))
    proofs = manifest.membership_proofs(manifest.observation_manifest(log, columns=COLUMNS, carry={"claim": claim}, part_leaves=50))
    got = proofs.select("obs_id", (manifest.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("own"), (manifest.fold(F.col("claim"), F.col("proof")) == F.col("root")).alias("changed")).collect()
    assert all(r.own for r in got)
    # the texts of the second rows of 7 and 8 have no capitals
    assert {r.obs_id for r in got if r.obs_id is not None and r.obs_id < 230 and r.changed} == {7, 8}


def test_an_empty_log_and_one_leaf(spark):
    assert manifest.membership_proofs(manifest.observation_manifest(spark.createDataFrame([], LOG), columns=COLUMNS)).count() == 0
    one = manifest.membership_proofs(manifest.observation_manifest(spark.createDataFrame([(1, "s", "t", "", 0, "", 0)], LOG), columns=COLUMNS)).first()
    assert one.leaf == one.subroot == one.root and one.proof == []


def test_octopus_asks_for_the_least_nodes():
    import numpy as np

    asked = [(lv, idx.tolist()) for lv, idx in manifest.missing_nodes(np.array([4, 5, 6, 7, 8]), 20, 4)]
    assert asked == [(0, [9, 10, 11]), (1, [0, 3]), (2, [1])]
