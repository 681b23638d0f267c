"""Connected components of an edge table.

First every task contracts the edges it holds: a union-find leaves one edge for each id that is not the
least of its local component, so cycles, repeats and chains inside a task are gone. When what is left of
all tasks together is small, by its measured number of rows, one more contraction ends it. Otherwise
alternating large-star and small-star steps go on: each is a group minimum joined back to the edges, so
no neighbourhood is ever collected, and the number of steps grows with the logarithm of the longest path.
Each step is written out, and a sum over the small table tells whether it changed anything.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsweave.session import cut

#: Edges that one task may contract at the end, about 100 MB of ids; more go through the steps.
SMALL_EDGES = 1 << 20
#: Edges that a task contracts at once before it starts afresh.
TASK_EDGES = 1 << 19


def _contract(batches):
    """Edges (u, v) -> one (id, least id of its component) for each id that is not the least; per about TASK_EDGES edges."""
    parent: dict = {}
    held = 0

    def find(x):
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    def flush():
        ids = [x for x in parent if find(x) != x]
        return pd.DataFrame({"u": ids, "v": [find(x) for x in ids]})

    for f in batches:
        for u, v in zip(f["u"].tolist(), f["v"].tolist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                low, high = (a, b) if a < b else (b, a)
                parent[high] = low
                parent.setdefault(low, low)
        held += len(f)
        if held >= TASK_EDGES:
            yield flush()
            parent.clear()
            held = 0
    if parent:
        yield flush()


def _large_star(e: DataFrame) -> DataFrame:
    sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _measured(e: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written out, with their number and an order-free sum of their hashes."""
    out, h = cut(e), F.xxhash64("u", "v")
    got = out.agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(h, 20)).alias("a"), F.bit_xor(h).alias("x")).first()
    return out, (got["n"], got["a"], got["x"])


def component_labels(edges: DataFrame, a: str = "a", b: str = "b", small_edges: int = SMALL_EDGES) -> DataFrame:
    """(id, label) for every id that has a smaller member in its component; label = least id.

    Ids without a row are the least member of their own component (singletons included), so the
    caller uses a left join and ``coalesce(label, id)``.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    shape = e.schema
    e, mark = _measured(e.mapInPandas(_contract, shape))
    if mark[0] <= small_edges:
        # a checked number of rows; TASK_EDGES is no less, so one pass sees them all together
        if mark[0] > 0:
            e = cut(e.repartition(1).mapInPandas(_contract_all, shape))
        return e.select(F.col("u").alias("id"), F.col("v").alias("label"))
    while True:
        e, now = _measured(_small_star(_large_star(e)))
        if now == mark:
            return e.select(F.col("u").alias("id"), F.col("v").alias("label"))
        mark = now


def _contract_all(batches):
    """`_contract` over everything one task is given."""
    yield from _contract(iter([pd.concat(list(batches), ignore_index=True)]))


def with_component(nodes: DataFrame, edges: DataFrame, node_id: str = "id", out: str = "component",
                   a: str = "a", b: str = "b") -> DataFrame:
    """Nodes with the least id of their component; nodes without edges keep their own id."""
    labels = component_labels(edges, a, b).select(F.col("id").alias("_id"), F.col("label").alias("_label"))
    return (nodes.join(labels, F.col(node_id) == F.col("_id"), "left")
            .withColumn(out, F.coalesce("_label", node_id)).drop("_id", "_label"))
