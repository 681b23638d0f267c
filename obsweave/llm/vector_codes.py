"""Approximate nearest neighbours of observation embeddings by randomly rotated one-bit codes.

Vectors are dealt to the nearest of some centres. What remains of a vector after its centre is
rotated at random and kept as the signs of its coordinates, packed into bits, with two numbers: its
length and how well the signs agree with it. A query sums signed coordinates by looking up each packed
byte in a table of 256 partial sums; from that and the two numbers come an estimate of the distance and
an error bound that holds with high probability. Vectors whose lower bound is not above the k-th
upper bound are measured exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsweave.llm.common import cut, fields, small_batches

#: Rows of a block of vectors and of a block of queries, on average.
VECTOR_BLOCK, QUERY_BLOCK = 8192, 1024


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(rest: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths, and the inner product of each unit vector with its code."""
    x = rest @ turn
    norm = np.linalg.norm(x, axis=1)
    bits = x > 0
    dot = np.abs(x).sum(axis=1) / np.sqrt(x.shape[1]) / np.maximum(norm, 1e-30)
    return np.packbits(bits, axis=1), norm, np.where(norm > 0, dot, 1.0)


def estimate(codes: np.ndarray, norm: np.ndarray, dot: np.ndarray, query: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances of a rotated query to the coded vectors."""
    dim = len(query)
    q = np.linalg.norm(query)
    padded = np.zeros(codes.shape[1] * 8)
    padded[:dim] = query
    signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1
    table = padded.reshape(-1, 8) @ signs.T
    agree = np.zeros(len(codes))
    for j in range(codes.shape[1]):
        agree += table[j][codes[:, j]]
    cos = agree / np.sqrt(dim) / dot  # estimate of <unit vector, query>
    error = q * np.sqrt(np.maximum(1 - dot**2, 0)) / dot * width / np.sqrt(max(dim - 1, 1))
    mid, spread = norm**2 + q**2 - 2 * norm * cos, 2 * norm * error + 1e-6 * (norm**2 + q**2)
    return np.maximum(mid - spread, 0), mid + spread


def _unit_rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        at = np.argmin((c**2).sum(axis=1) - 2 * x @ c.T, axis=1)
        for j in range(len(c)):
            if (at == j).any():
                c[j] = x[at == j].mean(axis=0)
    return c


def _deal(model, probes: int):
    """Rows (cell, id, vec): the nearest centres of each vector."""
    def run(batches):
        c = model.value["centres"]
        for batch in batches:
            x = _unit_rows(batch.column("vec"))
            if len(x):
                far = (c**2).sum(axis=1) - 2 * x @ c.T
                near = np.argsort(far, axis=1, kind="stable")[:, :probes]
                at = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), batch.column("id").take(at), batch.column("vec").take(at)], names=["cell", "id", "vec"])
    return run


def _measure(model, k: int, width: float):
    """For each query of a block its k nearest of a block of vectors of the same cell."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        m = model.value
        ids = right["id"].to_pylist()
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            order = sorted(range(len(ids)), key=lambda i: ids[i])
            ids = [ids[i] for i in order]
            x = _unit_rows(right["vec"].combine_chunks())[order]
            centre = m["centres"][right["cell"][0].as_py()]
            codes, norm, dot = encode(x - centre, m["turn"])
            queries = _unit_rows(left["vec"].combine_chunks())
            place: dict = {}
            for i, v in enumerate(ids):
                place.setdefault(v, []).append(i)
            for name, q in zip(left["id"].to_pylist(), queries, strict=True):
                low, high = estimate(codes, norm, dot, (q - centre) @ m["turn"], width)
                own = place.get(name, [])
                low[own], high[own] = np.inf, np.inf
                n = min(k, len(ids) - len(own))
                if n:
                    some = np.flatnonzero(low <= np.partition(high, n - 1)[n - 1])
                    exact = np.sqrt(((x[some] - q)**2).sum(axis=1))
                    best = np.argsort(exact, kind="stable")[:k]  # rows are in order of id
                    out[0].extend([name] * len(best))
                    out[1].extend(ids[i] for i in some[best])
                    out[2].extend(exact[best].tolist())
        kind = right["id"].type
        return pa.table({"query": pa.array(out[0], kind), "id": pa.array(out[1], kind), "score": pa.array(out[2], pa.float64())})
    return run


def _search(queries: DataFrame, vectors: DataFrame, shared, probes: int, k: int, width: float, vector_blocks: dict, kind: str) -> DataFrame:
    """Queries against the vectors of their cells, block by block."""
    spread = F.create_map(*[F.lit(x) for pair in vector_blocks.items() for x in pair]) if vector_blocks else F.create_map(F.lit(-1), F.lit(1))
    asked = queries.mapInArrow(_deal(shared, probes), f"cell int, id {kind}, vec array<double>")
    per_cell = cut(asked.withColumn("v", F.explode(F.sequence(F.lit(0), F.coalesce(F.element_at(spread, F.col("cell")), F.lit(1)) - 1))))
    query_blocks = {r["cell"]: -(-r["c"] // QUERY_BLOCK) for r in per_cell.where("v = 0").groupBy("cell").agg(F.count(F.lit(1)).alias("c")).collect()}
    if not query_blocks:
        query_blocks = {-1: 1}
    deal = F.create_map(*[F.lit(x) for pair in query_blocks.items() for x in pair])
    q = per_cell.withColumn("q", F.pmod(F.xxhash64("id"), F.element_at(deal, F.col("cell"))).cast("int"))
    blocks = F.element_at(deal, F.col("cell"))
    v = vectors.where(blocks.isNotNull()).withColumn("q", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    keys = ["cell", "v", "q"]
    met = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(_measure(shared, k, width), f"query {kind}, id {kind}, score double")
    return met


def nearest_observations(observations: DataFrame, is_query: Column, obs_id: str = "obs_id", embedding: str = "embedding", k: int = 10, probe_share: float = 0.85,
                         fit_rows: int = 20000, cell_rows: int = 4000, most_cells: int = 1024, width: float = 3.0) -> DataFrame:
    """The ``k`` nearest observations, by Euclidean distance, of those that ``is_query`` picks.

    Returns query, rank (from 1), obs_id and score (distance in double precision of the vectors as
    given), nearest first, ties to the lesser obs_id; a vector is no neighbour of itself. Centres are
    fitted to about ``fit_rows`` vectors chosen by hash, about one for ``cell_rows`` vectors and at most
    ``most_cells``; every vector is indexed, and a query looks into the nearest ``probe_share`` of the cells (vectors without
    clusters need most of them for a recall of 0.9; clustered ones far fewer). A query
    that finds fewer than ``k`` there looks into all cells, so it gets ``k`` or all there are.

    Vectors that are null, of zero length or hold null, NaN or infinite components take no part, nor do those of
    another dimension than most. Rows of one obs_id are one observation (an arbitrary one of several
    vectors, all of a repeated row). Null obs_id: no part. Other columns are ignored. An empty table
    gives an empty result. A cell of any size is met in blocks, so equal vectors in a third of all
    rows spread over tasks.
    """
    spark = observations.sparkSession
    small_batches(spark, 5000)
    rows = fields(observations.withColumn("__asked", F.coalesce(is_query, F.lit(False))), id=obs_id, vec=embedding, asked="__asked").withColumn("vec", F.col("vec").cast("array<double>"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    good = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite)
    kind = rows.schema["id"].dataType
    name = kind.simpleString()
    out_shape = T.StructType([T.StructField("query", kind), T.StructField("rank", T.IntegerType()), T.StructField(obs_id, kind), T.StructField("score", T.DoubleType())])
    dims = good.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "d").first()
    if dims is None:
        return spark.createDataFrame([], out_shape)
    good = cut(good.where(F.size("vec") == dims["d"]).dropDuplicates(["id"]))
    n = dims["c"]
    sample = good.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, fit_rows / n))).select("id", "vec").orderBy("id").toPandas()
    x = np.array(sample["vec"].tolist(), float) if len(sample) else np.zeros((1, dims["d"]))
    model = {"centres": kmeans(x, int(np.clip(n // cell_rows, 1, most_cells))), "turn": rotation(dims["d"])}
    probes = max(1, int(np.ceil(probe_share * len(model["centres"]))))
    shared = spark.sparkContext.broadcast(model)
    dealt = cut(good.select("id", "vec").mapInArrow(_deal(shared, 1), f"cell int, id {name}, vec array<double>"))
    # at most most_cells rows
    blocks = {r["cell"]: int(-(-r["c"] // VECTOR_BLOCK)) for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).collect()}
    spread = F.create_map(*[F.lit(v) for pair in blocks.items() for v in pair])
    vectors = dealt.withColumn("v", F.pmod(F.xxhash64("id"), F.element_at(spread, F.col("cell"))).cast("int"))
    queries = good.where("asked").select("id", "vec")
    best = lambda df: (df.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "id"))), 1, k).alias("best")))  # noqa: E731  k a block
    found = cut(best(_search(queries, vectors, shared, probes, k, width, blocks, name)))
    if len(model["centres"]) > probes:
        full = found.where(F.size("best") >= min(k, n - 1)).select(F.col("query").alias("id"))
        short = queries.join(full, "id", "left_anti")
        more = best(_search(short, vectors, shared, len(model["centres"]), k, width, blocks, name))
        found = found.where(F.size("best") >= min(k, n - 1)).unionByName(more)
    return found.select("query", F.posexplode("best").alias("r", "b")).select("query", (F.col("r") + 1).cast("int").alias("rank"), F.col("b.id").alias(obs_id), F.col("b.score").alias("score"))
