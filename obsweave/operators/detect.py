"""Detections made once per tile stack, and put into log, ledger and cache as one repeatable commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsweave.operators import ingest as I
from obsweave.operators.raster import coarsen_detections
from obsweave.session import cut
from obsweave.sources import sinks

KEYS = "cache_key string, n_detections long, run long"


def stack_observations(placed: DataFrame, source_id: str, theater: str) -> DataFrame:
    """The most confident detection of each stack and cell as an observation; label and size settle ties."""
    cols = [c for c in placed.columns if c not in ("cache_key", "cell_id")]
    best = placed.groupBy("cache_key", "cell_id").agg(F.max_by(F.struct(*cols), F.struct("self_conf", "n_pixels", "label")).alias("b")).select("cache_key", "cell_id", "b.*")
    d = best.withColumn("source_id", F.lit(source_id)).withColumn("theater_id", F.lit(theater)).withColumn("modality", F.lit("imagery"))
    d = d.withColumn("occurred_start", F.col("stack_start")).withColumn("occurred_end", F.col("stack_end")).withColumn("place_id", F.lit(None).cast("long"))
    return I.with_identity(d)


def detect_and_persist(stacks: DataFrame, detect: Callable[[DataFrame], DataFrame], grid: DataFrame, root: str, source_id: str, theater: str) -> dict[str, int]:
    """Run a detector over the stacks (``cache_key``, ..) that were not processed yet and store what comes of it.

    ``detect`` maps stacks to detections (cache_key, obs_type, label, text, self_conf, n_pixels, lon, lat,
    scale_m, stack_start, stack_end). Under ``root``: ``cache`` (placed detections, no coordinates),
    ``log`` and ``ledger`` (`sinks.commit_batch`) and ``keys``, the processed stacks with their number of
    detections, also those without any. Detections outside the grid go to the ledger.

    The keys are written last and are the commit: what was not committed is done again, under the same run
    number (a hash of its stacks), which replaces its own parts. A run over processed stacks changes nothing.
    Repeated rows of a stack must be equal; null keys are never processed.
    """
    spark = stacks.sparkSession
    at = {name: f"{root}/{name}" for name in ("cache", "log", "ledger", "keys")}
    done = sinks.read_table(spark, at["keys"], KEYS, declared=True).select("cache_key")
    todo = cut(stacks.where("cache_key is not null").join(done, "cache_key", "left_anti"))
    keys = todo.select("cache_key").distinct()
    mark = keys.agg(F.count(F.lit(1)).alias("n"), F.shiftrightunsigned(F.bit_xor(F.xxhash64("cache_key")), 1).alias("run")).first()
    if not mark["n"]:
        return {"stacks": 0, "detections": 0, "placed": 0, "unplaced": 0}
    run = mark["run"]
    found = cut(detect(todo))
    placed, lost = coarsen_detections(found, grid)
    placed = cut(placed)
    only = lambda df, path: df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)
    only(placed, at["cache"])
    obs = cut(stack_observations(placed, source_id, theater))
    others = sinks.logged_hashes(obs, at["log"]).where(~F.col("batch_id").eqNullSafe(F.lit(run)))
    new, dup = I.split_new(obs, others, "cache_key")
    gone = lost.select(F.lit(theater).alias("theater_id"), F.lit(source_id).alias("source_id"), I.payload(lost, lost.columns).alias("raw_payload"), "reason")
    same = dup.select("theater_id", "source_id", I.payload(dup, dup.columns).alias("raw_payload"), F.lit("exact_dup").alias("reason"))
    sinks.commit_batch(new, gone.unionByName(same), at["log"], at["ledger"], run)
    only(keys.join(found.groupBy("cache_key").agg(F.count(F.lit(1)).alias("n_detections")), "cache_key", "left").na.fill(0, ["n_detections"]), at["keys"])
    n, ok = found.count(), placed.count()
    return {"stacks": mark["n"], "detections": n, "placed": ok, "unplaced": n - ok}
