"""Ingest as a stream: files of raw reports -> normalised log and ledger.

Each micro-batch goes through the batch chain, so the two agree row for row. Log rows name their batch,
so a batch that is run again after a failure is judged as the first time and adds only what is missing;
one log takes one stream (rows appended by other means have no batch). The hash anti-join
against the log decides what is new; the watermark only bounds the state that drops repeats early,
and every report it drops is one the log already holds or will hold from the same window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from obsweave.operators import ingest as I
from obsweave.sources import sinks

RAW_SCHEMA = ("seq long, theater_id string, source_id string, modality string, obs_type string, occurred_start timestamp, occurred_end timestamp, "
              "lon double, lat double, geom_precision_m double, place_id long, place_name string, self_conf double, meta string, text string")

def raw_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", max_files).json(path)


def ingest_batch(grid: DataFrame, log_path: str, ledger_path: str, alias: DataFrame | None = None):
    def run(batch: DataFrame, batch_id: int) -> None:
        log = sinks.logged_hashes(batch, log_path).where(~F.col("batch_id").eqNullSafe(F.lit(batch_id))).select("content_hash")
        obs, rejected = I.normalize(batch, grid, "seq", alias, log)
        sinks.commit_batch(obs, rejected, log_path, ledger_path, batch_id)
    return run


def start_ingest(raw: DataFrame, grid: DataFrame, log_path: str, ledger_path: str, checkpoint: str, alias: DataFrame | None = None,
                 available_now: bool = True) -> StreamingQuery:
    w = raw.writeStream.foreachBatch(ingest_batch(grid, log_path, ledger_path, alias)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def distinct_reports(raw: DataFrame, delay: str = "2 days") -> DataFrame:
    """Repeats within the watermark dropped by hash before any sink; for consumers that only follow new reports."""
    from obsweave.functions import text as T
    from obsweave.functions.cells import with_cell

    d = with_cell(raw, "lon", "lat").withColumn("content_hash", T.content_hash(F.col("text"), F.col("cell_id"), F.col("occurred_start")))
    return d.withWatermark("occurred_start", delay).dropDuplicatesWithinWatermark(["content_hash"])
