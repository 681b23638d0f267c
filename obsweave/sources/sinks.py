"""Append-only log, rebuildable read model, annotations and static export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.operators import ingest as I
from obsweave.session import cut

REVIEW_ACTIONS = ["confirm", "split", "reject", "flag"]     # fixed values
LABEL_KINDS = ["incident_label", "gray_verdict"]


def read_table(spark: SparkSession, path: str, schema: str | None = None, declared: bool = False) -> DataFrame | None:
    """A Parquet table, or an empty frame of ``schema`` where nothing was written yet; None without a schema.

    ``declared`` reads the columns of ``schema``; older files without one of them give null.
    """
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return (spark.read.schema(schema) if declared else spark.read).parquet(path)
    return spark.createDataFrame([], schema) if schema else None


LOG_KEYS = "content_hash string, batch_id long, theater_id string, start_date date"
LEDGER = "theater_id string, source_id string, raw_payload string, reason string, batch_id long"


def logged_hashes(df: DataFrame, log_path: str) -> DataFrame:
    """(content_hash, batch_id) of the log rows that rows of ``df`` can equal.

    A hash covers the hour of the start, so only the folders of the batch's own dates are opened. A
    batch has few dates (one row each goes through the driver), however long the log is.
    """
    log = read_table(df.sparkSession, log_path, LOG_KEYS, declared=True)
    days = [r[0] for r in df.select(F.to_date("occurred_start").alias("d")).distinct().collect()]
    known = [d for d in days if d is not None]
    near = F.col("start_date").isin(known) if known else F.lit(False)
    return log.where(near | F.col("start_date").isNull() if None in days else near).select("content_hash", "batch_id")


def commit_batch(obs: DataFrame, rejected: DataFrame, log_path: str, ledger_path: str, batch_id: int) -> None:
    """Put one batch into log and ledger, as often as it is tried: rows that its earlier try has written are not written again.

    ``obs`` holds the batch's new rows (judged without its own rows in the log), ``rejected`` its ledger
    rows. The ledger's part of a batch is replaced, and the log takes what is missing of it.
    """
    obs, rejected = cut(obs), cut(rejected)
    own = logged_hashes(obs, log_path).where(F.col("batch_id").eqNullSafe(F.lit(batch_id))).select("content_hash")
    missing = cut(obs.join(own, "content_hash", "left_anti"))
    append_rejections(rejected, ledger_path, batch_id=batch_id)
    (missing.withColumn("batch_id", F.lit(batch_id).cast("long")).withColumn("start_date", F.to_date("occurred_start"))
     .write.mode("append").partitionBy("theater_id", "start_date").parquet(log_path))


def append_observations(df: DataFrame, log_path: str, ledger_path: str, order: str) -> dict[str, int]:
    """Append rows whose content hash is new; repeats go to the ledger as ``exact_dup``.

    The log is partitioned by theater and start date; of it only the hashes of the batch's dates are read.
    """
    df = cut(df)    # its dates, first copies and rows are read one by one
    marked = cut(I.mark_new(df, logged_hashes(df, log_path).select("content_hash"), order))   # decided before the log grows
    new, dup = marked.where("is_new").drop("is_new"), marked.where("not is_new").drop("is_new")
    (new.withColumn("batch_id", F.lit(None).cast("long")).withColumn("start_date", F.to_date("occurred_start"))
     .write.mode("append").partitionBy("theater_id", "start_date").parquet(log_path))
    append_rejections(dup.withColumn("reason", F.lit("exact_dup")), ledger_path, dup.columns)
    return {"ingested": new.count(), "exact_dup": dup.count()}


def append_rejections(df: DataFrame, ledger_path: str, payload_columns: list[str] | None = None, batch_id: int | None = None) -> None:
    """Ledger rows (theater_id, source_id, raw_payload, reason, batch_id), one folder per batch.

    A named batch replaces what it has written before; rows without one are added.
    """
    d = df if payload_columns is None else df.withColumn("raw_payload", I.payload(df, payload_columns))
    w = d.select("theater_id", "source_id", "raw_payload", "reason", F.lit(batch_id).cast("long").alias("batch_id")).write
    w = w.mode("append") if batch_id is None else w.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    w.partitionBy("batch_id").parquet(ledger_path)


def write_read_model(df: DataFrame, path: str) -> None:
    """Replace the theaters present in ``df``; other theaters stay. Writing twice leaves the same table."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("theater_id").parquet(path))


def append_annotation(df: DataFrame, path: str, kind: str) -> None:
    """Reviews need a known action, labels a known kind; one bad row fails the whole batch before it is written."""
    col, allowed = ("action", REVIEW_ACTIONS) if kind == "review" else ("kind", LABEL_KINDS)
    bad = df.where(~F.coalesce(F.col(col).isin(allowed), F.lit(False)))
    if not bad.isEmpty():
        raise ValueError(f"{col} must be one of {allowed}")
    df.write.mode("append").parquet(path)


def append_unseen(df: DataFrame, path: str, key: str) -> int:
    """Append rows with new keys only (verdict and detection caches); returns how many."""
    seen = read_table(df.sparkSession, path)
    new = df.dropDuplicates([key])
    if seen is not None:
        new = new.join(seen.select(key), key, "left_anti")
    new = cut(new)
    new.write.mode("append").parquet(path)
    return new.count()


def write_reads(reads: DataFrame, path: str) -> None:
    """Replace the table of area reads; the new state is settled before the old one goes."""
    cut(reads).write.mode("overwrite").parquet(path)


def export_views(views: dict[str, DataFrame], out: str) -> None:
    """Every view as JSON files, one folder per theater."""
    for name, df in views.items():
        w = df.write.mode("overwrite")
        (w.partitionBy("theater_id") if "theater_id" in df.columns else w).json(f"{out}/{name}")
