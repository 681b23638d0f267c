"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the JVM does not compile methods above 8000 bytes; beyond that, split expressions run faster
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

#: Deletes the shuffle files of a query at its end; otherwise they stay until the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
TABLE_OPTIONS = {"compression": "zstd", "parquet.dictionary.page.size": str(16 << 20)}
#: Bytes of files, and bytes measured in memory, up to which a join may broadcast a table.
FILE_BROADCAST, MEASURED_BROADCAST = 256 << 10, 4 << 20


def build_session(master: str | None = None, app: str = "obsweave", **extra: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**CONF, **extra}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a private one only where none is set (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="obsweave-ckpt-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise a plan as a table in the shared folder and continue from its files.

    A lost executor then re-reads files instead of the lineage, the plan is computed once (an RDD
    checkpoint runs its last stage twice), and later joins know the true size of their input. The shuffles
    behind the table are deleted once it stands, and repeated ids are kept in one dictionary a file.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/obsweave/{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.options(**TABLE_OPTIONS).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that `cut` wrote and that nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if "/obsweave/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bound_broadcasts(spark: SparkSession) -> None:
    """Tables are broadcast by their measured size, not by that of their files.

    A table of repeated strings is up to a hundred times larger in memory than in its Parquet files, and all
    of it passes through the driver. So only tiny files are broadcast before a run; what adaptive execution has
    measured may be larger. Lower settings of the session stay.
    """
    size = lambda name: spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    static, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    now = size(static)
    if spark.conf.get(measured, None) is None:
        spark.conf.set(measured, str(min(now, MEASURED_BROADCAST)))
    elif size(measured) > MEASURED_BROADCAST:
        spark.conf.set(measured, str(MEASURED_BROADCAST))
    if now > FILE_BROADCAST:
        spark.conf.set(static, str(FILE_BROADCAST))


def tune_local(spark: SparkSession) -> None:
    """UTC, bounded broadcasts and a partition count that fits a local master; clusters keep their other settings."""
    bound_broadcasts(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", CONF["spark.sql.codegen.hugeMethodLimit"])
    master = spark.sparkContext.master
    if master.startswith("local") and "OBSWEAVE_KEEP_CONF" not in os.environ:
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
