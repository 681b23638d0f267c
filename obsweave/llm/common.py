"""Shared steps of the text operators."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsweave import session

__all__ = ["cut", "fields", "id_type", "learnt", "read", "small_batches", "stage"]


#: Tables that the running stage has written, and those of the stage before it.
_written: list[DataFrame] | None = None
_before: list[DataFrame] = []


def cut(df: DataFrame) -> DataFrame:
    """`session.cut`; a pipeline stage remembers the table, to delete it when the next stage begins."""
    out = session.cut(df)
    if _written is not None:
        _written.append(out)
    return out


def stage(fn):
    """A pipeline stage that owns the tables it writes on the way.

    Its result is written before the next stage is called, so the next one deletes them.
    """
    @functools.wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _written, _before
        for table in _before:
            session.discard(table)
        _before, _written = [], []
        try:
            return fn(spark, docs, sf_dir)
        finally:
            _before, _written = _written, None
    return run


def fields(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under internal names, so other columns of any name can do no harm."""
    return df.select(*[df[f"`{name}`"].alias(alias) for alias, name in columns.items()])


def id_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def learnt(key: str | Column, folds: int, out: int) -> Column:
    """Whether a row may be learned from: crc32 of its id as text, modulo folds, is not ``out``."""
    return F.crc32(F.col(key).cast("string").cast("binary") if isinstance(key, str) else key) % folds != out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand whole texts to Python by the thousand, where the session still has Spark's own batch size."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
