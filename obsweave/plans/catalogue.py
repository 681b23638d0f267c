"""All registered queries with their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODULES = ["q_core", "q_assess", "q_eval", "q_geo", "q_feeds"]


def all_queries() -> dict:
    out: dict = {}
    for m in MODULES:
        for name, q in import_module(f"obsweave.plans.{m}").Q.items():
            assert name not in out, name
            out[name] = q
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from obsweave.plans.q_core import Run

    return Run(spark, sf_dir).events().groupBy("confidence_band", "event_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("n_sources").alias("n_observations"))
