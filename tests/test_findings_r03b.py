"""Faults of the third round at size: work done again and again."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from obsweave.operators import ingest as I
from obsweave.sources import json_elements as J
from obsweave.sources import sinks


def counted(spark, df):
    """The frame, and an accumulator of the rows that its evaluations have made."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    return df.mapInPandas(look, df.schema), seen


def reports(spark, n):
    return spark.range(n).select(
        F.col("id").alias("seq"), F.lit("t").alias("theater_id"), F.lit("acled_api").alias("source_id"), F.lit("text").alias("modality"), F.lit("strike").alias("obs_type"),
        F.concat(F.lit(" a  report "), (F.col("id") % 40).cast("string")).alias("text"), F.lit("36UYA0101").alias("cell_id"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 5)").alias("occurred_start"), F.lit(None).cast("timestamp").alias("occurred_end"))


def test_an_append_evaluates_its_batch_once(spark, tmp_path):
    d, seen = counted(spark, I.with_identity(reports(spark, 60)))
    assert sinks.append_observations(d, f"{tmp_path}/log", f"{tmp_path}/ledger", "seq") == {"ingested": 40, "exact_dup": 20}
    assert seen.value == 60


def test_records_are_named_once(spark):
    """Repeats are found in what was written; a record without a cell goes to the ledger as it came."""
    raw = reports(spark, 60).drop("cell_id").withColumn("lon", F.when(F.col("seq") < 50, 37.0).otherwise(0.0)).withColumn("lat", F.lit(48.0)).withColumn("geom_precision_m", F.lit(100.0))
    grid = I.with_cell(raw.where("seq = 0"), "lon", "lat").select("cell_id")
    obs, rejected = I.normalize(raw, grid, "seq")
    plan = obs._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and "regexp_replace" not in plan
    assert obs.count() == 40 and {r["text"] for r in obs.select("text").collect()} == {f"a report {i}" for i in range(40)}
    why = {r["reason"]: r["n"] for r in rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert why == {"exact_dup": 10, "no_cell_resolve": 10}
    lost = rejected.where("reason = 'no_cell_resolve'").select(F.get_json_object("raw_payload", "$.text").alias("t"), F.get_json_object("raw_payload", "$.occurred_end").alias("e")).collect()
    assert {r["t"] for r in lost} == {f" a  report {i}" for i in range(10, 20)} and {r["e"] for r in lost} == {None}


def test_strings_are_passed_over_whole():
    """The scanner of braces against one that stops at every quote and escape, begun outside and inside a string."""
    token, r = re.compile(r'\\.|["{]', re.S), random.Random(3)
    for n in range(4000):
        b, inside = J.Braces(bool(n % 2)), bool(n % 2)
        for _ in range(3):
            text, want = "".join(r.choice('"\\{a[, \n') for _ in range(r.randrange(14))), []
            for m in token.finditer(text):
                if m.group() == '"':
                    inside = not inside
                elif m.group() == "{" and not inside:
                    want.append(m.start())
            want += [] if inside else [len(text)]
            assert [place for place, _ in b.events(text)] == want and b.inside == inside
