"""Faults of the third round: long pages, whole areas, broadcasts by the size of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsweave.operators import areas as R
from obsweave.operators import serve as V
from obsweave.session import bound_broadcasts, cut

SF = "/root/testdata/sf0.001"


def test_long_pages_take_no_room_for_absent_rows(spark):
    ledger = spark.range(0, 5000, 1, 7).select(
        F.lit("dup").alias("reason"), F.concat(F.lit("s"), F.col("id") % 3).alias("source_id"), F.format_string("%05d", F.pmod(F.col("id") * 7919, F.lit(5000))).alias("raw_payload"))
    rows = [tuple(r) for r in V.list_rejections(ledger, limit=10**9).select("source_id", "raw_payload").collect()]
    assert len(rows) == 5000 and rows == sorted(rows)
    part = V.page(ledger, ["source_id", "reason", "raw_payload"], limit=1200, offset=1700, heap_rows=10)
    assert [tuple(r) for r in part.select("source_id", "raw_payload").collect()] == rows[1700:2900]
    assert V.list_rejections(ledger, source="none", limit=10**9).count() == 0
    short = V.list_rejections(ledger, "dup", "s1", limit=5, offset=2).select("source_id", "raw_payload").collect()
    assert [tuple(r) for r in short] == [r for r in rows if r[0] == "s1"][2:7]


def test_areas_rank_all_their_events(spark):
    from obsweave.plans import fixture as X
    from obsweave.plans import q_assess

    fn, sql = q_assess.Q["significant_in_area"]
    assert "LIMIT" not in sql
    got = {r["area"]: r["n"] for r in fn(spark, SF).groupBy("area").agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = q_assess.area_cells_of(spark, SF)
    all_ = R.area_events(cells, X.stored_events(spark, SF)).groupBy("area").agg(F.least(F.count(F.lit(1)), F.lit(50)).alias("n"))
    assert got == {r["area"]: r["n"] for r in all_.collect()}


def test_well_packed_tables_are_not_broadcast_by_their_file_size(spark):
    bound_broadcasts(spark)
    packed = cut(spark.range(0, 600_000, 1, 2).select((F.col("id") % 60_000).alias("k"), F.concat(F.lit("a long name of a run " * 8), F.col("id") % 9000).alias("name")))
    big = cut(spark.range(0, 600_000, 1, 2).select(F.col("id").alias("k"), F.rand(1).alias("x")))
    plan = big.join(packed, "k")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    size = int(str(packed._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert 256 << 10 < size < 10 << 20 < 600_000 * 170
    assert "BroadcastHashJoin" not in big.join(packed, "k")._jdf.queryExecution().executedPlan().toString()
