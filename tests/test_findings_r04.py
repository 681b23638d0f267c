"""Findings of round 4: pairs, edges and slices travel once, and what lies behind a table goes."""

from pyspark.sql import functions as F

from obsweave.operators import fuse as FU
from obsweave.operators import nearby
from obsweave.operators import score as S
from obsweave.session import cut


def _rows(spark, n, key="k"):
    return spark.range(n).select(F.lit(key).alias("k"), F.concat(F.lit("r"), F.col("id")).alias("id"))


def test_a_side_that_is_not_hot_makes_no_copies_of_the_other(spark):
    left, right, keys = nearby.salted_sides(_rows(spark, 2), _rows(spark, 40), ["k"], "id", 5)
    assert right.count() == 40 and left.count() == 16
    pairs = left.alias("a").join(right.alias("b"), keys).select(F.col("a.id"), F.col("b.id").alias("o"))
    assert pairs.count() == pairs.distinct().count() == 80


def test_hot_on_both_sides_every_pair_meets_once(spark):
    left, right, keys = nearby.salted_sides(_rows(spark, 23), _rows(spark, 31), ["k"], "id", 5)
    pairs = left.alias("a").join(right.alias("b"), keys).select(F.col("a.id"), F.col("b.id").alias("o"))
    assert pairs.count() == pairs.distinct().count() == 23 * 31


def test_lattices_end_at_the_last_tier_with_rows(spark):
    rows = [(7200, 400.0, 300), (172800, 450.0, 300), (7200, 9000.0, 2)]
    d = spark.createDataFrame(rows, "window_s int, precision_m double, group_rows long")
    big, reach_us, reach_m, n = S._tiers(d, 256)
    assert big.count() == 2 and n == 3 and len(reach_us) == 2 and len(reach_m) == 1
    assert abs(reach_us[1] - S.REACH * 172800e6) < 1 and reach_m[0] < S.REACH * 1.5 * 1.4143 * 450


def test_pairs_the_cache_cannot_hold_do_not_meet_it(spark):
    gray = spark.range(2000).select(F.concat(F.lit("a"), "id").alias("obs_a"), F.concat(F.lit("b"), "id").alias("obs_b"),
                                    F.sha2(F.col("id").cast("string"), 256).alias("pair_key"))
    gray = gray.unionByName(spark.sql("select 'x' obs_a, 'y' obs_b, cast(null as string) pair_key"))
    cache = gray.where("obs_a in ('a7', 'a8', 'a9')").select(
        "pair_key", (F.col("obs_a") != "a9").alias("same"), F.when(F.col("obs_a") == "a7", 0.4).otherwise(0.9).alias("confidence"))
    got = {r.obs_a: r for r in FU.adjudicate(gray, cut(cache)).collect()}
    assert len(got) == 2001 and {k for k, r in got.items() if r.source == "cache"} == {"a7", "a8", "a9"}
    assert (got["a7"].same, got["a7"].needs_check) == (True, True) and (got["a9"].same, got["a9"].confidence) == (False, 0.9)
    assert not got["x"].same and got["x"].needs_check
    assert gray.where(FU.may_hold(cut(cache), "pair_key")).count() < 20
    none = FU.adjudicate(gray, cut(cache).where("false"))
    assert none.where("source = 'degraded_keep_separate'").count() == 2001


def test_edges_to_unplaced_or_unknown_records_are_ignored(spark):
    obs = spark.createDataFrame([("o1", "c"), ("o2", "c"), ("o3", ""), ("o4", "c")], "obs_id string, cell_id string")
    edges = spark.createDataFrame([("o1", "o3"), ("o3", "o4"), ("o1", "zz"), ("zz", "o4"), ("o1", "o2"), (None, "o4")], "a string, b string")
    members, rejected = FU.propagate(obs, edges)
    assert {(r.obs_id, r.component) for r in members.collect()} == {("o1", "o1"), ("o2", "o1"), ("o4", "o4")}
    assert [r.obs_id for r in rejected.collect()] == ["o3"]


def test_a_cut_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    before = files()
    t = cut(spark.range(5000).groupBy((F.col("id") % 77).alias("k")).count())
    assert not files() - before
    assert t.count() == 77 and t.agg(F.sum("count")).first()[0] == 5000


def test_runs_meet_in_as_many_partitions_as_their_number_asks(spark, monkeypatch):
    from obsweave.operators import block as B
    from tests.test_fusion import board, placed
    obs = placed(spark, board(3, 80))
    want = {(r.obs_id, r.group_rows) for r in B.block(obs).collect()}
    monkeypatch.setattr(B, "PART_RUNS", 2)
    slices = cut(B.cell_slices(B.with_span(obs)))
    edges = B.spatial_edges(slices)
    assert "REPARTITION_BY_NUM" in edges._jdf.queryExecution().executedPlan().toString()
    assert {(r.obs_id, r.group_rows) for r in B.block(obs).collect()} == want


def test_more_text_gets_more_partitions_in_the_trigram_model(spark):
    from obsweave.llm.language_model import model_scores
    d = spark.createDataFrame([(f"d{i}", f"one two three {i % 5} four") for i in range(60)], "obs_id string, text string")
    few = model_scores(d, block_words=30)
    many = model_scores(d, block_words=30, part_bytes=64)
    volume = d.agg(F.sum(F.octet_length("text"))).first()[0]
    assert f", {1 + volume // 64}), REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()
    key = lambda r: r.obs_id
    assert sorted(few.collect(), key=key) == sorted(many.collect(), key=key)
