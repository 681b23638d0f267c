"""Admin units, settlements, cell context and control derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsweave import dims
from obsweave.functions.cells import with_cell, with_centroid
from obsweave.operators import grid as G
from obsweave.plans import fixture as X
from obsweave.plans.fixture import frac, table

LC_CODES = [10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100]
ROADS = ["motorway", "trunk", "primary", "secondary", "tertiary", "residential", "track", "path"]


def _box(w, s, e, n):
    v = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(v(w, s), v(e, s), v(e, n), v(w, n)))


def units(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes cut from the theater: regions as rows, nations as columns within, suppliers as strips within.

    Ranks are taken within a region (25 nations) and a nation.
    """
    reg, nat, sup = (table(spark, sf, t) for t in ("region", "nation", "supplier"))
    s0 = 46.8 + 0.54 * F.col("r_regionkey")
    r = reg.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("admin_id"), F.col("r_name").alias("name"), F.lit(1).alias("level"),
                   F.lit(None).cast("string").alias("parent_id"), _box(F.lit(36.0), s0, F.lit(39.5), 46.8 + 0.54 * (F.col("r_regionkey") + 1)).alias("rings"))
    n = nat.withColumn("j", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1)
    w0, sn = 36.0 + 0.7 * F.col("j"), 46.8 + 0.54 * F.col("n_regionkey")
    nn = n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("admin_id"), F.col("n_name").alias("name"), F.lit(2).alias("level"),
                  F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent_id"),
                  _box(w0, sn, 36.0 + 0.7 * (F.col("j") + 1), 46.8 + 0.54 * (F.col("n_regionkey") + 1)).alias("rings"))
    w = Window.partitionBy("s_nationkey")
    s = sup.select("s_suppkey", "s_name", "s_nationkey").withColumn("i", F.row_number().over(w.orderBy("s_suppkey")) - 1).withColumn(
        "k", F.count(F.lit(1)).over(w)).join(n.select("n_nationkey", "n_regionkey", "j"), F.col("s_nationkey") == F.col("n_nationkey"))
    lo = 46.8 + 0.54 * F.col("n_regionkey") + 0.54 * F.col("i") / F.col("k")
    hi = 46.8 + 0.54 * F.col("n_regionkey") + 0.54 * (F.col("i") + 1) / F.col("k")
    ss = s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("admin_id"), F.col("s_name").alias("name"), F.lit(3).alias("level"),
                  F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("parent_id"), _box(36.0 + 0.7 * F.col("j"), lo, 36.0 + 0.7 * (F.col("j") + 1), hi).alias("rings"))
    return r.unionByName(nn).unionByName(ss)


def settlements(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.round(36.0 + 3.5 * frac(k * 0.61803398875), 6).alias("lon"),
                                               F.round(46.8 + 2.7 * frac(k * 0.75487766625), 6).alias("lat"))


def cell_users(spark: SparkSession, sf: str) -> DataFrame:
    """(cell_id, u): the first user of each grid cell, which seeds the cell's static layers."""
    s = F.floor(F.col("user_id") / 3)
    pts = table(spark, sf, "events").select("user_id").distinct().select(
        "user_id", F.round(36.0 + 3.5 * frac(s * 0.61803398875) + 0.012 * (F.col("user_id") % 3), 6).alias("lon"),
        F.round(46.8 + 2.7 * frac(s * 0.75487766625), 6).alias("lat"))
    w, s_, e, n = X.BBOX
    d = with_cell(pts.where(F.col("lon").between(w, e) & F.col("lat").between(s_, n)), "lon", "lat")
    return d.groupBy("cell_id").agg(F.min("user_id").alias("u"))


def layers(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("u")
    cls = F.element_at(F.lit(LC_CODES), (u % 11 + 1).cast("int"))
    road = F.get(F.lit(ROADS), (u % 10).cast("int"))
    surf = F.when(u % 4 == 0, "gravel").when(u % 4 == 1, "asphalt")
    d = cell_users(spark, sf).withColumn("landcover_class", F.when(u % 13 != 0, cls)).withColumn("builtup_pct", F.when(u % 3 != 0, (u % 10) / 10))
    return (d.withColumn("landcover_label", F.when(F.col("landcover_class").isNotNull(), dims.choose(F.col("landcover_class"), dims.LANDCOVER_LABELS, "unknown")))
            .withColumn("road_class", road).withColumn("road_surface", F.when(road.isNotNull(), G.classify_surface(road, surf))).drop("u"))


def build_context(spark: SparkSession, sf: str) -> DataFrame:
    cells = with_centroid(X.grid_of(spark, sf)).select("cell_id", "lon", "lat")
    return G.build_cell_context(G.stamp_admin(cells, units(spark, sf)), layers(spark, sf))


def context(spark: SparkSession, sf: str) -> DataFrame:
    return X.stored(spark, sf, "context", lambda: build_context(spark, sf))


def aoi_cells(spark: SparkSession, sf: str) -> DataFrame:
    """User areas: one per tenth user, holding the cells of its users."""
    return cell_users(spark, sf).select((F.col("u") % 10).cast("string").alias("aoi_id"), "cell_id")
