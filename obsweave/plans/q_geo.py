"""Queries for polygons, lines and covered area, with shapes made from customers, suppliers and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsweave.functions.cells import with_centroid
from obsweave.operators import areas as R
from obsweave.operators import grid as G
from obsweave.plans import fixture as X
from obsweave.plans.fixture import frac, table
from obsweave.plans.oracle import D, with_
from obsweave.plans.q_assess import SETTLE
from obsweave.session import cut

Q: dict = {}


def query(name, sql=None):
    def deco(fn):
        Q[name] = (fn, sql)
        return fn
    return deco


def cells(spark, sf):
    return cut(with_centroid(X.grid_of(spark, sf)))


def _ring(*points):
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def _at_site(k):
    """A place near the site that a number falls on; several numbers share a site."""
    site = k % 500
    return (F.round(36.0 + 3.5 * frac(site * 0.61803398875) + 0.0013 * (k % 11) - 0.006, 6), F.round(46.8 + 2.7 * frac(site * 0.75487766625) + 0.0011 * (k % 7) - 0.004, 6))


def footprints(spark, sf):
    """An L-shaped building per customer; those of one site overlap."""
    k = F.col("c_custkey")
    x, y = _at_site(k)
    d = (1 + k % 5) * 0.0007
    return table(spark, sf, "customer").select(k.alias("building_id"), F.array(_ring((x, y), (x + 2 * d, y), (x + 2 * d, y + d), (x + d, y + d), (x + d, y + 2 * d), (x, y + 2 * d))).alias("rings"))


# a cell's covered share again, by cutting both axes at every side of a box: each building is two boxes
FOOT = [f"ft AS (SELECT c_custkey AS id, round(36.0{D} + 3.5{D} * (s * 0.61803398875{D} - floor(s * 0.61803398875{D})) + 0.0013{D} * (k % 11) - 0.006{D}, 6) AS x, "
        f"round(46.8{D} + 2.7{D} * (s * 0.75487766625{D} - floor(s * 0.75487766625{D})) + 0.0011{D} * (k % 7) - 0.004{D}, 6) AS y, (1 + k % 5) * 0.0007{D} AS d FROM (SELECT *, c_custkey AS k, c_custkey % 500 AS s FROM customer))",
        "cb AS (SELECT cell_id, sw_lon AS w, sw_lat AS s, sw_lon + step_lon AS e, sw_lat + step_lat AS n FROM cen)",
        "bx AS (SELECT id, x AS bw, y AS bs, x + 2 * d AS be, y + d AS bn FROM ft UNION ALL SELECT id, x, y, x + d, y + 2 * d FROM ft)",
        "hit AS (SELECT cell_id, w, s, e, n, id, bw, bs, be, bn FROM cb JOIN bx ON bw <= e AND be >= w AND bs <= n AND bn >= s)",
        "gx AS (SELECT cell_id, v, lead(v) OVER (PARTITION BY cell_id ORDER BY v) AS v2 FROM (SELECT DISTINCT cell_id, unnest([w, e, greatest(bw, w), least(be, e)]) AS v FROM hit))",
        "gy AS (SELECT cell_id, v, lead(v) OVER (PARTITION BY cell_id ORDER BY v) AS v2 FROM (SELECT DISTINCT cell_id, unnest([s, n, greatest(bs, s), least(bn, n)]) AS v FROM hit))",
        "sq AS (SELECT DISTINCT h.cell_id, gx.v AS x1, gx.v2 AS x2, gy.v AS y1, gy.v2 AS y2, (e - w) * (n - s) AS whole FROM hit h JOIN gx ON gx.cell_id = h.cell_id AND gx.v >= h.bw AND gx.v2 <= h.be JOIN gy ON gy.cell_id = h.cell_id AND gy.v >= h.bs AND gy.v2 <= h.bn)",
        "ar AS (SELECT cell_id, sum((x2 - x1) * (y2 - y1)) / max(whole) AS share FROM sq GROUP BY cell_id)"]


@query("building_zonal", with_("units", *FOOT, """SELECT cell_id, count(DISTINCT id) AS building_count, round(coalesce(max(share), 0), 6) AS building_share
 FROM cb LEFT JOIN hit USING (cell_id) LEFT JOIN ar USING (cell_id) GROUP BY cell_id"""))
def _(spark, sf):
    return G.building_zonal(footprints(spark, sf), cells(spark, sf)).withColumn("building_share", F.round("building_share", 6))


def drawn_areas(spark, sf):
    """A triangle and a line per supplier, beginning at its settlement."""
    k = F.col("s_suppkey")
    x, y = F.round(36.0 + 3.5 * frac(k * 0.61803398875), 6), F.round(46.8 + 2.7 * frac(k * 0.75487766625), 6)
    d = table(spark, sf, "supplier")
    tri = d.select(F.concat(F.lit("t"), k.cast("string")).alias("aoi_id"), F.array(_ring((x, y), (x + 0.3, y + 0.05), (x + 0.1, y + 0.25))).alias("rings"))
    line = d.select(F.concat(F.lit("l"), k.cast("string")).alias("aoi_id"), _ring((x, y), (x + 0.02, y + 0.4), (F.lit(37.5), F.lit(48.2))).alias("vertices"))
    return tri.unionByName(line, allowMissingColumns=True)


DRAWN = [*SETTLE, "cb AS (SELECT cell_id, sw_lon AS w, sw_lat AS s, sw_lon + step_lon AS e, sw_lat + step_lat AS n FROM cen)",
         "pos AS (SELECT replace(name, 'Supplier#', '')::INT AS k, lon AS x, lat AS y FROM stl)",
         f"""seg AS (SELECT 't' || k AS aoi_id, x AS x1, y AS y1, x + 0.3{D} AS x2, y + 0.05{D} AS y2 FROM pos UNION ALL SELECT 't' || k, x + 0.3{D}, y + 0.05{D}, x + 0.1{D}, y + 0.25{D} FROM pos
 UNION ALL SELECT 't' || k, x + 0.1{D}, y + 0.25{D}, x, y FROM pos UNION ALL SELECT 'l' || k, x, y, x + 0.02{D}, y + 0.4{D} FROM pos UNION ALL SELECT 'l' || k, x + 0.02{D}, y + 0.4{D}, 37.5{D}, 48.2{D} FROM pos)""",
         # Liang and Barsky: the part of a segment inside a box, as a range of its parameter
         """clip AS (SELECT aoi_id, cell_id, greatest(0, CASE WHEN x2 = x1 THEN CASE WHEN x1 BETWEEN w AND e THEN 0 ELSE 2 END ELSE least((w - x1) / (x2 - x1), (e - x1) / (x2 - x1)) END,
 CASE WHEN y2 = y1 THEN CASE WHEN y1 BETWEEN s AND n THEN 0 ELSE 2 END ELSE least((s - y1) / (y2 - y1), (n - y1) / (y2 - y1)) END) AS t0,
 least(1, CASE WHEN x2 = x1 THEN 1 ELSE greatest((w - x1) / (x2 - x1), (e - x1) / (x2 - x1)) END, CASE WHEN y2 = y1 THEN 1 ELSE greatest((s - y1) / (y2 - y1), (n - y1) / (y2 - y1)) END) AS t1 FROM seg, cb)""",
         "inn AS (SELECT aoi_id, cell_id FROM seg, cb WHERE aoi_id LIKE 't%' AND (y1 > s) <> (y2 > s) AND w < (x2 - x1) * (s - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)"]


@query("area_from_geometry", with_("units", *DRAWN, "SELECT aoi_id, cell_id FROM clip WHERE t0 <= t1 UNION SELECT aoi_id, cell_id FROM inn"))
def _(spark, sf):
    return R.geometry_aois(drawn_areas(spark, sf), cells(spark, sf)).select("aoi_id", "cell_id")


@query("derive_parents_concave", f"""SELECT 'N' || n_nationkey AS admin_id, n_nationkey || CASE WHEN 1 + n_nationkey % 4 >= 1 + n_nationkey * 3 % 5 THEN ':left' ELSE ':right' END AS parent_id FROM nation
 UNION ALL SELECT 'X' || n_nationkey, NULL FROM nation""")
def _(spark, sf):
    """U-shaped units whose centre lies outside them; the wider leg's side is the parent. Units far from all parents have none."""
    k = F.col("n_nationkey")
    x0, a, b = k * 1.0, (1 + k % 4) * 0.05 + 0.01, (1 + k * 3 % 5) * 0.05
    u = lambda s: _ring((x0, s), (x0 + 0.9, s), (x0 + 0.9, s + 1), (x0 + 0.9 - b, s + 1), (x0 + 0.9 - b, s + 0.2), (x0 + a, s + 0.2), (x0 + a, s + 1), (x0, s + 1))
    nations = table(spark, sf, "nation")
    child = nations.select(F.concat(F.lit("N"), k.cast("string")).alias("admin_id"), F.array(u(F.lit(0.0))).alias("rings")).unionByName(
        nations.select(F.concat(F.lit("X"), k.cast("string")).alias("admin_id"), F.array(u(F.lit(40.0))).alias("rings")))
    part = lambda name, lo, hi: nations.select(F.concat(k.cast("string"), F.lit(f":{name}")).alias("admin_id"),
                                               F.array(_ring((x0 + lo, F.lit(-1.0)), (x0 + hi, F.lit(-1.0)), (x0 + hi, F.lit(2.0)), (x0 + lo, F.lit(2.0)))).alias("rings"))
    return G.derive_parents(child, part("left", -0.01, 0.3).unionByName(part("middle", 0.3, 0.6)).unionByName(part("right", 0.6, 0.91)))
