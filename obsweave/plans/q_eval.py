"""Queries for evaluation, the output boundary and pixel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsweave.functions.cells import with_centroid
from obsweave.operators import boundary as BD
from obsweave.operators import evaluate as E
from obsweave.operators import fuse as FU
from obsweave.operators import grid as G
from obsweave.operators import raster as RS
from obsweave.plans import fixture as X
from obsweave.plans import fixture_areas as Y
from obsweave.plans.oracle import CTES, D, centroid_ctes, with_
from obsweave.plans.q_core import hav
from obsweave.session import cut

Q: dict = {}


def query(name, sql=None):
    def deco(fn):
        Q[name] = (fn, sql)
        return fn
    return deco


# Truth of the fixture: records of one user on one date belong to one incident.
CTES["truth"] = CTES["events"] + [
    "tr AS (SELECT obs_id, user_id || '-' || strftime(occurred_start, '%Y-%m-%d') AS incident_id FROM obs)",
    "mm AS (SELECT obs_id, component AS event_id FROM mem)", "con AS (SELECT event_id, incident_id, count(*) AS n FROM tr JOIN mm USING (obs_id) GROUP BY ALL)",
    "outc AS (SELECT incident_id, count(DISTINCT event_id) AS k FROM tr JOIN mm USING (obs_id) GROUP BY 1)"]


def truth(spark, sf):
    m = X.event_members(spark, sf)
    t = m.select("obs_id", F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("occurred_start", "yyyy-MM-dd")).alias("incident_id"))
    return m.select("obs_id", F.col("component").alias("event_id")), t


@query("event_recall", with_("truth", "SELECT count(*) FILTER (k = 1) AS recovered, count(*) AS incidents, round(count(*) FILTER (k = 1) / count(*), 6) AS event_recall FROM outc"))
def _(spark, sf):
    return E.event_recall(*truth(spark, sf))


@query("pairwise_pr", with_("truth", """SELECT tp, pred - tp AS fp, tru - tp AS fn, tot - pred - tru + tp AS tn, round(tp / pred, 6) AS precision, round(tp / tru, 6) AS recall FROM (SELECT
 (SELECT sum(n * (n - 1) // 2) FROM con)::BIGINT AS tp, (SELECT sum(n * (n - 1) // 2) FROM (SELECT sum(n)::BIGINT AS n FROM con GROUP BY event_id))::BIGINT AS pred,
 (SELECT sum(n * (n - 1) // 2) FROM (SELECT sum(n)::BIGINT AS n FROM con GROUP BY incident_id))::BIGINT AS tru, (SELECT sum(n)::BIGINT * (sum(n)::BIGINT - 1) // 2 FROM con) AS tot)"""))
def _(spark, sf):
    return E.pairwise_pr(*truth(spark, sf))


@query("merge_rates", with_("truth", "SELECT (SELECT round(avg((k > 1)::INT), 6) FROM outc) AS fragmentation, (SELECT round(avg((k > 1)::INT), 6) FROM (SELECT count(*) AS k FROM con GROUP BY event_id)) AS over_merge"))
def _(spark, sf):
    return E.merge_rates(*truth(spark, sf))


@query("band_correctness", with_("truth", """SELECT t.incident_id, CASE WHEN nf >= 2 THEN 'High' ELSE 'Rumored' END AS band, confidence_band AS got FROM (SELECT incident_id, min(component) AS component FROM tr JOIN mem USING (obs_id) JOIN outc USING (incident_id) WHERE outc.k = 1 GROUP BY 1) t
 JOIN (SELECT incident_id, count(DISTINCT fam) AS nf FROM tr JOIN m_ USING (obs_id) GROUP BY 1) USING (incident_id) JOIN evt USING (component)"""))
def _(spark, sf):
    m, t = truth(spark, sf)
    fam = X.stored_observations(spark, sf).select("obs_id", "source_family_id")
    exp = t.join(fam, "obs_id").groupBy("incident_id").agg(F.when(F.countDistinct("source_family_id") >= 2, "High").otherwise("Rumored").alias("band"))
    ev = X.stored_events(spark, sf).withColumn("event_id", F.col("component"))
    return E.band_correctness(m, t, ev, exp).drop("ok")


# radar and optical detections against the damage points, all of them
DET = ["det AS (SELECT DISTINCT cell_id FROM obs WHERE modality = 'imagery' AND source_id <> 'unosat')", "tru AS (SELECT DISTINCT cell_id FROM obs WHERE source_id = 'unosat')"]


def detection_fixture(spark, sf):
    o = X.stored_observations(spark, sf)
    return o.where("modality = 'imagery' and source_id <> 'unosat'").select("cell_id").distinct(), o.where("source_id = 'unosat'").select("cell_id").distinct()


for _b in (0, 1500):
    def _sc(spark, sf, b=_b):
        return E.score_cells(*detection_fixture(spark, sf), b)
    _cond = "false" if _b == 0 else f"{hav('a', 'b')} <= {_b}"
    Q[f"score_cells_{_b}m"] = (_sc, with_("norm", *DET, "both_ AS (SELECT cell_id FROM det UNION SELECT cell_id FROM tru)", *centroid_ctes("both_", "cen"), f"""nr AS (SELECT a.cell_id AS d, b.cell_id AS t FROM cen a JOIN cen b ON {_cond}
 WHERE a.cell_id IN (SELECT cell_id FROM det) AND a.cell_id NOT IN (SELECT cell_id FROM tru) AND b.cell_id IN (SELECT cell_id FROM tru))""",
        "x AS (SELECT (SELECT count(*) FROM det) AS n_detected, (SELECT count(*) FROM tru) AS n_truth, (SELECT count(*) FROM (SELECT cell_id FROM det INTERSECT SELECT cell_id FROM tru UNION SELECT d FROM nr)) AS true_positives,"
        " (SELECT count(*) FROM (SELECT cell_id FROM det INTERSECT SELECT cell_id FROM tru UNION SELECT t FROM nr)) AS matched_truth)",
        """SELECT *, n_detected - true_positives AS false_positives, round(coalesce(true_positives / nullif(n_detected, 0), 0), 4) AS precision, round(coalesce(matched_truth / nullif(n_truth, 0), 0), 4) AS recall,
 round(coalesce(2 * (true_positives / nullif(n_detected, 0)) * (matched_truth / nullif(n_truth, 0)) / nullif(true_positives / nullif(n_detected, 0) + matched_truth / nullif(n_truth, 0), 0), 0), 4) AS f1 FROM x"""))


@query("truth_cells", with_("norm", "SELECT cell_id, max(k % 7) AS worst, count(*) AS n, count(*) FILTER (k % 7 = 2) AS grade_2, count(*) FILTER (k % 7 = 3) AS grade_3, count(*) FILTER (k % 7 = 4) AS grade_4 FROM placed WHERE k % 7 BETWEEN 2 AND 4 AND lon BETWEEN 36.0 AND 39.5 AND lat BETWEEN 46.8 AND 49.5 GROUP BY 1"))
def _(spark, sf):
    r = X.raw_observations(spark, sf).select("lon", "lat", (F.col("k") % 7).alias("damage"), F.col("source_id").alias("city"))
    return E.truth_cells(r, X.BBOX).drop("cities")


@query("recall_by_source", with_("norm", *DET, "SELECT source_id, count(*) AS n_truth, count(det.cell_id) AS n_matched, round(count(det.cell_id) / count(*), 4) AS recall FROM (SELECT DISTINCT source_id, cell_id FROM obs) t LEFT JOIN det USING (cell_id) GROUP BY 1"))
def _(spark, sf):
    det, _t = detection_fixture(spark, sf)
    return E.recall_by(X.stored_observations(spark, sf).select("cell_id", "source_id"), det, "source_id")


# Pair scores from neighbouring embeddings, with equal labels as truth.
EMB = """prs AS (SELECT round(greatest(0, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))), 6) AS p,
 a.label = b.label AS same FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def emb_pairs(spark, sf):
    from obsweave.functions import text as T
    e = X.table(spark, sf, "embeddings").withColumn("n", T.norm(F.col("embedding")))
    a, b = e.alias("a"), e.withColumn("vec_id", F.col("vec_id") - 1).alias("b")
    return a.join(b, F.col("a.vec_id") == F.col("b.vec_id")).select(
        F.round(T.cosine(F.col("a.embedding"), F.col("b.embedding"), F.col("a.n"), F.col("b.n")), 6).alias("p"), (F.col("a.label") == F.col("b.label")).alias("same"))


@query("rethreshold", f"""WITH {EMB} SELECT count(*) AS pairs, count(*) FILTER (p > 0.05 AND p < 0.2) AS gray, count(*) FILTER (p >= 0.2) AS merged, count(*) FILTER (p >= 0.2 AND same) AS merged_right, count(*) FILTER (same) AS truly_same,
 round(count(*) FILTER (p > 0.05 AND p < 0.2) / count(*), 4) AS gray_share, round(coalesce(count(*) FILTER (p >= 0.2 AND same) / nullif(count(*) FILTER (p >= 0.2), 0), 1), 4) AS precision, round(coalesce(count(*) FILTER (p >= 0.2 AND same) / nullif(count(*) FILTER (same), 0), 1), 4) AS recall FROM prs""")
def _(spark, sf):
    return E.rethreshold(emb_pairs(spark, sf), 0.05, 0.2)


@query("histogram", f"WITH {EMB} SELECT least(floor(p * 20), 19)::INT AS bin, count(*) AS n FROM prs GROUP BY 1")
def _(spark, sf):
    return E.histogram(emb_pairs(spark, sf))


@query("freeze_verdicts", """SELECT sha256(concat_ws('|', least(h1, h2), greatest(h1, h2), 'fire', 'strike', 'v1', 'm1', 'v1', 'e1')) AS pair_key, arg_max(toxic = 1, (quality, doc_id)) AS same, arg_max(quality::DOUBLE, (quality, doc_id)) AS confidence
 FROM (SELECT l.*, sha256(source) AS h1, sha256(lang) AS h2 FROM labels l JOIN documents d USING (doc_id)) GROUP BY 1""")
def _(spark, sf):
    d = X.table(spark, sf, "labels").join(X.table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id")
    v = d.select(F.sha2("source", 256).alias("hash_a"), F.sha2("lang", 256).alias("hash_b"), F.lit("strike").alias("type_a"), F.lit("fire").alias("type_b"),
                 F.lit(None).cast("string").alias("prompt_version"), F.lit("m1").alias("model_version"), F.lit(None).cast("string").alias("schema_version"), F.lit("e1").alias("embedding_version"),
                 (F.col("toxic") == 1).alias("same"), F.col("quality").cast("double").alias("confidence"), F.col("quality").alias("created_at"), F.col("doc_id").alias("label_id"))
    return FU.freeze_verdicts(v, {"prompt_version": "v1", "schema_version": "v1"})


@query("parse_verdicts", """SELECT turn, role, count(*) FILTER (turn % 3 <> 2) AS n_valid, count(*) FILTER (turn % 3 = 2) AS n_rejected FROM conversations GROUP BY ALL""")
def _(spark, sf):
    c = X.table(spark, sf, "conversations")
    j = c.withColumn("verdict", F.when(F.col("turn") % 3 == 2, F.concat(F.lit('{"same": tru, "rationale": "'), F.col("conv_id").cast("string"))).otherwise(
        F.to_json(F.struct((F.col("turn") % 2 == 0).alias("same"), F.lit(0.7).alias("confidence"), F.col("text").alias("rationale")))))
    ok, bad = FU.parse_verdicts(j.select("turn", "role", "verdict"))
    d = ok.select("turn", "role", F.lit(1).alias("v")).unionByName(bad.select("turn", "role", F.lit(0).alias("v")))
    return d.groupBy("turn", "role").agg(F.sum("v").alias("n_valid"), F.sum(1 - F.col("v")).alias("n_rejected"))


@query("route_tiers", """SELECT event_id, CASE WHEN (event_type <> 'purchase') AND (event_id % 100) / 100.0 >= 0.72 THEN 'gate' WHEN event_type <> 'purchase' AND (event_id % 90) / 90.0 >= 0.68 THEN 'adjudicator' ELSE 'escalation' END AS tier,
 CASE WHEN (event_type <> 'purchase') AND (event_id % 100) / 100.0 >= 0.72 THEN user_id % 2 = 0 WHEN event_type <> 'purchase' AND (event_id % 90) / 90.0 >= 0.68 THEN user_id % 3 = 0 ELSE user_id % 5 = 0 END AS same FROM events""")
def _(spark, sf):
    e = X.table(spark, sf, "events").withColumn("pair_key", F.col("event_id").cast("string"))
    p = e.select("event_id", "pair_key", F.when(F.col("event_type") == "purchase", "airstrike").otherwise("fire").alias("type_a"), F.lit("fire").alias("type_b"))
    tier = lambda m, c: e.select("pair_key", (F.col("user_id") % m == 0).alias("same"), c.alias("confidence"))
    r = FU.route_tiers(p, tier(2, (F.col("event_id") % 100) / 100), tier(3, (F.col("event_id") % 90) / 90), tier(5, F.lit(0.9)))
    return r.select("event_id", "tier", "same")


# ------------------------------------------------------------------ boundary
@query("coarsen_events", with_("units", """SELECT event_id, round(cen.lon, 6) AS shown_lon, round(cen.lat, 6) AS shown_lat, landcover_label IS NULL AND NOT coalesce(road_surface = 'unpaved' OR road_class IN ('motorway', 'trunk', 'primary', 'secondary'), false) AS no_phrase FROM evt JOIN cen USING (cell_id) LEFT JOIN ctx USING (cell_id)"""))
def _(spark, sf):
    c = Y.context(spark, sf)
    d = BD.coarsen(X.stored_events(spark, sf), with_centroid(c.select("cell_id")), context=c)
    xy = F.from_json("geometry", "type string, coordinates array<double>")["coordinates"]
    return d.select("event_id", F.round(xy[0], 6).alias("shown_lon"), F.round(xy[1], 6).alias("shown_lat"),
                    F.col("phrase").isNull().alias("no_phrase"))


# ------------------------------------------------------------------ zonal and pixels
@query("landcover_zonal", """WITH px AS (SELECT (l_orderkey % 200)::VARCHAR AS cell_id, CASE WHEN l_quantity < 5 THEN 0 ELSE l_linenumber * 10 END AS c FROM lineitem), n AS (SELECT cell_id, c, count(*) AS n FROM px WHERE c <> 0 GROUP BY ALL)
 SELECT cell_id, arg_min(c, (-n, c)) AS landcover_class, round(sum(CASE WHEN c = 50 THEN n ELSE 0 END) / sum(n), 4) AS builtup_pct FROM n GROUP BY 1""")
def _(spark, sf):
    li = X.table(spark, sf, "lineitem")
    px = li.select((F.col("l_orderkey") % 200).cast("string").alias("cell_id"), F.when(F.col("l_quantity") < 5, 0).otherwise(F.col("l_linenumber") * 10).alias("class_code"))
    return G.landcover_zonal(px).drop("landcover_label")


@query("slope_zonal", f"""WITH dem AS (SELECT l_suppkey % 10 AS cell_id, l_orderkey % 40 AS row, l_partkey % 40 AS col, max(l_quantity){D} AS z FROM lineitem GROUP BY ALL),
 g AS (SELECT *, lag(z) OVER h AS xa, lead(z) OVER h AS xb, lag(z) OVER v AS ya, lead(z) OVER v AS yb FROM dem WINDOW h AS (PARTITION BY cell_id, row ORDER BY col), v AS (PARTITION BY cell_id, col ORDER BY row)),
 d AS (SELECT cell_id, CASE WHEN xa IS NULL AND xb IS NULL THEN 0 WHEN xa IS NULL THEN xb - z WHEN xb IS NULL THEN z - xa ELSE (xb - xa) / 2 END / 30.0{D} AS gx, CASE WHEN ya IS NULL AND yb IS NULL THEN 0 WHEN ya IS NULL THEN yb - z WHEN yb IS NULL THEN z - ya ELSE (yb - ya) / 2 END / 30.0{D} AS gy FROM g)
 SELECT cell_id, round(avg(degrees(atan(sqrt(gx * gx + gy * gy)))), 4) AS slope_deg FROM d GROUP BY 1""")
def _(spark, sf):
    li = X.table(spark, sf, "lineitem")
    dem = li.groupBy((F.col("l_suppkey") % 10).alias("cell_id"), (F.col("l_orderkey") % 40).alias("row"), (F.col("l_partkey") % 40).alias("col")).agg(F.max("l_quantity").cast("double").alias("z"))
    return G.slope_zonal(dem, 30.0)


@query("road_zonal", """WITH r AS (SELECT o_custkey % 300 AS cell_id, o_orderkey AS id, (['motorway','trunk','primary','secondary','tertiary','residential','track','path','service'])[o_orderkey % 9 + 1] AS h, CASE o_orderkey % 4 WHEN 0 THEN 'gravel' WHEN 1 THEN 'asphalt' END AS sf, o_orderkey % 50 = 0 AS b FROM orders),
 k AS (SELECT cell_id, min((CASE WHEN h = 'service' THEN 99 ELSE list_position(['motorway','trunk','primary','secondary','tertiary','residential','track','path'], h) END, id)) AS m, bool_or(b) AS has_bridge FROM r GROUP BY 1)
 SELECT k.cell_id, h AS road_class, CASE WHEN sf = 'gravel' THEN 'unpaved' WHEN sf = 'asphalt' THEN 'paved' WHEN h IN ('track', 'path') THEN 'unpaved' WHEN h = 'service' THEN 'unknown' ELSE 'paved' END AS road_surface, has_bridge FROM k JOIN r ON r.cell_id = k.cell_id AND r.id = m[2]""")
def _(spark, sf):
    o, k = X.table(spark, sf, "orders"), F.col("o_orderkey")
    h = F.element_at(F.lit([*G.ROAD_RANK, "service"]), (k % 9 + 1).cast("int"))
    r = o.select((F.col("o_custkey") % 300).alias("cell_id"), k.alias("road_id"), h.alias("highway"), F.when(k % 4 == 0, "gravel").when(k % 4 == 1, "asphalt").alias("surface"), (k % 50 == 0).alias("bridge"))
    return G.road_zonal(r)


@query("control_as_of", """WITH ch AS (SELECT c_nationkey AS settlement, o_orderdate::DATE AS date, max(o_orderstatus) AS side FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), q AS (SELECT n_nationkey AS settlement, x.d AS as_of FROM nation, (VALUES (DATE '1995-06-30'), (DATE '1990-01-01'), (DATE '1998-03-01')) x(d))
 SELECT q.settlement, q.as_of::VARCHAR AS as_of, coalesce((SELECT arg_max(side, date) FROM ch WHERE ch.settlement = q.settlement AND ch.date <= q.as_of), 'D') AS side FROM q""")
def _(spark, sf):
    nat = X.table(spark, sf, "nation")
    ch = X.table(spark, sf, "orders").join(X.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_nationkey").alias("settlement"), F.col("o_orderdate").cast("date").alias("date")).agg(F.max("o_orderstatus").alias("side"))
    days = F.array(*[F.to_date(F.lit(x)) for x in ("1995-06-30", "1990-01-01", "1998-03-01")])
    r = G.control_as_of(nat.select(F.col("n_nationkey").alias("settlement"), F.lit("D").alias("default_side")), ch, nat.select(F.col("n_nationkey").alias("settlement"), F.explode(days).alias("as_of")))
    return r.withColumn("as_of", F.col("as_of").cast("string"))


PIX = """px AS (SELECT l_partkey % 8 AS fp, l_linenumber % 4 AS acq, l_orderkey % 32 AS row, l_suppkey % 32 AS col, avg(l_quantity)::DOUBLE AS q, avg(l_extendedprice)::DOUBLE AS x, avg(l_discount)::DOUBLE AS y FROM lineitem GROUP BY ALL)"""


def pixel_fixture(spark, sf):
    li = X.table(spark, sf, "lineitem")
    p = cut(li.groupBy((F.col("l_partkey") % 8).alias("fp"), (F.col("l_linenumber") % 4).alias("acq"), (F.col("l_orderkey") % 32).cast("int").alias("row"), (F.col("l_suppkey") % 32).cast("int").alias("col")).agg(
        F.avg("l_quantity").cast("double").alias("q"), F.avg("l_extendedprice").cast("double").alias("x"), F.avg("l_discount").cast("double").alias("y")))
    tid = F.concat_ws("-", F.col("fp").cast("string"), F.col("acq").cast("string"))
    start = F.timestamp_seconds(F.lit(1704067200) + F.col("acq") * 86400)
    tiles = p.select("fp", "acq").distinct().select(
        tid.alias("tile_id"), (36.0 + 0.1 * F.col("fp")).alias("w"), F.lit(47.0).alias("s"), (36.1 + 0.1 * F.col("fp")).alias("e"), F.lit(47.1).alias("n"), start.alias("acq_start"),
        (start + F.expr("interval 1 hour")).alias("acq_end"), F.lit(32).alias("height"), F.lit(32).alias("width"), F.lit(300.0).alias("scale_m"))
    band = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), v.alias("value")) for b, v in (
        ("VV", F.col("q")), ("B3", F.col("x")), ("B8", F.col("x") * 2), ("B12", F.col("q") * 1000 + F.col("y")))]))
    return p.select(tid.alias("tile_id"), "row", "col", band.alias("b")).select("tile_id", "b.band", "row", "col", "b.value"), tiles


def cluster_sql(mask: str) -> list[str]:
    return [f"mk AS MATERIALIZED (SELECT row_number() OVER (ORDER BY fp, row, col) AS i, * FROM ({mask}))",
            "ed AS MATERIALIZED (SELECT a.i AS a, b.i AS b FROM mk a JOIN mk b ON a.fp = b.fp AND abs(a.row - b.row) + abs(a.col - b.col) = 1)",
            "cl(i, g) USING KEY (i) AS (SELECT i, i FROM mk UNION SELECT ed.b, min(cl.g) FROM cl JOIN ed ON ed.a = cl.i JOIN recurring.cl AS r ON r.i = ed.b WHERE cl.g < r.g GROUP BY ed.b)",
            "st AS (SELECT fp, g, count(*) AS n_pixels, avg(abs(d)) AS mag, avg(d) AS md, max(d) AS pk, avg(row) AS r, avg(col) AS c FROM mk JOIN cl USING (i) GROUP BY ALL)"]


# decimal rounding, as Spark rounds doubles half up in decimal form
CENTRE = (f"round((36.0{D} + 0.1{D} * fp + (c + 0.5) * 0.1{D} / 32)::DECIMAL(18,10), 6)::DOUBLE AS lon,"
          f" round((47.1{D} - (r + 0.5) * 0.1{D} / 32)::DECIMAL(18,10), 6)::DOUBLE AS lat")


@query("sar_logratio", "WITH RECURSIVE " + ",\n".join([PIX, "hv AS (SELECT fp, row, col, avg(q) FILTER (acq < 2) AS b, avg(q) FILTER (acq >= 2) AS a FROM px GROUP BY ALL)", *cluster_sql("SELECT fp, row, col, a - b AS d FROM hv WHERE abs(a - b) >= 4")]) +
       f" SELECT {CENTRE}, n_pixels, round(mag, 6) AS magnitude, CASE WHEN md > 0 THEN 'increase' ELSE 'decrease' END AS direction, round((0.3 + 0.6 * greatest(0, least(1, (mag - 4) / 8)))::DECIMAL(18,10), 4)::DOUBLE AS self_conf FROM st WHERE n_pixels >= 4")
def _(spark, sf):
    return RS.sar_logratio(*pixel_fixture(spark, sf)).select(F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "n_pixels", F.round("magnitude", 6).alias("magnitude"), "direction", "self_conf")


@query("optical_burn", "WITH RECURSIVE " + ",\n".join([PIX, "hv AS (SELECT fp, row, col, avg(x * 2) FILTER (acq < 2) AS nb, avg(x * 2) FILTER (acq >= 2) AS na, avg(q * 1000 + y) FILTER (acq < 2) AS sb, avg(q * 1000 + y) FILTER (acq >= 2) AS sa FROM px GROUP BY ALL)",
       *cluster_sql("SELECT fp, row, col, (nb - sb) / (nb + sb) - (na - sa) / (na + sa) AS d FROM hv WHERE (nb - sb) / (nb + sb) - (na - sa) / (na + sa) >= 0.25")]) + f" SELECT {CENTRE}, n_pixels, round(md, 6) AS mean_delta FROM st WHERE n_pixels >= 6")
def _(spark, sf):
    return RS.optical_index(*pixel_fixture(spark, sf)).where("obs_type = 'burn_scar'").select(F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "n_pixels", F.round("mean_delta", 6).alias("mean_delta"))


@query("vessel_threshold_median", "WITH " + PIX + " SELECT fp || '-' || acq AS tile_id, round(median(q), 6) AS median FROM px GROUP BY 1")
def _(spark, sf):
    p, _t = pixel_fixture(spark, sf)
    return RS.exact_median(p.where("band = 'VV'"), "tile_id", "value").select("tile_id", F.round("median", 6).alias("median"))


# clutter of about one decibel, and bright pairs of pixels in open water (in sevenths, so that no confidence is a rounding tie);
# constants of the rule as literals
SEA = """sea AS (SELECT fp * 10 + acq AS f, row, col, q / 50 - 15 + CASE WHEN row % 6 = 2 AND col % 6 IN (2, 3) THEN 9 + q / 7 ELSE 0 END AS v FROM px),
 md AS (SELECT f AS f0, median(v) AS m FROM sea GROUP BY f), ma AS (SELECT f0 AS f1, any_value(m) AS m, median(abs(v - m)) AS mad FROM sea JOIN md ON f0 = f GROUP BY f0)"""


@query("vessel_cfar", "WITH RECURSIVE " + ",\n".join([PIX, SEA, *cluster_sql(
    "SELECT f AS fp, row, col, v - (m + greatest(4 * 1.4826 * mad, 8)) AS d FROM sea JOIN ma ON f = f1 WHERE v >= m + greatest(4 * 1.4826 * mad, 8)")]) +
       " SELECT (fp // 10) || '-' || (fp % 10) AS footprint, n_pixels, round((0.3 + 0.6 * least(1, pk / 10))::DECIMAL(18,10), 4)::DOUBLE AS self_conf FROM st WHERE n_pixels BETWEEN 2 AND 300")
def _(spark, sf):
    p, t = pixel_fixture(spark, sf)
    bright = (F.col("row") % 6 == 2) & (F.col("col") % 6).isin(2, 3)
    p = p.where("band = 'VV'").withColumn("value", F.col("value") / 50 - 15 + F.when(bright, 9 + F.col("value") / 7).otherwise(0))
    return RS.vessel_cfar(p, t).select("footprint", "n_pixels", "self_conf")


@query("tile_hash", "SELECT doc_id, sha256(doc_id || text) AS tile_hash FROM documents")
def _(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", RS.tile_hash(F.col("doc_id"), F.col("text")).alias("tile_hash"))


@query("stack_hash", "SELECT source AS footprint, sha256(string_agg(h, '' ORDER BY h)) AS stack_hash FROM (SELECT source, sha256(doc_id || text) AS h FROM documents) GROUP BY 1")
def _(spark, sf):
    d = X.table(spark, sf, "documents").select(F.col("source").alias("footprint"), RS.tile_hash(F.col("doc_id"), F.col("text")).alias("tile_hash"))
    return RS.stack_hash(d)


@query("quantize_confidence", "SELECT event_id, CASE WHEN s >= 0.85 THEN 0.95 WHEN s >= 0.7 THEN 0.85 WHEN s >= 0.5 THEN 0.65 WHEN s >= 0.3 THEN 0.45 ELSE 0.2 END::DOUBLE AS c FROM (SELECT event_id, least(1, value / 400) AS s FROM events)")
def _(spark, sf):
    return X.table(spark, sf, "events").select("event_id", RS.quantize_confidence(F.col("value") / 400).alias("c"))


@query("latest_control", "SELECT user_id::VARCHAR AS cell_id, max(ts) AS as_of, arg_max(event_type, (ts, event_type)) AS side FROM events GROUP BY 1")
def _(spark, sf):
    e = X.table(spark, sf, "events")
    return G.latest_control(e.select(F.col("user_id").cast("string").alias("cell_id"), F.col("ts").cast("timestamp").alias("as_of"), F.col("event_type").alias("side")))


# every event is a cluster, at the threshold of its type; nothing is as large as the last size
STEPS = {"view": 3.0, "error": 4.0, "click": 5.0, "purchase": 6.0, "signup": 8.0}


@query("parameter_sweep", f"""WITH c AS (SELECT CASE event_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in STEPS.items())} END::DOUBLE AS threshold, user_id AS cell, max(CAST(json_extract_string(props, '$.k') AS INT)) AS px FROM events GROUP BY ALL),
 tr AS (SELECT DISTINCT user_id AS cell FROM events WHERE event_type = 'purchase' AND value > 100), st AS (SELECT t::DOUBLE AS threshold, m AS min_px FROM (VALUES {", ".join(f"({v})" for v in STEPS.values())}) a(t), (VALUES (90), (97), (99), (1000)) b(m))
 SELECT threshold, min_px, count(c.cell) AS n_detected, count(tr.cell) AS true_positives, round(coalesce(count(tr.cell) / nullif(count(c.cell), 0), 0), 4) AS precision, round(count(tr.cell) / (SELECT count(*) FROM tr), 4) AS recall
 FROM st LEFT JOIN c ON c.threshold = st.threshold AND min_px <= px LEFT JOIN tr ON tr.cell = c.cell GROUP BY ALL""".replace("SELECT threshold, min_px, count", "SELECT st.threshold, min_px, count"))
def _(spark, sf):
    e = X.table(spark, sf, "events")
    cell = F.col("user_id").cast("string").alias("cell_id")
    thr = F.element_at(F.create_map(*[F.lit(x) for pair in STEPS.items() for x in pair]), F.col("event_type")).alias("threshold")
    clusters = e.select(thr, cell, F.get_json_object("props", "$.k").cast("int").alias("n_pixels"))
    return E.parameter_sweep(clusters, e.where("event_type = 'purchase' and value > 100").select(cell), list(STEPS.values()), [90, 97, 99, 1000])
