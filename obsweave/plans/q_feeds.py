"""Queries over feeds: rows of the given tables are written as feed files to the shared folder, read back and parsed."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsweave.operators import detect as DT
from obsweave.operators import ingest as I
from obsweave.plans import fixture as X
from obsweave.plans.fixture import frac, table
from obsweave.plans.oracle import D, LAT, LON, codec_ctes, with_
from obsweave.session import checkpoint_dir
from obsweave.sources import feeds, sinks

Q: dict = {}
BOX = X.BBOX


def query(name, sql=None):
    def deco(fn):
        Q[name] = (fn, sql)
        return fn
    return deco


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/obsweave/{name}-{uuid.uuid4().hex}"


def _as_csv(df: DataFrame, name: str) -> str:
    path = _folder(df.sparkSession, name)
    df.write.csv(path, header=True, escape='"', emptyValue="", nullValue="")
    return path


def _as_json(features: DataFrame, name: str, array: str, order: str) -> str:
    """Objects (``text``) as files of one document each, in the order of a column over all files."""
    def document(batches):
        first = True
        for batch in batches:
            values = [", " + value for value in batch.column("text").to_pylist()]
            if values and first:
                values[0], first = f'{{"type": "FeatureCollection", "{array}": [' + values[0][2:], False
            yield pa.RecordBatch.from_arrays([pa.array(values, "string")], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([f'{{"{array}": []}}' if first else "]}"])], names=["value"])

    path = _folder(features.sparkSession, name)
    features.repartitionByRange(order).sortWithinPartitions(order).select("text").mapInArrow(document, "value string").write.text(path)
    return path


def _site(user):
    s = F.floor(user / 3)
    return F.round(36.0 + 3.5 * frac(s * 0.61803398875) + 0.012 * (user % 3), 6), F.round(46.8 + 2.7 * frac(s * 0.75487766625), 6)


# ------------------------------------------------------------------ fires
def fire_rows(spark, sf):
    """One fire row per event, three kinds of confidence among them, and none."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    lon, lat = _site(F.col("user_id"))
    conf = (F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, "").when(k % 7 == 2, " N ").when(k % 7 == 3, "high").when(k % 7 == 4, "abc")
            .when(k % 7 == 5, (k % 130).cast("string")).otherwise("l"))
    minutes = F.hour("ts") * 100 + F.minute("ts")
    return e.select(F.when(k % 11 == 0, "x").otherwise(lat.cast("string")).alias("latitude"), lon.cast("string").alias("longitude"), F.date_format("ts", "yyyy-MM-dd").alias("acq_date"),
                    F.when(k % 13 == 0, F.lit("99")).otherwise(minutes.cast("string")).alias("acq_time"), F.lit("N").alias("satellite"), conf.alias("confidence"), k.cast("string").alias("frp"),
                    (k % 2).alias("half"))


@query("fire_feed", f"""SELECT event_id::VARCHAR AS frp, CASE WHEN event_id % 2 = 0 THEN 'firms_viirs_snpp' ELSE 'firms_modis' END AS source_id, date_trunc('minute', ts) AS occurred_start,
 CASE event_id % 7 WHEN 2 THEN 0.6 WHEN 3 THEN 0.9 WHEN 5 THEN least(1.0{D}, (event_id % 130) / 100.0{D}) WHEN 6 THEN 0.3 END::DOUBLE AS self_conf, 'ok' AS outcome
 FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0
 UNION ALL SELECT event_id::VARCHAR, CASE WHEN event_id % 2 = 0 THEN 'firms_viirs_snpp' ELSE 'firms_modis' END, NULL, NULL, CASE WHEN event_id % 13 = 0 THEN 'no_date' ELSE 'no_place' END
 FROM events WHERE event_id % 11 = 0 OR event_id % 13 = 0""")
def _(spark, sf):
    d = fire_rows(spark, sf)
    read = feeds.read_fire_detections(spark, {"VIIRS_SNPP_NRT": _as_csv(d.where("half = 0").drop("half"), "viirs"), "MODIS_NRT": _as_csv(d.where("half = 1").drop("half"), "modis")})
    good = feeds.parse_fire_row(read).select(F.get_json_object("meta", "$.frp").alias("frp"), "source_id", "occurred_start", "self_conf", F.lit("ok").alias("outcome"))
    bad = feeds.fire_rejections(read).select(F.get_json_object("raw_payload", "$.frp").alias("frp"), "source_id", F.lit(None).cast("timestamp").alias("occurred_start"),
                                             F.lit(None).cast("double").alias("self_conf"), F.col("reason").alias("outcome"))
    return good.unionByName(bad).withColumn("occurred_start", F.col("occurred_start").cast("timestamp_ntz"))


# ------------------------------------------------------------------ conflict reports
def conflict_rows(spark, sf):
    """One conflict row per document with its whole text as the article; some without a place or a date."""
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    lon, lat = _site(k)
    day = F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (k % 400).cast("int")), "yyyy-MM-dd")
    none = F.lit(None).cast("string")
    return d.select(k.cast("string").alias("id"), F.when(k % 5 != 0, lat.cast("string")).alias("latitude"), F.when(k % 5 != 0, lon.cast("string")).alias("longitude"),
                    F.when(k % 3 == 0, F.concat(F.lit("place "), (k % 50).cast("string"))).alias("where_coordinates"), F.when(k % 3 == 1, "district").alias("adm_2"),
                    F.when(k % 17 != 0, F.when(k % 4 == 0, F.replace(day, F.lit("-"), F.lit("/"))).otherwise(day)).alias("date_start"), none.alias("date_end"),
                    (k % 4).cast("string").alias("type_of_violence"), F.when(k % 6 == 0, "0").when(k % 6 == 1, "").otherwise((k % 6).cast("string")).alias("best"),
                    F.when(k % 2 == 0, F.lit('the "long" war, part II')).alias("conflict_name"), F.lit("A-B").alias("dyad_name"), F.regexp_replace("text", r"\s+", " ").alias("source_article"))


@query("conflict_feed", f"""SELECT doc_id::VARCHAR AS id, CASE doc_id % 4 WHEN 1 THEN 'strike' WHEN 2 THEN 'strike' ELSE 'other' END AS obs_type,
 (DATE '2023-01-01' + (doc_id % 400)::INT)::TIMESTAMP AS occurred_start, place AS place_name, CASE WHEN doc_id % 5 <> 0 THEN 1000.0{D} ELSE 0.0{D} END AS geom_precision_m,
 sha256(CASE WHEN doc_id % 2 = 0 THEN 'the "long" war, part II' ELSE 'A-B' END || ' — ' || coalesce(place, 'unknown location') || CASE WHEN doc_id % 6 > 1 THEN '; best fatality estimate ' || doc_id % 6 ELSE '' END
 || CASE WHEN article <> '' THEN '; ' || article ELSE '' END) AS text_sha256, 'ok' AS outcome
 FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'place ' || doc_id % 50 WHEN 1 THEN 'district' END AS place, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS article FROM documents)
 WHERE doc_id % 17 <> 0 AND (doc_id % 5 <> 0 OR place IS NOT NULL)
 UNION ALL SELECT doc_id::VARCHAR, NULL, NULL, NULL, NULL, NULL, CASE WHEN doc_id % 17 = 0 THEN 'no_date' ELSE 'no_place' END FROM documents WHERE doc_id % 17 = 0 OR (doc_id % 5 = 0 AND doc_id % 3 = 2)""")
def _(spark, sf):
    read = feeds.read_conflict_events(spark, _as_csv(conflict_rows(spark, sf), "conflicts"))
    good = feeds.parse_conflict_row(read).select(F.get_json_object("meta", "$.ucdp_id").alias("id"), "obs_type", F.col("occurred_start").cast("timestamp_ntz").alias("occurred_start"), "place_name", "geom_precision_m",
                                                 F.sha2("text", 256).alias("text_sha256"), F.lit("ok").alias("outcome"))
    bad = feeds.conflict_rejections(read).select(F.get_json_object("raw_payload", "$.id").alias("id"), F.col("reason").alias("outcome"))
    return good.unionByName(bad, allowMissingColumns=True)


# ------------------------------------------------------------------ damage points and boundaries
@query("damage_feed", with_("points", f"""p AS (SELECT event_id, event_id % 7 AS damage, CASE WHEN event_id % 3 > 0 THEN 'city ' || event_id % 5 ELSE '' END AS city, strftime(ts, '%Y-%m-%d') AS date, cell_id
 FROM events JOIN u_cells USING (user_id) WHERE event_id % 7 BETWEEN 2 AND 4 AND lon BETWEEN 36.0 AND 39.5 AND lat BETWEEN 46.8 AND 49.5)""",
"""g AS (SELECT cell_id, date, count(*) AS n, max(damage)::INT AS worst, arg_max(city, event_id) FILTER (city <> '') AS city FROM p GROUP BY ALL)""",
f"""SELECT *, CASE worst WHEN 2 THEN 0.6 WHEN 3 THEN 0.8 ELSE 0.9 END{D} AS self_conf, 'UNOSAT satellite assessment: ' || n || ' damaged structure(s) (' || CASE worst WHEN 2 THEN 'moderate damage' WHEN 3 THEN 'severe damage'
 ELSE 'destroyed' END || ') in ' || coalesce(city, 'the area') || ' as of ' || date AS text FROM g"""))
def _(spark, sf):
    """One damage point per event, written as GeoJSON; the last named city of a cell and day stands."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    lon, lat = _site(F.col("user_id"))
    props = F.struct((k % 7).alias("damage"), F.when(k % 3 > 0, F.concat(F.lit("city "), (k % 5).cast("string"))).otherwise("").alias("city"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("date"),
                     F.lit('brace } and "quote" {').alias("note"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry")))
    points = feeds.read_damage_points(spark, _as_json(e.select("event_id", feature.alias("text")), "damage", "features", "event_id"))
    return feeds.aggregate_damage(points, BOX).select("cell_id", "date", "n", "worst", "city", "self_conf", "text")


@query("boundary_feed", f"""SELECT doc_id::VARCHAR AS admin_id, sha256(coalesce(text, '-')) AS name_sha256, CASE WHEN doc_id % 4 = 1 THEN 2 ELSE 1 END AS n_rings,
 (doc_id % 100 * 4 + 2){D} + CASE WHEN doc_id % 4 = 1 THEN (doc_id % 100 * 4 + 6){D} ELSE 0 END AS sum_x FROM documents WHERE doc_id % 4 < 3""")
def _(spark, sf):
    """One unit per document with its whole text as the name; some of two polygons, some points, which are no units."""
    k = F.col("doc_id")
    x = k % 100
    box = lambda at: F.array(*[F.array((x + at + dx).cast("double"), F.lit(float(dy))) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))])
    kind = F.when(k % 4 == 1, "MultiPolygon").when(k % 4 == 3, "Point").otherwise("Polygon")
    xy = F.when(k % 4 == 1, F.to_json(F.array(F.array(box(0)), F.array(box(1))))).when(k % 4 == 3, "[1, 2]").otherwise(F.to_json(F.array(box(0))))
    props = F.to_json(F.struct(k.cast("string").alias("shapeID"), F.col("text").alias("shapeName")))
    feature = F.concat(F.lit('{"type": "Feature", "properties": '), props, F.lit(', "geometry": {"type": "'), kind, F.lit('", "coordinates": '), xy, F.lit("}}"))
    units = feeds.read_admin_boundaries(spark, _as_json(table(spark, sf, "documents").select("doc_id", feature.alias("text")), "units", "features", "doc_id"), 1)
    total = F.aggregate(F.flatten("rings"), F.lit(0.0), lambda s, p: s + p["x"])
    return units.select("admin_id", F.sha2(F.coalesce("name", F.lit("-")), 256).alias("name_sha256"), F.size("rings").alias("n_rings"), total.alias("sum_x"))


# ------------------------------------------------------------------ places
GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_extract_all(lower({n}), '[a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("place_names", with_("points", "part_ AS (SELECT p_partkey AS k, p_partkey AS user_id, floor(p_partkey / 3)::DOUBLE AS s, p_name || ' ' || p_size AS n, p_name, p_size FROM part)",
 f"apts AS (SELECT k, {LON} AS lon, {LAT} AS lat FROM part_)", *codec_ctes("apts", "k", "p"),
 """al AS (SELECT k AS alias_id, k + 1000 AS place_id, CASE WHEN k % 2 = 0 THEN n ELSE upper(n) END AS name, CASE WHEN k % 3 = 1 THEN 'east' ELSE 'west' END AS theater_id, k % 5 = 0 AS is_preferred,
 CASE WHEN k % 4 > 0 THEN 'c' || k WHEN k % 8 = 0 AND cell_id IN (SELECT cell_id FROM grid) THEN cell_id END AS cell_id FROM part_ JOIN p_cells USING (k))""",
 """rec AS (SELECT k AS seq, CASE WHEN k % 7 = 1 THEN 'east' ELSE 'west' END AS theater_id, CASE k % 5 WHEN 0 THEN upper(n) || ' ' WHEN 1 THEN p_name || 's ' || p_size WHEN 2 THEN 'xyzzy ' || k WHEN 4 THEN '' ELSE n END AS place_name,
 CASE WHEN k % 5 = 4 THEN cell_id END AS pc FROM part_ JOIN p_cells USING (k))""",
 "pt AS (SELECT seq, pc FROM rec WHERE pc IN (SELECT cell_id FROM grid))",
 "need AS (SELECT DISTINCT theater_id, place_name FROM rec ANTI JOIN pt USING (seq) WHERE place_name <> '')",
 "ex AS (SELECT theater_id, place_name, arg_min((place_id, cell_id), (NOT is_preferred, alias_id)) AS p FROM need JOIN al USING (theater_id) WHERE lower(trim(place_name)) = lower(trim(name)) GROUP BY ALL)",
 f"q AS MATERIALIZED (SELECT theater_id, place_name, {GRAMS.format(n='place_name')} AS g FROM need ANTI JOIN ex USING (theater_id, place_name))",
 f"a AS MATERIALIZED (SELECT theater_id, name, {GRAMS.format(n='name')} AS h, arg_min((place_id, cell_id, alias_id), alias_id) AS p FROM al GROUP BY theater_id, name)",
 "s AS (SELECT theater_id, place_name, p, len(list_intersect(g, h)) AS i, len(g) + len(h) AS u FROM q JOIN a USING (theater_id))",
 "fz AS (SELECT theater_id, place_name, arg_max((p[1], p[2]), (i / (u - i), -p[3])) AS p FROM s WHERE i / (u - i) > 0.4 GROUP BY ALL)",
 "hit AS (SELECT *, 'exact' AS how FROM ex UNION ALL SELECT *, 'fuzzy' FROM fz)",
 """SELECT seq, coalesce(pc_, p[2]) AS cell_id, CASE WHEN pc_ IS NOT NULL THEN 'point' WHEN p[2] IS NOT NULL THEN how END AS resolved_by, CASE WHEN pc_ IS NULL AND p[2] IS NOT NULL THEN p[1] END AS place_id
 FROM rec LEFT JOIN (SELECT seq, pc AS pc_ FROM pt) USING (seq) LEFT JOIN hit USING (theater_id, place_name)"""))
def _(spark, sf):
    """Records by point or by name, in two theaters; aliases of equal names, without a cell, with a point and without."""
    k, n = F.col("p_partkey"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))
    part = table(spark, sf, "part")
    lon, lat = _site(k)
    alias = part.select(k.alias("alias_id"), (k + 1000).alias("place_id"), F.when(k % 2 == 0, n).otherwise(F.upper(n)).alias("name"), F.when(k % 3 == 1, "east").otherwise("west").alias("theater_id"),
                        (k % 5 == 0).alias("is_preferred"), F.when(k % 4 > 0, F.concat(F.lit("c"), k.cast("string"))).alias("cell_id"), F.when(k % 8 == 0, lon).alias("lon"), F.when(k % 8 == 0, lat).alias("lat"))
    name = F.when(k % 5 == 0, F.concat(F.upper(n), F.lit(" "))).when(k % 5 == 1, F.concat("p_name", F.lit("s "), F.col("p_size").cast("string"))).when(k % 5 == 2, F.concat(F.lit("xyzzy "), k.cast("string"))).when(k % 5 == 4, "").otherwise(n)
    rec = part.select(k.alias("seq"), F.when(k % 7 == 1, "east").otherwise("west").alias("theater_id"), name.alias("place_name"), F.when(k % 5 == 4, lon).alias("lon"), F.when(k % 5 == 4, lat).alias("lat"),
                      F.lit(300.0).alias("geom_precision_m"))
    return I.resolve_to_cell(rec, X.grid_of(spark, sf), alias).select("seq", "cell_id", "resolved_by", "place_id")


def gazetteer(spark, sf):
    """One place per supplier as tab-separated lines of 19 fields, with short and unfit lines among them."""
    k = F.col("s_suppkey")
    kind = F.when(k % 9 == 0, "R").otherwise("P")
    lon = F.when(k % 10 == 3, F.lit("x")).otherwise(F.round(36.0 + 3.5 * frac(k * 0.61803398875), 6).cast("string"))
    lat = F.round(46.8 + 2.7 * frac(k * 0.75487766625), 6).cast("string")
    blank = [F.lit("")] * 6
    line = F.concat_ws("\t", k.cast("string"), "s_name", F.lit(""), F.lit(""), lat, lon, kind, F.lit("PPL"), F.lit("UA"), *blank[:5], (k * 10).cast("string"), *blank[:4])
    return table(spark, sf, "supplier").select(F.when(k % 23 == 7, F.lit("short\trow")).otherwise(line).alias("value"))


@query("gazetteer_feed", f"""SELECT s_suppkey AS place_id, s_name AS name, round(36.0{D} + 3.5{D} * (s_suppkey * 0.61803398875{D} - floor(s_suppkey * 0.61803398875{D})), 6) AS lon, s_suppkey * 10 AS population,
 CASE WHEN s_suppkey % 4 < 3 THEN 'alt ' || s_suppkey END AS alternate FROM supplier WHERE s_suppkey % 9 <> 0 AND s_suppkey % 10 <> 3 AND s_suppkey % 23 <> 7""")
def _(spark, sf):
    k = F.col("s_suppkey")
    path, names = _folder(spark, "gazetteer"), _folder(spark, "names")
    gazetteer(spark, sf).write.text(path)
    lang = F.when(k % 4 == 0, "uk").when(k % 4 == 1, "ru-Latn").when(k % 4 == 2, "").otherwise("fr")
    table(spark, sf, "supplier").select(F.concat_ws("\t", (k * 7).cast("string"), k.cast("string"), lang, F.concat(F.lit("alt "), k.cast("string")), F.lit("1")).alias("value")).write.text(names)
    places = feeds.read_gazetteer(spark, path, BOX)
    alt = feeds.read_alternate_names(spark, names, places).select("place_id", F.col("name").alias("alternate"))
    return places.join(alt, "place_id", "left").select("place_id", "name", "lon", "population", "alternate")


# ------------------------------------------------------------------ detections
@query("detect_and_persist", with_("norm", "g AS (SELECT user_id, cell_id FROM u_cells LEFT JOIN grid USING (cell_id) WHERE cell_id IN (SELECT cell_id FROM grid))",
                                   """st AS (SELECT user_id, ts::DATE AS day, max(least(1, value / 400)) FILTER (event_type = 'signup') AS c, count(*) FILTER (event_type = 'signup') AS n FROM events GROUP BY ALL)""",
                                   """SELECT 'log' AS part, cell_id, user_id::VARCHAR || '|' || day AS stack, CASE WHEN c >= 0.85 THEN 0.95 WHEN c >= 0.7 THEN 0.85 WHEN c >= 0.5 THEN 0.65 WHEN c >= 0.3 THEN 0.45 ELSE 0.2 END::DOUBLE AS self_conf, 1 AS n FROM st JOIN g USING (user_id) WHERE n > 0
 UNION ALL SELECT 'ledger', NULL, 'no_cell_resolve', NULL, sum(n)::INT FROM st WHERE user_id NOT IN (SELECT user_id FROM g) HAVING sum(n) > 0
 UNION ALL SELECT 'first run', NULL, 'stacks', NULL, count(*)::INT FROM st UNION ALL SELECT 'first run', NULL, 'detections', NULL, sum(n)::INT FROM st
 UNION ALL SELECT 'second run', NULL, 'stacks', NULL, 0 UNION ALL SELECT 'second run', NULL, 'detections', NULL, 0"""))
def _(spark, sf):
    """A stack per user and day; its signups are the detections. Run twice: the second time there is nothing to do."""
    e = table(spark, sf, "events").withColumn("cache_key", F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")))
    stacks = e.select("cache_key").distinct()
    lon, lat = _site(F.col("user_id"))
    day = F.to_timestamp(F.to_date("ts"))
    found = e.where("event_type = 'signup'").select("cache_key", F.lit("building_damaged").alias("obs_type"), F.col("event_id").cast("string").alias("label"),
                                                    F.concat(F.lit("detections of stack "), "cache_key").alias("text"), F.least(F.lit(1.0), F.col("value") / 400).alias("self_conf"), F.lit(1).alias("n_pixels"),
                                                    lon.alias("lon"), lat.alias("lat"), F.lit(30).alias("scale_m"), day.alias("stack_start"), (day + F.expr("interval 1 day")).alias("stack_end"))
    root = _folder(spark, "detections")
    runs = [DT.detect_and_persist(stacks, lambda s: s.join(found, "cache_key"), X.grid_of(spark, sf), root, "sentinel1_sar_logratio", X.THEATER) for _ in range(2)]
    log = sinks.read_table(spark, f"{root}/log").select(F.lit("log").alias("part"), "cell_id", F.col("cache_key").alias("stack"), "self_conf", F.lit(1).alias("n"))
    ledger = sinks.read_table(spark, f"{root}/ledger", sinks.LEDGER, declared=True).groupBy("reason").agg(F.count(F.lit(1)).cast("int").alias("n"))
    counts = spark.createDataFrame([(name, k, r[k]) for name, r in zip(("first run", "second run"), runs, strict=True) for k in ("stacks", "detections")], "part string, stack string, n int")
    none = {"cell_id": F.lit(None).cast("string"), "self_conf": F.lit(None).cast("double")}
    return log.unionByName(ledger.select(F.lit("ledger").alias("part"), F.col("reason").alias("stack"), "n").withColumns(none)).unionByName(counts.withColumns(none))


@query("append_twice", with_("norm", "SELECT 'ingested' AS counter, count(*) AS n FROM obs UNION ALL SELECT 'exact_dup', 2 * (SELECT count(*) FROM placed WHERE reason0 IS NULL) - (SELECT count(*) FROM obs) UNION ALL SELECT 'log', count(*) FROM obs"))
def _(spark, sf):
    """All records go to a log, and then all of them again: the second time each is a repeat."""
    root = _folder(spark, "log")
    d = I.resolve_to_cell(I.validate_enums(X.raw_observations(spark, sf)).where("reason is null").drop("reason"), X.grid_of(spark, sf))
    d = I.with_identity(d.where("cell_id is not null"))
    runs = [sinks.append_observations(d, f"{root}/log", f"{root}/ledger", "event_id") for _ in range(2)]
    n = sinks.read_table(spark, f"{root}/log").count()
    return spark.createDataFrame([(k, sum(r[k] for r in runs)) for k in ("ingested", "exact_dup")] + [("log", n)], "counter string, n bigint")
