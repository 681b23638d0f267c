"""Feed readers and the parsing of their rows into raw observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave import dims
from obsweave.functions.cells import with_cell
from obsweave.functions.timegeo import in_bbox, parse_acq_time, parse_date_multi
from obsweave.operators.ingest import period_key
from obsweave.sources.json_elements import read_json_elements
from obsweave.sources.quoted_csv import read_quoted_csv

# Fixed values of the feeds.
VIOLENCE_LABEL = {1: "Armed Conflict (Government)", 2: "Armed Conflict (Non-State)", 3: "One-sided violence"}
VIOLENCE_TYPE = {1: "strike", 2: "strike", 3: "other"}
DAMAGE_GRADE = {2: ("moderate damage", 0.6), 3: ("severe damage", 0.8), 4: ("destroyed", 0.9)}
FIRE_WORDS = {"l": 0.3, "low": 0.3, "n": 0.6, "nominal": 0.6, "h": 0.9, "high": 0.9}
PLACE_CLASSES = ["P", "H", "L", "S", "T"]
CONFLICT_COLUMNS = ["id", "latitude", "longitude", "where_coordinates", "adm_1", "adm_2", "where_description", "date_start", "date_end", "type_of_violence",
                    "best", "conflict_name", "dyad_name", "country", "source_article", "source_headline", "precision_m"]
RAW_COLUMNS = ["theater_id", "source_id", "modality", "obs_type", "occurred_start", "occurred_end", "lon", "lat", "geom_precision_m", "place_name",
               "text", "self_conf", "meta"]


def _strings(df: DataFrame, names: list[str]) -> DataFrame:
    """All named columns as text; absent ones as null."""
    return df.select(*[(F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in names])


def filled(*names: str) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def number(c: Column) -> Column:
    return F.trim(c).try_cast("double")


# ------------------------------------------------------------------ readers
def read_conflict_events(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """CSV with header, or JSON: an array of rows, alone or under ``Result``. One file is read by many tasks."""
    if fmt == "csv":
        return _strings(read_quoted_csv(spark, path), CONFLICT_COLUMNS)
    return read_json_elements(spark, path, "Result", ", ".join(f"{c} string" for c in CONFLICT_COLUMNS))


def combine_event_files(spark: SparkSession, main: str, monthly: str, country: str, since: str, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Main files, then monthly ones, in path order; the first row of an id wins.

    The order of rows is file rank, then path, then position in the file. Large files are read by many tasks (`quoted_csv`).
    """
    def read(path: str, rank: int) -> DataFrame:
        d = read_quoted_csv(spark, path, positions=True)
        columns = [(F.col(c) if c in d.columns else F.lit(None).cast("string")).alias(c) for c in CONFLICT_COLUMNS]
        return d.select(*columns, "file_path", "start", "line").withColumn("rank", F.lit(rank))

    d = read(main, 0).unionByName(read(monthly, 1))
    day = F.substring("date_start", 1, 10)
    d = d.where((F.col("country") == country) & (F.length(day) == 10) & (day >= since) & in_bbox(number(F.col("longitude")), number(F.col("latitude")), bbox))
    first = d.groupBy("id").agg(F.min_by(F.struct(*CONFLICT_COLUMNS), F.struct("rank", "file_path", "start", "line")).alias("r"))
    return first.select("r.*").orderBy("date_start", "id")


def read_fire_detections(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """CSV per sensor feed name, with the sensor's source and family."""
    cols = ["latitude", "longitude", "acq_date", "acq_time", "satellite", "instrument", "confidence", "frp", "bright_ti4", "daynight"]
    out = None
    for feed, path in paths.items():
        source, fam = dims.FIRE_SENSORS[feed]
        d = _strings(spark.read.csv(path, header=True), cols).withColumn("source_id", F.lit(source)).withColumn("source_family_id", F.lit(fam))
        out = d if out is None else out.unionByName(d)
    return out


POINT_SCHEMA = "properties struct<damage:int,city:string,date:string>, geometry struct<coordinates:array<double>>"


def read_damage_points(spark: SparkSession, path: str) -> DataFrame:
    """FeatureCollection -> (damage, city, date, lon, lat, seq); ``seq`` orders the points as in the files."""
    d = read_json_elements(spark, path, "features", POINT_SCHEMA, order=True)
    xy = F.col("geometry.coordinates")
    return d.select("properties.damage", "properties.city", F.substring("properties.date", 1, 10).alias("date"), F.get(xy, F.lit(0)).alias("lon"), F.get(xy, F.lit(1)).alias("lat"),
                    F.struct("file_path", "start", "line").alias("seq"))


def read_gazetteer(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Tab-separated place rows of 19 columns or more; settlements and features with numeric coordinates."""
    p = F.split("value", "\t")
    d = spark.read.text(path).where(F.size(p) >= 19).select(
        p[0].try_cast("long").alias("place_id"), p[1].alias("name"), number(p[4]).alias("lat"), number(p[5]).alias("lon"), p[6].alias("feature_class"),
        p[7].alias("feature_code"), p[8].alias("country"), p[14].try_cast("long").alias("population"))
    d = d.where(F.col("feature_class").isin(PLACE_CLASSES) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return d if bbox is None else d.where(in_bbox(F.col("lon"), F.col("lat"), bbox))


def read_alternate_names(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    p = F.split("value", "\t")
    d = spark.read.text(path).where(F.size(p) >= 4).select(p[1].try_cast("long").alias("place_id"), p[2].alias("lang"), p[3].alias("name"),
                                                          (F.coalesce(F.get(p, F.lit(4)), F.lit("")) == "1").alias("is_preferred"))
    ok = F.col("lang").isin("uk", "ru", "en", "translit", "") | F.col("lang").startswith("uk") | F.col("lang").startswith("ru")
    return d.where(ok).join(places.select("place_id"), "place_id", "left_semi")


def read_admin_boundaries(spark: SparkSession, path: str, level: int) -> DataFrame:
    """Polygon and MultiPolygon features -> (admin_id, name, level, rings). A unit's rings are kept together."""
    f = read_json_elements(spark, path, "features", "properties struct<shapeID:string,shapeName:string>, geometry struct<type:string,coordinates:string>")
    one = F.from_json("geometry.coordinates", "array<array<array<double>>>")
    many = F.flatten(F.from_json("geometry.coordinates", "array<array<array<array<double>>>>"))
    rings = F.when(F.col("geometry.type") == "Polygon", one).when(F.col("geometry.type") == "MultiPolygon", many)
    pts = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
    return f.where(rings.isNotNull()).select(F.col("properties.shapeID").alias("admin_id"), F.col("properties.shapeName").alias("name"), F.lit(level).alias("level"), pts.alias("rings"))


def read_places(spark: SparkSession, path: str) -> DataFrame:
    return read_json_elements(spark, path, "places", "name string, lon double, lat double")


def read_control_timeline(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(settlements with default side, dated changes)."""
    d = read_json_elements(spark, path, "settlements", "name string, lon double, lat double, default string, changes array<struct<date:string,side:string>>").select(F.struct("*").alias("s"))
    base = d.select(F.col("s.name").alias("settlement"), F.col("s.lon").alias("lon"), F.col("s.lat").alias("lat"), F.col("s.default").alias("default_side"))
    ch = d.select(F.col("s.name").alias("settlement"), F.explode("s.changes").alias("c")).select("settlement", F.to_date("c.date").alias("date"), F.col("c.side").alias("side"))
    return base, ch


def curated_incidents(df: DataFrame) -> DataFrame:
    """Nested incidents (incident_id, theater_id, observations) -> one-hour raw observations marked as seeded."""
    d = df.select("incident_id", "theater_id", F.explode("observations").alias("o")).select("incident_id", "theater_id", "o.*")
    return d.withColumn("occurred_end", F.col("occurred_start") + F.expr("interval 1 hour")).withColumn(
        "meta", F.to_json(F.struct(F.lit(True).alias("seeded"), "incident_id")))


TILE_SCHEMA = "tile_id string, band string, row int, col int, value double"


def read_tiles(spark: SparkSession, path: str, bands: list[str]) -> DataFrame:
    """Float arrays in ``.npy`` files -> pixel rows; Python only decodes the bytes of one file at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("tile_id"), "content")

    def decode(batches):
        import io

        import numpy as np
        import pandas as pd
        for pdf in batches:
            for tile, content in zip(pdf["tile_id"], pdf["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a[None] if a.ndim == 2 else a
                for i, plane in enumerate(a):
                    r, c = np.indices(plane.shape)
                    yield pd.DataFrame({"tile_id": tile, "band": bands[i], "row": r.ravel().astype("int32"), "col": c.ravel().astype("int32"), "value": plane.ravel().astype("float64")})

    return files.mapInPandas(decode, TILE_SCHEMA)


# ------------------------------------------------------------------ row parsers
def violence_type(c: Column) -> Column:
    return dims.choose(F.floor(number(c)).cast("int"), VIOLENCE_TYPE, "other")


def _conflict_fields(df: DataFrame, text_limit: int | None = None) -> DataFrame:
    place = filled("where_coordinates", "adm_2", "adm_1", "where_description")
    article = F.trim(F.coalesce(filled("source_article", "source_headline"), F.lit("")))
    best = F.col("best")
    text = F.concat(F.coalesce(filled("conflict_name", "dyad_name"), F.lit("armed conflict")), F.lit(" — "), F.coalesce(place, F.lit("unknown location")),
                    F.when(best.isNotNull() & ~best.isin("", "0"), F.concat(F.lit("; best fatality estimate "), best)).otherwise(""),
                    F.when(article != "", F.concat(F.lit("; "), article if text_limit is None else F.substring(article, 1, text_limit))).otherwise(""))
    start, end = parse_date_multi(filled("date_start", "date_end")), parse_date_multi(filled("date_end", "date_start"))
    d = df.select("*", number(F.col("latitude")).alias("lat"), number(F.col("longitude")).alias("lon"), place.alias("place_name"), start.alias("occurred_start"),
                  F.coalesce(end, start).alias("occurred_end"), text.alias("text"))
    somewhere = "lat is not null or lon is not null or place_name is not null"
    return d.withColumn("parse_reason", F.when(F.col("occurred_start").isNull(), "no_date").when(~F.expr(somewhere), "no_place"))


def unparsed_rows(df: DataFrame, fields: DataFrame, theater: str, source: Column) -> DataFrame:
    """Ledger rows of feed rows that make no observation."""
    return fields.where("parse_reason is not null").select(
        F.lit(theater).alias("theater_id"), source.alias("source_id"), F.to_json(F.struct(*df.columns)).alias("raw_payload"), F.col("parse_reason").alias("reason"))


def conflict_rejections(df: DataFrame, theater: str = "ua_donbas") -> DataFrame:
    """Ledger rows (``no_date``, ``no_place``) of the conflict rows that `parse_conflict_row` leaves out."""
    return unparsed_rows(df, _conflict_fields(df), theater, F.lit("ucdp_ged_bulk"))


def parse_conflict_row(df: DataFrame, theater: str = "ua_donbas", text_limit: int | None = None) -> DataFrame:
    """Conflict rows -> raw observations with the whole article text, or ``text_limit`` characters of it.

    Rows without any place or date are in `conflict_rejections`.
    """
    d = _conflict_fields(df, text_limit).where("parse_reason is null")
    return d.select(F.lit(theater).alias("theater_id"), F.lit("ucdp_ged_bulk").alias("source_id"), F.lit("text").alias("modality"), violence_type(F.col("type_of_violence")).alias("obs_type"),
                    "occurred_start", "occurred_end", "lon", "lat",
                    F.when(F.col("lat").isNotNull(), F.coalesce(number(F.col("precision_m")), F.lit(1000.0))).otherwise(0.0).alias("geom_precision_m"), "place_name", "text",
                    F.lit(None).cast("double").alias("self_conf"), F.to_json(F.struct(F.col("id").alias("ucdp_id"), "country", "type_of_violence")).alias("meta"))


def fire_confidence(c: Column) -> Column:
    """Share from a word or a number of percent; null where there is neither."""
    s = F.lower(F.trim(c))
    # least() passes over nulls, so a value that is no number must be kept from it; nor is NaN a number here
    n = F.when(s.rlike(r"^[+-]?[0-9.]"), s.try_cast("double")) / 100
    return F.coalesce(dims.choose(s, FIRE_WORDS, F.lit(None).cast("double")), F.when(n.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), n))))


def _fire_fields(df: DataFrame) -> DataFrame:
    acq = parse_acq_time(F.col("acq_date"), F.col("acq_time"))
    d = df.select("*", number(F.col("latitude")).alias("lat"), number(F.col("longitude")).alias("lon"), acq.alias("occurred_start"))
    return d.withColumn("parse_reason", F.when(F.col("occurred_start").isNull(), "no_date").when(F.col("lat").isNull() | F.col("lon").isNull(), "no_place"))


def fire_rejections(df: DataFrame, theater: str = "ua_donbas") -> DataFrame:
    """Ledger rows (``no_date``, ``no_place``) of the fire rows that `parse_fire_row` leaves out."""
    return unparsed_rows(df, _fire_fields(df), theater, F.col("source_id"))


def parse_fire_row(df: DataFrame, theater: str = "ua_donbas") -> DataFrame:
    """Fire detections -> raw observations; rows without a point or time are in `fire_rejections`."""
    sat = F.coalesce(filled("satellite", "instrument"), F.col("source_id"))
    d = _fire_fields(df).where("parse_reason is null")
    show = lambda c: F.coalesce(F.col(c), F.lit("None"))
    text = F.concat(F.lit("active fire detection ("), sat, F.lit(") at "), F.date_format("occurred_start", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00; FRP "), show("frp"),
                    F.lit(" MW; confidence "), show("confidence"))
    return d.select(F.lit(theater).alias("theater_id"), "source_id", F.lit("thermal").alias("modality"), F.lit("fire").alias("obs_type"), "occurred_start",
                    (F.col("occurred_start") + F.expr("interval 1 hour")).alias("occurred_end"), "lon", "lat", F.lit(375.0).alias("geom_precision_m"),
                    F.lit(None).cast("string").alias("place_name"), text.alias("text"), fire_confidence(F.col("confidence")).alias("self_conf"),
                    F.to_json(F.struct(sat.alias("satellite"), "frp", "confidence", "bright_ti4", "daynight")).alias("meta"))


# ------------------------------------------------------------------ pre-aggregation
def aggregate_periods(df: DataFrame, bbox: tuple[float, float, float, float], granularity: str = "month", order: str = "seq") -> DataFrame:
    """Conflict rows -> one raw observation per cell and period. ``order`` is the input position.

    The dominant violence code has the highest count, then the earliest row.
    """
    day = F.substring("date_start", 1, 10)
    d = df.select("*", number(F.col("longitude")).alias("lon"), number(F.col("latitude")).alias("lat"), day.alias("day")).where((F.length("day") == 10) & in_bbox(F.col("lon"), F.col("lat"), bbox))
    d = with_cell(d, "lon", "lat").where("cell_id is not null").withColumn("period", period_key(F.col("day").cast("timestamp"), granularity))
    as_int = lambda c, v: F.coalesce(F.floor(number(F.col(c))).cast("int"), F.lit(v))
    d = d.withColumn("code", as_int("type_of_violence", 1)).withColumn("deaths", as_int("best", 0))
    key = ["cell_id", "period"]
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(order)))
    per = d.groupBy(*key, "code").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_row"), F.sum("deaths").alias("deaths"), F.min("day").alias("first"), F.max("day").alias("last"),
                                      last(filled("adm_2", "adm_1", "where_coordinates")).alias("place"), F.max(F.when(filled("adm_2", "adm_1", "where_coordinates").isNotNull(), F.col(order))).alias("place_at"),
                                      last(filled("conflict_name")).alias("conflict"), F.max(F.when(filled("conflict_name").isNotNull(), F.col(order))).alias("conflict_at"))
    g = per.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("deaths").alias("deaths"), F.min_by("code", F.struct(-F.col("n"), F.col("first_row"))).alias("dominant"),
                              F.min("first").alias("first"), F.max("last").alias("last"), F.max_by("place", "place_at").alias("place"), F.max_by("conflict", "conflict_at").alias("conflict"))
    span = F.when(F.col("first") == F.col("last"), F.col("first")).otherwise(F.concat("first", F.lit("…"), "last"))
    text = F.concat(F.lit("UCDP: "), F.col("n").cast("string"), F.lit(" armed-conflict event(s) near "), F.coalesce("place", F.lit("the area")), F.lit(" ("), span, F.lit(")"),
                    F.when(F.col("deaths") != 0, F.concat(F.lit("; "), F.col("deaths").cast("string"), F.lit(" fatalities"))).otherwise(""),
                    F.when(F.col("conflict").isNotNull(), F.concat(F.lit(" — "), "conflict")).otherwise(""))
    conf = F.when(F.col("deaths") == 0, 0.78).when(F.col("deaths") >= 5, 0.85).otherwise(0.82)
    return g.select("cell_id", "period", "n", "deaths", "dominant", dims.choose(F.col("dominant"), VIOLENCE_TYPE, "other").alias("obs_type"),
                    F.to_timestamp("first").alias("occurred_start"), (F.to_timestamp("last") + F.expr("interval 23 hours 59 minutes")).alias("occurred_end"),
                    "place", text.alias("text"), conf.alias("self_conf"))


def aggregate_damage(points: DataFrame, bbox: tuple[float, float, float, float], order: str | None = "seq") -> DataFrame:
    """Damage points -> one raw observation per cell and date, with the worst grade and the last named city."""
    p = points.where(F.col("damage").isin(list(DAMAGE_GRADE)) & in_bbox(F.col("lon"), F.col("lat"), bbox) & (F.col("date") != ""))
    city = F.nullif(F.col("city"), F.lit(""))
    name = F.max(city) if order is None else F.max_by(city, F.when(city.isNotNull(), F.col(order)))
    g = with_cell(p, "lon", "lat").where("cell_id is not null").groupBy("cell_id", "date").agg(F.count(F.lit(1)).alias("n"), F.max("damage").alias("worst"), name.alias("city"))
    label = dims.choose(F.col("worst"), {k: v[0] for k, v in DAMAGE_GRADE.items()}, "")
    text = F.concat(F.lit("UNOSAT satellite assessment: "), F.col("n").cast("string"), F.lit(" damaged structure(s) ("), label, F.lit(") in "), F.coalesce("city", F.lit("the area")), F.lit(" as of "), "date")
    return g.select("cell_id", "date", "n", "worst", "city", F.lit("building_damaged").alias("obs_type"), F.to_timestamp("date").alias("occurred_start"),
                    (F.to_timestamp("date") + F.expr("interval 23 hours 59 minutes")).alias("occurred_end"), text.alias("text"),
                    dims.choose(F.col("worst"), {k: v[1] for k, v in DAMAGE_GRADE.items()}, 0.0).alias("self_conf"))
