"""Output boundary: no precise coordinates, no persons, cell geometry only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsweave.functions.cells import with_centroid
from obsweave.operators.grid import geo_phrase

# Column names that would leak a position, and entity kinds that must not appear.
PRECISE_NAMES = ["lon", "lat", "longitude", "latitude", "precise_geom", "exact_geom", "exact_lon", "exact_lat", "x", "y", "easting", "northing"]
PERSON_KINDS = ["person", "individual", "people"]
KIND_COLUMNS = ["kind", "entity_kind", "entity_type"]
POLYGON_MODALITIES: list[str] = []  # every modality shows the centre; callers may ask for boxes


class BoundaryError(ValueError):
    pass


def assert_no_precise_coords(df: DataFrame) -> DataFrame:
    """Fails if a precise column holds any value; one aggregation over the suspect columns only."""
    bad = [c for c in df.columns if c.lower() in PRECISE_NAMES]
    if bad:
        row = df.agg(*[F.count(c).alias(c) for c in bad]).first()
        leaks = [c for c in bad if row[c]]
        if leaks:
            raise BoundaryError(f"precise coordinates in {leaks}")
    return df


def assert_no_person(df: DataFrame) -> DataFrame:
    for c in (c for c in df.columns if c.lower() in KIND_COLUMNS):
        if not df.where(F.lower(F.col(c).cast("string")).isin(PERSON_KINDS)).isEmpty():
            raise BoundaryError(f"person entity in {c}")
    return df


def cell_geometry(mode: Column) -> Column:
    """GeoJSON text of a cell with `with_centroid` columns: its centre, or its box for area-like data."""
    r = lambda c: F.round(c, 6)
    w, s = r(F.col("sw_lon")), r(F.col("sw_lat"))
    e, n = r(F.col("sw_lon") + F.col("step_lon")), r(F.col("sw_lat") + F.col("step_lat"))
    ring = F.array(*[F.array(x, y) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))])
    poly = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(r(F.col("lon")), r(F.col("lat"))).alias("coordinates")))
    return F.when(mode == "polygon", poly).otherwise(point)


def geometry_mode(modality: Column) -> Column:
    return F.when(modality.isin(POLYGON_MODALITIES), "polygon").otherwise("point") if POLYGON_MODALITIES else F.lit("point")


def coarsen(df: DataFrame, centroids: DataFrame, nearest: DataFrame | None = None, context: DataFrame | None = None, mode: Column | None = None) -> DataFrame:
    """Events, cells or records ready to leave: checked, with cell geometry, place label and phrase.

    ``centroids`` has one row per cell; the cell geometry is made there, once per cell.
    """
    assert_no_person(assert_no_precise_coords(df))
    geo = with_centroid(centroids.select("cell_id")) if "sw_lon" not in centroids.columns else centroids
    g = geo.select("cell_id", cell_geometry(F.lit("point")).alias("_pt"), cell_geometry(F.lit("polygon")).alias("_pg"))
    m = mode if mode is not None else geometry_mode(F.col("modality")) if "modality" in df.columns else F.lit("point")
    d = df.join(g, "cell_id", "left").withColumn("geometry", F.when(m == "polygon", F.col("_pg")).otherwise(F.col("_pt"))).drop("_pt", "_pg")
    if nearest is not None:
        d = d.join(nearest.select("cell_id", F.col("label").alias("place_label"), "distance_km"), "cell_id", "left")
    if context is not None:
        c = context.select("cell_id", geo_phrase(F.col("landcover_label"), F.col("road_class"), F.col("road_surface")).alias("phrase"))
        d = d.join(c, "cell_id", "left")
    return d
