"""The 1 km grid, its static context per cell, and zonal aggregation of layers onto cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsweave import dims
from obsweave.functions.cells import with_cell, with_centroid
from obsweave.operators.polygons import covered_share, edges_on_cells, inner_points, line_edges, points_in_polygons, ring_edges, segment_meets_box

# Road ranks, surface words, river kinds.
ROAD_RANK = {"motorway": 1, "trunk": 2, "primary": 3, "secondary": 4, "tertiary": 5, "residential": 6, "track": 7, "path": 8}
UNPAVED = ["unpaved", "dirt", "ground", "gravel", "compacted", "fine_gravel", "earth", "mud", "sand"]
PAVED = ["paved", "asphalt", "concrete", "paving_stones", "sett", "cobblestone"]
WATERWAYS = ["river", "stream", "canal"]
BUILT_UP_CLASS = 50


def build_grid(spark: SparkSession, bbox: tuple[float, float, float, float], step: float = 0.01) -> DataFrame:
    """Cells met by a lattice of sample points; the lattice comes from integer indices."""
    w, s, e, n = bbox
    nx, ny = int(round((e - w) / step)) + 1, int(round((n - s) / step)) + 1
    # one row per latitude line, expanded in the tasks
    pts = spark.range(ny).select((s + F.col("id") * step).alias("lat"), F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("i"))
    d = with_cell(pts.select((w + F.col("i") * step).alias("lon"), "lat"), "lon", "lat").where("cell_id is not null")
    return with_centroid(d.select("cell_id").distinct())


def assign_local_seq(cells: DataFrame, admin: str = "admin_id") -> DataFrame:
    """1..n by cell id within each admin unit (cells are bounded by the unit's area)."""
    w = Window.partitionBy(F.coalesce(admin, F.lit("_unassigned"))).orderBy("cell_id")
    return cells.withColumn("local_seq", F.row_number().over(w))


def build_label(name: Column, seq: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    return F.concat(F.when(clean == "", "Unknown").otherwise(clean), F.lit("-"), seq.cast("string"))


# ------------------------------------------------------------------ polygons
def stamp_admin(cells: DataFrame, units: DataFrame, levels=(1, 2, 3)) -> DataFrame:
    """Cells (cell_id, lon, lat) with id and name of the unit around their centre, per level.

    Where units overlap, the lowest id is taken.
    """
    hits = points_in_polygons(cells, units).join(units.select("admin_id", "name", "level"), "admin_id")
    per = hits.groupBy("cell_id").agg(*[F.min(F.when(F.col("level") == lv, F.struct("admin_id", "name"))).alias(f"a{lv}") for lv in levels])
    d = cells.join(per, "cell_id", "left")
    for lv in levels:
        d = d.withColumn(f"admin{lv}_id", F.col(f"a{lv}.admin_id")).withColumn(f"admin{lv}_name", F.col(f"a{lv}.name")).drop(f"a{lv}")
    return d


def admin_link(stamped: DataFrame) -> DataFrame:
    """Deepest admin unit per cell."""
    return stamped.select("cell_id", F.coalesce("admin3_id", "admin2_id", "admin1_id").alias("admin_id"))


def derive_parents(child: DataFrame, parent: DataFrame) -> DataFrame:
    """(admin_id, parent_id): the parent around the child's representative point; null outside all.

    The point lies inside the child whatever its form (`polygons.inner_points`); of several parents the lowest id is taken.
    """
    p = inner_points(child).withColumnRenamed("admin_id", "child_id")
    hit = points_in_polygons(p, parent, "child_id").groupBy("child_id").agg(F.min("admin_id").alias("parent_id"))
    return child.select("admin_id").join(hit, F.col("admin_id") == F.col("child_id"), "left").select("admin_id", "parent_id")


def clip_to_aoi(units: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Units that meet a box: an edge in the box, or the box inside the unit."""
    w, s, e, n = (F.lit(float(v)) for v in bbox)
    by_edge = ring_edges(units, "admin_id").where(segment_meets_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), w, s, e, n)).select("admin_id")
    corner = units.sparkSession.range(1).select(F.lit("box").alias("k"), w.alias("lon"), s.alias("lat"))
    around = points_in_polygons(corner, units, "k").select("admin_id")
    return units.join(by_edge.unionByName(around).distinct(), "admin_id", "left_semi")


def lines_on_cells(lines: DataFrame, cells: DataFrame, keep: list[str]) -> DataFrame:
    """(cell_id, keep..) for each line that meets a cell box; ``vertices`` is array<struct<x, y>>."""
    return edges_on_cells(line_edges(lines, *keep), cells, keep)


# ------------------------------------------------------------------ layers
def landcover_zonal(pixels: DataFrame) -> DataFrame:
    """(cell_id, class_code) pixels -> dominant class, label and built-up share; 0 is no data."""
    n = pixels.where("class_code <> 0").groupBy("cell_id", "class_code").agg(F.count(F.lit(1)).alias("n"))
    d = n.groupBy("cell_id").agg(F.min_by("class_code", F.struct(-F.col("n"), F.col("class_code"))).alias("landcover_class"),
                                 F.round(F.sum(F.when(F.col("class_code") == BUILT_UP_CLASS, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("builtup_pct"))
    return d.withColumn("landcover_label", dims.choose(F.col("landcover_class"), dims.LANDCOVER_LABELS, "unknown"))


def slope_zonal(dem: DataFrame, spacing_m: float) -> DataFrame:
    """(cell_id, row, col, z) -> mean slope in degrees; differences are central inside, one-sided at edges."""
    def grad(along: str, across: str) -> Column:
        w = Window.partitionBy("cell_id", across).orderBy(along)
        a, b = F.lag("z").over(w), F.lead("z").over(w)
        return F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull(), b - F.col("z")).when(b.isNull(), F.col("z") - a).otherwise((b - a) / 2) / spacing_m

    d = dem.withColumn("gx", grad("col", "row")).withColumn("gy", grad("row", "col"))
    return d.groupBy("cell_id").agg(F.round(F.avg(F.degrees(F.atan(F.hypot("gx", "gy")))), 4).alias("slope_deg"))


def building_zonal(buildings: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell_id, building_count, building_share): footprints (building_id, rings) that meet each cell and the exact share they cover together.

    Cells without buildings have zeros. Overlapping footprints count once in the share; a part beyond the cell does not count.
    """
    return covered_share(buildings, cells)


def classify_surface(highway: Column, surface: Column) -> Column:
    return (F.when(surface.isin(UNPAVED), "unpaved").when(surface.isin(PAVED), "paved").when(highway.isin("track", "path"), "unpaved")
            .when(highway.isin([k for k in ROAD_RANK if k not in ("track", "path")]), "paved").otherwise("unknown"))


def road_zonal(hits: DataFrame) -> DataFrame:
    """(cell_id, road_id, highway, surface, bridge) hits -> best-ranked road with its surface, any bridge."""
    rank = dims.choose(F.col("highway"), ROAD_RANK, 99)
    best = F.min(F.struct(rank.alias("rank"), F.col("road_id").alias("id"), F.col("highway").alias("h"), F.col("surface").alias("s")))
    d = hits.groupBy("cell_id").agg(best.alias("b"), F.max(F.coalesce("bridge", F.lit(False))).alias("has_bridge"))
    return d.select("cell_id", F.col("b.h").alias("road_class"), classify_surface(F.col("b.h"), F.col("b.s")).alias("road_surface"), "has_bridge")


def river_zonal(hits: DataFrame) -> DataFrame:
    return hits.where(F.col("waterway").isin(WATERWAYS)).select("cell_id").distinct().withColumn("has_river", F.lit(True))


def classify_feature(tags: Column) -> Column:
    """(kind, subkind) of a tagged feature, first rule wins; null drops it."""
    t = lambda k: F.try_element_at(tags, F.lit(k))
    pair = lambda kind, sub: F.struct(F.lit(kind).alias("kind"), sub.alias("subkind"))
    return (F.when(t("waterway").isin(WATERWAYS), pair("water", t("waterway")))
            .when(t("natural") == "water", pair("water", F.lit("waterbody")))
            .when(t("landuse") == "forest", pair("forest", F.lit("forest")))
            .when(t("natural") == "wood", pair("forest", F.lit("wood")))
            .when(t("highway").isin("motorway", "trunk", "primary"), pair("road", t("highway")))
            .when(t("railway") == "rail", pair("rail", F.lit("rail")))
            .when(t("landuse").isin("residential", "industrial"), pair("builtup", t("landuse"))))


def load_features(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Classified features (feature_id, tags, lon, lat) with the cell of their point; unknown kinds drop."""
    d = df.withColumn("_k", classify_feature(F.col("tags"))).where("_k is not null")
    d = with_cell(d.withColumn("kind", F.col("_k.kind")).withColumn("subkind", F.col("_k.subkind")).drop("_k"), "lon", "lat")
    known = grid.select("cell_id").withColumn("_g", F.lit(True))
    return d.join(known, "cell_id", "left").withColumn("cell_id", F.when(F.col("_g"), F.col("cell_id"))).drop("_g", "lon", "lat")


def build_aliases(places: DataFrame, alternates: DataFrame, grid: DataFrame) -> DataFrame:
    """Name rows per place: the main English name, preferred, and alternates; cells only inside the grid."""
    cell = with_cell(places.select("place_id", "lon", "lat"), "lon", "lat").select("place_id", "cell_id").join(grid.select("cell_id"), "cell_id", "left_semi")
    main = places.select("place_id", F.col("name"), F.lit("en").alias("lang"), F.lit(True).alias("is_preferred"))
    alt = alternates.select("place_id", "name", "lang", F.coalesce("is_preferred", F.lit(False)).alias("is_preferred"))
    d = main.unionByName(alt).withColumn("name", F.trim("name")).where("name <> ''")
    return d.join(cell, "place_id", "left").withColumn("alias_id", F.xxhash64("place_id", "name", "lang"))


# ------------------------------------------------------------------ context
def build_cell_context(cells: DataFrame, *layers: DataFrame) -> DataFrame:
    """One row per cell with all layer columns; a cell missing from a layer keeps nulls."""
    d = cells
    for layer in layers:
        d = d.join(layer, "cell_id", "left")
    return d


def context_coverage(context: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n, pct, total) in one pass over the context."""
    one = context.agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(c) for c in fields])
    stack = ", ".join(f"'{c}', {c}" for c in fields)
    return one.selectExpr("total", f"stack({len(fields)}, {stack}) as (field, n)").withColumn(
        "pct", F.round(F.when(F.col("total") > 0, 100.0 * F.col("n") / F.col("total")).otherwise(0.0), 1))


def verify_substrate(context: DataFrame) -> DataFrame:
    if context.isEmpty():
        raise ValueError("the grid has no cells")
    return context


def terrain_profile(area_cells: DataFrame, context: DataFrame) -> DataFrame:
    """Per area: cells, mean built-up share (null as 0), unpaved share of surfaced roads, land-cover shares."""
    d = area_cells.join(context.select("cell_id", "landcover_label", "builtup_pct", "road_surface"), "cell_id")
    per = d.groupBy("area", "landcover_label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("builtup_pct", F.lit(0.0))).alias("bu"),
        F.count_if(F.col("road_surface") == "unpaved").alias("unpaved"), F.count_if(F.col("road_surface").isin("paved", "unpaved")).alias("surfaced"))
    known = F.sum(F.when(F.col("landcover_label").isNotNull(), F.col("n")))
    a = per.groupBy("area").agg(F.sum("n").alias("n_cells"), (F.sum("bu") / F.sum("n")).alias("builtup_pct"), F.sum("unpaved").alias("u"), F.sum("surfaced").alias("s"),
                                known.alias("known"), F.array_sort(F.collect_list(F.when(F.col("landcover_label").isNotNull(), F.struct((-F.col("n")).alias("neg"), "landcover_label")))).alias("lc"))
    share = F.transform("lc", lambda x: F.struct(x["landcover_label"].alias("label"), F.round(-x["neg"] / F.col("known"), 4).alias("share")))
    return a.select("area", "n_cells", F.round("builtup_pct", 4).alias("builtup_pct"),
                    F.round(F.when(F.col("s") > 0, F.col("u") / F.nullif(F.col("s"), F.lit(0))).otherwise(0.0), 4).alias("road_unpaved_share"), share.alias("landcover"))


def latest_control(control: DataFrame) -> DataFrame:
    """Newest control row per cell; the side settles equal dates."""
    return control.groupBy("cell_id").agg(F.max(F.struct("as_of", "side")).alias("m")).select("cell_id", "m.as_of", "m.side")


def control_as_of(settlements: DataFrame, changes: DataFrame, dates: DataFrame) -> DataFrame:
    """Side of each settlement at each asked date: the last change up to it, else the default side.

    ``dates`` is (settlement, as_of); a null date asks for the latest. Changes are merged with the
    questions and carried forward, so no date meets all changes of its settlement.
    """
    far = F.to_date(F.lit("9999-12-31"))
    q = dates.select("settlement", "as_of", F.coalesce("as_of", far).alias("d"), F.lit(1).alias("is_q"), F.lit(None).cast("string").alias("side"))
    c = changes.select("settlement", F.lit(None).cast("date").alias("as_of"), F.col("date").alias("d"), F.lit(0).alias("is_q"), "side")
    w = Window.partitionBy("settlement").orderBy("d", "is_q", "side").rowsBetween(Window.unboundedPreceding, 0)
    d = q.unionByName(c).withColumn("last_side", F.last("side", ignorenulls=True).over(w)).where("is_q = 1")
    return d.join(settlements.select("settlement", "default_side"), "settlement").select("settlement", "as_of", F.coalesce("last_side", "default_side").alias("side"))


def geo_phrase(landcover_label: Column, road_class: Column, road_surface: Column) -> Column:
    """Short description of a cell; null when nothing is known."""
    names = {"trees": "woodland", "built-up": "a built-up area", "bare": "bare ground"}  # fixed wording
    ground = F.concat(F.lit("on "), dims.choose(landcover_label, names, landcover_label))
    road = F.when((road_surface == "unpaved") & road_class.isNotNull(), F.when(
        road_class.isin("track", "path"), F.lit("along an unpaved track")).otherwise(F.concat(F.lit("along an unpaved "), road_class, F.lit(" road")))).when(
        road_class.isin("motorway", "trunk", "primary", "secondary"), F.concat(F.lit("near a "), road_class, F.lit(" road")))
    return F.nullif(F.concat_ws(" · ", ground, road), F.lit(""))


