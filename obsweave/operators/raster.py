"""Change detection on pixel tables.

A tile catalogue has one row per tile (tile_id, w, s, e, n, acq_start, acq_end, height, width, scale_m);
pixels are rows (tile_id, band, row, col, value). Footprints are processed together, and pixel
clusters are connected components over neighbour edges, so no image has to fit one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsweave.operators import ingest as I
from obsweave.operators.components import with_component
from obsweave.session import cut

# Fixed values of the detectors.
SAR_THRESHOLD_DB, SAR_SATURATE_DB, SAR_MIN_PX = 4.0, 12.0, 4
FLOOD_DELTA, BURN_DELTA, OPTICAL_MIN_PX, OPTICAL_SATURATE = 0.20, 0.25, 6, 0.55
LAND_FLOOR_DB, MIN_WATER_PX, CFAR_SIGMA, CFAR_MARGIN_DB, VESSEL_MIN_PX, VESSEL_MAX_PX, VESSEL_SATURATE_DB = -28.0, 50, 4.0, 8.0, 2, 300, 10.0
CLOUD_CLASSES, WATER_CLASS = [3, 8, 9, 10, 11], 6
CONFIDENCE_BANDS = [("very_high", 0.85, 0.95), ("high", 0.70, 0.85), ("medium", 0.50, 0.65), ("low", 0.30, 0.45), ("very_low", 0.00, 0.20)]
PX = ["footprint", "row", "col"]


# ------------------------------------------------------------------ stacks
def fetch_window(tiles: DataFrame, start: str, end: str, equals: dict | None = None, contains: dict | None = None, below: dict | None = None, cap: int | None = None) -> DataFrame:
    """Tiles of a date window that pass the filters; with ``cap`` only the first granules by time (a request's own limit)."""
    d = tiles.where((F.col("acq_start") >= F.lit(start).cast("timestamp")) & (F.col("acq_start") < F.lit(end).cast("timestamp")))
    for k, v in (equals or {}).items():
        d = d.where(F.col(k) == v)
    for k, v in (contains or {}).items():
        d = d.where(F.array_contains(k, v))
    for k, v in (below or {}).items():
        d = d.where(F.col(k) < v)
    return d if cap is None else d.orderBy("acq_start", "tile_id").limit(cap)


def group_footprint(tiles: DataFrame) -> DataFrame:
    """Tiles with their footprint, before/after half and the stack's dates; stacks of one tile drop out.

    Tiles whose shape differs from the first tile of their half are left out of its composite, and a
    stack whose halves differ in shape drops out.
    """
    fp = F.concat_ws(",", *[F.round(F.col(c), 6).cast("string") for c in ("w", "s", "e", "n")])
    d = tiles.withColumn("footprint", fp)
    w = Window.partitionBy("footprint").orderBy("acq_start", "tile_id")
    d = d.withColumn("i", F.row_number().over(w)).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("footprint"))).where("k >= 2")
    d = d.withColumn("mid", F.greatest(F.lit(1), F.floor(F.col("k") / 2)))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = (d.withColumn("half", F.when(F.col("i") <= F.col("mid"), "before").otherwise("after"))
         .withColumn("shape", F.struct("height", "width")))
    own = Window.partitionBy("footprint", "half").orderBy("acq_start", "tile_id")
    d = (d.withColumn("of_half", F.first("shape").over(own)).withColumn("of_stack", F.first("shape").over(whole)).withColumn("of_last", F.last("of_half").over(whole))
         .withColumn("stack_start", F.last("acq_start").over(whole)).withColumn("stack_end", F.last("acq_end").over(whole))
         .withColumn("change_from", F.max(F.when(F.col("i") == F.col("mid"), F.col("acq_start"))).over(Window.partitionBy("footprint"))))
    return d.where("shape = of_half and of_stack = of_last").drop("shape", "of_half", "of_stack", "of_last", "mid", "k", "i")


def composite(pixels: DataFrame, stacks: DataFrame) -> DataFrame:
    """Mean per footprint, half, band and pixel (combined in the map tasks)."""
    return pixels.join(stacks.select("tile_id", "footprint", "half"), "tile_id").groupBy("footprint", "half", "band", "row", "col").agg(F.avg("value").alias("value"))


def composite_median_masked(pixels: DataFrame, stacks: DataFrame, water_value: float) -> DataFrame:
    """Median per pixel without cloudy looks; water pixels are set to a constant. ``scl`` is the scene class."""
    d = pixels.where(~F.col("scl").isin(CLOUD_CLASSES)).withColumn("value", F.when(F.col("scl") == WATER_CLASS, F.lit(water_value)).otherwise(F.col("value")))
    return d.join(stacks.select("tile_id", "footprint", "half"), "tile_id").groupBy("footprint", "half", "band", "row", "col").agg(
        F.expr("percentile(value, 0.5)").alias("value"))  # a group holds one value per look at the pixel


def halves(comp: DataFrame, bands: list[str] | None = None) -> DataFrame:
    """One row per pixel with ``before_<band>`` and ``after_<band>``; pixels missing in a half drop."""
    bands = bands or ["value"]
    col = lambda h, b: F.max(F.when((F.col("half") == h) & (F.col("band") == b), F.col("value"))).alias(f"{h}_{b}")
    return comp.groupBy(*PX).agg(*[col(h, b) for h in ("before", "after") for b in bands])


def normalized_difference(a: Column, b: Column) -> Column:
    return F.when(a + b == 0, F.lit(0.0)).otherwise((a - b) / F.nullif(a + b, F.lit(0.0)))


# ------------------------------------------------------------------ clusters
def label_clusters(mask: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Masked pixels with ``label``, the component of pixels that touch by a side (per footprint)."""
    keys = keys or PX
    fp = keys[:-2]
    m = cut(mask.withColumn("px", F.concat_ws(":", *[F.col(c).cast("string") for c in fp], F.lpad(F.col("row").cast("string"), 9, "0"), F.lpad(F.col("col").cast("string"), 9, "0"))))
    base = m.select(*keys, "px")
    right = base.withColumn("col", F.col("col") - 1).withColumnRenamed("px", "b")
    down = base.withColumn("row", F.col("row") - 1).withColumnRenamed("px", "b")
    edges = base.join(right, keys).select(F.col("px").alias("a"), "b").unionByName(base.join(down, keys).select(F.col("px").alias("a"), "b"))
    return with_component(m, edges, "px", "label").drop("px")


def magnitude_confidence(mag: Column, thr: Column | float, sat: Column | float) -> Column:
    thr, sat = (v if isinstance(v, Column) else F.lit(float(v)) for v in (thr, sat))
    part = (mag - thr) / F.nullif(sat - thr, F.lit(0.0))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), part))
    return F.when(sat <= thr, F.lit(0.6)).when(part.isNotNull(), F.round(0.3 + 0.6 * share, 4))


def cluster_stats(labelled: DataFrame, footprints: DataFrame, min_px: int, max_px: int | None = None) -> DataFrame:
    """Clusters with size, magnitude, mean change and centre. ``footprints``: bounds, height and width per footprint."""
    c = labelled.groupBy("footprint", "label").agg(
        F.count(F.lit(1)).alias("n_pixels"), F.avg(F.abs("delta")).alias("magnitude"), F.avg("delta").alias("mean_delta"), F.max("delta").alias("peak"),
        F.avg("row").alias("r"), F.avg("col").alias("c"))
    size = F.col("n_pixels") >= min_px if max_px is None else F.col("n_pixels").between(min_px, max_px)
    d = c.where(size).join(footprints, "footprint")
    return d.withColumn("lon", F.col("w") + (F.col("c") + 0.5) * (F.col("e") - F.col("w")) / F.col("width")).withColumn(
        "lat", F.col("n") - (F.col("r") + 0.5) * (F.col("n") - F.col("s")) / F.col("height")).drop("r", "c")


def footprints_of(stacks: DataFrame) -> DataFrame:
    one = ["w", "s", "e", "n", "height", "width", "scale_m", "stack_start", "stack_end", "change_from"]
    return stacks.groupBy("footprint").agg(*[F.max(c).alias(c) for c in one])


def sar_logratio(pixels: DataFrame, tiles: DataFrame, band: str = "VV", threshold: float = SAR_THRESHOLD_DB, min_px: int = SAR_MIN_PX) -> DataFrame:
    """Clusters where the mean backscatter changed by the threshold or more, either way."""
    stacks = cut(group_footprint(tiles))
    h = halves(composite(pixels.where(F.col("band") == band), stacks), [band])
    delta = F.col(f"after_{band}") - F.col(f"before_{band}")
    mask = h.withColumn("delta", delta).where(F.abs("delta") >= threshold).select(*PX, "delta")
    c = cluster_stats(label_clusters(mask), footprints_of(stacks), min_px)
    way = F.when(F.col("mean_delta") > 0, "increase").otherwise("decrease")
    return (c.withColumn("direction", way).withColumn("self_conf", magnitude_confidence(F.col("magnitude"), threshold, SAR_SATURATE_DB))
            .withColumn("text", F.concat(F.lit("SAR backscatter "), way, F.lit(" of "), F.format_string("%.1f", "magnitude"), F.lit(" dB over ~"),
                                         F.col("n_pixels").cast("string"), F.lit(f" px (Sentinel-1 {band} log-ratio change)")))
            .withColumn("obs_type", F.lit("building_damaged")).withColumn("detector", F.lit("sar_logratio")))


def optical_index(pixels: DataFrame, tiles: DataFrame, green: str = "B3", nir: str = "B8", swir: str = "B12") -> DataFrame:
    """Flood (water index up) and burn (burn ratio down) clusters."""
    stacks = cut(group_footprint(tiles))
    h = halves(composite(pixels.where(F.col("band").isin(green, nir, swir)), stacks), [green, nir, swir])
    nd = lambda half, a: normalized_difference(F.col(f"{half}_{a}"), F.col(f"{half}_{swir}"))
    d = cut(h.select(*PX, (nd("after", green) - nd("before", green)).alias("flood"), (nd("before", nir) - nd("after", nir)).alias("burn_scar")))
    out = None
    for kind, name, thr, words in (("flood", "MNDWI", FLOOD_DELTA, "new surface water"), ("burn_scar", "dNBR", BURN_DELTA, "vegetation burn signature")):
        mask = d.where(F.col(kind) >= thr).select(*PX, F.col(kind).alias("delta"))
        c = cluster_stats(label_clusters(mask), footprints_of(stacks), OPTICAL_MIN_PX)
        c = (c.withColumn("obs_type", F.lit(kind)).withColumn("self_conf", magnitude_confidence(F.col("mean_delta"), thr, thr + OPTICAL_SATURATE))
             .withColumn("text", F.concat(F.lit(f"Sentinel-2 {name} change of "), F.format_string("%.2f", "mean_delta"), F.lit(" over ~"),
                                          F.col("n_pixels").cast("string"), F.lit(f" px ({words})"))).withColumn("detector", F.lit("optical_index")))
        out = c if out is None else out.unionByName(c)
    return out


def exact_median(df: DataFrame, key: str, value: str, bins: int = 1024) -> DataFrame:
    """(key, median): exact, by refining histograms, without ordering a key's values.

    Each round counts the values of every key in ``bins`` equal parts of the range that still holds its
    middle (combined in the map tasks), with the least and greatest value of each part; the part that
    holds the middle is the next range. It ends when that part holds one value. Nulls do not count.
    """
    d = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_v"))
    whole = d.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("a"), F.max("_v").alias("b"))
    held = cut(whole.select("_key", F.posexplode(F.array(F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2))).alias("side", "rank"), "a", "b"))
    found = held.where("a = b")
    order = Window.partitionBy("_key", "side").orderBy("bin")   # at most ``bins`` rows
    while True:
        held = held.where("a < b")
        if held.isEmpty():
            break
        part = F.least(F.floor((F.col("_v") - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1))
        counts = (d.join(held, "_key").where("_v between a and b").groupBy("_key", "side", "rank", part.alias("bin"))
                  .agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("a"), F.max("_v").alias("b")))
        upto = counts.withColumn("upto", F.sum("n").over(order)).where("rank <= upto and rank > upto - n")
        held = cut(upto.select("_key", "side", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "a", "b"))
        found = found.unionByName(held.where("a = b"))
    return found.groupBy("_key").agg(F.avg("a").alias("median")).withColumnRenamed("_key", key)


def vessel_cfar(pixels: DataFrame, tiles: DataFrame, band: str = "VV") -> DataFrame:
    """Bright targets on water per tile, above a robust background threshold."""
    sea = cut(pixels.where((F.col("band") == band) & (F.col("value") > LAND_FLOOR_DB)).select("tile_id", "row", "col", "value"))
    enough = sea.groupBy("tile_id").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= MIN_WATER_PX).select("tile_id")
    sea = sea.join(enough, "tile_id", "left_semi")
    med = cut(exact_median(sea, "tile_id", "value"))
    dev = sea.join(med, "tile_id").withColumn("dev", F.abs(F.col("value") - F.col("median")))
    mad = exact_median(dev, "tile_id", "dev").withColumnRenamed("median", "mad")
    thr = med.join(mad, "tile_id").select("tile_id", F.col("median").alias("sea_median"), (F.col("median") + F.greatest(
        F.lit(CFAR_SIGMA * 1.4826) * F.col("mad"), F.lit(CFAR_MARGIN_DB))).alias("thr"))
    thr = cut(thr)
    mask = sea.join(thr, "tile_id").where("value >= thr").select(F.col("tile_id").cast("string").alias("footprint"), "row", "col", (F.col("value") - F.col("thr")).alias("delta"))
    fp = tiles.select(F.col("tile_id").cast("string").alias("footprint"), "w", "s", "e", "n", "height", "width", "scale_m", F.col("acq_start").alias("stack_start"),
                      F.col("acq_end").alias("stack_end"), F.col("acq_start").alias("change_from"))
    c = cluster_stats(label_clusters(mask), fp, VESSEL_MIN_PX, VESSEL_MAX_PX)
    return (c.withColumn("obs_type", F.lit("naval_transit")).withColumn("self_conf", magnitude_confidence(F.col("peak"), 0.0, VESSEL_SATURATE_DB))
            .withColumn("text", F.concat(F.lit("SAR bright target "), F.format_string("%.1f", "peak"), F.lit(" dB above sea clutter (~"), F.col("n_pixels").cast("string"),
                                         F.lit(f" px) — likely vessel (Sentinel-1 {band})"))).withColumn("detector", F.lit("sar_vessel")))


# ------------------------------------------------------------------ caching and hand-over
def quantize_confidence(c: Column) -> Column:
    """Representative value of the confidence band; null stays null."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    out = None
    for _name, low, rep in CONFIDENCE_BANDS:
        out = F.when(c.isNull(), F.lit(None)).when(s >= low, rep) if out is None else out.when(s >= low, rep)
    return out.otherwise(CONFIDENCE_BANDS[-1][2])


def tile_hash(granule: Column, data: Column) -> Column:
    return F.sha2(F.concat(F.encode(granule.cast("string"), "utf-8"), data.cast("binary")), 256)


def stack_hash(tiles: DataFrame, by: str = "footprint") -> DataFrame:
    """Order-free hash of each stack's tile hashes (a stack has one hash per acquisition)."""
    return tiles.groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("tile_hash")), ""), 256).alias("stack_hash"))


def detection_key(stack: Column, digest: str, detector: str) -> Column:
    return F.sha2(F.concat_ws("|", stack, F.lit(digest), F.lit(detector)), 256)


def coarsen_detections(detections: DataFrame, grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed detections with banded confidence and no coordinates, unplaced ones)."""
    d = I.with_point_cell(detections.withColumn("geom_precision_m", F.coalesce(F.col("scale_m").cast("double"), F.lit(500.0))), grid)
    d = d.withColumnRenamed("point_cell", "cell_id").withColumn("self_conf", quantize_confidence(F.col("self_conf")))
    gone = ["lon", "lat", "w", "s", "e", "n", "resolution"]
    return d.where("cell_id is not null").drop(*gone), d.where("cell_id is null").drop(*gone).withColumn("reason", F.lit("no_cell_resolve"))


def best_per_cell(detections: DataFrame) -> DataFrame:
    """Most confident detection per cell; the label settles ties."""
    cols = [c for c in detections.columns if c != "cell_id"]
    best = detections.groupBy("cell_id").agg(F.max_by(F.struct(*cols), F.struct("self_conf", F.col("n_pixels"), F.col("label"))).alias("b"))
    return best.select("cell_id", "b.*")


def cached_detect(keyed_tiles: DataFrame, cache: DataFrame, detect: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all detections, new rows for the cache). Only tiles whose ``cache_key`` is unknown are processed.

    ``detect`` maps tiles to detections with their ``cache_key``.
    """
    known = cache.select("cache_key").distinct()
    fresh = cut(detect(keyed_tiles.join(known, "cache_key", "left_anti")).select(*cache.columns))
    hits = cache.join(keyed_tiles.select("cache_key").distinct(), "cache_key", "left_semi")
    return hits.unionByName(fresh), fresh


def passthrough_detections(tiles: DataFrame) -> DataFrame:
    """Detections that come with the tiles."""
    return tiles.select("tile_id", "acq_start", "acq_end", F.explode("detections").alias("d")).select("tile_id", "acq_start", "acq_end", "d.*")


class DetectorRegistry:
    """Named detectors; a name is taken once."""

    def __init__(self) -> None:
        self._by_name: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, fn: Callable[..., DataFrame]) -> None:
        if name in self._by_name:
            raise ValueError(f"detector {name} is already registered")
        self._by_name[name] = fn

    def get(self, name: str) -> Callable[..., DataFrame]:
        return self._by_name[name]

    def names(self) -> list[str]:
        return sorted(self._by_name)


DETECTORS = DetectorRegistry()
for _n, _f in (("sar_logratio", sar_logratio), ("optical_index", optical_index), ("sar_vessel", vessel_cfar), ("passthrough", passthrough_detections)):
    DETECTORS.register(_n, _f)


def detections_to_observations(placed: DataFrame, source_id: str, theater: str) -> DataFrame:
    """Best detection per cell as an observation, without placing it again."""
    d = best_per_cell(placed).withColumn("source_id", F.lit(source_id)).withColumn("theater_id", F.lit(theater)).withColumn("modality", F.lit("imagery"))
    d = d.withColumn("occurred_start", F.col("stack_start")).withColumn("occurred_end", F.col("stack_end")).withColumn("place_id", F.lit(None).cast("long"))
    return I.with_identity(d)


