"""Reference dimensions: fixed values that results depend on, and their Spark forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Event types, modalities, type compatibility, blocking radii/windows, land-cover rules, source
# families and reliabilities, thresholds, weights and severities that results must agree with.

EVENT_TYPES = [
    "strike", "airstrike", "artillery_fire", "missile_launch", "explosion", "fire",
    "troop_move", "armor_move", "convoy", "crossing",
    "naval_transit", "naval_engagement", "naval_mine",
    "bridge_damaged", "bridge_destroyed", "road_blocked", "utility_damaged",
    "civilian_displacement", "humanitarian_delivery", "hospital_event",
    "checkpoint_established", "checkpoint_removed", "building_damaged", "crater",
    "flood", "burn_scar", "installation_change", "other",
]
MODALITIES = ["text", "thermal", "imagery", "ais", "adsb", "seismic"]

TYPE_COMPAT = {
    "strike": {"airstrike": 0.8, "artillery_fire": 0.7, "explosion": 0.7, "fire": 0.4,
               "missile_launch": 0.6, "other": 0.3},
    "airstrike": {"missile_launch": 0.6, "explosion": 0.6, "fire": 0.3, "other": 0.3},
    "artillery_fire": {"explosion": 0.8, "fire": 0.3, "other": 0.3},
    "explosion": {"fire": 0.5, "other": 0.3},
    "fire": {"utility_damaged": 0.4, "other": 0.2},
    "troop_move": {"armor_move": 0.7, "convoy": 0.6, "crossing": 0.5, "other": 0.3},
    "naval_transit": {"naval_engagement": 0.6, "naval_mine": 0.4, "other": 0.2},
    "building_damaged": {"strike": 0.7, "airstrike": 0.7, "artillery_fire": 0.6,
                         "explosion": 0.7, "bridge_damaged": 0.5, "other": 0.3},
    "crater": {"strike": 0.7, "artillery_fire": 0.7, "airstrike": 0.6, "explosion": 0.7,
               "missile_launch": 0.5, "other": 0.3},
    "flood": {"utility_damaged": 0.3, "other": 0.2},
    "burn_scar": {"fire": 0.8, "airstrike": 0.4, "explosion": 0.4, "other": 0.3},
    "installation_change": {"troop_move": 0.4, "armor_move": 0.4, "convoy": 0.3, "other": 0.3},
}
SAME_TYPE, CROSS_TYPE = 1.0, 0.1

BLOCK_PARAMS = {  # type -> (radius in metres, window in hours)
    "strike": (2000, 6), "airstrike": (3000, 4), "artillery_fire": (2000, 4),
    "explosion": (1500, 3), "fire": (1000, 2), "troop_move": (10000, 24),
    "armor_move": (8000, 12), "convoy": (5000, 8), "naval_transit": (25000, 12),
    "building_damaged": (1500, 720), "crater": (1500, 720), "flood": (5000, 72),
    "burn_scar": (3000, 48), "installation_change": (3000, 72),
}
BLOCK_DEFAULT = (5000, 12)
PERSISTENT_MIN_H = 48

LANDCOVER_IMPLAUSIBLE = {  # type -> (land-cover codes, multiplier)
    "naval_transit": ([40, 10, 30, 20], 0.2), "naval_engagement": ([40, 10, 30, 20], 0.2),
    "naval_mine": ([40, 10, 30, 20], 0.2), "troop_move": ([80], 0.3), "convoy": ([80], 0.3),
    "building_damaged": ([80], 0.5), "crater": ([80], 0.6),
}
LANDCOVER_LABELS = {
    10: "trees", 20: "shrubland", 30: "grassland", 40: "cropland", 50: "built-up", 60: "bare",
    70: "snow-ice", 80: "water", 90: "wetland", 95: "mangroves", 100: "moss-lichen",
}

SOURCES = [  # source, family, label, modality, reliability
    ("ucdp_ged_bulk", "ucdp", "UCDP Georeferenced Event Database (bulk)", "text", 1.0),
    ("gdelt_v2", "gdelt", "GDELT Event Database v2", "text", 0.6),
    ("acled_api", "acled", "ACLED API", "text", 0.9),
    ("firms_viirs_snpp", "nasa_firms", "NASA FIRMS VIIRS SNPP active fire", "thermal", 0.85),
    ("firms_viirs_noaa20", "nasa_firms", "NASA FIRMS VIIRS NOAA-20 active fire", "thermal", 0.85),
    ("firms_modis", "nasa_modis", "NASA FIRMS MODIS active fire", "thermal", 0.75),
    ("sentinel1_sar_logratio", "copernicus_sar", "Sentinel-1 SAR amplitude log-ratio change", "imagery", 0.8),
    ("sentinel1_sar_vessel", "copernicus_sar", "Sentinel-1 SAR vessel detection", "imagery", 0.8),
    ("sentinel2_optical_index", "copernicus_optical", "Sentinel-2 spectral-index change", "imagery", 0.75),
    ("sentinel1_sar_deepcd", "copernicus_sar", "Sentinel-1 SAR deep change model", "imagery", 0.85),
    ("unosat", "unosat", "UNOSAT / UNITAR satellite damage assessment", "imagery", 1.0),
]
FALLBACK_RELIABILITY = {
    "ucdp_ged": 1.0, "firms_viirs": 0.85, "firms_modis": 0.75, "acled": 0.9, "gdelt": 0.6,
}
DEFAULT_RELIABILITY, RELIABILITY_CAP = 0.7, 0.95
FIRE_SENSORS = {  # feed name -> (source, family)
    "VIIRS_SNPP_NRT": ("firms_viirs_snpp", "nasa_firms"),
    "VIIRS_NOAA20_NRT": ("firms_viirs_noaa20", "nasa_firms"),
    "MODIS_NRT": ("firms_modis", "nasa_modis"),
}

TAU_HIGH, TAU_LOW = 0.82, 0.38
BAND_HIGH_MIN, BAND_HIGH_FAMILIES, BAND_MEDIUM_MIN, BAND_LOW_MIN = 0.85, 2, 0.65, 0.45
W_GEO, W_TIME, W_TEXT, W_TYPE = 1.0, 1.0, 0.6, 1.0
SIGMA_K, TAU_TIME_S, ALPHA_TEXT = 1.5, 6 * 3600.0, 0.7
TOPONYM_BONUS, NUMBER_BONUS = 0.30, 0.05
BANDS = ["High", "Medium", "Low", "Rumored"]

SEVERITY = {
    "missile_launch": 0.95, "bridge_destroyed": 0.95, "airstrike": 0.90, "strike": 0.85,
    "naval_engagement": 0.85, "building_damaged": 0.80, "hospital_event": 0.85,
    "civilian_displacement": 0.80, "bridge_damaged": 0.75, "artillery_fire": 0.75,
    "explosion": 0.75, "crater": 0.70, "utility_damaged": 0.70, "armor_move": 0.65,
    "troop_move": 0.60, "convoy": 0.60, "flood": 0.65, "crossing": 0.55, "naval_mine": 0.70,
    "naval_transit": 0.45, "road_blocked": 0.50, "checkpoint_established": 0.45,
    "checkpoint_removed": 0.45, "burn_scar": 0.45, "installation_change": 0.65, "fire": 0.40,
    "humanitarian_delivery": 0.30, "other": 0.30,
}
DEFAULT_SEVERITY = 0.50

VERSIONS = {"prompt": "v1", "model": "qwen2.5-3b-v1+qwen2.5-14b-v1+qwen2.5-14b-v1",
            "schema": "v1", "embedding": "minilm-l6-v2-384d-v1"}
GATE_MIN, ADJUDICATOR_MIN = 0.72, 0.68
HIGH_SALIENCE = ["bridge_damaged", "bridge_destroyed", "utility_damaged", "missile_launch",
                 "naval_engagement", "airstrike"]

THEATERS = {  # theater -> (label, west, south, east, north)
    "ua_donbas": ("Ukraine — Donbas + Zaporizhzhia", 36.0, 46.8, 39.5, 49.5),
    "black_sea": ("Black Sea — Crimea + naval theater", 32.0, 44.0, 37.0, 46.3),
    "delhi": ("Delhi NCT + Yamuna floodplain", 76.8, 28.3, 77.5, 29.0),
    "hormuz": ("Strait of Hormuz", 55.5, 25.8, 59.0, 27.5),
}
# ---------------------------------------------------------------- end of fixed values

_UNKNOWN = len(EVENT_TYPES)


def compat_value(a: str, b: str) -> float:
    if a == b:
        return SAME_TYPE
    return TYPE_COMPAT.get(a, {}).get(b, TYPE_COMPAT.get(b, {}).get(a, CROSS_TYPE))


def block_params(t: str) -> tuple[int, int]:
    return BLOCK_PARAMS.get(t, BLOCK_DEFAULT)


def choose(col: Column, table: dict, default) -> Column:
    """A small constant lookup as one CASE expression, kept inside generated code."""
    out = None
    by_value: dict = {}
    for k, v in table.items():
        by_value.setdefault(v, []).append(k)
    for v, keys in by_value.items():
        cond = col.isin(keys)
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    d = default if isinstance(default, Column) else F.lit(default)
    return d if out is None else out.otherwise(d)


def type_index(t: Column) -> Column:
    """Position of the type in the taxonomy; unknown types share the last slot."""
    return F.coalesce(F.nullif(F.array_position(F.lit(EVENT_TYPES), t), F.lit(0)),
                      F.lit(_UNKNOWN + 1)).cast("int")


def compat_by_index(ta: Column, tb: Column, same: Column) -> Column:
    """Compatibility by taxonomy position: one constant-array access per pair."""
    names = EVENT_TYPES + ["\0"]
    flat = [compat_value(x, y) if x != y else CROSS_TYPE for x in names for y in names]
    pos = (ta - 1) * F.lit(len(names)) + tb
    return F.when(same, F.lit(SAME_TYPE)).otherwise(F.element_at(F.lit(flat), pos.cast("int")))


def type_compat(a: Column, b: Column) -> Column:
    return compat_by_index(type_index(a), type_index(b), a == b)


def block_radius_m(t: Column) -> Column:
    return choose(t, {k: float(v[0]) for k, v in BLOCK_PARAMS.items()}, float(BLOCK_DEFAULT[0]))


def block_window_s(t: Column) -> Column:
    return choose(t, {k: v[1] * 3600 for k, v in BLOCK_PARAMS.items()}, BLOCK_DEFAULT[1] * 3600)


def is_persistent(t: Column) -> Column:
    return block_window_s(t) >= PERSISTENT_MIN_H * 3600


def time_tau_s(wa: Column, wb: Column) -> Column:
    """Decay constant of a pair from its two block windows."""
    widest = F.greatest(wa, wb)
    return F.when(widest >= PERSISTENT_MIN_H * 3600, widest.cast("double")).otherwise(F.lit(TAU_TIME_S))


def landcover_multiplier(t: Column, code: Column, rules: dict | None = None) -> Column:
    """1 when unknown or plausible; rules hold implausible codes, or required ones."""
    rules = rules or {k: {"implausible": c, "factor": f} for k, (c, f) in LANDCOVER_IMPLAUSIBLE.items()}
    out = F.when(code.isNull(), F.lit(1.0))
    for name, r in rules.items():
        if "required" in r:
            out = out.when((t == name) & ~code.isin(r["required"]), F.lit(float(r["factor"])))
        else:
            out = out.when((t == name) & code.isin(r["implausible"]), F.lit(float(r["factor"])))
    return out.otherwise(F.lit(1.0))


def family(source: Column) -> Column:
    return choose(source, {s[0]: s[1] for s in SOURCES}, source)


def reliability(source: Column) -> Column:
    table = {**FALLBACK_RELIABILITY, **{s[0]: s[4] for s in SOURCES}}
    return choose(source, {k: min(v, RELIABILITY_CAP) for k, v in table.items()}, DEFAULT_RELIABILITY)


def severity(t: Column) -> Column:
    return choose(t, SEVERITY, DEFAULT_SEVERITY)


# ------------------------------------------------------------- the same as tables
def load_reference_dims(spark: SparkSession) -> dict[str, DataFrame]:
    """Reference dimensions as DataFrames; each has at most a few hundred rows by construction."""
    types = [(t, *[float(x) for x in block_params(t)], t in BLOCK_PARAMS and block_params(t)[1] >= PERSISTENT_MIN_H,
              SEVERITY.get(t, DEFAULT_SEVERITY)) for t in EVENT_TYPES]
    compat = [(a, b, compat_value(a, b)) for a in EVENT_TYPES for b in EVENT_TYPES]
    rules = [(t, codes, f) for t, (codes, f) in LANDCOVER_IMPLAUSIBLE.items()]
    return {
        "types": spark.createDataFrame(
            types, "event_type string, radius_m double, window_hours double, persistent boolean, severity double"),
        "type_compat": spark.createDataFrame(compat, "type_a string, type_b string, compat double"),
        "landcover_rules": spark.createDataFrame(rules, "event_type string, codes array<int>, factor double"),
        "sources": spark.createDataFrame(
            SOURCES, "source_id string, family_id string, label string, modality string, reliability double"),
        "theaters": spark.createDataFrame(
            [(k, *v) for k, v in THEATERS.items()],
            "theater_id string, label string, west double, south double, east double, north double"),
    }


def load_dims_from_config(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Reference dimensions from a JSON document of row arrays, one key per dimension."""
    doc = spark.read.json(path, multiLine=True)
    return {c: doc.select(F.explode(c).alias("r")).select("r.*") for c in doc.columns}
