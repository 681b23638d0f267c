"""Distance, interval and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_M) -> Column:
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))
    # least() passes over nulls: a missing position has no distance
    return F.when(a.isNotNull(), 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return haversine_m(lon1, lat1, lon2, lat2, 6371.0)


def cell_distance_m(cell_a: Column, cell_b: Column, lon1, lat1, lon2, lat2) -> Column:
    return F.when(cell_a == cell_b, F.lit(0.0)).otherwise(haversine_m(lon1, lat1, lon2, lat2))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def interval_overlap_ratio(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared span over total span of two intervals in microseconds; 0 when disjoint."""
    inter = F.least(e1, e2) - F.greatest(s1, s2)
    union = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(inter <= 0, F.lit(0.0)).otherwise(inter / union)


def interval_gap_s(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Seconds between two intervals in microseconds; 0 when they meet or overlap."""
    return F.greatest(F.lit(0), s2 - e1, s1 - e2) / F.lit(1e6)


def in_bbox(lon: Column, lat: Column, bbox: tuple[float, float, float, float]) -> Column:
    w, s, e, n = bbox
    return lon.between(w, e) & lat.between(s, n)


DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss"]


def parse_date_multi(col: Column) -> Column:
    """ISO text first, then the listed formats; zone-less values are UTC; bad text is null."""
    c = F.trim(col.cast("string"))
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), c.try_cast("timestamp"))
    return F.coalesce(iso, *[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS])


def parse_acq_time(date: Column, hhmm: Column) -> Column:
    """Date plus HHMM (possibly unpadded) in UTC; bad values are null."""
    t = F.coalesce(hhmm.cast("string"), F.lit("0"))
    t = F.when(F.length(t) < 4, F.lpad(t, 4, "0")).otherwise(t)
    hh, mm = F.substring(t, F.lit(1), F.length(t) - 2), F.substring(t, F.length(t) - 1, F.lit(2))
    return F.when(date.isNotNull() & t.rlike(r"^\d{3,4}$"),
                  F.try_to_timestamp(F.concat(F.trim(date.cast("string")), F.lit(" "), F.lpad(hh, 2, "0"), F.lit(":"), mm),
                                     F.lit("yyyy-MM-dd HH:mm")))


def hour_bucket(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH")
