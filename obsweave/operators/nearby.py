"""Equality keys for interval and distance joins, and salting of hot keys.

Pairs are wanted at different reaches (a persistent type looks months back, a transient one hours),
so rows carry a tier; a pair belongs to the larger tier of its two rows, and each tier has its own
bucket width. One side of the join stays narrow (the buckets its own extent touches), the other is
widened by the reach; with buckets two reaches wide that is about two buckets per axis.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsweave.session import cut

M_PER_DEG_LOW = 110000.0   # below the true length of a degree, so that reaches never fall short
HOT_BUCKET_ROWS = 4000
HOT_KEYS = 1 << 15         # hot keys, counted, up to which they are broadcast (a few MB)


def _pick(tier: Column, values: Sequence[float]) -> Column:
    return F.element_at(F.lit([float(v) for v in values]), tier + 1)


def time_keys(df: DataFrame, start: str, end: str, tier: str, reach_us: Sequence[float], wide: bool,
              any_tier: bool = True) -> DataFrame:
    """One row per (time_tier, time_bucket) touched. ``first_bucket`` lets the join keep a pair only
    in the first bucket that both sides touch (see `same_time`)."""
    d = df.withColumn("time_tier", F.explode(F.sequence(F.col(tier), F.lit(len(reach_us) - 1))) if any_tier else F.col(tier))
    reach = _pick(F.col("time_tier"), reach_us)
    lo, hi = (F.col(start) - reach, F.col(end) + reach) if wide else (F.col(start), F.col(end))
    first, last = F.floor(lo / (2 * reach)), F.floor(F.greatest(lo, hi) / (2 * reach))
    return d.withColumn("first_bucket", first).withColumn("time_bucket", F.explode(F.sequence(first, last)))


def same_time(a: str, b: str, tier_a: str, tier_b: str) -> Column:
    """Keeps a pair once: in its own tier and its first common bucket."""
    return ((F.col(f"{a}.time_tier") == F.greatest(F.col(f"{a}.{tier_a}"), F.col(f"{b}.{tier_b}")))
            & (F.col(f"{a}.time_bucket") == F.greatest(F.col(f"{a}.first_bucket"), F.col(f"{b}.first_bucket"))))


def space_keys(df: DataFrame, lon: str, lat: str, tier: str, reach_m: Sequence[float], wide: bool,
               any_tier: bool = True) -> DataFrame:
    """Lattice square(s) of each row per ``space_tier``; wide rows visit every square in reach.

    The longitude step follows the latitude row, so no global extent is needed. A narrow row sits in
    one square per tier, so a pair meets at most once per tier (see `same_space`).
    """
    last = F.lit(len(reach_m) - 1)
    d = df.withColumn("space_tier", F.explode(F.sequence(F.col(tier), last)) if any_tier else F.col(tier))
    reach = _pick(F.col("space_tier"), reach_m) * 1.1 / M_PER_DEG_LOW
    step = reach * 2

    def lon_factor(row: Column) -> Column:  # degrees of longitude per degree of latitude, at the far edge
        edge = F.least(F.greatest(F.abs(row), F.abs(row + 1)) * step, F.lit(89.0))
        return 1 / F.cos(F.radians(edge))

    own = F.floor(F.col(lat) / step)
    if not wide:
        return d.withColumn("lat_row", own).withColumn("lon_col", F.floor(F.col(lon) / (step * lon_factor(own))))
    d = d.withColumn("lat_row", F.explode(F.sequence(F.floor((F.col(lat) - reach) / step), F.floor((F.col(lat) + reach) / step))))
    width = step * lon_factor(F.col("lat_row"))
    span = reach * F.greatest(lon_factor(own), lon_factor(F.col("lat_row")))
    return d.withColumn("lon_col", F.explode(F.sequence(F.floor((F.col(lon) - span) / width),
                                                        F.floor((F.col(lon) + span) / width))))


def same_space(a: str, b: str, tier_a: str, tier_b: str) -> Column:
    return F.col(f"{a}.space_tier") == F.greatest(F.col(f"{a}.{tier_a}"), F.col(f"{b}.{tier_b}"))


SPACE_KEYS = ["space_tier", "lat_row", "lon_col"]
TIME_KEYS = ["time_tier", "time_bucket"]


def salted_sides(left: DataFrame, right: DataFrame, keys: list[str], spread: str,
                 hot_rows: int | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Split hot keys into a lattice of sub-keys: each side is cut into slices of about ``hot_rows`` rows, and
    every slice of one meets every slice of the other exactly once. A side that is not hot stays whole, so
    the other's rows are not copied for it."""
    hot_rows = hot_rows or HOT_BUCKET_ROWS
    zero = F.lit(0).cast("long")
    count = lambda df, a, b: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*keys, a.alias("_na"), b.alias("_nb"))
    sizes = count(left, F.col("_n"), zero).unionByName(count(right, zero, F.col("_n"))).groupBy(*keys).agg(F.sum("_na").alias("_na"), F.sum("_nb").alias("_nb"))
    slices = [F.greatest(F.lit(1), F.ceil(F.col(n) / hot_rows)).cast("int").alias(k) for n, k in (("_na", "_ka"), ("_nb", "_kb"))]
    hot = cut(sizes.where((F.col("_na") > 0) & (F.col("_nb") > 0) & (F.greatest("_na", "_nb") > hot_rows)).select(*keys, *slices))
    # each has thousands of rows, so the keys are few; while they are, the sides need not be dealt out to learn them
    hot = F.broadcast(hot) if hot.count() <= HOT_KEYS else hot

    def side(df: DataFrame, mine: str, other: str) -> DataFrame:
        d = df.join(hot, keys, "left")
        return (d.withColumn(f"_s{mine}", F.pmod(F.xxhash64(spread), F.coalesce(f"_k{mine}", F.lit(1))).cast("int"))
                .withColumn(f"_s{other}", F.explode(F.sequence(F.lit(0), F.coalesce(f"_k{other}", F.lit(1)) - 1))).drop("_ka", "_kb"))

    return side(left, "a", "b"), side(right, "b", "a"), [*keys, "_sa", "_sb"]
