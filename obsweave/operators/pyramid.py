"""Nearest place by a pyramid of squares with branch and bound.

Places fall into nested squares; each square keeps the bounds of its places. A search goes down from the
whole globe: of the squares it still holds, those whose nearest possible place lies beyond the farthest
possible place of another one are dropped, and the rest is split. What is left at the bottom is a few
squares, whose places are measured. No search looks at all places, and many places at one point are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsweave.functions.timegeo import haversine_km
from obsweave.session import cut

BASE = 0.02     # degrees; the smallest squares
LEVELS = 7      # each level is four times as wide; 0.02 * 4**7 = 327.68 degrees, two squares for the globe
#: Levels whose squares are so few on the whole globe that they are broadcast: at 1.28 degrees 282 * 141.
FEW = 3
EARTH_KM = 6371.0


def _square(df: DataFrame) -> DataFrame:
    return df.withColumn("i", F.floor((F.col("lon") + 180) / BASE)).withColumn("j", F.floor((F.col("lat") + 90) / BASE))


def _lift(c: str, levels: int) -> Column:
    return F.shiftright(c, 2 * levels)


def _levels(places: DataFrame) -> list[DataFrame]:
    """Squares of every level with the bounds of their places, lowest first."""
    out = [cut(places.groupBy("i", "j").agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n")))]
    for _ in range(LEVELS):
        up = out[-1].groupBy(_lift("i", 1).alias("i"), _lift("j", 1).alias("j"))
        out.append(cut(up.agg(F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n"))))
    return out


def _reach() -> tuple[Column, Column]:
    """Least and greatest distance in km from (lon, lat) to a place within bounds: safe on both sides."""
    lon, lat, w, s, e, n = (F.col(c) for c in ("lon", "lat", "w", "s", "e", "n"))
    turn = lambda a, b: F.least(F.abs(a - b), 360 - F.abs(a - b))
    beside = F.when(lon.between(w, e), F.lit(0.0)).otherwise(F.least(turn(lon, w), turn(lon, e)))
    above = F.greatest(s - lat, lat - n, F.lit(0.0))
    # no nearer than the parallel, nor than the meridian
    low = EARTH_KM * F.greatest(F.radians(above), F.asin(F.cos(F.radians(lat)) * F.sin(F.radians(F.least(beside, F.lit(90.0))))))
    # along the meridian and then along a parallel of the bounds
    far_lat = F.greatest(F.abs(lat - s), F.abs(lat - n))
    far_lon = F.least(F.greatest(turn(lon, w), turn(lon, e)) + (e - w), F.lit(180.0))
    widest = F.when((s <= 0) & (n >= 0), F.lit(0.0)).otherwise(F.least(F.abs(s), F.abs(n)))
    high = EARTH_KM * (F.radians(far_lat) + F.radians(far_lon) * F.cos(F.radians(widest)))
    return low * (1 - 1e-9) - 1e-9, high * (1 + 1e-9) + 1e-9


def nearest(points: DataFrame, places: DataFrame, key: str = "cell_id") -> DataFrame:
    """(key, name, km): the nearest of the places (name, lon, lat) for each point (key, lon, lat).

    Equal distances go to the lesser name. Points and places without a position take no part; without
    places the result is empty.
    """
    known = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    spots = cut(_square(places.where(known).groupBy("lon", "lat").agg(F.min("name").alias("name"))))
    levels = _levels(spots)
    # the globe is two squares of the highest level side by side
    top = F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))
    held = points.where(known).select(key, "lon", "lat").distinct().withColumn("i", top).withColumn("j", F.lit(0).cast("long"))
    best = Window.partitionBy(key)
    low, high = _reach()
    for level in range(LEVELS, -1, -1):
        squares = levels[level]
        if level < LEVELS:
            squares = squares.select("*", _lift("i", 1).alias("pi"), _lift("j", 1).alias("pj"))
            held = held.select(key, "lon", "lat", F.col("i").alias("pi"), F.col("j").alias("pj"))
        on = ["i", "j"] if level == LEVELS else ["pi", "pj"]
        met = held.join(F.broadcast(squares) if level >= FEW else squares, on)
        met = met.withColumn("low", low).withColumn("bound", F.min(high).over(best)).where("low <= bound").select(key, "lon", "lat", "i", "j")
        held = met if level >= FEW else cut(met)
    own = spots.select("i", "j", "name", F.col("lon").alias("x"), F.col("lat").alias("y"))
    km = haversine_km(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"))
    return held.join(own, ["i", "j"]).groupBy(key).agg(F.min(F.struct(km.alias("km"), "name")).alias("m")).select(key, "m.name", "m.km")
