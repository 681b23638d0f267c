"""1 km grid-cell codec: MGRS squares with two plus two digits, as Spark expressions.

The transverse Mercator series is the third-flattening (Krueger) form to n^3 on WGS-84. Each step
is its own projection so that no sub-expression is repeated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS-84, UTM scale, letter sets of the grid.
A, INV_F, K0 = 6378137.0, 298.257223563, 0.9996
COLUMN_LETTERS = {1: "ABCDEFGH", 2: "JKLMNPQR", 0: "STUVWXYZ"}
ROW_LETTERS = "ABCDEFGHJKLMNPQRSTUV"
BAND_LETTERS = "CDEFGHJKLMNPQRSTUVWX"
M_PER_DEG = 111320.0
CELL_PATTERN = "^[0-9]{1,2}[A-Z]{3}[0-9]{4}$"

_F = 1 / INV_F
_N = _F / (2 - _F)
RECT = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
E2C = 2 * math.sqrt(_N) / (1 + _N)
ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240]
BETA = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480]
DELTA = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15]


def _series(coef: list[float], outer, inner, xi: Column, eta: Column) -> Column:
    total = None
    for j, c in enumerate(coef, start=1):
        term = F.lit(c) * outer(xi * (2 * j)) * inner(eta * (2 * j))
        total = term if total is None else total + term
    return total


def _zone(lon: Column, lat: Column) -> Column:
    base = F.least((F.floor((lon + 180) / 6) + 1), F.lit(60)).cast("int")
    svalbard = F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).otherwise(37)
    return (F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), F.lit(32))
            .when((lat >= 72) & (lon >= 0) & (lon < 42), svalbard)
            .otherwise(base))


def with_cell(df: DataFrame, lon: str, lat: str, out: str = "cell_id") -> DataFrame:
    """Add the 1 km cell id of (lon, lat); null when the point is missing or outside 80S-84N."""
    keep = df.columns
    ok = (F.col(lon).isNotNull() & F.col(lat).isNotNull() & F.col(lat).between(-80, 84)
          & F.col(lon).between(-180, 180))
    d = df.withColumn("_x", F.when(ok, F.col(lon))).withColumn("_y", F.when(ok, F.col(lat)))
    d = d.withColumn("_zone", _zone(F.col("_x"), F.col("_y")))
    d = (d.withColumn("_sin", F.sin(F.radians("_y")))
         .withColumn("_lam", F.radians(F.col("_x") - (F.col("_zone") * 6 - 183))))
    d = d.withColumn("_t", F.sinh(F.atanh(F.col("_sin")) - E2C * F.atanh(E2C * F.col("_sin"))))
    d = (d.withColumn("_xi", F.atan2(F.col("_t"), F.cos("_lam")))
         .withColumn("_eta", F.atanh(F.sin("_lam") / F.sqrt(1 + F.col("_t") * F.col("_t")))))
    d = (d.withColumn("_e", 500000 + K0 * RECT * (F.col("_eta") + _series(ALPHA, F.cos, F.sinh, F.col("_xi"), F.col("_eta"))))
         .withColumn("_n", K0 * RECT * (F.col("_xi") + _series(ALPHA, F.sin, F.cosh, F.col("_xi"), F.col("_eta")))))
    d = d.withColumn("_n", F.when(F.col("_n") < 0, F.col("_n") + 10000000).otherwise(F.col("_n")))
    d = (d.withColumn("_ek", F.floor(F.col("_e") / 1000).cast("int"))
         .withColumn("_nk", F.floor(F.col("_n") / 1000).cast("int")))
    col_no = F.floor(F.col("_ek") / 100).cast("int")
    row_no = ((F.floor(F.col("_nk") / 100) + F.when(F.col("_zone") % 2 == 0, 5).otherwise(0)) % 20).cast("int")
    letters = (F.when(F.col("_zone") % 3 == 1, F.lit(COLUMN_LETTERS[1]))
               .when(F.col("_zone") % 3 == 2, F.lit(COLUMN_LETTERS[2])).otherwise(F.lit(COLUMN_LETTERS[0])))
    band = F.least(F.floor((F.col("_y") + 80) / 8), F.lit(19)).cast("int")
    code = F.concat(
        F.col("_zone").cast("string"),
        F.substring(F.lit(BAND_LETTERS), band + 1, F.lit(1)),
        F.substring(letters, col_no, F.lit(1)),
        F.substring(F.lit(ROW_LETTERS), row_no + 1, F.lit(1)),
        F.lpad((F.col("_ek") % 100).cast("string"), 2, "0"),
        F.lpad((F.col("_nk") % 100).cast("string"), 2, "0"))
    # A one-element explode keeps filters on the cell above the codec: pushed through the projections
    # they would copy the whole expression at every step.
    return d.select(*[c for c in keep if c != out], F.explode(F.array(code)).alias(out))


def is_valid_cell(cell: Column) -> Column:
    return F.coalesce(cell.rlike(CELL_PATTERN), F.lit(False))


def with_centroid(df: DataFrame, cell: str = "cell_id", prefix: str = "") -> DataFrame:
    """Add south-west corner, box steps and centre (degrees) of each cell id.

    The box spans a fixed 1000/111320 degrees of latitude from the corner and the matching
    longitude step. Call it on distinct cells and join the result.
    """
    keep = df.columns
    c = F.col(cell)
    valid = is_valid_cell(c)
    zlen = F.length(c) - 7
    d = df.withColumn("_zone", F.when(valid, F.substring(c, F.lit(1), zlen).cast("int")))
    d = (d.withColumn("_band", F.instr(F.lit(BAND_LETTERS), F.substring(c, zlen + 1, F.lit(1))) - 1)
         .withColumn("_col", F.when(F.col("_zone") % 3 == 1, F.instr(F.lit(COLUMN_LETTERS[1]), F.substring(c, zlen + 2, F.lit(1))))
                     .when(F.col("_zone") % 3 == 2, F.instr(F.lit(COLUMN_LETTERS[2]), F.substring(c, zlen + 2, F.lit(1))))
                     .otherwise(F.instr(F.lit(COLUMN_LETTERS[0]), F.substring(c, zlen + 2, F.lit(1)))))
         .withColumn("_row", (F.instr(F.lit(ROW_LETTERS), F.substring(c, zlen + 3, F.lit(1))) - 1
                              + F.when(F.col("_zone") % 2 == 0, 15).otherwise(0)) % 20))
    d = (d.withColumn("_e", F.col("_col") * 100000.0 + F.substring(c, zlen + 4, F.lit(2)).cast("int") * 1000.0)
         .withColumn("_n0", F.col("_row") * 100000.0 + F.substring(c, zlen + 6, F.lit(2)).cast("int") * 1000.0)
         # northing of the band's lower edge on the central meridian, to pick the 2000 km cycle
         .withColumn("_floor", F.radians(F.col("_band") * 8.0 - 80.0)))
    d = d.withColumn("_base", K0 * RECT * _meridian_arc(F.col("_floor")) + F.when(F.col("_band") < 10, 10000000.0).otherwise(0.0))
    d = d.withColumn("_n", F.col("_n0") + 2000000.0 * F.ceil((F.col("_base") - 100000.0 - F.col("_n0")) / 2000000.0))
    d = (d.withColumn("_xi", (F.col("_n") - F.when(F.col("_band") < 10, 10000000.0).otherwise(0.0)) / (K0 * RECT))
         .withColumn("_eta", (F.col("_e") - 500000.0) / (K0 * RECT)))
    d = (d.withColumn("_xp", F.col("_xi") - _series(BETA, F.sin, F.cosh, F.col("_xi"), F.col("_eta")))
         .withColumn("_ep", F.col("_eta") - _series(BETA, F.cos, F.sinh, F.col("_xi"), F.col("_eta"))))
    d = d.withColumn("_chi", F.asin(F.sin("_xp") / F.cosh("_ep")))
    chi = F.col("_chi")
    phi = chi + sum((F.lit(c_) * F.sin(chi * (2 * j)) for j, c_ in enumerate(DELTA, start=1)), F.lit(0.0))
    lam = F.atan2(F.sinh("_ep"), F.cos("_xp"))
    d = (d.withColumn(prefix + "sw_lat", F.degrees(phi))
         .withColumn(prefix + "sw_lon", F.degrees(lam) + (F.col("_zone") * 6 - 183)))
    d = (d.withColumn(prefix + "step_lat", F.when(valid, F.lit(1000 / M_PER_DEG)))
         .withColumn(prefix + "step_lon", 1000 / (M_PER_DEG * F.cos(F.radians(prefix + "sw_lat")))))
    d = (d.withColumn(prefix + "lon", F.col(prefix + "sw_lon") + F.col(prefix + "step_lon") / 2)
         .withColumn(prefix + "lat", F.col(prefix + "sw_lat") + F.col(prefix + "step_lat") / 2))
    new = [prefix + k for k in ("sw_lon", "sw_lat", "step_lon", "step_lat", "lon", "lat")]
    box = F.struct(*[F.col(k).alias(k) for k in new])
    return d.select(*[k for k in keep if k not in new], F.inline(F.array(box)))  # keeps filters above, as in with_cell


def _meridian_arc(phi: Column) -> Column:
    """Rectifying latitude by its n-series (enough to place a 2000 km cycle)."""
    return (phi - F.lit(1.5 * _N) * F.sin(phi * 2) + F.lit(15 / 16 * _N**2) * F.sin(phi * 4))


def cell_dimension(df: DataFrame, cell: str = "cell_id") -> DataFrame:
    """One row per distinct valid cell with its centre and box."""
    return with_centroid(df.select(cell).where(is_valid_cell(F.col(cell))).distinct(), cell)
