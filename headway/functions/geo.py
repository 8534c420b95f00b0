"""Geometry helpers as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius in metres used by every distance feature.
EARTH_RADIUS_M = 6_371_000.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_m(lat1, lon1, lat2, lon2, float32_coords: bool = False) -> Column:
    """Great-circle distance in metres (atan2 form). Null if any input is null.

    ``float32_coords`` rounds the inputs to single precision first, as the feeds that
    store coordinates as float32 do; the arithmetic itself always runs in double.
    """
    cols = [_c(lat1), _c(lon1), _c(lat2), _c(lon2)]
    if float32_coords:
        cols = [c.cast("float").cast("double") for c in cols]
    else:
        cols = [c.cast("double") for c in cols]
    la1, lo1, la2, lo2 = cols
    dphi = F.radians(la2 - la1)
    dlmb = F.radians(lo2 - lo1)
    a = F.pow(F.sin(dphi / 2.0), 2) + F.cos(F.radians(la1)) * F.cos(F.radians(la2)) * F.pow(F.sin(dlmb / 2.0), 2)
    # 1 - a can dip below zero by rounding for antipodal points
    c = 2.0 * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1.0 - a)))
    return F.lit(EARTH_RADIUS_M) * c


def repair_coord(raw) -> Column:
    """Coordinate repair for malformed strings: keep digits only and put the decimal
    point after the first two ('410082' -> 41.0082, '41.008.238' -> 41.008238).
    The sign is lost ('-41.5' -> 41.5); fewer than two digits -> null.
    Input must be read as a string so no float printing gets in the way.
    """
    digits = F.regexp_replace(_c(raw).cast("string"), r"[^0-9]", "")
    txt = F.concat(F.substring(digits, 1, 2), F.lit("."), F.substring(digits, 3, 1 << 20))
    return F.when(F.length(digits) >= 2, txt.try_cast("double"))
