"""Column functions over band values: indices, normalisation, stretches, radiometry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ndvi(nir: Column, red: Column) -> Column:
    """Null where both are 0."""
    return F.try_divide(nir - red, nir + red)


def ndvi_byte(nir: Column, red: Column) -> Column:
    """Index with a small term in the divisor, clamped to 0..1, as 0..255."""
    return 255 * F.least(F.greatest((nir - red) / (nir + red + F.lit(1e-7)), F.lit(0.0)), F.lit(1.0))


def vndvi(red: Column, green: Column, blue: Column) -> Column:
    """Vegetation index of visible bands; null unless all are positive. Exponents are fixed values."""
    v = F.lit(0.5268) * F.pow(red, F.lit(-0.1294)) * F.pow(green, F.lit(0.3389)) * F.pow(blue, F.lit(-0.3118))
    return F.when((red > 0) & (green > 0) & (blue > 0), v)


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def rescale(c: Column, lo: Column, hi: Column, to: tuple[float, float]) -> Column:
    """Affine map of lo..hi to a range; a constant input gives the middle."""
    a, b = to
    return F.when(hi > lo, F.lit(a) + (c - lo) / (hi - lo) * F.lit(b - a)).otherwise(F.lit((a + b) / 2))


def z_clip(c: Column, mean: Column, std: Column, limit: float = 4.0) -> Column:
    """Standard score, clipped; 0 for no variance."""
    return F.when(std > 0, clamp((c - mean) / std, -limit, limit)).otherwise(F.lit(0.0))


def byte_stretch(c: Column, lo: Column, hi: Column, first: int = 1) -> Column:
    """Linear stretch of lo..hi to first..255, truncated; 0 is for no data where first is 1."""
    return F.floor(F.lit(float(first)) + F.least(F.greatest(F.try_divide(c - lo, hi - lo), F.lit(0.0)), F.lit(1.0)) * F.lit(255.0 - first)).cast("int")


def julian_date(ts: Column) -> Column:
    """Julian date of a timestamp (Gregorian calendar)."""
    y, m = F.year(ts), F.month(ts)
    yy, mm = F.when(m <= 2, y - 1).otherwise(y), F.when(m <= 2, m + 12).otherwise(m)
    day = F.dayofmonth(ts) + (F.hour(ts) + (F.minute(ts) + F.second(ts) / F.lit(60.0)) / F.lit(60.0)) / F.lit(24.0)
    century = F.floor(yy / 100)
    return F.floor(F.lit(365.25) * (yy + 4716)) + F.floor(F.lit(30.6001) * (mm + 1)) + day + (2 - century + F.floor(century / 4)) - F.lit(1524.5)


def earth_sun_distance(jd: Column) -> Column:
    g = (F.lit(357.529) + F.lit(0.98560028) * (jd - F.lit(2451545.0))) * F.lit(math.pi / 180)
    return F.lit(1.00014) - F.lit(0.01671) * F.cos(g) - F.lit(0.00014) * F.cos(2 * g)


def radiance(dn: Column, gain: Column, offset: Column, abs_cal: Column, bandwidth: Column) -> Column:
    return gain * dn * (abs_cal / bandwidth) + offset


def reflectance(radiance_: Column, distance: Column, irradiance: Column, sun_elevation_deg: Column) -> Column:
    """Top-of-atmosphere reflectance, from the sun's elevation."""
    theta = (F.lit(90.0) - sun_elevation_deg) * F.lit(math.pi / 180)
    return radiance_ * distance * distance * F.lit(math.pi) / (irradiance * F.cos(theta))


def band_roles(n: int) -> dict[str, int]:
    """Which band (from 1) is which, by the number of bands."""
    roles = {8: (2, 3, 5, 7), 4: (1, 2, 3, 4)}
    if n not in roles:
        raise ValueError(f"no roles are known for {n} bands")
    return dict(zip(("blue", "green", "red", "nir"), roles[n]))
