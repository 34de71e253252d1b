"""Column functions over coordinates, boxes and rings (arrays of structs x, y)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def utm_zone(lon: Column, lat: Column, truncate: bool = False) -> Column:
    """Zone number with the two exception areas; truncate rounds degrees toward 0 rather than down."""
    deg = lon.cast("int") if truncate else F.floor(lon)
    plain = F.floor((deg + 180) / 6) + 1
    norway = (lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12)
    svalbard = (lat >= 72) & (lat < 84) & (lon >= 0) & (lon < 42)
    arctic = F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).otherwise(37)
    return F.when(norway, 32).when(svalbard, arctic).otherwise(plain).cast("int")


def hemisphere(lat: Column) -> Column:
    return F.when(lat > 0, "N").otherwise("S")


def to_utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing on the WGS 84 ellipsoid by the third-order series in the third flattening."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    k0, c = 0.9996, 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(c) * F.atanh(F.lit(c) * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    e, north = eta, xi
    for j, a in enumerate(alpha, 1):
        e = e + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(500000.0) + F.lit(k0 * radius) * e, F.when(lat < 0, 10000000.0).otherwise(0.0) + F.lit(k0 * radius) * north


def geo_forward(gt: tuple[float, ...], px: Column, py: Column) -> tuple[Column, Column]:
    """World position of a pixel: gt is (x0, dx, rx, y0, ry, dy)."""
    x0, dx, rx, y0, ry, dy = (F.lit(float(v)) for v in gt)
    return x0 + px * dx + py * rx, y0 + px * ry + py * dy


def geo_inverse(gt: tuple[float, ...], x: Column, y: Column) -> tuple[Column, Column]:
    """Pixel of a world position, for a transform without rotation."""
    return F.floor((x - F.lit(float(gt[0]))) / F.lit(float(gt[1]))), F.floor((y - F.lit(float(gt[3]))) / F.lit(float(gt[5])))


def box_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Area that two boxes (minx, miny, maxx, maxy) share; 0 where they only touch."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def following(ring: Column) -> Column:
    """The ring begun at its second point."""
    return F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, F.lit(1), F.lit(1)))


def signed_area(ring: Column) -> Column:
    """Positive for counter-clockwise rings."""
    cross = F.zip_with(ring, following(ring), lambda p, q: p.x * q.y - q.x * p.y)
    return F.aggregate(cross, F.lit(0.0), lambda a, v: a + v) / 2


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule by edges crossed to the right."""
    hit = F.zip_with(ring, following(ring), lambda p, q: F.when((p.y > y) != (q.y > y), (x < (q.x - p.x) * (y - p.y) / (q.y - p.y) + p.x).cast("int")).otherwise(0))
    return F.aggregate(hit, F.lit(0), lambda a, v: a + v) % 2 == 1


def edge_distance(ring: Column, x: Column, y: Column) -> Column:
    """Least distance of a point to the lines through a ring's edges: twice a triangle's area over its base."""
    d = F.zip_with(ring, following(ring), lambda p, q: F.abs((q.x - p.x) * (p.y - y) - (p.x - x) * (q.y - p.y)) / F.hypot(q.x - p.x, q.y - p.y))
    return F.array_min(d)


def shifted(ring: Column, dx: Column, dy: Column) -> Column:
    return F.transform(ring, lambda p: F.struct((p.x + dx).alias("x"), (p.y + dy).alias("y")))


def ring_bounds(ring: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def heron_squared(a: Column, b: Column, c: Column) -> Column:
    """Square of a triangle's area from its sides."""
    s = (a + b + c) / 2
    return s * (s - a) * (s - b) * (s - c)


def plane_z(a: Column, b: Column, c: Column, d: Column, x: Column, y: Column) -> Column:
    return F.try_divide(-(a * x + b * y + d), c)


def rotation(z: float, y: float, x: float) -> list[list[float]]:
    """Matrix of rotations about z, then y, then x."""
    (cz, sz), (cy, sy), (cx, sx) = ((math.cos(v), math.sin(v)) for v in (z, y, x))
    return [[cy * cz, -cy * sz, sy], [cx * sz + cz * sx * sy, cx * cz - sx * sy * sz, -cy * sx], [sx * sz - cx * cz * sy, cz * sx + cx * sy * sz, cx * cy]]


def rotated(m: list[list[float]], x: Column, y: Column, z: Column) -> tuple[Column, ...]:
    return tuple(F.lit(r[0]) * x + F.lit(r[1]) * y + F.lit(r[2]) * z for r in m)
