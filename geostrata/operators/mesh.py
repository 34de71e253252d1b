"""Burning polygons, lines and triangles into cells; parametric patches; walls; ring clean-up and clipping."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.functions.geometry import following


def cells_between(lo: Column, hi: Column) -> Column:
    """Cells whose centres (k + 0.5) lie in lo..hi; none where the range has no centre."""
    a, b = F.ceil(lo - 0.5), F.floor(hi - 0.5)
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))


def burn_edges(edges: DataFrame) -> DataFrame:
    """(id, row, col) of cells whose centres are inside polygons of edges (id, x0, y0, x1, y1), in cell units, by the even-odd rule.

    On a row of cells an edge turns over all cells whose centres are left of where it crosses. Turns at one cell are
    counted before any shuffle, so a row costs as many cells as it has, however many edges cross it.
    """
    c = F.col
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    e = edges.dropna(subset=["x0", "y0", "x1", "y1"]).where("y0 <> y1").withColumn("row", F.explode(cells_between(low, high)))
    y = c("row") + F.lit(0.5)
    e = e.where((c("y0") > y) != (c("y1") > y)).withColumn("x", (c("x1") - c("x0")) * (y - c("y0")) / (c("y1") - c("y0")) + c("x0"))
    # the first cell whose centre isn't left of the crossing; the difference may be rounded
    k = F.ceil(c("x") - 0.5)
    k = F.when(k + F.lit(0.5) < c("x"), k + 1).otherwise(k)
    turns = e.groupBy("id", "row", k.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    line = Window.partitionBy("id", "row").orderBy("k")
    runs = turns.withColumns({"after": F.lead("k").over(line), "r": F.row_number().over(line)}).where("r % 2 = 1")
    return runs.select("id", "row", F.explode(F.sequence(c("k"), c("after") - 1)).alias("col"))


def burn_rings(rings: DataFrame) -> DataFrame:
    """The same of rings (id, r)."""
    r = F.col("r")
    ends = F.zip_with(r, following(r), lambda p, q: F.struct(p.x.alias("x0"), p.y.alias("y0"), q.x.alias("x1"), q.y.alias("y1")))
    return burn_edges(rings.select("id", F.inline(ends)))


def burn_lines(lines: DataFrame) -> DataFrame:
    """(id, row, col) of cells on segments (id, x0, y0, x1, y1): one cell a step along the longer axis."""
    n = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    steps = lines.withColumn("n", F.ceil(n)).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    at = lambda a, b: F.floor(F.col(a) + F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0) * (F.col(b) - F.col(a)))
    return steps.select("id", at("y0", "y1").alias("row"), at("x0", "x1").alias("col")).distinct()


def barycentric(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Coordinates of a point in the triangle (ax, ay), (bx, by), (cx, cy); null for a flat triangle."""
    c = F.col
    det = (c("by") - c("cy")) * (c("ax") - c("cx")) + (c("cx") - c("bx")) * (c("ay") - c("cy"))
    u = F.try_divide((c("by") - c("cy")) * (x - c("cx")) + (c("cx") - c("bx")) * (y - c("cy")), det)
    v = F.try_divide((c("cy") - c("ay")) * (x - c("cx")) + (c("ax") - c("cx")) * (y - c("cy")), det)
    return u, v, 1 - u - v


def elevation(triangles: DataFrame, flat: bool = False) -> DataFrame:
    """(row, col, v): the highest triangle over each cell centre; flat: a triangle has the mean height of its corners."""
    c = F.col
    lo = lambda k: F.least(*[c(f"{t}{k}") for t in "abc"])
    hi = lambda k: F.greatest(*[c(f"{t}{k}") for t in "abc"])
    cells = triangles.withColumn("row", F.explode(cells_between(lo("y"), hi("y")))).withColumn("col", F.explode(cells_between(lo("x"), hi("x"))))
    u, v, w = barycentric(c("col") + F.lit(0.5), c("row") + F.lit(0.5))
    inside = cells.withColumns({"u": u, "v": v, "w": w}).where("u >= 0 and v >= 0 and w >= 0")
    z = (c("az") + c("bz") + c("cz")) / 3 if flat else c("u") * c("az") + c("v") * c("bz") + c("w") * c("cz")
    return inside.groupBy("row", "col").agg(F.max(z).alias("v"))


def sphere_patches(spheres: DataFrame, around: int = 20, up: int = 10) -> DataFrame:
    """(id, i, j, x, y, z) of vertices on spheres (id, x, y, z, radius), from the rim to the top."""
    spark = spheres.sparkSession
    i, j = spark.range(around).select(F.col("id").alias("i")), spark.range(up).select(F.col("id").alias("j"))
    g = spheres.crossJoin(F.broadcast(i.crossJoin(j)))
    theta, phi = F.col("i") * F.lit(2 * math.pi / around), F.col("j") * F.lit(math.pi / 2 / max(1, up - 1))
    r = F.col("radius")
    return g.select("id", "i", "j", (F.col("x") + r * F.cos(phi) * F.cos(theta)).alias("x"), (F.col("y") + r * F.cos(phi) * F.sin(theta)).alias("y"), (F.col("z") + r * F.sin(phi)).alias("z"))


def walls(rings: DataFrame) -> DataFrame:
    """(id, k, a, b, c, d): one quad an edge between a ring's lower vertices 0..n-1 and upper vertices n..2n-1."""
    n = F.size("r").cast("long")
    k = F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    q = rings.select("id", n.alias("n"), k.alias("k")).withColumn("m", (F.col("k") + 1) % F.col("n"))
    return q.select("id", "k", F.col("k").alias("a"), F.col("m").alias("b"), (F.col("m") + F.col("n")).alias("c"), (F.col("k") + F.col("n")).alias("d"))


def without_close_vertices(ring: Column, limit: float = 1e-6) -> Column:
    """The ring without points closer than the limit to their predecessor."""
    far = F.zip_with(ring, following(ring), lambda p, q: F.when(F.hypot(p.x - q.x, p.y - q.y) >= limit, q))
    return F.filter(far, lambda q: q.isNotNull())


def clip_half_plane(ring: Column, a: float, b: float, c: float) -> Column:
    """The part of a ring where a x + b y + c >= 0; exact for convex rings."""
    side = lambda p: F.lit(float(a)) * p.x + F.lit(float(b)) * p.y + F.lit(float(c))

    def edge(p: Column, q: Column) -> Column:
        s, t = side(p), side(q)
        u = F.try_divide(s, s - t)
        cut = F.struct((p.x + u * (q.x - p.x)).alias("x"), (p.y + u * (q.y - p.y)).alias("y"))
        keep = F.struct(q.x.alias("x"), q.y.alias("y"))
        none = F.array().cast("array<struct<x:double,y:double>>")
        return F.when((s >= 0) & (t >= 0), F.array(keep)).when((s >= 0) & (t < 0), F.array(cut)).when((s < 0) & (t >= 0), F.array(cut, keep)).otherwise(none)

    # the ring is bound once, so that clips can be chained without their expressions growing
    return F.transform(F.array(ring), lambda r: F.flatten(F.zip_with(r, following(r), edge)))[0]


def clip_box(rings: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Rings (id, r) clipped to a box; empty ones go."""
    for plane in ((1, 0, -x0), (-1, 0, x1), (0, 1, -y0), (0, -1, y1)):
        rings = rings.withColumn("r", clip_half_plane(F.col("r"), *plane)).where(F.size("r") > 0)
    return rings
