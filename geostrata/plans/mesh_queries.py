"""Queries over burned shapes, patches, walls, band layouts and packings."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from geostrata import fixtures as fx
from geostrata.functions import geometry as geo
from geostrata.operators import mesh, overlay
from geostrata.plans.raster_queries import rounded
from geostrata.plans.registry import query
from geostrata.plans.vector_queries import RING, SHOELACE, ring_vertices, rings
from geostrata.session import table

c = F.col
CONTAINS = "list_sum(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN (r[i].y > y) <> (r[i % len(r) + 1].y > y) AND x < (r[i % len(r) + 1].x - r[i].x) * (y - r[i].y) / (r[i % len(r) + 1].y - r[i].y) + r[i].x THEN 1 ELSE 0 END)) % 2 = 1"


@query(f"""WITH {RING}, cell AS (SELECT a AS "row", b AS col, b + 0.5::DOUBLE AS x, a + 0.5::DOUBLE AS y FROM range(-12, 102) p(a), range(0, 98) q(b)) SELECT id, "row", col FROM ring, cell WHERE {CONTAINS}""")
def polygon_burn(spark, d):
    return mesh.burn_edges(overlay.edges_of(ring_vertices(spark, d)))


LINES = "ln AS (SELECT s_suppkey AS id, (s_suppkey % 50)::DOUBLE AS x0, (s_suppkey % 31)::DOUBLE AS y0, (s_suppkey * 7 % 64)::DOUBLE AS x1, (s_suppkey * 3 % 40)::DOUBLE AS y1 FROM supplier), n AS (SELECT *, ceil(greatest(abs(x1 - x0), abs(y1 - y0)))::BIGINT AS n FROM ln)"


@query(f"""WITH {LINES} SELECT DISTINCT id, floor(y0 + CASE WHEN n > 0 THEN k / n::DOUBLE ELSE 0 END * (y1 - y0))::BIGINT AS "row", floor(x0 + CASE WHEN n > 0 THEN k / n::DOUBLE ELSE 0 END * (x1 - x0))::BIGINT AS col FROM n, LATERAL (SELECT unnest(range(0, n + 1)) AS k)""")
def line_burn(spark, d):
    k = c("s_suppkey")
    dbl = lambda x, n: x.cast("double").alias(n)
    return mesh.burn_lines(table(spark, d, "supplier").select(k.alias("id"), dbl(k % 50, "x0"), dbl(k % 31, "y0"), dbl(k * 7 % 64, "x1"), dbl(k * 3 % 40, "y1")))


TRI = "tri AS (SELECT vec_id AS id, 40 + 30 * embedding[1]::DOUBLE AS ax, 40 + 30 * embedding[2]::DOUBLE AS ay, embedding[3]::DOUBLE AS az, 40 + 30 * embedding[4]::DOUBLE AS bx, 40 + 30 * embedding[5]::DOUBLE AS \"by\", embedding[6]::DOUBLE AS bz, 40 + 30 * embedding[7]::DOUBLE AS cx, 40 + 30 * embedding[8]::DOUBLE AS cy, embedding[9]::DOUBLE AS cz FROM embeddings)"


def triangles(spark, d):
    e = lambda k: c("embedding")[k].cast("double")
    cols = [v.alias(f"{t}{n}") for i, t in enumerate("abc") for v, n in ((40 + 30 * e(3 * i), "x"), (40 + 30 * e(3 * i + 1), "y"), (e(3 * i + 2), "z"))]
    return table(spark, d, "embeddings").select(c("vec_id").alias("id"), *cols)


@query(f"""WITH {TRI}, cell AS (SELECT a AS "row", b AS col, b + 0.5::DOUBLE AS x, a + 0.5::DOUBLE AS y FROM range(-40, 140) p(a), range(-40, 140) q(b)),
j AS (SELECT "row", col, az, bz, cz, (("by" - cy) * (x - cx) + (cx - bx) * (y - cy)) / (("by" - cy) * (ax - cx) + (cx - bx) * (ay - cy)) AS u, ((cy - ay) * (x - cx) + (ax - cx) * (y - cy)) / (("by" - cy) * (ax - cx) + (cx - bx) * (ay - cy)) AS v
FROM tri JOIN cell ON x BETWEEN least(ax, bx, cx) AND greatest(ax, bx, cx) AND y BETWEEN least(ay, "by", cy) AND greatest(ay, "by", cy)) SELECT "row", col, round(max(u * az + v * bz + (1 - u - v) * cz), 6) AS v FROM j WHERE u >= 0 AND v >= 0 AND 1 - u - v >= 0 GROUP BY 1, 2""")
def mesh_elevation(spark, d):
    return rounded(mesh.elevation(triangles(spark, d)), "v")


@query(f"""WITH {fx.VEC_SQL} SELECT id, i, j, round(x + 2 * cos(j * {math.pi / 2 / 9!r}::DOUBLE) * cos(i * {2 * math.pi / 20!r}::DOUBLE), 6) AS x, round(y + 2 * cos(j * {math.pi / 2 / 9!r}::DOUBLE) * sin(i * {2 * math.pi / 20!r}::DOUBLE), 6) AS y, round(z + 2 * sin(j * {math.pi / 2 / 9!r}::DOUBLE), 6) AS z FROM vec, range(0, 20) a(i), range(0, 10) b(j)""")
def sphere_patch_mesh(spark, d):
    s = fx.vec(spark, d).withColumn("radius", F.lit(2.0))
    return rounded(mesh.sphere_patches(s), "x", "y", "z")


@query(f"WITH {RING} SELECT id, k, k AS a, (k + 1) % len(r) AS b, (k + 1) % len(r) + len(r) AS c, k + len(r) AS d FROM ring, LATERAL (SELECT unnest(range(0, len(r))) AS k)")
def prism_walls(spark, d):
    return mesh.walls(rings(spark, d))


@query(f"WITH {RING}, q AS (SELECT id, list_filter(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN sqrt((r[i].x - r[i % len(r) + 1].x) ** 2 + (r[i].y - r[i % len(r) + 1].y) ** 2) >= 20 THEN r[i % len(r) + 1] END), lambda p: p IS NOT NULL) AS r FROM ring) SELECT id, len(r)::INTEGER AS n, round(coalesce({SHOELACE}, 0), 6) AS area FROM q")
def close_vertex_removal(spark, d):
    r = rings(spark, d).withColumn("r", mesh.without_close_vertices(c("r"), 20))
    return r.select("id", F.size("r").alias("n"), F.round(geo.signed_area(c("r")), 6).alias("area"))


@query("WITH t AS (SELECT c_custkey AS id, (c_custkey % 40)::DOUBLE AS x, (c_custkey % 23)::DOUBLE AS y FROM customer) SELECT id, round(greatest(0, least(x + 10, 30) - greatest(x, 5)) * greatest(0, least(y + 10, 20) - greatest(y, 5)), 6) AS area FROM t WHERE least(x + 10, 30) > greatest(x, 5) AND least(y + 10, 20) > greatest(y, 5)")
def convex_clip_area(spark, d):
    x, y = (c("c_custkey") % 40).cast("double"), (c("c_custkey") % 23).cast("double")
    p = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    boxes = table(spark, d, "customer").select(c("c_custkey").alias("id"), F.array(p(F.lit(0.0), F.lit(0.0)), p(F.lit(10.0), F.lit(0.0)), p(F.lit(10.0), F.lit(10.0)), p(F.lit(0.0), F.lit(10.0))).alias("r"))
    return mesh.clip_box(boxes, 5, 5, 30, 20).select("id", F.round(F.abs(geo.signed_area(c("r"))), 6).alias("area")).where("area > 0")


@query(f"WITH {fx.BANDS_SQL} SELECT pid, round(blue * (blue + 2 * green + nir) / (blue + green + red + nir), 6) AS blue, round(red * (blue + 2 * green + nir) / (blue + green + red + nir), 6) AS red FROM bands")
def pansharpen_brovey(spark, d):
    """Bands scaled by a panchromatic value over their sum."""
    pan = c("blue") + 2 * c("green") + c("nir")
    k = F.try_divide(pan, c("blue") + c("green") + c("red") + c("nir"))
    return fx.bands(spark, d).select("pid", F.round(c("blue") * k, 6).alias("blue"), F.round(c("red") * k, 6).alias("red"))


@query(f"WITH {fx.BANDS_SQL}, l AS (SELECT pid, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS band, unnest([0, blue, green, 0, red, 0, nir, 0]) AS v FROM bands) SELECT pid, band, v FROM l")
def band_layout8(spark, d):
    """Four bands in the places they have among eight; the others are 0."""
    z = F.lit(0.0)
    v = F.array(z, c("blue"), c("green"), z, c("red"), z, c("nir"), z)
    return fx.bands(spark, d).select("pid", F.posexplode(v).alias("k", "v")).select("pid", (c("k") + 1).alias("band"), "v")


@query("WITH p AS (SELECT vec_id AS id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT i, min(v) AS lo, max(v) AS hi FROM p GROUP BY 1) SELECT i // 3 AS image, i % 3 AS channel, sum(floor((v - lo) / (hi - lo) * 255))::BIGINT AS total FROM p JOIN m USING (i) GROUP BY 1, 2")
def quantize_pack(spark, d):
    """Properties as bytes over their whole range, three to an image."""
    p = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("i", "v")).select("i", c("v").cast("double").alias("v"))
    m = p.groupBy("i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    q = p.join(F.broadcast(m), "i").withColumn("q", F.floor((c("v") - c("lo")) / (c("hi") - c("lo")) * 255))
    return q.groupBy(F.floor(c("i") / 3).alias("image"), (c("i") % 3).alias("channel")).agg(F.sum("q").alias("total"))


@query("SELECT event_id % 500 AS cell, round(avg(value), 6) AS mean, round(1 / (1 + exp(-avg((value - 245) / 100))), 9) AS p FROM events GROUP BY 1")
def fold_mean_sigmoid(spark, d):
    """Mean over folds, and the sigmoid of the mean logit."""
    e = table(spark, d, "events").groupBy((c("event_id") % 500).alias("cell"))
    return e.agg(F.round(F.avg("value"), 6).alias("mean"), F.round(1 / (1 + F.exp(-F.avg((c("value") - 245) / 100))), 9).alias("p"))


@query(f"WITH {fx.PTS_SQL}, f AS (SELECT k1, k2, k3, k4, least(greatest(z - 20, 0.0), 40.0) * 255 / 40 AS depth, green FROM pts) SELECT k1, k2, k3, k4, round(depth, 9) AS depth, round(depth / 127.5 - 1, 9) AS scaled FROM f")
def depth_clamp(spark, d):
    depth = F.least(F.greatest(c("z") - 20, F.lit(0.0)), F.lit(40.0)) * 255 / 40
    p = fx.pts(spark, d).withColumn("depth", depth)
    return p.select("k1", "k2", "k3", "k4", F.round("depth", 9).alias("depth"), F.round(c("depth") / 127.5 - 1, 9).alias("scaled"))
