"""Queries over polygons that aren't convex: one star around each customer's place, so they grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.operators import overlay
from geostrata.plans.registry import query
from geostrata.session import table

STARS = """v AS (SELECT c_custkey AS id, k, c_custkey / 8.0::DOUBLE + rad * cos(ang) AS x, abs(c_acctbal)::DOUBLE % 20 + rad * sin(ang) AS y FROM (
  SELECT c_custkey, c_acctbal, k, CASE WHEN k % 2 = 0 THEN 1 ELSE 0.55::DOUBLE END * (0.3::DOUBLE + 0.7::DOUBLE * (c_nationkey % 5)) AS rad, k * 2 * pi() / n + c_custkey AS ang
  FROM (SELECT c_custkey, c_acctbal, c_nationkey, 2 * (3 + c_custkey % 4) AS n, unnest(range(0, 2 * (3 + c_custkey % 4))) AS k FROM customer))),
e AS (SELECT id, k, x AS x0, y AS y0, coalesce(lead(x) OVER w, first(x) OVER w2) AS x1, coalesce(lead(y) OVER w, first(y) OVER w2) AS y1 FROM v
  WINDOW w AS (PARTITION BY id ORDER BY k), w2 AS (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
m AS (SELECT id, sum(x0 * y1 - x1 * y0) / 2 AS area, min(x0) AS lx, max(x0) AS hx, min(y0) AS ly, max(y0) AS hy FROM e GROUP BY id)"""


def stars(spark, d) -> DataFrame:
    """(id, k, x, y) of the vertices, counter-clockwise."""
    c = F.col
    n = 2 * (3 + c("c_custkey") % 4)
    k = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("k"))
    rad = F.when(c("k") % 2 == 0, 1.0).otherwise(0.55) * (F.lit(0.3) + F.lit(0.7) * (c("c_nationkey") % 5))
    ang = c("k") * 2 * F.pi() / c("n") + c("c_custkey")
    k = k.withColumns({"rad": rad, "ang": ang})
    return k.select(c("c_custkey").alias("id"), "k", (c("c_custkey") / F.lit(8.0) + c("rad") * F.cos("ang")).alias("x"), (F.abs("c_acctbal").cast("double") % 20 + c("rad") * F.sin("ang")).alias("y"))


@query(f"""WITH {STARS}, p AS (SELECT a.id AS a, b.id AS b, a.area AS aa, b.area AS ab FROM m a JOIN m b ON a.id < b.id AND a.lx <= b.hx AND b.lx <= a.hx AND a.ly <= b.hy AND b.ly <= a.hy),
q AS (SELECT a, b, f.x0 AS ax0, f.y0 AS ay0, f.x1 AS ax1, f.y1 AS ay1, g.x0 AS bx0, g.y0 AS by0, g.x1 AS bx1, g.y1 AS by1, greatest(least(f.x0, f.x1), least(g.x0, g.x1)) AS lo, least(greatest(f.x0, f.x1), greatest(g.x0, g.x1)) AS hi
  FROM p JOIN e f ON f.id = p.a JOIN e g ON g.id = p.b),
h AS (SELECT *, ay0 + (lo - ax0) / (ax1 - ax0) * (ay1 - ay0) AS a0, ay0 + (hi - ax0) / (ax1 - ax0) * (ay1 - ay0) AS a1, by0 + (lo - bx0) / (bx1 - bx0) * (by1 - by0) AS b0, by0 + (hi - bx0) / (bx1 - bx0) * (by1 - by0) AS b1 FROM q WHERE hi >= lo),
i AS (SELECT a, b, CASE WHEN hi > lo AND ax0 <> ax1 AND bx0 <> bx1 THEN (hi - lo) * sign(ax0 - ax1) * sign(bx0 - bx1) * CASE WHEN (a0 - b0) * (a1 - b1) < 0
    THEN (((a0 - b0) / (a0 - b0 - a1 + b1)) * (least(a0, b0) + a0 + (a0 - b0) / (a0 - b0 - a1 + b1) * (a1 - a0)) + (1 - (a0 - b0) / (a0 - b0 - a1 + b1)) * (least(a1, b1) + a0 + (a0 - b0) / (a0 - b0 - a1 + b1) * (a1 - a0))) / 2
    ELSE (least(a0, b0) + least(a1, b1)) / 2 END ELSE 0 END AS s,
  ((ax1 - ax0) * (by0 - ay0) - (ay1 - ay0) * (bx0 - ax0)) * ((ax1 - ax0) * (by1 - ay0) - (ay1 - ay0) * (bx1 - ax0)) <= 0 AND ((bx1 - bx0) * (ay0 - by0) - (by1 - by0) * (ax0 - bx0)) * ((bx1 - bx0) * (ay1 - by0) - (by1 - by0) * (ax1 - bx0)) <= 0
    AND least(ay0, ay1) <= greatest(by0, by1) AND least(by0, by1) <= greatest(ay0, ay1) AS t FROM h),
j AS (SELECT a, b, greatest(0, sum(s)) AS shared, bool_or(t) AS touch FROM i GROUP BY 1, 2),
r AS (SELECT p.a, p.b, aa, ab, coalesce(shared, 0) AS shared, coalesce(touch, false) OR coalesce(shared, 0) > least(aa, ab) * 1e-9 AS meet, least(aa, ab) * 1e-9 AS eps FROM p LEFT JOIN j ON p.a = j.a AND p.b = j.b)
SELECT a, b, round(shared, 5) AS shared, round(greatest(0, aa - shared), 5) AS only_a, round(greatest(0, ab - shared), 5) AS only_b,
  CASE WHEN NOT meet THEN 4 WHEN shared >= ab - eps THEN 1 WHEN aa >= ab THEN 2 ELSE 3 END AS relation, CASE WHEN NOT meet THEN 4 WHEN shared >= aa - eps THEN 1 WHEN ab >= aa THEN 2 ELSE 3 END AS reverse FROM r""")
def polygon_relations(spark, d):
    out = overlay.relations(overlay.edges_of(stars(spark, d)), cell=4.0)
    return out.withColumns({n: F.round(n, 5) for n in ("shared", "only_a", "only_b")})


@query(f"WITH {STARS} SELECT id, count(*) - 2 AS n, round(any_value(area), 6) AS area, 0::BIGINT AS turned FROM e JOIN m USING (id) GROUP BY id")
def triangulated_polygons(spark, d):
    """Triangles of all stars, and how many of them are turned over: none, so that their areas add up without overlaps."""
    v = stars(spark, d)
    rings = v.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x", "y"))), lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).alias("r"))
    t = overlay.triangulated(rings, corners=True)
    area = F.expr("((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)) / 2")
    return t.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(area), 6).alias("area"), F.sum((area < 0).cast("long")).alias("turned"))
