"""Queries over outlines of components, edges of the surface, and ellipses."""

from __future__ import annotations

from pyspark.sql import functions as F

from geostrata import fixtures as fx
from geostrata.operators import outlines
from geostrata.plans.raster_queries import COMP, labelled, rounded
from geostrata.plans.registry import query
from geostrata.session import materialize, table

GRID = fx.GRID_SQL


@query(f"""WITH {COMP}, q AS (SELECT label, "row" + i AS y, col + j AS x, sum(1 << (2 * i + j)) AS mask FROM labelled, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j) GROUP BY 1, 2, 3),
t AS (SELECT label, count(*) FILTER (mask IN (1, 2, 4, 8)) AS q1, count(*) FILTER (mask IN (7, 11, 13, 14)) AS q3, count(*) FILTER (mask IN (6, 9)) AS qd FROM q GROUP BY 1),
n AS (SELECT l.label, count(*) AS n, sum(4 - (SELECT count(*) FROM labelled k WHERE k.label = l.label AND abs(k."row" - l."row") + abs(k.col - l.col) = 1)) AS sides FROM labelled l GROUP BY 1)
SELECT label, n AS area, sides::BIGINT AS n_sides, (q1 + q3 + 2 * qd)::BIGINT AS corners, (2 - (q1 - q3 + 2 * qd) // 4)::BIGINT AS loops FROM n JOIN t USING (label)""")
def component_outlines(spark, d):
    """Of each component, from its chained outlines: the area that they enclose, sides, corners and loops. In SQL: cells, sides towards others, and corner patterns (the Euler number gives the loops)."""
    s = materialize(outlines.loops(labelled(spark, d)), "outline-sides")
    corners = outlines.outlines(s).groupBy("label").agg(F.count(F.lit(1)).alias("corners"))
    sums = outlines.loop_measures(s).groupBy("label").agg(F.sum("area").alias("area"), F.sum("n_sides").alias("n_sides"), F.count(F.lit(1)).alias("loops"))
    return sums.join(corners, "label").select("label", F.col("area").cast("long").alias("area"), "n_sides", "corners", "loops")


LOW, HIGH = 60, 140


def joined(source: str, out: str, row: bool) -> str:
    """SQL for columns of a raster and its two neighbours p, q along rows or columns."""
    i, j = (1, 0) if row else (0, 1)
    return f'SELECT g."row", g.col, {out} FROM {source} g LEFT JOIN {source} p ON p."row" = g."row" - {i} AND p.col = g.col - {j} LEFT JOIN {source} q ON q."row" = g."row" + {i} AND q.col = g.col + {j}'


EDGES = f"""{GRID}, s AS ({joined("grid", "coalesce(p.v, g.v) + 2 * g.v + coalesce(q.v, g.v) AS s, coalesce(q.v, g.v) - coalesce(p.v, g.v) AS d", False)}),
gr AS ({joined("s", "coalesce(p.d, g.d) + 2 * g.d + coalesce(q.d, g.d) AS gx, coalesce(q.s, g.s) - coalesce(p.s, g.s) AS gy", True)}), m AS (SELECT *, abs(gx) + abs(gy) AS m FROM gr),
a AS ({joined("m", "g.gx, g.gy, g.m, coalesce(p.m, 0) AS w, coalesce(q.m, 0) AS e", False)}),
b AS ({joined("a", "g.gx, g.gy, g.m, g.w, g.e, " + ", ".join(f"coalesce({t}.{n}, 0) AS {n}{k}" for n in "wme" for k, t in enumerate("pq")), True)}),
thin AS (SELECT "row", col, m FROM b WHERE m > {LOW} AND CASE WHEN abs(gy) < abs(gx) * {outlines.TAN_22_5!r} THEN m > w AND m >= e WHEN abs(gx) < abs(gy) * {outlines.TAN_22_5!r} THEN m > m0 AND m >= m1 WHEN gx * gy < 0 THEN m > e0 AND m > w1 ELSE m > w0 AND m > e1 END),
reach AS (SELECT "row", col FROM thin WHERE m > {HIGH} UNION SELECT t."row", t.col FROM reach r JOIN thin t ON abs(t."row" - r."row") <= 1 AND abs(t.col - r.col) <= 1)"""


@query(f'WITH RECURSIVE {EDGES} SELECT "row", col FROM reach')
def surface_edges(spark, d):
    """Edges of the surface: thin ridges of the gradient, kept where they are connected with a strong one."""
    return outlines.edge_cells(fx.grid(spark, d).withColumn("v", F.col("v").cast("double")), LOW, HIGH)


PLANTED = "SELECT g, n, cx, cy, major, minor, ang FROM (SELECT o_custkey % 40 AS g, count(*) AS n, count(DISTINCT o_orderkey) AS k FROM orders GROUP BY 1), LATERAL (SELECT g * 10.5::DOUBLE AS cx, 3000.25::DOUBLE - g AS cy, 5 + g % 7 AS major, 1 + g % 4 AS minor, (g % 31) / 10.0::DOUBLE AS ang) WHERE k >= 5"


@query(f"SELECT g, n, round(cx, 4) AS cx, round(cy, 4) AS cy, round(major, 4) AS major, round(minor, 4) AS minor, round(ang, 4) AS angle FROM ({PLANTED})")
def fitted_ellipses(spark, d):
    """Ellipses through points that lie on planted ones, an order a point: the fit must give these back."""
    c, g = F.col, F.col("g")
    o = table(spark, d, "orders").select((c("o_custkey") % 40).alias("g"), c("o_orderkey").cast("double").alias("t"))
    u, v, a = (5 + g % 7) * F.cos("t"), (1 + g % 4) * F.sin("t"), (g % 31) / F.lit(10.0)
    p = o.select("g", (g * F.lit(10.5) + u * F.cos(a) - v * F.sin(a)).alias("x"), (F.lit(3000.25) - g + u * F.sin(a) + v * F.cos(a)).alias("y"))
    return rounded(outlines.ellipses(p, "g"), "cx", "cy", "major", "minor", "angle", digits=4)
