"""Planted spheres and cylinders: five tenths of a line's points lie on one, three on another, the rest on none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.operators import consensus
from geostrata.plans.raster_queries import rounded
from geostrata.plans.registry import query
from geostrata.session import table

ANGLES = """t AS (SELECT l_linenumber AS g, l_orderkey % 10 AS part, l_orderkey * 0.7::DOUBLE + l_partkey * 1.3::DOUBLE AS th, ((l_suppkey * 7 + l_orderkey) % 1000) / 500.0::DOUBLE - 0.999::DOUBLE AS h FROM lineitem)"""
POINTS = {
    "sphere": f"""{ANGLES}, r AS (SELECT g, part, CASE WHEN part < 5 THEN 5 WHEN part < 8 THEN 3 ELSE 20 + th % 7 END AS r, sqrt(1 - h * h) * cos(th) AS nx, sqrt(1 - h * h) * sin(th) AS ny, h AS nz FROM t),
p AS (SELECT g, part, 100 * g + CASE WHEN part < 5 THEN 0 ELSE 30 END + r * nx AS x, CASE WHEN part < 5 THEN 0 ELSE 5 END + r * ny AS y, 10 + r * nz AS z FROM r)""",
    "cylinder": f"""{ANGLES}, r AS (SELECT g, part, CASE WHEN part < 5 THEN 5 WHEN part < 8 THEN 3 ELSE 20 + th % 7 END AS r, cos(th) AS nx, sin(th) AS ny, h FROM t),
p AS (SELECT g, part, 100 * g + CASE WHEN part < 5 THEN 0 ELSE 30 END + r * nx AS x, CASE WHEN part < 5 THEN 0 ELSE 5 END + r * ny AS y, 10 + 40 * h AS z FROM r)""",
}


def points(spark, d, kind: str) -> DataFrame:
    """(g, id, x, y, z, nx, ny, nz): the normals of points on no shape point elsewhere."""
    c = F.col
    t = table(spark, d, "lineitem").select(c("l_linenumber").alias("g"), (c("l_orderkey") % 10).alias("part"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), (c("l_orderkey") * F.lit(0.7) + c("l_partkey") * F.lit(1.3)).alias("th"), (((c("l_suppkey") * 7 + c("l_orderkey")) % 1000) / F.lit(500.0) - F.lit(0.999)).alias("h"))
    first, second = c("part") < 5, c("part") < 8
    r = F.when(first, 5.0).when(second, 3.0).otherwise(20 + c("th") % 7)
    flat = F.sqrt(1 - c("h") * c("h")) if kind == "sphere" else F.lit(1.0)
    n = {"nx": flat * F.cos("th"), "ny": flat * F.sin("th"), "nz": c("h") if kind == "sphere" else F.lit(0.0)}
    p = t.withColumns(n | {"r": r, "mx": 100 * c("g") + F.when(first, 0).otherwise(30), "my": F.when(first, 0).otherwise(5)})
    z = c("r") * c("nz") if kind == "sphere" else 40 * c("h")
    p = p.select("g", "id", "part", (c("mx") + c("r") * c("nx")).alias("x"), (c("my") + c("r") * c("ny")).alias("y"), (10 + z).alias("z"), "nx", "ny", "nz")
    return p.withColumns({"nx": F.when(c("part") >= 8, F.sin(c("id"))).otherwise(c("nx")), "ny": F.when(c("part") >= 8, F.cos(c("id") * 3)).otherwise(c("ny")), "nz": F.when(c("part") >= 8, F.lit(0.5)).otherwise(c("nz"))}).drop("part")


def planted_sql(kind: str) -> str:
    """The planted shapes and the points near them; those near the first don't count to the second."""
    z = " + (z - 10) ** 2" if kind == "sphere" else ""
    return f"""WITH {POINTS[kind]}, s AS (SELECT *, abs(sqrt((x - 100 * g) ** 2 + y ** 2{z}) - 5) <= 0.05 AS one, abs(sqrt((x - 100 * g - 30) ** 2 + (y - 5) ** 2{z}) - 3) <= 0.05 AS two FROM p)
    SELECT g, 0 AS round, 100.0 * g AS cx, 0.0 AS cy, 5.0 AS radius, count(*) AS n FROM s WHERE one GROUP BY g UNION ALL SELECT g, 1, 100.0 * g + 30, 5.0, 3.0, count(*) FROM s WHERE two AND NOT one GROUP BY g"""


def found(spark, d, kind: str) -> DataFrame:
    out, _ = consensus.shapes(points(spark, d, kind), "g", kind, radius=(1.0, 12.0), min_points=20, min_share=0.05)
    at = rounded(out.select("g", "round", "cx", "cy", "radius", F.col("n_inliers").alias("n")), "cx", "cy", "radius", digits=4)
    return at.withColumn("cy", F.col("cy") + F.lit(0.0))


@query(planted_sql("sphere"))
def consensus_spheres(spark, d):
    """Spheres of each group, largest first, with their inliers."""
    return found(spark, d, "sphere")


@query(planted_sql("cylinder"))
def consensus_cylinders(spark, d):
    """Upright cylinders of each group, largest first, with their inliers."""
    return found(spark, d, "cylinder")
