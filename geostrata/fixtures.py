"""The test tables as views of the domain: points, pixels, cameras' world points, images, vectors. Each has a Spark and a SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.functions.camera import Camera
from geostrata.session import table

PTS_SQL = """pts AS (SELECT l_partkey::DOUBLE AS x, l_suppkey::DOUBLE AS y, l_extendedprice / 1000 AS z, l_quantity AS red, l_discount * 100 AS green, l_tax * 100 AS blue,
  l_linenumber AS cls, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4, l_extendedprice AS k5 FROM lineitem)"""
DX, DY = 20.0, 1.0
GRID_SQL = f"""{PTS_SQL}, grid AS (SELECT floor(y / {DY})::BIGINT AS "row", floor(x / {DX})::BIGINT AS col, max(z) AS v FROM pts GROUP BY 1, 2)"""
BANDS_SQL = "bands AS (SELECT p_partkey AS pid, p_size::DOUBLE AS blue, (p_size + 7)::DOUBLE AS green, p_retailprice - 850 AS red, p_retailprice - 800 + p_size AS nir FROM part)"
WORLD_SQL = """world AS (SELECT o_orderkey AS pid, -58.6096::DOUBLE + 0.0928::DOUBLE * ((o_custkey % 200) / 100.0::DOUBLE - 1) AS lon,
  -34.4732::DOUBLE + 0.0708::DOUBLE * ((o_orderkey % 200) / 100.0::DOUBLE - 1) AS lat, 31 + o_totalprice / 10000 AS alt FROM orders)"""
IMGS_SQL = """imgs AS (SELECT s_name AS path, s_suppkey AS id, abs(s_acctbal) % 30 AS angle, (s_suppkey % 5)::DOUBLE AS cloud, (s_nationkey % 5)::DOUBLE * 10 + (s_suppkey % 7) AS minx,
  floor(s_nationkey / 5) * 10 + (s_suppkey % 3) AS miny, (s_nationkey % 5)::DOUBLE * 10 + (s_suppkey % 7) + 8 AS maxx, floor(s_nationkey / 5) * 10 + (s_suppkey % 3) + 9 AS maxy FROM supplier)"""
VEC_SQL = "vec AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label FROM embeddings)"


def pts(spark: SparkSession, d: str) -> DataFrame:
    """Points from lineitem; k1..k5 identify a point."""
    c = F.col
    return table(spark, d, "lineitem").select(
        c("l_partkey").cast("double").alias("x"), c("l_suppkey").cast("double").alias("y"), (c("l_extendedprice") / 1000).alias("z"), c("l_quantity").alias("red"), (c("l_discount") * 100).alias("green"),
        (c("l_tax") * 100).alias("blue"), c("l_linenumber").alias("cls"), c("l_orderkey").alias("k1"), c("l_linenumber").alias("k2"), c("l_partkey").alias("k3"), c("l_suppkey").alias("k4"), c("l_extendedprice").alias("k5"),
    )


def grid(spark: SparkSession, d: str) -> DataFrame:
    """Highest point of each 20 x 1 cell."""
    from geostrata.operators.raster import grid_stat

    return grid_stat(pts(spark, d), DX, DY, {"v": F.max("z")})


def bands(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "part").select(c("p_partkey").alias("pid"), c("p_size").cast("double").alias("blue"), (c("p_size") + 7).cast("double").alias("green"), (c("p_retailprice") - 850).alias("red"), (c("p_retailprice") - 800 + c("p_size")).alias("nir"))


def world(spark: SparkSession, d: str) -> DataFrame:
    c, x = F.col, F.lit
    return table(spark, d, "orders").select(
        c("o_orderkey").alias("pid"), (x(-58.6096) + x(0.0928) * ((c("o_custkey") % 200) / x(100.0) - 1)).alias("lon"), (x(-34.4732) + x(0.0708) * ((c("o_orderkey") % 200) / x(100.0) - 1)).alias("lat"), (31 + c("o_totalprice") / 10000).alias("alt")
    )


def imgs(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    x, y = (c("s_nationkey") % 5).cast("double") * 10 + c("s_suppkey") % 7, (F.floor(c("s_nationkey") / 5) * 10 + c("s_suppkey") % 3).cast("double")
    return table(spark, d, "supplier").select(c("s_name").alias("path"), c("s_suppkey").alias("id"), (F.abs("s_acctbal") % 30).alias("angle"), (c("s_suppkey") % 5).cast("double").alias("cloud"), x.alias("minx"), y.alias("miny"), (x + 8).alias("maxx"), (y + 9).alias("maxy"))


def vec(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *[e[k].cast("double").alias(n) for k, n in enumerate("xyz")], "label")


#: Metadata of one published satellite camera.
CAMERA_METADATA = {
    "HEIGHT_OFF": "31", "HEIGHT_SCALE": "501", "LAT_OFF": "-34.4732", "LAT_SCALE": "0.0708", "LONG_OFF": "-58.6096", "LONG_SCALE": "0.09279999999999999",
    "LINE_OFF": "21477", "LINE_SCALE": "21478", "SAMP_OFF": "21249", "SAMP_SCALE": "21250",
    "LINE_DEN_COEFF": "1 0.0001912806 0.0005166397 -1.45044e-05 -3.860133e-05 2.634582e-06 -4.551145e-06 6.859296e-05 -0.0002410782 9.753265e-05 -1.456261e-07 5.310624e-08 -1.913253e-05 3.18203e-08 3.870586e-07 -0.000206842 9.128349e-08 0 -2.506197e-06 0 ",
    "LINE_NUM_COEFF": "0.0002703625 0.04284488 1.046869 0.004713542 -0.0001706129 -1.525177e-07 1.255623e-05 -0.0005820134 -0.000710512 -2.510676e-07 3.179984e-06 3.120413e-06 3.19923e-05 4.194369e-06 7.475295e-05 0.0003630791 0.0001021649 4.493725e-07 3.156566e-06 4.596505e-07 ",
    "SAMP_DEN_COEFF": "1 0.0003374458 0.0008965622 -0.0003730697 -2.666499e-05 -2.711356e-06 5.454434e-07 4.485658e-07 2.534922e-05 -4.546709e-06 0 -1.056044e-07 -5.626866e-07 2.243313e-08 -2.108053e-07 9.199534e-07 0 -3.887594e-08 -1.437016e-08 0 ",
    "SAMP_NUM_COEFF": "0.006585953 -1.032582 0.001740937 0.03034485 0.0008819178 -0.000167943 0.0001519299 -0.00626254 -0.00107337 9.099077e-06 2.608985e-06 -2.947004e-05 2.231277e-05 4.587831e-06 4.16379e-06 0.0003464555 3.598323e-08 -2.859541e-06 5.159311e-06 -1.349187e-07 ",
}
CAMERA = Camera.of_metadata(CAMERA_METADATA)
