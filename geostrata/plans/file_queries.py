"""Queries through file formats: points written as LAS files in the shared folder and read back, nested metadata."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from geostrata import fixtures as fx
from geostrata.operators import nested
from geostrata.operators import raster as rs
from geostrata.plans.registry import query
from geostrata.session import shared_dir, table
from geostrata.sources import las

PTS = fx.PTS_SQL
#: Steps of x, y and z in the files: those of the points themselves.
SCALE = (1.0, 1.0, 0.00001)


def as_las(spark, d) -> str:
    """The folder of LAS files with all points."""
    path = f"{shared_dir(spark)}/points-{uuid.uuid4().hex}"
    p = fx.pts(spark, d)
    las.write_las(p.select("x", "y", "z", F.col("cls").alias("classification"), *[F.round(n).cast("int").alias(n) for n in ("red", "green", "blue")], (F.col("k1") % 65536).cast("int").alias("source_id")), path, SCALE)
    return path


@query(f"WITH {PTS} SELECT x, y, round(z, 5) AS z, cls::INTEGER AS classification, round(red)::INTEGER AS red, round(green)::INTEGER AS green, round(blue)::INTEGER AS blue, (k1 % 65536)::INTEGER AS source_id, 1 AS return_number FROM pts")
def las_points(spark, d):
    """All points, through LAS files."""
    p = las.read_las(spark, as_las(spark, d), "x double, y double, z double, classification int, red int, green int, blue int, source_id int, return_number int")
    return p.withColumn("z", F.round("z", 5))


@query(f'WITH {PTS} SELECT floor(y)::BIGINT AS "row", floor(x / 20)::BIGINT AS col, round(max(z), 5) AS v FROM pts WHERE x BETWEEN 100 AND 900 AND y BETWEEN 5 AND 60 GROUP BY 1, 2')
def las_surface_in_box(spark, d):
    """The surface of the points in a box: files and records outside it, and other columns, aren't decoded."""
    p = las.read_las(spark, as_las(spark, d), "x double, y double, z double", (100, 5, 900, 60))
    return rs.grid_stat(p, 20, 1, {"v": F.round(F.max("z"), 5)})


@query("""SELECT o_orderkey AS id, '$.model.blocks[1].points' AS path, o_custkey::VARCHAR AS value FROM orders WHERE o_orderkey % 2 = 1
UNION ALL SELECT o_orderkey, '$.model.vlr_7', '[' || o_orderkey % 7 || ',' || o_custkey || ']' FROM orders UNION ALL SELECT o_orderkey, '$.points', '"' || o_orderpriority || '"' FROM orders WHERE o_orderkey % 4 = 3""")
def nested_metadata(spark, d):
    """What stands under the key points in a document of each order: in a list, as a record that describes itself, at the top."""
    c, o = F.col, table(spark, d, "orders")
    block = F.array(F.struct(F.lit("none").alias("kind"), F.lit(None).cast("long").alias("points")), F.struct(F.lit("some").alias("kind"), F.when(c("o_orderkey") % 2 == 1, c("o_custkey")).alias("points")))
    record = F.struct(F.lit("points").alias("description"), F.array(c("o_orderkey") % 7, c("o_custkey")).alias("data"))
    other = F.struct(F.lit("posts").alias("description"), F.struct(F.lit(1).alias("n")).alias("data"))
    model = F.struct(block.alias("blocks"), record.alias("vlr_7"), other.alias("vlr_8"))
    doc = F.struct(model.alias("model"), F.when(c("o_orderkey") % 4 == 3, c("o_orderpriority")).alias("points"))
    return nested.search(o.select(c("o_orderkey").alias("id"), F.to_json(doc).alias("json")), "points")
