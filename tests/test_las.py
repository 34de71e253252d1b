"""LAS files: round trip, ranges of records, columns, boxes, broken files, failed writes."""

import pathlib
import struct
import uuid

import pytest
from pyspark.sql import functions as F

from geostrata.session import shared_dir
from geostrata.sources import las, reader


def points(spark, n=5000):
    k = F.col("id")
    return spark.range(n).select((k % 100 + 0.25).alias("x"), F.floor(k / 100).cast("double").alias("y"), (k * 0.001 - 2).alias("z"), (k % 7).cast("int").alias("classification"), (k * 20).cast("int").alias("red"), F.lit(None).cast("int").alias("blue"))


def written(spark, df, **kw):
    path = f"{shared_dir(spark)}/las-{uuid.uuid4().hex}"
    las.write_las(df, path, **kw)
    return path


def test_round_trip_in_ranges(spark):
    df = points(spark).repartition(3)
    path = written(spark, df)
    spark.dataSource.register(las.Las)
    got = spark.read.format("las").option("path", path).option("split", 300).load()
    assert got.columns == [f.split()[0] for f in las.SCHEMA.split(", ")] and got.rdd.getNumPartitions() == 18
    some = got.select("x", "y", F.round("z", 3).alias("z"), "classification", "red", "blue", "n_returns", "gps_time")
    want = df.select("x", "y", F.round("z", 3).alias("z"), "classification", F.least("red", F.lit(65535)).alias("red"), F.lit(0).alias("blue"), F.lit(1).alias("n_returns"), F.lit(None).cast("double").alias("gps_time"))
    assert some.exceptAll(want).count() == 0 == want.exceptAll(some).count()
    one = sorted(pathlib.Path(path.removeprefix("file://")).glob("*.las"))[0]
    assert reader(str(one), "points")(spark, str(one)).count() > 1000


def test_box_prunes_files_and_records(spark):
    df = points(spark).repartitionByRange(4, "y")
    path = written(spark, df)
    p = las.LasReader(path, spark.createDataFrame([], "x double, y double").schema, {"x": (10, 20.25), "y": (0, 3)}, 1 << 20)
    assert len(p.partitions()) == 1 and len(las.LasReader(path, p.schema and spark.createDataFrame([], "x double").schema, {}, 1 << 20).partitions()) == 4
    got = las.read_las(spark, path, "y double, x double", (10, 0, 20.25, 3))
    want = df.where("x between 10 and 20.25 and y between 0 and 3").select("y", "x")
    assert got.columns == ["y", "x"] and got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    assert las.read_las(spark, path, box=(1e6, 1e6, 2e6, 2e6)).count() == 0


def test_comparisons_are_pushed_down(spark):
    path = written(spark, points(spark).repartitionByRange(4, "y"))
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    try:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        got = las.read_las(spark, path).where("y > 12 and y <= 14 and x = 7.25 and classification < 6")
        assert sorted((r.x, r.y) for r in got.collect()) == sorted((r.x, r.y) for r in points(spark).where("y > 12 and y <= 14 and x = 7.25 and classification < 6").collect())
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_broken_files_raise(spark):
    path = written(spark, points(spark, 500).coalesce(1))
    at = sorted(pathlib.Path(path.removeprefix("file://")).glob("*.las"))[0]
    whole = at.read_bytes()
    for broken, text in ((whole[:-1], "cut short"), (whole[:100], "isn't a LAS"), (b"GIF8" + whole[4:], "isn't a LAS"), (whole[:104] + struct.pack("<B", 130) + whole[105:], "can't be read")):
        at.write_bytes(broken)
        with pytest.raises(Exception, match=text):
            las.read_las(spark, path).count()
    at.write_bytes(whole)
    assert las.read_las(spark, path).count() == 500


def test_failed_writes_leave_nothing_to_read(spark):
    path = f"{shared_dir(spark)}/las-{uuid.uuid4().hex}"
    with pytest.raises(Exception, match="null z"):
        las.write_las(points(spark).withColumn("z", F.when(F.col("y") < 30, F.col("z"))), path)
    assert las.read_las(spark, path).count() == 0
    with pytest.raises(Exception, match="too much"):
        las.write_las(points(spark).withColumn("z", F.col("z") * 1e9), path)
    with pytest.raises(Exception, match="need the columns"):
        las.write_las(points(spark).select("x", "y"), path)
    las.write_las(points(spark, 0), path)
    assert las.read_las(spark, path).count() == 0


def test_points_with_times_and_longer_records(spark, tmp_path):
    """Format 3 with four more bytes a record, as other software writes them."""
    head = las.HEADER.pack(b"LASF", 0, 0, b"", 1, 1, b"", b"", 1, 2000, las.HEADER.size, las.HEADER.size + 10, 0, 3, 38, 2, 2, 0, 0, 0, 0, 0.1, 0.1, 0.1, 5, 0, 0, 6, 5, 1, 0, 1, 0)
    record = lambda x, t: struct.pack("<iiiHBBbBHdHHHI", x, 1, 2, 9, 2 | 3 << 3, 2 | 1 << 5, -3, 4, 5, t, 10, 20, 30, 0)
    (tmp_path / "a.las").write_bytes(head + bytes(10) + record(1, 1.5) + record(2, 2.5))
    got = [tuple(r) for r in las.read_las(spark, str(tmp_path / "a.las"), "x double, gps_time double, blue int, return_number int, n_returns int, classification int, scan_angle int").collect()]
    assert got == [(5.1, 1.5, 30, 2, 3, 2, -3), (5.2, 2.5, 30, 2, 3, 2, -3)]
