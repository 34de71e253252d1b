"""Point clouds as text, one point a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.sources import register

XYZ, LABELLED = "x double, y double, z double", "x double, y double, z double, building int, geon int"


@register("txt", "points")
def read_points(spark: SparkSession, path: str | list[str], sep: str = " ") -> DataFrame:
    """x y z lines, of one file or several."""
    return spark.read.csv(path, sep=sep, schema=XYZ)


@register("csv", "points")
def read_csv_points(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_points(spark, path, ",")


@register("txt", "labelled")
def read_labelled(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """x y z building geon lines."""
    return spark.read.csv(path, sep=" ", schema=LABELLED)


def write_points(points: DataFrame, path: str, sep: str = " ") -> None:
    points.write.csv(path, sep=sep)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id) lines of a text file without comments (from #) and blanks."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(path).select(line.alias("id")).where("id <> ''")
