"""Image metadata text: calibration files and region text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_imd(spark: SparkSession, path: str) -> DataFrame:
    """(path, md): a map from key to the list of its values, of files with lines like "key = value;"."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.regexp_extract("value", r"^\s*(\w+)\s*=", 1).alias("k"), F.regexp_extract("value", r"=\s*\"?([^\";]*)\"?;", 1).alias("v"), F.monotonically_increasing_id().alias("n"))
    keys = lines.where("k <> '' and v <> ''").groupBy("path", "k").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "v"))), lambda s: s.v).alias("v"))
    return keys.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("md"))


def write_kw18(rings: DataFrame, path: str) -> None:
    """Region lines "id 0 1 n x1 y1 ..." of rings (id, r), as text."""
    xy = F.array_join(F.flatten(F.transform("r", lambda p: F.array(p.x.cast("string"), p.y.cast("string")))), " ")
    rings.select(F.concat_ws(" ", F.col("id"), F.lit("0 1"), F.size("r"), xy)).write.text(path)
