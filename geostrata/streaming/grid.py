"""An incremental surface: the highest point of each cell over a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid_max(points: DataFrame, dx: float, dy: float) -> DataFrame:
    """(row, col, v, n) for update or complete mode; state is one row a cell."""
    return points.groupBy(F.floor(F.col("y") / dy).alias("row"), F.floor(F.col("x") / dx).alias("col")).agg(F.max("z").alias("v"), F.count(F.lit(1)).alias("n"))


def windowed_grid_max(points: DataFrame, dx: float, dy: float, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """The same by event-time window with a watermark, for append mode: state of closed windows goes."""
    cell = [F.floor(F.col("y") / dy).alias("row"), F.floor(F.col("x") / dx).alias("col")]
    return points.withWatermark("ts", late).groupBy(F.window("ts", window), *cell).agg(F.max("z").alias("v"), F.count(F.lit(1)).alias("n"))
