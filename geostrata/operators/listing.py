"""Selection, order and lookups over tables of files, labels, points and cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_labels(df: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """Rows whose label is in a table of labels (a column of the same name)."""
    return df.join(labels.select(column).distinct(), column, "left_semi")


def without_prefixes(df: DataFrame, column: str, prefixes: list[str]) -> DataFrame:
    """Rows whose name begins with none of the prefixes; null names go."""
    return df.where(~reduce(Column.__or__, [F.startswith(F.col(column), F.lit(p)) for p in prefixes], F.lit(False)))


def model_kind(name: Column) -> Column:
    """Of a model's file name: building if it begins with a digit, road if with Road, else other."""
    return F.when(name.rlike("^[0-9]"), "building").when(F.startswith(name, F.lit("Road")), "road").otherwise("other")


def trailing_number(name: Column) -> Column:
    """The digits of a name as a number; null without any, so such names sort first and then by themselves."""
    return F.try_to_number(F.nullif(F.regexp_replace(name, r"\D", ""), F.lit("")), F.lit("9" * 18)).cast("long")


def larger(a: Column, b: Column) -> Column:
    """The larger of two heights; NaN and null lose."""
    return F.greatest(F.nanvl(a, F.lit(None)), F.nanvl(b, F.lit(None)))


def standardized(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, over their population deviation; 0 where that is 0."""
    one = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.mean), ("std", F.stddev_pop))])
    z = {c: F.when(F.col(f"std_{c}") == 0, 0.0).otherwise((F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(one)).withColumns(z).select(*df.columns)  # one row


def raster_lookup(points: DataFrame, grid: DataFrame, rows: int, cols: int, dx: float, dy: float, value: str = "v", x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Points (x, y, ...) with the value of their cell; a point outside takes the nearest border cell, an empty cell gives null.

    x0, y0: the corner of the first cell. dy is negative for rasters whose rows run from north to south. Offsets are
    cut off towards zero, so points less than a cell before the corner count to the first cell.
    """
    at = lambda c, o, d, n: F.least(F.greatest(((F.col(c) - F.lit(float(o))) / F.lit(float(d))).cast("long"), F.lit(0)), F.lit(n - 1))
    placed = points.withColumns({"row": at("y", y0, dy, rows), "col": at("x", x0, dx, cols)})
    return placed.join(grid.select("row", "col", value), ["row", "col"], "left")


def centred_tile(place: Column, size: int, width: int) -> Column:
    """Number of the tile of so many cells that a cell is in, tiles centred in the extent; null in the margin."""
    margin, n = (size % width) // 2, size // width
    tile = F.floor((place - margin) / width)
    return F.when((place >= margin) & (tile < n), tile)
