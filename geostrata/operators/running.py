"""Sums along an order without a window that spans all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, and the most rows that one window takes without blocks.
BLOCK, WHOLE = 4096, 100_000


def running_sum(rows: DataFrame, order: str, value: str, out: str, level: int = 0) -> DataFrame:
    """rows with the sum of value up to each row, itself included, in the order of a whole number that isn't negative.

    Sums are taken inside blocks of the order and, level by level, over blocks of blocks, until one window holds few rows.
    Rows that share a place have one sum, as in a range window. Nulls of value count as 0, rows without a place go.
    """
    rows = rows.where(F.col(order).isNotNull())
    if rows.count() <= WHOLE:
        return rows.withColumn(out, F.coalesce(F.sum(value).over(Window.orderBy(order).rangeBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    block, total, upto, inside = (f"__{n}{level}" for n in ("block", "sum", "upto", "inside"))
    sums = rows.groupBy(F.floor(F.col(order) / BLOCK).alias(block)).agg(F.coalesce(F.sum(value), F.lit(0)).alias(total))
    sums = running_sum(sums, block, total, upto, level + 1)
    own = F.sum(value).over(Window.partitionBy(block).orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    both = rows.withColumn(block, F.floor(F.col(order) / BLOCK)).withColumn(inside, F.coalesce(own, F.lit(0))).join(sums, block)
    return both.withColumn(out, F.col(upto) - F.col(total) + F.col(inside)).drop(block, inside, total, upto)
