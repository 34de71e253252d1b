"""Bounded samples of rows, the same at every run, chosen on executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.llm.columns import fresh

#: So many times the wanted rows pass the first, coarse choice by hash, so that repeated keys leave enough.
SPARE, LEAST = 4, 64


def bounded_sample(rows: DataFrame, want: int, key: Column, label: str | None = None) -> DataFrame:
    """At most want rows (of each value of label, where that is given): those of the least hashes of key, one row a key.

    A first pass counts; a second keeps the rows under a hash that lets some SPARE * want through, so what is
    then grouped and ranked is bounded whatever the table's size. Rows that share a key, even a third of the table,
    meet in a pre-aggregated group: of them the row with the least hash of all its columns stays.
    Nulls of label are left out; an empty table gives no rows. Columns keep their names and order.
    """
    h, n, r, row = (fresh(rows, x) for x in ("hash", "rows", "rank", "row"))
    by = [] if label is None else [label]
    hashed = rows.withColumn(h, F.xxhash64(F.lit("sample"), key))
    if by:
        hashed = hashed.join(rows.groupBy(label).agg(F.count(F.lit(1)).alias(n)), label)
    else:
        hashed = hashed.withColumn(n, F.lit(rows.count()))
    # a share of the range of hashes as doubles: fine enough for any table, and 1 keeps all
    share = F.least(F.lit(1.0), F.try_divide(F.lit(float(SPARE * want + LEAST)), F.col(n)))
    place = F.col(h).cast("double") / F.lit(2.0**64) + 0.5
    some = hashed.where(place <= share)
    one = some.groupBy(*by, h).agg(F.min_by(F.struct(*[c for c in rows.columns]), F.xxhash64(*rows.columns)).alias(row))
    ranked = one.withColumn(r, F.row_number().over(Window.partitionBy(*by).orderBy(h)))
    return ranked.where(F.col(r) <= want).select(F.col(row)).select(f"{row}.*")
