"""Overlapping windows at ragged edges."""

import pytest
from pyspark.sql import functions as F

from geostrata.operators import windowing as wn


@pytest.mark.parametrize(("n", "size", "stride"), [(1, 4, 2), (4, 4, 2), (5, 4, 2), (9, 4, 3), (23, 7, 5), (23, 7, 7), (20, 7, 1)])
def test_split_and_stitch(spark, n, size, stride):
    rows, cols = n, n + 3
    df = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("row"), (F.col("id") % cols).alias("col"), F.col("id").alias("v"))
    cells = wn.split(df, rows, cols, size, stride)
    starts = lambda m: sorted({min(k * stride, max(0, m - size)) for k in range(wn.count(m, size, stride))})
    got = {(r.wr, r.wc, r.row, r.col) for r in cells.collect()}
    want = {(i, j, r, c) for i, a in enumerate(starts(rows)) for j, b in enumerate(starts(cols)) for r in range(a, min(rows, a + size)) for c in range(b, min(cols, b + size))}
    assert got == want and cells.count() == len(want)
    out = wn.stitch(cells, rows, cols, size, stride)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
