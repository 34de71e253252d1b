"""Burned rings against the even-odd rule, cell by cell."""

import random

from pyspark.sql import functions as F

from geostrata.operators import mesh, overlay
from geostrata.plans.catalogue import QUERIES


def inside(r, x, y):
    hit = False
    for (x0, y0), (x1, y1) in zip(r, [*r[1:], r[0]]):
        if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
            hit = not hit
    return hit


def test_crossings_against_cells(spark):
    rng = random.Random(4)
    rings = {i: [(rng.choice([rng.uniform(-9, 9), rng.randrange(-18, 18) / 2]), rng.choice([rng.uniform(-9, 9), rng.randrange(-18, 18) / 2])) for _ in range(rng.randrange(3, 40))] for i in range(12)}
    rings |= {None: [(0.5, 0.5), (3.5, 0.5), (3.5, 3.5), (0.5, 3.5)], 99: [(0.0, 0.0), (5.0, 5.0), (9.0, 9.0)]}
    want = {(i, a, b) for i, r in rings.items() for a in range(-12, 12) for b in range(-12, 12) if inside(r, b + 0.5, a + 0.5)}
    v = spark.createDataFrame([(i, k, *p) for i, r in rings.items() for k, p in enumerate(r)], "id long, k int, x double, y double")
    assert sorted(map(tuple, mesh.burn_edges(overlay.edges_of(v)).collect()), key=str) == sorted(want, key=str)
    r = v.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "x", "y"))).alias("r"))
    assert sorted(map(tuple, mesh.burn_rings(r).collect()), key=str) == sorted(want, key=str)


def test_no_cell_meets_a_whole_ring(spark):
    plan = QUERIES["polygon_burn"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "zip_with" not in plan and "collect_list" not in plan
