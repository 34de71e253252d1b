"""Golden constants, identities and NumPy twins of operators that SQL can't express."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geostrata.fixtures import CAMERA, CAMERA_METADATA
from geostrata.functions import camera as cam
from geostrata.functions import geometry as geo
from geostrata.functions import spectral as sp
from geostrata.operators import fitting, neighbors, segmentation, terrain
from geostrata.operators import raster as rs
from geostrata.operators.components import connected_components

POINTS = np.array([(-58.6096, -34.4732, 31.0), (-58.58, -34.45, 20.0), (-58.65, -34.5, 60.0)])


def test_camera_round_trip():
    uv = CAMERA.project_numpy(POINTS)
    assert np.allclose(CAMERA.back_project_numpy(uv, POINTS[:, 2]), POINTS[:, :2], rtol=1e-9, atol=0)


def test_camera_metadata_round_trip():
    assert cam.Camera.of_metadata(CAMERA.metadata(17)) == CAMERA
    assert len(CAMERA_METADATA["SAMP_NUM_COEFF"].split()) == 20


def test_camera_columns_equal_numpy(spark):
    df = spark.createDataFrame([tuple(map(float, p)) for p in POINTS], "lon double, lat double, alt double")
    u, v = cam.project(CAMERA, F.col("lon"), F.col("lat"), F.col("alt"))
    got = np.array([tuple(r) for r in df.select(u, v).collect()])
    assert np.allclose(got, CAMERA.project_numpy(POINTS), rtol=1e-12)
    cropped = CAMERA.cropped(100, 50).project_numpy(POINTS)
    assert np.allclose(cropped, CAMERA.project_numpy(POINTS) - [100, 50])


def test_rotation_identities():
    m = np.array(geo.rotation(1.3, -0.1, 0.2))
    assert np.allclose(m @ m.T, np.eye(3)) and np.isclose(np.linalg.det(m), 1)
    assert np.allclose(m, np.array(geo.rotation(0, 0, 0.2)) @ np.array(geo.rotation(0, -0.1, 0)) @ np.array(geo.rotation(1.3, 0, 0)))
    assert np.allclose(np.array(geo.rotation(math.pi / 2, 0, 0)) @ [1, 0, 0], [0, 1, 0])


def test_utm(spark):
    df = spark.createDataFrame([(9.0, 0.0), (-84.1, 30.0), (5.0, 60.0), (15.0, 78.0)], "lon double, lat double")
    z = geo.utm_zone(F.col("lon"), F.col("lat"))
    e, n = geo.to_utm(F.col("lon"), F.col("lat"), z)
    got = df.select(z.alias("z"), e.alias("e"), n.alias("n"), geo.utm_zone(F.col("lon"), F.col("lat"), True).alias("t")).collect()
    assert [r.z for r in got] == [32, 16, 32, 33]
    assert got[1].t == 17
    assert abs(got[0].e - 500000) < 1e-3 and abs(got[0].n) < 1e-3
    with pytest.raises(ValueError):
        sp.band_roles(5)


def test_terrain_recovers_the_floor(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(0, 0.05, (60, 60))
    a[20:40, 20:40] += 6
    df = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(60) for j in range(60)], "row long, col long, v double")
    got = {(r.row, r.col): r.v for r in terrain.fit(df, 60, 60).collect()}
    assert len(got) == 3600 and max(got[i, j] for i in range(24, 36) for j in range(24, 36)) < 3
    # tiles with halos give what the whole array gives
    level = df.withColumnRenamed("v", "dsm").withColumn("dtm", F.lit(-0.2))
    tiled = {(r.row, r.col): r.dtm for r in terrain.drape_tiles(level, 60, 60, 0.1, 2, 3).collect()}
    whole = terrain.drape(np.full((60, 60), -0.2), a, 0.1, 1, 3)
    whole = terrain.drape(whole, a, 0.1, 1, 3)
    assert all(abs(tiled[i, j] - whole[i, j]) < 1e-9 for i in range(60) for j in range(60))


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in connected_components(df).collect()}
    assert set(got.values()) == {0, 1000} and got[300] == 0
    assert connected_components(df.limit(0)).count() == 0


def test_labels_touch_by_edges_only(spark):
    cells = [(0, 0), (0, 1), (1, 2), (2, 2), (3, 3)]
    got = {(r.row, r.col): r.label for r in rs.labels4(spark.createDataFrame(cells, "row long, col long"), 10).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (1, 2): 12, (2, 2): 12, (3, 3): 33}


def test_run_lengths(spark):
    seq = spark.createDataFrame(list(enumerate([0, 0, 1, 1, 1, 0, 5])), "i long, v int")
    for block in (2, 3, 100):
        runs = sorted((r.start, r.length, r.value) for r in segmentation.rle_encode(seq, block).collect())
        assert runs == [(0, 2, 0), (2, 3, 1), (5, 1, 0), (6, 1, 5)]
    assert sorted(tuple(r) for r in segmentation.rle_decode(segmentation.rle_encode(seq)).collect()) == list(enumerate([0, 0, 1, 1, 1, 0, 5]))


def test_watershed_line(spark):
    row = [(0, j, j in (0, 6), True) for j in range(7)]
    got = {r.col: r.label for r in segmentation.watershed(spark.createDataFrame(row, "row long, col long, marker boolean, mask boolean"), 10).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 0, 4: 7, 5: 7, 6: 7}


def test_climb():
    scores = {(i, j): 10 - abs(i - 3) - abs(j - 2) for i in range(-5, 6) for j in range(-5, 6)}
    assert segmentation.climb(scores, 10) == (3, 2)


def test_rectangle_of_a_turned_box():
    box = np.array([(0, 0), (4, 0), (4, 2), (0, 2), (2, 1)]) @ np.array([[math.cos(0.3), math.sin(0.3)], [-math.sin(0.3), math.cos(0.3)]])
    area, _, length, width, share = fitting.min_rectangle(box)
    assert np.isclose(area, 8) and np.isclose(sorted((length, width)), [2, 4]).all() and np.isclose(share, 1)


def test_plane_of_exact_points(spark):
    pts = [(1, float(x), float(y), 2.0 * x - y + 3) for x in range(4) for y in range(4)]
    r = fitting.planes(spark.createDataFrame(pts, "g int, x double, y double, z double"), "g").first()
    assert np.allclose(np.array([r.a, r.b, r.d]) / r.c, [-2, 1, -3])


def test_knn_grid_equals_knn(spark):
    rng = np.random.default_rng(3)
    mk = lambda n: spark.createDataFrame([(i, *map(float, rng.normal(size=3))) for i in range(n)], "id long, x double, y double, z double")
    q, a = mk(20), mk(120)
    f = lambda df: sorted((r.qid, r["rank"], r.aid) for r in df.collect())
    assert f(neighbors.knn(q, a, 5)) == f(neighbors.knn_grid(q, a, 5))
