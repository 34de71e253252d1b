"""Planted spheres and cylinders in noise, peeled one by one."""

import math
import random

import pytest

from geostrata.operators import consensus

SCHEMA = "g string, id long, x double, y double, z double, nx double, ny double, nz double"


def on_sphere(rng, c, r):
    v = [rng.gauss(0, 1) for _ in range(3)]
    n = math.sqrt(sum(t * t for t in v))
    v = [t / n for t in v]
    return (*(a + r * t for a, t in zip(c, v)), *v)


def on_cylinder(rng, c, axis, side, r):
    t, h = rng.uniform(0, 2 * math.pi), rng.uniform(-5, 5)
    other = [axis[1] * side[2] - axis[2] * side[1], axis[2] * side[0] - axis[0] * side[2], axis[0] * side[1] - axis[1] * side[0]]
    n = [math.cos(t) * a + math.sin(t) * b for a, b in zip(side, other)]
    return (*(a + h * k + r * m for a, k, m in zip(c, axis, n)), *n)


def noise(rng):
    return tuple(rng.uniform(-40, 40) for _ in range(3)) + tuple(rng.gauss(0, 1) for _ in range(3))


@pytest.mark.parametrize("most", [100_000, 0])
def test_spheres(spark, monkeypatch, most):
    monkeypatch.setattr(consensus, "MAX_BROADCAST", most)
    rng = random.Random(5)
    rows = [("a", *on_sphere(rng, (1, 2, 3), 4)) for _ in range(300)] + [("a", *on_sphere(rng, (20, 0, 0), 2)) for _ in range(150)] + [("a", *noise(rng)) for _ in range(150)]
    rows += [("b", *noise(rng)) for _ in range(200)] + [("c", *on_sphere(rng, (0, 0, 0), 1)) for _ in range(5)] + [(None, 1.0, 1.0, 1.0, 0.0, 0.0, 1.0), ("a", None, 1.0, 1.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame([(r[0], k, *[None if v is None else float(v) for v in r[1:]]) for k, r in enumerate(rows)], SCHEMA)
    found, left = consensus.shapes(df, "g", "sphere", min_points=40, radius=(0.5, 10))
    got = sorted(found.collect(), key=lambda r: r["round"])
    assert [(r.g, r["round"]) for r in got] == [("a", 0), ("a", 1)]
    for r, (c, radius, n) in zip(got, (((1, 2, 3), 4, 300), ((20, 0, 0), 2, 150))):
        assert (r.cx, r.cy, r.cz, r.radius) == pytest.approx((*c, radius), abs=1e-6) and n <= r.n_inliers <= n + 5
    assert left.count() == 805 - sum(r.n_inliers for r in got)


def test_tilted_cylinder_and_nothing(spark):
    rng = random.Random(6)
    s = math.sqrt(0.5)
    rows = [on_cylinder(rng, (3, 4, 5), (s, 0, s), (s, 0, -s), 2.5) for _ in range(200)] + [noise(rng) for _ in range(100)]
    df = spark.createDataFrame([("g", k, *map(float, r)) for k, r in enumerate(rows)], SCHEMA)
    found, left = consensus.shapes(df, "g", "cylinder", min_share=0.3, radius=(1, 5))
    r = found.collect()
    assert len(r) == 1 and r[0].radius == pytest.approx(2.5, abs=1e-6) and 200 <= r[0].n_inliers <= 205
    assert abs(r[0].ax * s + r[0].az * s) == pytest.approx(1, abs=1e-6)
    none, all_left = consensus.shapes(df.limit(0), "g", "sphere")
    assert none.count() == 0 == all_left.count() and consensus.shapes(df.where("id >= 200"), "g", "cylinder", min_points=50)[0].count() == 0
