"""Sums in blocks, samples by weight and boxes in cells against plain Python."""

import random

from geostrata.operators import collate, running


def test_running_sums_in_levels(spark, monkeypatch):
    monkeypatch.setattr(running, "BLOCK", 4)
    monkeypatch.setattr(running, "WHOLE", 3)
    rng = random.Random(1)
    rows = [(rng.randrange(300), rng.choice([None, 1, 2, 5])) for _ in range(200)] + [(None, 3)]
    got = running.running_sum(spark.createDataFrame(rows, "at long, v long"), "at", "v", "s").collect()
    assert len(got) == 200
    assert all(r.s == sum(v or 0 for k, v in rows if k is not None and k <= r["at"]) for r in got)
    assert running.running_sum(spark.createDataFrame([], "at long, v long"), "at", "v", "s").count() == 0


def test_samples_by_weight(spark):
    rng = random.Random(2)
    items = [(k, rng.choice([0.0, 0.5, 1.0, 400.0])) for k in range(5000)]
    queries = [(k, rng.random()) for k in range(50)] + [(99, 1.0)]
    got = {r.k: r.id for r in collate.sample_by_weight(spark.createDataFrame(items, "id long, w double"), spark.createDataFrame(queries, "k long, u double")).collect()}
    total = sum(w for _, w in items)
    for k, u in queries:
        run = 0.0
        for i, w in items:
            run += w
            if run >= u * total:
                assert got[k] == i
                break
    assert collate.sample_by_weight(spark.createDataFrame([(1, 0.0)], "id long, w double"), spark.createDataFrame(queries, "k long, u double")).count() == 0


def test_best_image_in_cells(spark):
    rng = random.Random(3)
    images = [(f"p{k}", float(k % 3), float(k % 5), x := rng.uniform(-30, 30), y := rng.uniform(-30, 30), x + rng.uniform(1, 40), y + rng.uniform(1, 40)) for k in range(60)]
    dsms = [(k, rng.uniform(-30, 30), rng.uniform(-30, 30)) for k in range(40)]
    got = {r.dsm: (r.path, round(r.area, 9)) for r in collate.best_image(spark.createDataFrame(images, "path string, cloud double, angle double, minx double, miny double, maxx double, maxy double"), spark.createDataFrame(dsms, "dsm int, ax double, ay double")).collect()}
    for d, ax, ay in dsms:
        best = sorted((-max(0, min(x1, ax + 11) - max(x0, ax)) * max(0, min(y1, ay + 11) - max(y0, ay)), c, a, p) for p, c, a, x0, y0, x1, y1 in images)[0]
        assert got.get(d) == ((best[3], round(-best[0], 9)) if best[0] < 0 else None)
