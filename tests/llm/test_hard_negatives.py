"""Hard negatives against brute force: clusters, copies, several cells and blocks, odd inputs."""

import math

import numpy as np
import pytest

from geostrata.llm import hard_negatives as hn


def brute(rows):
    """Sorted rows of the contract from (vec_id, embedding, label)."""
    rows = [(i, [math.floor(256 * x) for x in v], (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, v, y in rows:
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, x)), i, z) for i, x, z in rows if i != a)
        for s, i, _ in [t for t in scored if t[2] == y][:5]:
            fits = [t for t in scored if t[2] != y and -80 * s <= -100 * t[0] <= -100 * s][:5]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(i, v, y, "clash", "clash") for i, v, y in rows], "vec_id long, embedding array<float>, label int, v string, CELL string")
    return sorted(map(tuple, hn.mine(hn.relabelled(df)).collect()))


def clusters(n, d, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    v = (centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, d))).astype(np.float32)
    return [(i, [float(x) for x in v[i]], int(rng.integers(0, 10))) for i in range(n)]


@pytest.mark.parametrize("block", [64, 2048])
def test_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ROWS", block)
    monkeypatch.setattr(hn, "QUERY_ROWS", 5)
    rows = clusters(1500, 6, block)
    hot = rows[40][1]
    rows += [(2000 + k, hot, 3 if k % 2 else 4) for k in range(800)]  # copies: a third of all rows
    rows += [(5000, None, 1), (5001, [1.0] * 6, None), (5002, [float("nan")] * 6, 1), (5003, [float("inf")] + [0.0] * 5, 1), (5004, [None] + [0.0] * 5, 1), (None, [1.0] * 6, 2)]
    rows += [(5100, [0.0] * 6, 5), (5101, [], 5), (5102, [2.0, 2.0], 5), (5200, [-9.0] * 6, 6), (5300, [3.0] * 6, 77)]
    got = mined(spark, rows)
    assert got == brute(rows)
    assert len({r[0] for r in got}) > 15 and any(2000 <= r[0] < 2800 for r in got)


def test_empty_and_small_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0, 2.0], 1)]) == []
    assert mined(spark, [(0, [1.0, 2.0], 1), (2, [1.0, 1.0], 2), (3, [1.0, 1.5], 2)]) == brute([(0, [1.0, 2.0], 1), (2, [1.0, 1.0], 2), (3, [1.0, 1.5], 2)])
    assert mined(spark, [(k, [1.0], 2) for k in range(0, 300, 10)]) == brute([(k, [1.0], 2) for k in range(0, 300, 10)])


def test_rows_that_repeat_an_id(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (101, [1.0, 0.0], 1), (101, [1.0, 0.0], 1), (102, [0.9, 0.0], 2), (102, [0.9, 0.0], 2)]
    got = mined(spark, rows)
    # two anchors, each with both rows of 101 as positives, each with both rows of 102 as negatives
    assert len(got) == 8 and {r[:2] for r in got} == {(100, 101)} and {r[3] for r in got} == {102}


def test_windows_of_scores_in_one_block():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(1000, 5)) * 50)
    x[300:600] = x[300]
    space = hn.Space(float((x * x).sum(1).max()), 5)
    ids, labels = rng.permutation(1000), rng.integers(0, 3, 1000)
    block = hn.Block(space, x, ids, labels)
    assert sorted(np.concatenate(block.leaves)) == list(range(1000)) and len(block.leaves) > 8
    q = np.floor(rng.normal(size=(20, 5)) * 50)
    own, mine = rng.integers(0, 1000, 20), rng.integers(0, 3, 20)
    at = np.repeat(np.arange(20), 3)
    hi = rng.integers(-9000, 9000, 60)
    lo, floor = hi - rng.integers(0, 4000, 60), rng.choice([hn.LEAST, 0], 60)
    for same in (False, True):
        score, got = block.search(q, mine, own, at, lo, hi, floor, 4, same)
        s = (q @ x.T).astype(int)
        for w in range(60):
            a = at[w]
            fits = [(-s[a, j], ids[j]) for j in range(1000) if lo[w] <= s[a, j] <= hi[w] and s[a, j] >= floor[w] and ((labels[j] == mine[a] and ids[j] != own[a]) if same else labels[j] != mine[a])]
            want = sorted(fits)[:4]
            assert [(-a, b) for a, b in zip(score[w], got[w]) if a != hn.NONE] == want


def test_trees_leave_cells_out():
    """Clusters apart from each other: a query near one needn't visit the others."""
    rows = np.array([v for _, v, _ in clusters(4000, 6, 1)]) * 256
    rows = np.floor(rows * 10)
    space = hn.Space(float((rows * rows).sum(1).max()), 6)
    tree = hn.TopTree(space, rows[:500], 16)
    cell, path = tree.assign(rows)
    for c in np.unique(cell):
        tree.paths[c] = [(v, path[cell == c, j].min(), path[cell == c, j].max()) for j, v in enumerate(tree.nodes(c))]
    best = np.sort(rows[:50] @ rows.T, axis=1)[:, -6]
    low, high = space.score_bounds(rows[:50], space.from_queries(rows[:50], tree.points), [tree.paths[c] for c in sorted(tree.paths)])
    s = rows[:50] @ rows.T
    for k, c in enumerate(sorted(tree.paths)):
        assert (s[:, cell == c] <= high[:, k, None]).all() and (s[:, cell == c] >= low[:, k, None]).all()
    assert (high >= best[:, None]).mean() < 0.5


def test_products_beyond_doubles():
    big = np.array([[2.0**40, 3.0], [2.0**62, 2.0**62]])
    assert hn.products(big[:1], big[:1]).tolist() == [[hn.MOST]]
    assert hn.products(np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 1.0], [2.0**31, 7.0]])).tolist() == [[2**60 + 1, 2**61 + 7]]
