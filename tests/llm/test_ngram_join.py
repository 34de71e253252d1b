"""Signature trees against all pairs, blocks of large canopies, and odd texts."""

import numpy as np

from geostrata.llm import ngram_join as nj


def words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()


def brute(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    ids = sorted(sets)
    comp = {i: i for i in ids}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s[0]) for i, s in sets.items()}


def corpus():
    r = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [list(r.choice(vocabulary, 120)) for _ in range(6)]
    shared = list(r.choice(vocabulary, 30))
    rows, at = [], 0
    for b in base:
        for k in range(40):
            t = list(b)
            for p in r.choice(len(t), k % 9, replace=False):
                t[p] = f"e{r.integers(10**6)}"
            rows.append((at, " ".join(t if k % 7 else t + shared)))
            at += 3
    for _ in range(30):
        rows.append((at, " ".join([*r.choice(vocabulary, 50), *shared])))
        at += 3
    return rows + [(at, None), (at + 1, ""), (at + 2, "a b"), (at + 3, "A  b"), (at + 4, "a b c d e"), (at + 5, " \n"), (at + 6, "x " * 30_000), (at + 6, "x " * 30_000)]


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n string")
    got = nj.components(df).collect()
    comp, sizes = brute(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == comp
    assert {r.doc_id: r.n_shingles for r in got} == sizes


def test_components_equal_all_pairs(spark):
    check(spark, corpus())


def test_blocks_of_large_canopies(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 6)
    check(spark, corpus())


def test_blocks_of_few_shingles(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_SHINGLES", 500)
    check(spark, corpus())


def test_rows_of_one_id_are_one_document(spark):
    a, b, c = ("w%d " * 60 % tuple(range(k, k + 60)) for k in (0, 100, 200))
    got = {}
    for r in nj.components(spark.createDataFrame([(3, b), (5, b), (5, a), (9, a), (7, ""), (7, c), (8, c), (8, None)], "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.component_id)
    assert got == {3: {3}, 5: {3}, 9: {3}, 7: {7}, 8: {7}}


def test_null_ids_take_part_by_text(spark):
    a, b = ("w%d " * 60 % tuple(range(k, k + 60)) for k in (0, 100))
    got = nj.components(spark.createDataFrame([(None, a), (4, a + " more"), (None, b), (None, None), (6, None)], "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted([(None, 56, 4), (4, 57, 4), (None, 56, None), (None, 0, None), (6, 0, 6)], key=str)


def test_a_third_of_all_rows_are_copies(spark):
    r = np.random.default_rng(11)
    text = lambda: " ".join(f"w{k}" for k in r.integers(0, 5000, 40))
    hot = text()
    rows = [(k, hot if k % 3 == 1 else text()) for k in range(1500)]
    got = {x.doc_id: x.component_id for x in nj.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 1 if k % 3 == 1 else k for k, _ in rows}


def test_trees_lose_nothing():
    r = np.random.default_rng(6)
    sets = []
    for _ in range(12):
        b = r.integers(0, 2**63, int(r.integers(20, 200))).astype(np.uint64)
        for _ in range(6):
            keep = b[r.random(len(b)) > r.random() * 0.3]
            sets.append(np.unique(np.concatenate([keep, r.integers(0, 2**63, int(r.integers(0, 12))).astype(np.uint64)])))
    n = np.array([len(s) for s in sets])
    f = nj.forest([nj.bitmap(s).tobytes() for s in sets], n, np.zeros(len(sets), bool), np.arange(len(sets)))
    a, b = nj.join_forests(f, f, True)
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(len(sets)) for j in range(i) for x in [len(np.intersect1d(sets[i], sets[j]))] if 100 * x >= 80 * (n[i] + n[j] - x)}
    assert {(j, i) for i, j in want} <= got and len(got) < 0.5 * len(sets) ** 2 / 2


def test_blocks_across_a_width_step(spark):
    """One pair that just links per leader, in two blocks of one or two documents whose bitmaps differ in width."""
    r = np.random.default_rng(8)
    draw = lambda k: r.integers(0, 2**63, k).astype(np.uint64)
    rows = []
    for leader in range(400):
        both = draw(228)
        sets = [(1, np.r_[both, draw(22)]), (2, np.r_[both, draw(34)])]
        if leader % 2:
            sets += [(1, draw(250)), (2, draw(262))]
        assert len(both) * 100 >= 80 * (250 + 262 - len(both)) and len(nj.bitmap(sets[0][1])) < len(nj.bitmap(sets[1][1]))
        rows += [(leader, block, len(s), False, nj.bitmap(s).tobytes()) for block, s in sets]
    df = spark.createDataFrame(rows, "leader long, block long, n long, linked boolean, bits binary")
    tops = df.repartition(4, "leader").sortWithinPartitions("leader", "block").mapInArrow(nj.roots, nj.ROOT_KINDS)
    got = {r.leader for r in nj.block_pairs(tops).where("block_a = 1 and block_b = 2").collect()}
    assert got == set(range(400))


def test_empty(spark):
    assert nj.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
