"""Line templates, decontamination and mixing: SQL twins, brute force and odd inputs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geostrata.llm import decontamination, line_templates, mixing, queries
from tests.harness import compare

SCHEMA = "doc_id long, text string, source string, n_lines string, size string, item string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", "clash", "clash") for i, t, s in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twins(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", queries.QUERIES[name], queries.SQL[name]) == ""


def test_mask_hits_every_window():
    masks = decontamination.MASKS
    for subs in itertools.combinations(range(decontamination.WINDOW), decontamination.WINDOW - decontamination.LEAST):
        assert any(all(o + i not in subs for i in m) for m in masks for o in range(decontamination.WINDOW - m[-1]))


def brute_leaks(texts, items):
    out = {}
    for d, t in texts:
        w = (t or "").lower().split()
        for i, s in items:
            x = (s or "").lower().split()
            n = min(13, len(x))
            best = 0
            for start in range(-len(x), len(w)):
                same = [0 <= start + k < len(w) and w[start + k] == x[k] for k in range(len(x))]
                best = max([best, *(sum(same[k : k + n]) for k in range(len(x) - n + 1))])
            if n and best >= (11 if len(x) >= 13 else n):
                out[d, i] = best
    return out


def test_leaks_against_brute_force(spark):
    passage = [f"w{k}" for k in range(20)]
    two, three = passage.copy(), passage[:13]
    two[4], two[11], three[2], three[6], three[9] = "a", "b", "a", "b", "c"
    texts = [(1, "x y " + " ".join(passage) + " z"), (2, "x " + " ".join(two)), (3, " ".join(three)), (4, "hello short Item here"), (5, None), (6, ""), (7, " ".join(passage[:12])), (8, "q " * 3000 + " ".join(passage)), (9, "one"), (9, "one")]
    items = [(1, " ".join(passage)), (2, "short item"), (3, None), (4, ""), (5, "one"), (6, "a b c d e f g h i")]
    df = docs(spark, [(i, t, "s") for i, t in texts])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_equal for r in decontamination.leaks(df, bench).collect()}
    assert got == brute_leaks(texts, items)
    assert (3, 1) not in got and (2, 1) in got
    old, decontamination.MAX_BROADCAST_BYTES = decontamination.MAX_BROADCAST_BYTES, 0
    try:
        assert {(r.doc_id, r.item_id): r.n_equal for r in decontamination.leaks(df, bench).collect()} == got
    finally:
        decontamination.MAX_BROADCAST_BYTES = old
    assert decontamination.leaks(df.limit(0), bench).count() == 0 == decontamination.leaks(df, bench.limit(0)).count()


def test_many_rows_without_an_id_on_both_paths(spark, monkeypatch):
    """A hit of one of many rows of a null or repeated id is verified in its own row only."""
    passage = " ".join(f"w{k}" for k in range(20))
    df = docs(spark, [(None if k % 2 else 5, f"{k} {passage}" if k % 50 < 2 else f"{k} x y z", "s") for k in range(2000)])
    bench = spark.createDataFrame([(None, passage), (None, "z z z"), (2, passage + " more"), (2, "5 x")], "item_id long, text string")
    want = {(None, None): 13, (5, None): 13, (None, 2): 13, (5, 2): 13}
    for most in (64_000_000, 0):
        monkeypatch.setattr(decontamination, "MAX_BROADCAST_BYTES", most)
        assert {(r.doc_id, r.item_id): r.n_equal for r in decontamination.leaks(df, bench).collect()} == want
    out = decontamination.leaks(df, bench)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "doc_row" in plan


def test_templates(spark):
    line = "Served page {} to the client at node {} in due time today ok"
    rows = [(1, "Only here\n" + line.format(1, 7), "s"), (2, line.format(22, 7) + "\nmine alone", "s"), (3, "\n" + line.format(333, 7), "s"), (4, "Served page 5 to the client at other 7 in due time today ok", "s"), (5, None, "s"), (6, "", "s"), (7, "a b\na b", "s"), (8, "a b", "s"), (9, "a b\n\nlast", "s"), (9, "a b\n\nlast", "s")]
    got = {r.doc_id: r for r in line_templates.drop_recurring(docs(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "mine alone" and got[3].text == "" and got[4].text == ""
    assert got[5].text is None and got[6].text == "" and got[5].n_lines == 0
    assert got[7].text == "a b\na b" and got[8].text == "" and got[9].text == "\nlast"
    assert line_templates.drop_recurring(docs(spark, rows)).count() == len(rows)
    assert line_templates.drop_recurring(docs(spark, []).limit(0)).count() == 0


def test_words_and_their_number(spark):
    lines = ["a", "a b", "a  b", " a b ", "a\tb c", "\ta\x0bb\r", "\u00e9 \u4e2d\u6587 \U0001f600", "x1 22 3.5"]
    df = spark.createDataFrame([(x,) for x in lines], "x string").select("x", line_templates.trimmed(line_templates.spaced(line_templates.folded(F.col("x")))).alias("t"))
    want = {"a  b": ["a", "", "b"], "a\tb c": ["a", "b", "c"], "\ta\x0bb\r": ["a\x0bb"], "x1 22 3.5": ["x0", "0", "0.0"]}
    for r in df.select("x", line_templates.words(F.col("t")).alias("w"), line_templates.n_words(F.col("t")).alias("n")).collect():
        assert r.w == want.get(r.x, r.x.split()) and r.n == len(r.w)


def test_fields_are_learned_in_their_leaf(spark):
    """Two variable words in different places of one line; a varied copy of a line that recurs whole; two templates in one leaf."""
    name = lambda k: "abcdefghij"[k // 10 % 10] + "klmnopqrst"[k % 10]
    log = [(k, f"the user named {name(k)} has logged in from the host {name(3 * k)} at noon today", "s") for k in range(1, 41)]
    exact = [(k, "we thank all of our readers for their many kind letters again", "s") for k in range(50, 55)] + [(60, "we thank all of our writers for their many kind letters again", "s")]
    two = [(k, f"the cat sat {name(k)} on the old mat in front of it" if k % 2 else f"the cat sat {name(k)} by a new door and it was red", "s") for k in range(70, 90)]
    clean = [(k, " ".join(["one two three"] + [f"{name(7 * k + 13 * j)}{name(k)}" for j in range(8)]), "s") for k in range(100, 140)]
    few = [(k, f"only two of these {name(k)} lines can be found in here", "s") for k in (200, 201)]
    null = [(None, f"the user named {name(k)} has logged in from the host {name(k + 5)} at noon today", "s") for k in range(90, 93)]
    rows = log + exact + two + clean + few + null
    got = line_templates.drop_recurring(docs(spark, rows)).collect()
    dropped = {r.doc_id for r in got if r.n_dropped}
    assert dropped == {*range(2, 41), *range(51, 55), 60, *range(72, 90)}
    assert all(r.text == "" for r in got if r.n_dropped) and sum(r.doc_id is None and r.text != "" for r in got) == 3


def many_templates():
    """Seven templates with fields in one leaf, of three documents and more, and lines that have at most two documents around them."""
    name = lambda k: "abcdefghij"[k // 10 % 10] + "klmnopqrst"[k % 10]
    own = lambda t: " ".join(f"{'stuvwxy'[t]}{name(10 * t + j)}" for j in range(7))
    rows, want = [], set()
    for t in range(7):
        ids = [100 * t + j for j in range(3 + t)]
        rows += [(i, f"we found that {own(t)} {name(i)}", "s") for i in ids]
        want |= set(ids[1:])
    pair = " ".join(name(80 + j) * 2 for j in range(7))
    return rows + [(1000 + j, f"we found that {pair} {name(j)}", "s") for j in range(2)], want


@pytest.mark.parametrize("cores", [1, 32])
def test_every_template_of_a_leaf(spark, monkeypatch, cores):
    rows, want = many_templates()
    monkeypatch.setattr(line_templates, "CORES", cores, raising=False)
    assert {r.doc_id for r in line_templates.drop_recurring(docs(spark, rows)).collect() if r.n_dropped} == want


def test_lines_of_a_core_that_failed_are_tried_again(spark):
    """The line with the most common words has one line around it, and that one, tried later, has three."""
    name = lambda k: "abcdefghij"[k // 10 % 10] + "klmnopqrst"[k % 10]
    core = "p q r s t u v".split()
    rows = [(1, "it is known p q r s t u v", "s"), (2, "it is known p q r g h i v", "s"), (3, "it is known a b c g h i v", "s"), (4, "it is known a q c g h i w", "s")]
    common = [(10 + k, " ".join(["it is known", *(w if j == k % 7 else f"{name(k)}{'abcdefg'[j]}" for j, w in enumerate(core))]), "s") for k in range(35)]
    assert {r.doc_id for r in line_templates.drop_recurring(docs(spark, rows + common)).collect() if r.n_dropped} == {2, 3, 4}


def test_copies_and_lines_that_repeat_in_a_document(spark):
    line = "a line that is said again and again by {} alone"
    rows = [(1, "\n".join(line.format(x) for x in ("ann", "bob", "carl", "dora")), "s"), (2, line.format("eve"), "s")]
    assert sum(r.n_dropped for r in line_templates.drop_recurring(docs(spark, rows)).collect()) == 0
    # rows that repeat an id and a text count as documents; a line that recurs whole keeps its own first copy
    more = rows + [(2, line.format("eve"), "s")] * 2 + [(3, line.format("finn") + "\nand more", "s")]
    assert {(r.doc_id, r.n_dropped) for r in line_templates.drop_recurring(docs(spark, more)).collect()} == {(1, 0), (2, 0), (3, 1)}


def test_line_dedup_keeps_columns_of_any_name(spark):
    base = docs(spark, [(k, "same line in all of them\nown " + "abcdef"[k], "s") for k in range(6)]).withColumn("n_chars", F.length("text"))
    names = ["__n_lines", "__n_dropped", "__n_cut", "__key", "__gone", "dkey", "rid", "place", "leaf", "whole", "f", "l", "line"]
    odd = base.withColumns({n: F.lit(7) for n in names})
    out = corpus_pipeline.drop_recurring_lines(spark, odd, "")
    assert out.columns == odd.columns
    rows = out.collect()
    assert len(rows) == 6 and all(r[n] == 7 for r in rows for n in names) and sum("same" in r.text for r in rows) == 1
    assert all(r.n_chars == len(r.text) for r in rows)


def test_marks_in_texts(spark):
    """Texts that hold the mark have no pieces and lose no character."""
    part = "This sentence of ours is a long one. " * 12
    rows = [(k, f"{part}\x01 {'own ' * (k + 1)}end. {part}\nthe last line here", "s") for k in range(4)] + [(9, f"x\x01y\n{part}", "s")]
    got = {r.doc_id: r for r in line_templates.drop_recurring(docs(spark, rows)).collect()}
    for k in range(1, 4):
        assert got[k].n_cut == 0 and got[k].text == rows[k][1].split("\n")[0]
    assert got[9].text == rows[4][1]


def test_texts_are_folded_once(spark):
    """No filter folds or marks texts that a projection folds as well, and null and empty texts give no lines."""
    rows = [(1, None, "s"), (2, "", "s"), (3, "A 12\n\n b\x01 ", "s"), (4, "a 7\n \nb\x02", "s")]
    lined = line_templates.hashed_lines(docs(spark, rows))
    plan = lined._jdf.queryExecution().executedPlan().toString().split("\n")
    assert len([x for x in plan if "regexp_replace" in x]) == 1 and not [x for x in plan if "Filter" in x and "regexp_replace" in x]
    got = lined.collect()
    assert sorted((r.doc_id, r.place >> line_templates.SHIFT) for r in got) == [(3, 0), (3, 2), (4, 0), (4, 2)]
    assert len({r.whole for r in got}) == 2


def test_passages_in_longer_lines(spark):
    passage = " ".join(f"Word{k} of sentence {k} stands {'x' * (i % 3)} here and is meant." for i, k in enumerate("abcdefghij"))
    own = lambda k: " ".join(f"Only {k} has {i * 7} such {'yz' * i} words{k} in its own{i} line." for i in range(8))
    rows = [(i, f"{own(f'doc{i}a')} {passage} {own(f'doc{i}b')}\nlast {'abcde'[i]}", "s") for i in range(1, 5)]
    rows = [(i, t.replace("doc", "abcde"[i]).replace("its own3 line. ", "its own3 line.\t"), s) for i, t, s in rows] + [(9, " ".join(["one"] * 5000), "s"), (10, "." * 400, "s")]
    got = {r.doc_id: r for r in line_templates.drop_recurring(docs(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[1].n_cut == 0
    for i, t, _ in rows[1:4]:
        text = got[i].text
        assert got[i].n_cut > 0 and got[i].n_dropped == 0 and text.endswith(f"\nlast {'abcde'[i]}")
        lost = len(t.split()) - len(text.split())
        assert 0.6 * len(passage.split()) <= lost <= len(passage.split())
        assert all(w in text.split() for w in own(f"doc{i}a".replace("doc", "abcde"[i])).split()[:40])
    assert got[9].text == rows[4][1] and got[10].text == rows[5][1]


def plain_fill(sizes, weights, budget, cap):
    target, total = {}, budget * sum(sizes.values())
    open_ = set(sizes)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weights[s] / sum(weights[k] for k in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
        open_ -= over
    return target


def test_water_level_and_samples(spark):
    rows = [(i, "w " * (1 + (i * 37) % 50), f"s{i % 7}" if i % 11 else None) for i in range(3000)]
    rows += [(5000, None, "s1"), (5001, "", "s2"), (5002, "\t\n", "s9"), (1, "again here", "s1"), (1, "again here", "s1")]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    names = sorted({r[2] for r in rows if r[2]}) + [None]
    sizes = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in names}
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want = plain_fill(sizes, weights, 1.5, 2)
    for s in names:
        own = [r for r in got if r.source == s]
        assert own[0].source_size == sizes[s] and abs(own[0].target - want[s]) < 1e-6 * max(1, want[s])
        assert abs(sum(r.taken for r in own) - want[s]) <= 60
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    again = mixing.mix(docs(spark, rows[::-1])).collect()
    assert sorted(map(tuple, [(r.doc_id, r.size, r.taken) for r in got])) == sorted(map(tuple, [(r.doc_id, r.size, r.taken) for r in again]))
    assert mixing.mix(docs(spark, rows).limit(0)).count() == 0
    assert mixing.mix(docs(spark, [(1, None, None)])).first().taken == 0


@pytest.mark.parametrize("ids", ["third", "all", "one"])
def test_targets_with_null_and_repeated_ids(spark, ids):
    of = {"third": lambda i: None if i % 3 == 0 else i, "all": lambda i: None, "one": lambda i: 7 if i % 3 == 0 else i}[ids]
    rows = [(of(i), f"w{i} " * (1 + (i * 37) % 50), f"s{i % 5}") for i in range(3000)]
    got = mixing.mix(docs(spark, rows)).collect()
    sums = {}
    for r in got:
        n, t, k = sums.get(r.source, (0, 0, 0))
        sums[r.source] = n + r.taken, r.target, k + (r.taken % r.size > 0)
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    # rows taken in part are those of one bucket; each loses less than a word
    assert all(abs(n - t) <= k + 1 and k < 10 for n, t, k in sums.values())
    again = mixing.mix(docs(spark, rows[::-1]).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing_ignores_columns_of_any_name(spark):
    df = docs(spark, [(k, "a b c", "s") for k in range(20)]).withColumns({n: F.lit("x") for n in ("target", "b1", "B2", "source_key", "words", "taken", "digest")})
    assert sum(r.taken for r in mixing.mix(df).collect()) == 90


def test_nothing_recurs_in_what_is_left(spark, monkeypatch):
    """Overlapping templates in one leaf, three cores a round: at the end no line has lines of three documents around it, by brute force."""
    rng = np.random.default_rng(4)
    rows = [(k, "one two three " + " ".join(f"{'abc'[i]}{place}x" for place, i in zip("abcdefghi", rng.integers(0, 3, 9))), "s") for k in range(36)]
    monkeypatch.setattr(line_templates, "CORES", 3)
    left, plain = [], line_templates.cores_of
    monkeypatch.setattr(line_templates, "cores_of", lambda pool, n: (left.append([r.words for r in pool.select("words").collect()]), plain(pool, n))[1])
    dropped = sum(r.n_dropped for r in line_templates.drop_recurring(docs(spark, rows)).collect())
    near = lambda a, b: 10 * sum(x == y for x, y in zip(a, b)) >= 7 * len(a)
    around = [max(sum(near(a, b) for b in pool) for a in pool) for pool in left]
    assert dropped > 3 and len(left) > 1 and around[0] >= 3 and around[-1] < 3
