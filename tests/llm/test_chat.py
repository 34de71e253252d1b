"""Role repair against a brute force over all legal sequences, and across segments."""

import itertools
import random

import pytest

from geostrata.llm import chat

NAMES = ["system", "user", "assistant"]


def brute(roles):
    """Least cost over every assignment of the turns to repaired turns."""
    best = chat.FAR
    for labels in itertools.product((1, 2, 3), repeat=len(roles)):
        for merged in itertools.product((False, True), repeat=len(roles)):
            cost, at = 0, 0
            for r, q, m in zip(roles, labels, merged):
                cost += 0 if q == r else (chat.RELABEL if r else chat.NAME)
                if m:
                    if at != q:
                        cost = chat.FAR
                        break
                    cost += chat.MERGE
                else:
                    ins = dict(chat.FOLLOW[at]).get(q)
                    if ins is None:
                        cost = chat.FAR
                        break
                    cost += chat.INSERT * len(ins)
                at = q
            if cost < chat.FAR:
                best = min(best, cost + chat.INSERT * len(chat.CLOSING[at]))
    return best


def cost_of(roles, steps):
    cost, at = 0, 0
    for r, (q, m, ins) in zip(roles, steps):
        cost += (0 if q == r else (chat.RELABEL if r else chat.NAME)) + (chat.MERGE if m else chat.INSERT * len(ins))
        at = q
    return cost + chat.INSERT * len(chat.CLOSING[at])


def test_cost_is_least():
    rng = random.Random(3)
    for n in range(1, 6):
        for _ in range(25):
            roles = [rng.randrange(4) for _ in range(n)]
            assert cost_of(roles, chat.trace(roles, 0, None)) == brute(roles)


def test_cut_equals_whole():
    rng = random.Random(4)
    for _ in range(50):
        roles = [rng.randrange(4) for _ in range(30)]
        parts = [roles[i : i + 7] for i in range(0, 30, 7)]
        ends = chat.boundaries([chat.matrix(p) for p in parts])
        steps = [s for p, (a, b) in zip(parts, ends) for s in chat.trace(p, a, b)]
        assert cost_of(roles, steps) == cost_of(roles, chat.trace(roles, 0, None))


def legal(roles):
    roles = roles[1:] if roles[:1] == ["system"] else roles
    return all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles)) and len(roles) % 2 == 0


def test_long_conversation_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 8)
    rng = random.Random(5)
    rows = [(1, t, rng.choice(NAMES + [None, "Human"]), f"a{t}") for t in range(60)]
    rows += [(2, t, "user", f"b{t}") for t in range(30)]
    rows += [(None, None, None, None), (3, 0, "user", "x"), (3, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = chat.repair(df).orderBy("conv_id", "out_turn", "piece").collect()
    for c in (1, 2, 3, None):
        mine = [r for r in got if r.conv_id == c]
        heads = [r for r in mine if r.piece == 0]
        assert legal([r.role for r in heads])
        assert [r.out_turn for r in heads] == list(range(len(heads)))
        text = "".join(r.rendered for r in mine)
        assert text.count("<|end|>") == len(heads)
    two = "".join(r.rendered for r in got if r.conv_id == 2)
    assert two == "<|user|>\n" + "\n".join(f"b{t}" for t in range(30)) + "<|end|>\n<|assistant|>\n<|end|>\n"
    assert sum(r.n_merged for r in got) == len(rows)


@pytest.mark.parametrize("segment", [8, 4096])
def test_rows_do_not_depend_on_partitions(spark, monkeypatch, segment):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    rng = random.Random(6)
    rows = [(c, t, ("user", "user", "assistant")[t], f"{'ab'[t % 2]}") for c in range(1000) for t in range(3)]
    rows += [(5000, t, rng.choice(NAMES + [None]), f"t{t}") for t in range(600)] + [(None, t % 3, "user", "same") for t in range(100)]
    df = spark.createDataFrame([(*r, "clash", "clash", 1, 2) for r in rows], "conv_id long, turn int, role string, text string, conv string, SEG string, place int, k int")
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (1, 4, 7, 13):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = sorted(map(str, chat.repair(df.repartition(n)).collect()))
            assert sum("conv_id=5000" not in r and "conv_id=None" not in r for r in got) == 2000
            seen.add(tuple(got))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert len(seen) == 1


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.repair(df).count() == 0
