"""Gradients against differences, window coverage, held-out quality, odd inputs."""

import numpy as np
from pyspark.sql import functions as F

from geostrata.llm import toxicity
from geostrata.session import table


def test_gradients():
    r = np.random.default_rng(5)
    net = toxicity.Network(3)
    inputs = np.vstack([r.normal(size=(40, toxicity.INPUTS)), np.zeros((1, toxicity.INPUTS))]).astype(np.float32)
    idx = r.integers(0, 40, (6, toxicity.WINDOW))
    idx[2, 10:] = 40
    y = np.array([0, 1, 1, 0, 1, 0], np.float32)

    def loss():
        q = toxicity.sigmoid(net.run(inputs, idx.copy()).astype(float))
        return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))

    for name, g in net.backward(inputs, idx.copy(), y).items():
        flat = net.p[name].reshape(-1)
        for k in r.choice(flat.size, min(4, flat.size), replace=False):
            old, eps = flat[k], 1e-2
            flat[k] = old + eps
            up = loss()
            flat[k] = old - eps
            down = loss()
            flat[k] = old
            assert abs((up - down) / (2 * eps) - g.reshape(-1)[k]) < 3e-3, name


def test_windows_cover_all_words():
    count = np.array([0, 1, 31, 32, 33, 56, 57, 1000])
    first = np.r_[0, np.cumsum(count)[:-1]]
    text, begin, size = toxicity.windows(count, first)
    for k, n in enumerate(count):
        seen = np.zeros(n, bool)
        for b, s in zip(begin[text == k] - first[k], size[text == k]):
            assert b >= 0 and b + s <= n
            seen[b : b + s] = True
        assert seen.all()


def test_gradients_of_inputs():
    r = np.random.default_rng(6)
    net = toxicity.Network(4)
    inputs = np.vstack([r.normal(size=(2 * toxicity.WINDOW, toxicity.INPUTS)), np.zeros((1, toxicity.INPUTS))]).astype(np.float32)
    idx = np.arange(2 * toxicity.WINDOW).reshape(2, -1)
    y, dx = np.array([0, 1], np.float32), np.zeros((2, toxicity.WINDOW, toxicity.INPUTS), np.float32)
    net.backward(inputs, idx.copy(), y, dx)

    def loss():
        q = toxicity.sigmoid(net.run(inputs, idx.copy()).astype(float))
        return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))

    for k in r.choice(2 * toxicity.WINDOW, 6, replace=False):
        for i in range(toxicity.INPUTS):
            old = inputs[k, i]
            inputs[k, i] = old + 1e-2
            up = loss()
            inputs[k, i] = old - 1e-2
            down = loss()
            inputs[k, i] = old
            assert abs((up - down) / 2e-2 - dx.reshape(-1, toxicity.INPUTS)[k, i]) < 3e-3


def test_score_by_plain_loops():
    """The largest logit of a text, word by word and window by window."""
    import re

    net = toxicity.Network(9)
    model = toxicity.Model(toxicity.Counted(np.random.default_rng(1).integers(0, 50, (2, toxicity.WORD_SLOTS + toxicity.TRIPLE_SLOTS + 1)).astype(float)))
    model.network = net
    text = " ".join(f"word{k * k % 17} x{k}" for k in range(40))
    data, o = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    words, t = re.findall(r"[^ ]+", text), toxicity.Tokens(data, o)
    counted, x = model.counted.of(t), []
    for k, w in enumerate(words):
        i = t.which[k]
        triples = t.triple[t.begin[i] : t.begin[i] + len(w)]
        x.append(np.concatenate([counted[i], net.words[t.slot[i]], np.mean([net.triples[q] for q in triples], axis=0)]))
    best, h, p = -np.inf, toxicity.STATES, net.p
    for begin in sorted({min(b, len(words) - 32) for b in range(0, len(words) - 32 + toxicity.STEP, toxicity.STEP)}):
        states = np.zeros((32, 2 * h))
        for d, order in (("f", range(32)), ("b", range(31, -1, -1))):
            s = np.zeros(h)
            for k in order:
                g = x[begin + k] @ p[f"x{d}"] + p[f"c{d}"]
                r, z = np.split(toxicity.sigmoid(g[: 2 * h] + s @ p[f"h{d}"][:, : 2 * h]), 2)
                s = z * s + (1 - z) * np.tanh(g[2 * h :] + r * (s @ p[f"h{d}"][:, 2 * h :]))
                states[k, (0 if d == "f" else h) : (h if d == "f" else 2 * h)] = s
        a = np.exp(states @ p["u"])
        best = max(best, float((a / a.sum()) @ states @ p["w"] + p["o"][0]))
    assert abs(model.largest(data, o)[0] - best) < 1e-4


def test_odd_columns_and_no_documents(spark):
    docs = spark.createDataFrame([(k, "bad ugly word" if k % 3 == 0 else "good fine word", 1, 0.5) for k in range(90)], "doc_id long, text string, toxic int, score double")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), "x") for k in range(90)], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert got == {k: int(k % 3 == 0) for k in range(90)}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.fit(docs, labels)
    held = docs.join(labels.where(~toxicity.is_train(F.col("doc_id"))), "doc_id")
    got = toxicity.score(held, model).join(labels, "doc_id").toPandas()
    rank = got.score.rank()
    n1, n0 = (got.toxic == 1).sum(), (got.toxic == 0).sum()
    assert (rank[got.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.85
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (4, "a b " * 60_000), (4, "a b " * 60_000)], "doc_id long, text string")
    odd = toxicity.score(odd, model).collect()
    assert len(odd) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, none) == 0
    assert toxicity.score(docs, 0.0).first().score == 0
