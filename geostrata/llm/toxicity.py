"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Every word is an input with a word part and a character part. Both have learned embeddings, trained with the
network by back-propagation: one by hashed word, and the mean of those of the word's hashed character triples.
Beside them stand four counted numbers: how much more often documents with the word are toxic, the mean and
the maximum of the same over the word's triples, and its length. The network reads windows of 32 words in both
directions; attention pools the states of a window to its logit. All overlapping windows (a new one every 16
words, the last one flush with the end, so a phrase of up to 17 words is whole in one) of the whole text are
scored, and the largest logit, calibrated, is the text's.

Fitting uses at most ``per_class`` labelled documents of each class, chosen by hash, in two halves. Executors
count their words and triples in fixed tables by half; a document's counted numbers come from the other half
while the network learns and is calibrated, and from both when it scores. Executors pick from each document
the window with the largest such odds among all its windows, and of clean documents one other, and the driver
trains the network on those (Adam). A logistic fit of the sampled documents' largest logits, weighted to the
true class shares, calibrates scores.

Nulls and texts without words: one window without words, scored like others. Very long texts: all windows.
Rows whose label is null aren't learned from. Without labels of both classes every score is the share of
toxic ones (0 without any). Repeated rows each give a row. Empty tables give none. Further columns, whatever
their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.llm.arrowtext import Words, chunks, utf8

#: Hashed words and triples, words of a window, step between windows, states of each direction, sampled documents of a class.
WORD_SLOTS, TRIPLE_SLOTS, WINDOW, STEP, STATES, PER_CLASS = 1 << 16, 1 << 14, 32, 16, 6, 3000
#: Counted numbers and numbers of each embedding of a word.
COUNTED, EMBEDDED = 4, 4
INPUTS = COUNTED + 2 * EMBEDDED
WINDOWS_AT_ONCE, RARE = 4096, 6


def is_train(doc_id: Column) -> Column:
    """Whether a document may be learned from: crc32 of its id as text, modulo 5, is not 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


class Tokens:
    """Distinct words of a block of texts with hashed slots and triples, and each word's place among them."""

    def __init__(self, part: np.ndarray, o: np.ndarray) -> None:
        w = Words(part, o)
        self.first, self.count, self.row = w.first, w.count, w.row
        u, at, self.which = np.unique(w.hash, return_index=True, return_inverse=True)
        self.slot = (u >> np.uint64(48)).astype(np.int64)
        start, end = w.start[at], w.end[at]
        self.length = end - start
        n = self.length
        place = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        x = w.data[place].astype(np.uint32)
        before, after = np.r_[np.uint32(32), x[:-1]], np.r_[x[1:], np.uint32(32)]
        self.begin = np.cumsum(n) - n
        before[self.begin] = 32
        after[self.begin + n - 1] = 32
        mixed = (before * np.uint32(31) + x * np.uint32(1009) + after * np.uint32(65537)) * np.uint32(2654435761)
        self.triple = (mixed >> np.uint32(18)).astype(np.int64)


def clipped_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Log odds ratio of documents with a feature, smoothed; 0 for features of fewer than RARE documents."""
    odds = np.log(((toxic + 2) / (n_toxic + 4)) / ((clean + 2 * n_clean / max(1, n_toxic)) / (n_clean + 4 * n_clean / max(1, n_toxic))))
    return np.where(toxic + clean >= RARE, odds.clip(-4, 4), 0).astype(np.float32)


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(half, slot, toxic documents, clean documents): words first, then triples, then all documents."""
    total = np.zeros((2, 2, WORD_SLOTS + TRIPLE_SLOTS + 1), np.int64)
    for b in batches:
        data, off = utf8(b.column("text"))
        label, half = b.column("toxic").to_numpy(), b.column("half").to_numpy()
        for lo, hi, part, o in chunks(data, off):
            t = Tokens(part, o)
            for k in range(hi - lo):
                own = np.unique(t.which[t.first[k] : t.first[k + 1]])
                side = total[half[lo + k], 0 if label[lo + k] else 1]
                side[np.unique(t.slot[own])] += 1
                if len(own):
                    at = np.concatenate([np.arange(t.begin[i], t.begin[i] + t.length[i]) for i in own])
                    side[WORD_SLOTS + np.unique(t.triple[at])] += 1
                side[-1] += 1
    for h in (0, 1):
        at = np.flatnonzero(total[h].sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), h)), pa.array(at), pa.array(total[h, 0, at]), pa.array(total[h, 1, at])], ["half", "slot", "toxic", "clean"])


class Counted:
    """Tables of log odds by slot; gives the counted numbers of words."""

    def __init__(self, counts: np.ndarray) -> None:
        odds = clipped_odds(counts[0], counts[1], *counts[:, -1])
        self.words, self.triples = odds[:WORD_SLOTS], odds[WORD_SLOTS:-1]

    def of(self, t: Tokens) -> np.ndarray:
        out = np.zeros((len(t.slot), COUNTED), np.float32)
        if len(t.slot):
            x = self.triples[t.triple]
            out[:, 0] = self.words[t.slot]
            out[:, 1] = np.add.reduceat(x, t.begin) / t.length
            out[:, 2] = np.maximum.reduceat(x, t.begin)
            out[:, 3] = np.minimum(t.length, 30) / 10
        return out


def windows(count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of every window of texts with so many words; a text without words has one."""
    extra = np.maximum(0, -(-(count - WINDOW) // STEP))
    n = extra + 1
    text = np.repeat(np.arange(len(count)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    begin = np.minimum(k * STEP, np.maximum(0, count[text] - WINDOW))
    return text, first[text] + begin, np.minimum(WINDOW, count[text])


def gather(which: np.ndarray, begin: np.ndarray, size: np.ndarray, pad: int) -> np.ndarray:
    """Word numbers of windows, windows by places; pad where a window is short."""
    at = begin[:, None] + np.arange(WINDOW)
    ok = np.arange(WINDOW) < size[:, None]
    return np.where(ok, which[np.minimum(at, max(0, len(which) - 1))] if len(which) else pad, pad)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Two gated recurrent layers (forward, backward), attention over their states, one logit a window."""

    def __init__(self, seed: int = 1) -> None:
        r = np.random.default_rng(seed)
        h = STATES
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = r.normal(0, 0.4, (INPUTS, 3 * h)).astype(np.float32)
            self.p[f"h{d}"] = r.normal(0, 0.3, (h, 3 * h)).astype(np.float32)
            self.p[f"c{d}"] = np.zeros(3 * h, np.float32)
        self.p["u"] = r.normal(0, 0.3, 2 * h).astype(np.float32)
        self.p["w"] = r.normal(0, 0.3, 2 * h).astype(np.float32)
        self.p["o"] = np.zeros(1, np.float32)
        self.words, self.triples = (r.normal(0, 0.1, (n, EMBEDDED)).astype(np.float32) for n in (WORD_SLOTS, TRIPLE_SLOTS))

    def inputs(self, counted: np.ndarray, slot: np.ndarray, triple: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Inputs of words, then a row of zeros for padding. triple: of all words in turn, length of them each (0: no word)."""
        out = np.zeros((len(slot) + 1, INPUTS), np.float32)
        out[:-1, :COUNTED] = counted
        some = np.flatnonzero(length)
        if len(some):
            out[some, COUNTED : COUNTED + EMBEDDED] = self.words[slot[some]]
            begin = (np.cumsum(length) - length)[some]
            out[some, COUNTED + EMBEDDED :] = np.add.reduceat(self.triples[triple], begin) / length[some, None]
        return out

    def run(self, inputs: np.ndarray, idx: np.ndarray, keep: bool = False):
        """Logits of windows; inputs: rows for word numbers, the last for padding; keep: what backward() needs."""
        p, h, n = self.p, STATES, len(idx)
        pad = idx == len(inputs) - 1
        pad[:, 0] = False
        some = pad.any(axis=0)
        states = np.empty((WINDOW, n, 2 * h), np.float32)
        kept = {}
        for k, d in enumerate("fb"):
            projected = inputs @ p[f"x{d}"] + p[f"c{d}"]
            wz, wn = p[f"h{d}"][:, : 2 * h], p[f"h{d}"][:, 2 * h :]
            s = np.zeros((n, h), np.float32)
            steps = range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1)
            trail = []
            for t in steps:
                g = projected[idx[:, t]]
                rz = sigmoid(g[:, : 2 * h] + s @ wz)
                r, z = rz[:, :h], rz[:, h:]
                hn = s @ wn
                cand = np.tanh(g[:, 2 * h :] + r * hn)
                new = z * s + (1 - z) * cand
                if some[t]:
                    new[pad[:, t]] = s[pad[:, t]]
                if keep:
                    trail.append((t, s, r, z, hn, cand))
                s = new
                states[t, :, k * h : (k + 1) * h] = s
            kept[d] = trail
        e = states @ p["u"]
        e[pad.T] = -1e9
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", a, states)
        logit = pooled @ p["w"] + p["o"][0]
        return (logit, states, a, pooled, pad, kept) if keep else logit

    def backward(self, inputs: np.ndarray, idx: np.ndarray, y: np.ndarray, of_inputs: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy; of_inputs (windows, places, inputs) gets those of the inputs added."""
        p, h, n = self.p, STATES, len(idx)
        logit, states, a, pooled, pad, kept = self.run(inputs, idx, True)
        d = (sigmoid(logit) - y) / n
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["w"], g["o"][0] = pooled.T @ d, d.sum()
        dp = d[:, None] * p["w"]
        da = np.einsum("tnh,nh->tn", states, dp)
        de = a * (da - (a * da).sum(axis=0))
        g["u"] = np.einsum("tn,tnh->h", de, states)
        ds_all = a[:, :, None] * dp + de[:, :, None] * p["u"]
        for k, way in enumerate("fb"):
            wz, wn = p[f"h{way}"][:, : 2 * h], p[f"h{way}"][:, 2 * h :]
            carry = np.zeros((n, h), np.float32)
            for t, s, r, z, hn, cand in reversed(kept[way]):
                ds = carry + ds_all[t, :, k * h : (k + 1) * h]
                live = ~pad[:, t][:, None]
                dz, dc = ds * (s - cand) * z * (1 - z) * live, ds * (1 - z) * (1 - cand**2) * live
                dr = dc * hn * r * (1 - r)
                drz = np.concatenate([dr, dz], axis=1)
                dx = np.concatenate([drz, dc], axis=1)
                x = inputs[idx[:, t]]
                g[f"x{way}"] += x.T @ dx
                if of_inputs is not None:
                    of_inputs[:, t] += dx @ p[f"x{way}"].T
                g[f"c{way}"] += dx.sum(axis=0)
                g[f"h{way}"][:, : 2 * h] += s.T @ drz
                g[f"h{way}"][:, 2 * h :] += s.T @ (dc * r)
                carry = np.where(live, ds * z + drz @ wz.T + (dc * r) @ wn.T, ds)
        return g

    def train(self, data: Training, y: np.ndarray, rounds: int = 8, batch: int = 128, rate: float = 0.01) -> None:
        """Adam on the network and on the embeddings of the batch's words and triples."""
        r, m, v, t = np.random.default_rng(2), {}, {}, 0
        total = rounds * -(-len(y) // batch)
        params = self.p | {"words": self.words, "triples": self.triples}
        for _ in range(rounds):
            order = r.permutation(len(y))
            for at in range(0, len(y), batch):
                k, t = order[at : at + batch], t + 1
                counted, slot, triple, length = data.rows(k)
                inputs = self.inputs(counted, slot, triple, length)
                idx = np.arange(len(slot)).reshape(len(k), WINDOW)
                idx[data.short[k]] = len(slot)
                dx = np.zeros((len(k), WINDOW, INPUTS), np.float32)
                grads = self.backward(inputs, idx, y[k], dx)
                dx[data.short[k]] = 0
                dx = dx.reshape(-1, INPUTS)
                grads["words"], grads["triples"] = np.zeros_like(self.words), np.zeros_like(self.triples)
                some = np.flatnonzero(length)
                np.add.at(grads["words"], slot[some], dx[some, COUNTED : COUNTED + EMBEDDED])
                np.add.at(grads["triples"], triple, np.repeat(dx[some, COUNTED + EMBEDDED :] / length[some, None], length[some], axis=0))
                for name, grad in grads.items():
                    if name not in m:
                        m[name], v[name] = np.zeros_like(grad), np.zeros_like(grad)
                    m[name] += 0.1 * (grad - m[name])
                    v[name] += 0.01 * (grad**2 - v[name])
                    params[name] -= (rate * (1 - t / (total + 1)) / (1 - 0.9**t) * m[name] / (np.sqrt(v[name] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)


class Training:
    """Windows that the network learns from: counted numbers, slots and triples of their words."""

    def __init__(self, counted: list[bytes], slots: list[bytes], triples: list[bytes], lengths: list[bytes]) -> None:
        self.counted = np.stack([np.frombuffer(x, np.float32).reshape(WINDOW, COUNTED) for x in counted])
        self.slots = np.stack([np.frombuffer(x, np.int32) for x in slots])
        self.lengths = np.stack([np.frombuffer(x, np.int32) for x in lengths])
        self.triples = [np.frombuffer(x, np.int32) for x in triples]
        self.short = self.lengths == 0
        self.short[:, 0] = False

    def rows(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return self.counted[k].reshape(-1, COUNTED), self.slots[k].ravel(), np.concatenate([self.triples[i] for i in k]), self.lengths[k].ravel()


class Model:
    """Counted odds, network and calibration."""

    def __init__(self, counted: Counted) -> None:
        self.counted, self.network, self.slope, self.offset = counted, Network(), 1.0, 0.0

    def largest(self, part: np.ndarray, o: np.ndarray, counted: Counted | None = None) -> np.ndarray:
        """The largest logit over each text's windows."""
        t = Tokens(part, o)
        rows = self.network.inputs((counted or self.counted).of(t), t.slot, t.triple, t.length)
        text, begin, size = windows(t.count, t.first[:-1])
        logit = np.empty(len(text))
        for at in range(0, len(text), WINDOWS_AT_ONCE):
            k = slice(at, at + WINDOWS_AT_ONCE)
            logit[k] = self.network.run(rows, gather(t.which, begin[k], size[k], len(rows) - 1))
        return np.maximum.reduceat(logit, np.searchsorted(text, np.arange(len(t.count))))

    def calibrate(self, logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Logistic fit of labels on logits by Newton steps, slightly ridged."""
        x = np.stack([logit, np.ones_like(logit)], axis=1)
        b = np.array([1.0, 0.0])
        weight = weight / weight.sum()
        for _ in range(50):
            q = sigmoid(x @ b)
            grad = x.T @ (weight * (q - y)) + 1e-4 * b
            hess = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-4 * np.eye(2)
            step = np.linalg.solve(hess, grad)
            b -= step * min(1.0, 2.0 / (1e-12 + np.abs(step).max()))
        self.slope, self.offset = float(b[0]), float(b[1])


PICKED = ["counted", "slots", "triples", "lengths", "y"]


def suspects(halves: list[Counted]):
    """For mapInArrow: from each text the window with the largest word odds of the other half, and of a clean text one other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column("text"))
            label, half = b.column("toxic").to_numpy(), b.column("half").to_numpy()
            out: list[list] = [[] for _ in PICKED]
            for lo, hi, part, o in chunks(data, off):
                t = Tokens(part, o)
                text, begin, size = windows(t.count, t.first[:-1])
                start, pad = np.searchsorted(text, np.arange(hi - lo + 1)), len(t.slot)
                counted = [np.vstack([c.of(t), np.zeros((1, COUNTED), np.float32)]) for c in halves]
                best = np.empty((2, len(text)), np.float32)
                for at in range(0, len(text), WINDOWS_AT_ONCE):
                    k = slice(at, at + WINDOWS_AT_ONCE)
                    idx = gather(t.which, begin[k], size[k], pad)
                    best[:, k] = [c[idx, 0].max(axis=1) for c in counted]
                for k in range(hi - lo):
                    other = 1 - half[lo + k]
                    n = start[k + 1] - start[k]
                    top = int(best[other, start[k] : start[k + 1]].argmax())
                    chosen = [top] if label[lo + k] or n == 1 else [top, (top + 1 + k % (n - 1)) % n]
                    for c in chosen:
                        w = start[k] + c
                        idx = gather(t.which, begin[w : w + 1], size[w : w + 1], pad)[0]
                        real = idx[idx < pad]
                        lengths = np.zeros(WINDOW, np.int32)
                        lengths[: len(real)] = t.length[real]
                        slots = np.zeros(WINDOW, np.int32)
                        slots[: len(real)] = t.slot[real]
                        triples = np.concatenate([t.triple[t.begin[i] : t.begin[i] + t.length[i]] for i in real]) if len(real) else np.empty(0)
                        for o_, v in zip(out, (counted[other][idx].tobytes(), slots.tobytes(), triples.astype(np.int32).tobytes(), lengths.tobytes(), int(label[lo + k]))):
                            o_.append(v)
            yield pa.RecordBatch.from_arrays([*[pa.array(v, pa.binary()) for v in out[:4]], pa.array(out[4], pa.int32())], PICKED)

    return run


def sampled_logits(model: Model, halves: list[Counted]):
    """For mapInArrow: the largest logit of each text by the counts of the other half, and its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            half = b.column("half").to_numpy()
            for h in (0, 1):
                rows = b.filter(pa.array(half == h))
                data, off = utf8(rows.column("text"))
                out = [model.largest(part, o, halves[1 - h]) for _, _, part, o in chunks(data, off)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out) if out else np.empty(0)), rows.column("toxic")], ["logit", "toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | float:
    """Fit on documents (doc_id, text) and labels (doc_id, toxic); without both classes, the share of toxic ones."""
    rows = labels.where(is_train(F.col("doc_id")) & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if not (counts.get(0) and counts.get(1)):
        return counts.get(1, 0) / max(1, sum(counts.values()))
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, per_class / counts[1]))).otherwise(F.lit(min(1.0, per_class / counts[0])))
    some = rows.where(F.pmod(F.xxhash64(F.lit("toxicity"), F.col("doc_id")), F.lit(1_000_000)) < share * 1_000_000)
    some = some.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id")), F.lit(2)).cast("int"))
    # 2 x per_class ids a class at most, so broadcast; one row an id, so a repeated id doesn't fill the sample
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    some = some.distinct().withColumn("rank", rank).where(F.col("rank") <= 2 * per_class).drop("rank")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    texts = texts.groupBy("doc_id", "toxic", "half").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic", "half")
    got = texts.mapInArrow(count_features, "half long, slot long, toxic long, clean long").groupBy("half", "slot").agg(F.sum("toxic"), F.sum("clean")).collect()
    table = np.zeros((2, 2, WORD_SLOTS + TRIPLE_SLOTS + 1))
    for half, slot, toxic, clean in got:
        table[half, :, slot] = toxic, clean
    n_toxic, n_clean = table.sum(axis=0)[:, -1]
    if not (n_toxic and n_clean):
        return counts[1] / (counts[0] + counts[1])
    model, halves = Model(Counted(table.sum(axis=0))), [Counted(table[0]), Counted(table[1])]
    picked = texts.mapInArrow(suspects(halves), "counted binary, slots binary, triples binary, lengths binary, y int").toPandas().sort_values(["y", "slots", "counted"])
    model.network.train(Training(*[picked[c].tolist() for c in PICKED[:4]]), picked.y.to_numpy(np.float32))
    logits = texts.mapInArrow(sampled_logits(model, halves), "logit double, toxic int").toPandas().sort_values(["toxic", "logit"])
    y = logits.toxic.to_numpy(float)
    model.calibrate(logits.logit.to_numpy(), y, np.where(y == 1, counts[1] / n_toxic, counts[0] / n_clean))
    return model


def score(docs: DataFrame, model: Model | float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted of each row."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column("text"))
            if isinstance(model, Model):
                out = [sigmoid(model.slope * model.largest(part, o) + model.offset) for _, _, part, o in chunks(data, off)]
                p = np.concatenate(out) if out else np.empty(0)
            else:
                p = np.full(len(b), float(model))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
