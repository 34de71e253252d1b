"""Language identification by hierarchical discrimination.

A text is first given to a language family, then to a language of that family. Both levels decide by
one-versus-one linear support vector machines: families against each other, and within a family each
pair of its closely related languages. Features are relative frequencies of hashed byte pairs and
triples of the whole lower-cased text, so a margin is a mean of weights over the text's n-grams and is
computed in one pass without any vector per document.

The machines (squared hinge loss, full-batch accelerated descent) are fitted on the driver on at most
``per_language`` labelled documents a language, chosen by hash. Margins become probabilities by a
logistic fit on the same documents. The score is the least probability among the duels that the
predicted language won.

Families of common languages are fixed values; a language outside them joins the family of the
language whose mean features are nearest. Text without a letter, or null, is ``und`` with score 0.
If no labelled text exists, every text is ``und``. Very long texts are read whole. Null ids are never
learned from. Repeated rows each give a row; empty tables none. Columns that have the names of the results
are replaced by them; other names can be given.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.llm.arrowtext import FOLD, chunks, utf8
from geostrata.llm.columns import fresh

#: Families by language code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "uralic": "fi et hu".split(),
    "indic": "hi bn mr ur ne gu pa".split(),
    "turkic": "tr az kk uz ky".split(),
    "semitic": "ar he am mt".split(),
    "sinitic": "zh yue".split(),
}
FAMILY_OF = {code: f for f, codes in FAMILIES.items() for code in codes}
DIMENSIONS, PER_LANGUAGE = 4096, 300


def gram_columns(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature of the byte pair and of the triple that begin at each byte."""
    x = FOLD[data].astype(np.uint32)
    pair = x.copy()
    pair[:-1] += x[1:] << np.uint32(8)
    triple = pair.copy()
    triple[:-2] += x[2:] << np.uint32(16)
    fold = lambda v: ((v * np.uint32(2654435761)) >> np.uint32(32 - 11)).astype(np.int32)
    return fold(pair), fold(triple) + DIMENSIONS // 2


def grams(data: np.ndarray) -> np.ndarray:
    """The same, two columns."""
    return np.stack(gram_columns(data), axis=1)


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, h, and the relative frequencies of a text's features as packed float32."""
    for b in batches:
        data, off = utf8(b.column("text"))
        out = []
        for lo, hi, part, o in chunks(data, off):
            g = grams(part)
            for k in range(hi - lo):
                own = g[o[k] : o[k + 1]]
                x = np.bincount(own.ravel(), minlength=DIMENSIONS) / max(1, len(own))
                out.append(x.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), pa.array(out, pa.binary())], ["lang", "h", "x"])


def fit_duel(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> tuple[np.ndarray, float, float]:
    """Weights, bias and logistic slope of a linear SVM with squared hinge loss on rows x and signs y."""
    n = len(x)
    weight = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    w, b, v, vb, t = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0, 1.0
    rate = 1.0 / (1.0 + 2 * c * float(np.mean(np.einsum("ij,ij->i", x, x)) + 1))
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v + np.float32(vb))) * weight
        g = v - np.float32(2 * c / n) * (x.T @ (slack * y).astype(np.float32))
        gb = -(2 * c / n) * float((slack * y).sum())
        w2, b2, t2 = v - np.float32(rate) * g, vb - rate * gb, (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + np.float32((t - 1) / t2) * (w2 - w), b2 + ((t - 1) / t2) * (b2 - b)
        w, b, t = w2, b2, t2
    m = y * (x @ w + b)
    slopes = np.geomspace(0.5, 32, 25)
    slope = slopes[int(np.argmin([np.mean(np.logaddexp(0, -s * m)) for s in slopes]))]
    return w, float(b), float(slope)


class Model:
    """Families, languages and the duels between them."""

    def __init__(self, langs: np.ndarray, x: np.ndarray) -> None:
        self.langs = sorted(set(langs))
        means = {a: x[langs == a].mean(axis=0) for a in self.langs}
        known = [a for a in self.langs if a in FAMILY_OF]
        self.family = {a: FAMILY_OF.get(a) or (FAMILY_OF[min(known, key=lambda k: float(np.abs(means[k] - means[a]).sum()))] if known else "other") for a in self.langs}
        fam = np.array([self.family[a] for a in langs])
        scale = (1.0 / (x.std(axis=0) + 1e-4)).astype(np.float32) / np.float32(np.sqrt(x.shape[1]))
        self.duels: list[tuple[str, str]] = []
        weights, self.bias, self.slope = [], [], []

        def add(a: str, b: str, of: np.ndarray) -> None:
            use = (of == a) | (of == b)
            w, bias, slope = fit_duel(x[use] * scale, np.where(of[use] == a, 1.0, -1.0).astype(np.float32))
            self.duels.append((a, b))
            weights.append(w * scale)
            self.bias.append(bias)
            self.slope.append(slope)

        families = sorted(set(self.family.values()))
        for a, b in combinations(families, 2):
            add(f"family {a}", f"family {b}", np.char.add("family ", fam))
        for f in families:
            for a, b in combinations([k for k in self.langs if self.family[k] == f], 2):
                add(a, b, langs)
        self.weights = np.stack(weights, axis=1).astype(np.float32) if weights else np.zeros((DIMENSIONS, 0), np.float32)

    def margins(self, part: np.ndarray, o: np.ndarray) -> np.ndarray:
        """One margin a duel for each text."""
        n = np.diff(o)
        out = np.zeros((len(n), len(self.duels)))
        if len(part) and self.duels:
            g = grams(part)
            full = np.flatnonzero(n)
            for d in range(len(self.duels)):
                w = np.ascontiguousarray(self.weights[:, d])
                out[full, d] = np.add.reduceat(w[g[:, 0]] + w[g[:, 1]], o[full], dtype=np.float64)
        return out / np.maximum(1, n)[:, None] + np.array(self.bias)

    def winners(self, m: np.ndarray, among: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the index in among that wins most duels (then the larger sum of margins), and its least probability."""
        votes, sure = np.zeros((len(m), len(among))), np.ones((len(m), len(among)))
        for d, (a, b) in enumerate(self.duels):
            if a in among and b in among:
                i, j = among.index(a), among.index(b)
                p = 1 / (1 + np.exp(-np.clip(self.slope[d] * m[:, d], -30, 30)))
                votes[:, i] += (p >= 0.5) + p / 1000
                votes[:, j] += (p < 0.5) + (1 - p) / 1000
                sure[:, i] = np.minimum(sure[:, i], p)
                sure[:, j] = np.minimum(sure[:, j], 1 - p)
        best = votes.argmax(axis=1)
        return best, sure[np.arange(len(m)), best]

    def predict(self, part: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = self.margins(part, o)
        families = sorted(set(self.family.values()))
        fam, sure = self.winners(m, [f"family {f}" for f in families])
        lang = np.empty(len(m), object)
        for k, f in enumerate(families):
            use, names = fam == k, [a for a in self.langs if self.family[a] == f]
            best, p = self.winners(m[use], names)
            lang[use] = np.array(names, object)[best]
            sure[use] = np.minimum(sure[use], p)
        return lang, sure


def is_train(doc_id: Column) -> Column:
    """Whether a document may be learned from: crc32 of its id as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on at most per_language documents a language, of rows (doc_id, text, lang) that may be learned from."""
    rows = docs.where(is_train(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for a, n in counts.items() for v in (a, min(1.0, 1.3 * per_language / n))])
    h = F.xxhash64(F.lit("language"), F.col("doc_id"))
    some = rows.withColumn("h", h).where(F.pmod("h", F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)
    # one row an id, ranked on executors, so the driver never gets more than the bound
    some = some.groupBy("lang", "h").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= per_language)
    got = some.select("text", "lang", "h").mapInArrow(features, "lang string, h long, x binary").toPandas().sort_values(["lang", "h"])
    return Model(got.lang.to_numpy(str), np.stack([np.frombuffer(v, np.float32) for v in got.x])) if len(got) else None


def identify(docs: DataFrame, model: Model | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add the predicted language and its score, under these names, to docs (all other columns kept; text is read)."""
    told, names = names, [c for c in docs.columns if c not in names]
    ready = docs.select(*names, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(fresh(docs, "letters")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names) + f", `{told[0]}` string, `{told[1]}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column("text"))
            lang, score = np.full(len(b), "und", object), np.zeros(len(b))
            letters = b.column(len(names)).to_numpy(zero_copy_only=False)
            if model is not None:
                for lo, hi, part, o in chunks(data, off):
                    lang[lo:hi], score[lo:hi] = model.predict(part, o)
            lang[~letters], score[~letters] = "und", 0.0
            cols = [b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score)], [*names, *told])

    return ready.mapInArrow(run, schema)
