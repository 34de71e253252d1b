"""Decoders of base64 error-model blocks into rows: anchors, per-point covariances, unmodeled posts.

Layouts are little-endian and packed. A covariance is six 32-bit floats: three on the diagonal, then
xy, xz, yz. Every decoder checks that it has used all bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

COV = "array<array<double>>"
#: Record layouts.
POST = np.dtype([("p", "<f8", 3), ("c", "<f4", 6)])
ANCHOR = np.dtype([("p", "<f8", 3), ("delta", "<f4", 3)])
PPE_HEAD = np.dtype([("n", "<u2"), ("field", "S32")])
UE_HEAD = np.dtype([("trajectory", "<u4"), ("uid", "S128"), ("theta", "<f8", 3), ("params", "<f4", 12), ("n", "<u2")])
DIRECT_TAIL = np.dtype([("n", "<u2"), ("mode", "<u2"), ("posts", "<u2"), ("damping", "<f8")])


class Block:
    """Bytes that are taken from the front."""

    def __init__(self, text: str) -> None:
        self.data, self.at = base64.b64decode(text), 0

    def take(self, kind: np.dtype, n: int = 1) -> np.ndarray:
        size = kind.itemsize * n
        if self.at + size > len(self.data):
            raise ValueError(f"block ends at {len(self.data)}, {self.at + size} bytes are needed")
        self.at += size
        return np.frombuffer(self.data, kind, n, self.at - size)

    def end(self) -> None:
        if self.at != len(self.data):
            raise ValueError(f"{len(self.data) - self.at} bytes are left over")


def matrix(c: np.ndarray) -> np.ndarray:
    """3 x 3 matrices of packed covariances."""
    c = np.asarray(c, float).reshape(-1, 6)
    return c[:, [0, 3, 4, 3, 1, 5, 4, 5, 2]].reshape(-1, 3, 3)


def per_point(text: str) -> list[tuple[int, list]]:
    """(i, cov) of a lookup block."""
    b = Block(text)
    head = b.take(PPE_HEAD)[0]
    cov = matrix(b.take(np.dtype("<f4"), 6 * int(head["n"])))
    b.end()
    return [(i, m.tolist()) for i, m in enumerate(cov)]


def unmodeled(text: str) -> list[tuple]:
    """(record, i, x, y, z, cov) of posts."""
    b, out = Block(text), []
    for r in range(int(b.take(np.dtype("<u2"))[0])):
        posts = b.take(POST, int(b.take(UE_HEAD)[0]["n"]))
        out += [(r, i, *map(float, p["p"]), m.tolist()) for i, (p, m) in enumerate(zip(posts, matrix(posts["c"])))]
    b.end()
    return out


def direct(text: str) -> list[tuple]:
    """(i, x, y, z, delta, cov, damping) of a ground-space block's anchors; cov is each anchor's own covariance.

    The block's cross covariances are one upper triangle by columns, each column led by its covariances
    with the three-dimensional conformal parameters, of which every flagged one counts.
    """
    b = Block(text)
    b.take(np.dtype("S32"))
    flags = int(b.take(np.dtype("u1"))[0])
    if flags:
        b.take(np.dtype("<f8"), 4)
    n_conformal = int(flags & 0x7F).bit_count()
    b.take(np.dtype("<f8"), n_conformal)
    head = b.take(DIRECT_TAIL)[0]
    n = int(head["n"])
    anchors = b.take(ANCHOR, n)
    b.take(np.dtype("<f4"), n_conformal * (n_conformal + 1) // 2)
    full = np.zeros((3 * n, 3 * n))
    for col in range(3 * n):
        b.take(np.dtype("<f4"), n_conformal)
        full[: col + 1, col] = b.take(np.dtype("<f4"), col + 1)
    full = np.triu(full) + np.triu(full, 1).T
    b.end()
    return [(i, *map(float, a["p"]), a["delta"].astype(float).tolist(), full[3 * i : 3 * i + 3, 3 * i : 3 * i + 3].tolist(), float(head["damping"])) for i, a in enumerate(anchors)]


KINDS = {
    "per_point": (per_point, ["i", "cov"], f"i int, cov {COV}"),
    "unmodeled": (unmodeled, ["record", "i", "x", "y", "z", "cov"], f"record int, i int, x double, y double, z double, cov {COV}"),
    "direct": (direct, ["i", "x", "y", "z", "delta", "cov", "damping"], f"i int, x double, y double, z double, delta array<double>, cov {COV}, damping double"),
}


def decode(blocks: DataFrame, kind: str) -> DataFrame:
    """Rows of all blocks (model_id, data) of a kind, with their model_id."""
    f, names, schema = KINDS[kind]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(m, *r) for m, text in zip(pdf["model_id"], pdf["data"]) for r in f(text)]
            yield pd.DataFrame(rows, columns=["model_id", *names])

    return blocks.select("model_id", "data").mapInPandas(run, f"model_id {blocks.schema['model_id'].dataType.simpleString()}, {schema}")
