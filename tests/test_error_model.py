"""Hand-packed blocks through the decoders; blends against NumPy."""

import base64

import numpy as np
import pytest

from geostrata.operators import error_model as em
from geostrata.sources import error_model as src


def packed(*parts) -> str:
    return base64.b64encode(b"".join(p if isinstance(p, bytes) else np.asarray(p[1], p[0]).tobytes() for p in parts)).decode()


PPE = packed(("<u2", 2), b"FIELD".ljust(32, b"\0"), ("<f4", [1, 2, 3, 0.5, 0.25, 0.125]), ("<f4", [4, 5, 6, 0, 0, 0]))
UE = packed(("<u2", 1), ("<u4", 7), b"u".ljust(128, b"\0"), ("<f8", [0, 0, 0]), ("<f4", [0] * 12), ("<u2", 1), ("<f8", [10, 20, 30]), ("<f4", [1, 1, 1, 0, 0, 0]))


def direct_block(flags: int) -> str:
    n3 = flags.bit_count()
    head = [b"set".ljust(32, b"\0"), ("<u1", flags), *([("<f8", [0] * 4), ("<f8", [1] * n3)] if flags else [])]
    anchors = [p for k in range(2) for p in (("<f8", [k, k, k]), ("<f4", [0.5] * 3))]
    cols = [p for c in range(6) for p in (("<f4", [9] * n3), ("<f4", [10 * r + c for r in range(c + 1)]))]
    return packed(*head, ("<u2", [2, 1, 4]), ("<f8", 2.5), *anchors, ("<f4", [0] * (n3 * (n3 + 1) // 2)), *cols)


def test_decoders(spark):
    df = spark.createDataFrame([("m", PPE)], "model_id string, data string")
    got = {r.i: r.cov for r in src.decode(df, "per_point").collect()}
    assert got[0] == [[1, 0.5, 0.25], [0.5, 2, 0.125], [0.25, 0.125, 3]] and got[1][2][2] == 6
    assert src.unmodeled(UE) == [(0, 0, 10.0, 20.0, 30.0, np.eye(3).tolist())]
    for flags in (0, 0b1010011):
        rows = src.direct(direct_block(flags))
        assert rows[1][:4] == (1, 1.0, 1.0, 1.0) and rows[0][6] == 2.5
        assert rows[0][5] == [[0, 1, 2], [1, 11, 12], [2, 12, 22]] and rows[1][5][0] == [33, 34, 35]
    with pytest.raises(ValueError):
        src.per_point(PPE[:-8] + "AAAAAAAAAAAA")


def test_total_error(spark):
    pts = [(k, float(k), 0.0, 1.0, k % 2) for k in range(6)]
    points = spark.createDataFrame(pts, "id long, x double, y double, z double, ppe_idx int")
    anchors = [(k, float(3 * k), 1.0, 0.0, (np.eye(3) * (k + 1)).tolist()) for k in range(3)]
    a = spark.createDataFrame(anchors, "i long, x double, y double, z double, cov array<array<double>>")
    blend = em.blended(points, a, 2, 1.5)
    ppe = src.decode(spark.createDataFrame([("m", PPE)], "model_id string, data string"), "per_point")
    ue = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0, np.eye(3).tolist()), (1, 1, 0.0, 0.0, 0.0, (9 * np.eye(3)).tolist())], "record int, i int, x double, y double, z double, cov array<array<double>>")
    got = {r.id: np.array(r.cov) for r in em.total(points, blend, em.looked_up(points, ppe), em.unmodeled(points, ue)).collect()}
    table = src.matrix([[1, 2, 3, 0.5, 0.25, 0.125], [4, 5, 6, 0, 0, 0]])
    for k, x, y, z, p in pts:
        d = np.array([np.linalg.norm(np.array([x, y, z]) - q[1:4]) for q in anchors])
        n = np.argsort(d, kind="stable")[:2]
        w = np.exp(-d[n] / 1.5)
        assert np.allclose(got[k], sum(w[i] * np.array(anchors[j][4]) for i, j in enumerate(n)) / w.sum() + table[p] + np.eye(3))
