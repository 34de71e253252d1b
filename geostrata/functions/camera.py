"""Rational polynomial cameras as Column expressions.

A camera maps (longitude, latitude, altitude) to (sample, line): both are ratios of polynomials with
20 terms over normalised coordinates. Coefficients of a few cameras are literals in the expression, so
the optimiser folds them and the projection runs in generated code.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Powers of (x, y, z) of the 20 terms, in coefficient order.
POWERS = (
    (0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (2, 0, 0), (0, 2, 0), (0, 0, 2),
    (1, 1, 1), (3, 0, 0), (1, 2, 0), (1, 0, 2), (2, 1, 0), (0, 3, 0), (0, 1, 2), (2, 0, 1), (0, 2, 1), (0, 0, 3),
)
NAMES = ("SAMP_NUM_COEFF", "SAMP_DEN_COEFF", "LINE_NUM_COEFF", "LINE_DEN_COEFF")


@dataclass(frozen=True)
class Camera:
    """coeff: rows sample numerator and denominator, line numerator and denominator."""

    coeff: tuple[tuple[float, ...], ...]
    world_offset: tuple[float, float, float]
    world_scale: tuple[float, float, float]
    image_offset: tuple[float, float]
    image_scale: tuple[float, float]

    @staticmethod
    def of_metadata(md: dict[str, str]) -> Camera:
        """From text metadata; empty tokens of coefficient lists are ignored."""
        three = lambda what: tuple(float(md[f"{d}_{what}"]) for d in ("LONG", "LAT", "HEIGHT"))
        two = lambda what: tuple(float(md[f"{d}_{what}"]) for d in ("SAMP", "LINE"))
        return Camera(tuple(tuple(float(t) for t in md[n].split()) for n in NAMES), three("OFF"), three("SCALE"), two("OFF"), two("SCALE"))

    def metadata(self, digits: int = 12) -> dict[str, str]:
        out = {n: " ".join(f"{c:.{digits}g}" for c in row) for n, row in zip(NAMES, self.coeff)}
        for d, o, s in zip(("LONG", "LAT", "HEIGHT"), self.world_offset, self.world_scale):
            out |= {f"{d}_OFF": f"{o:.{digits}g}", f"{d}_SCALE": f"{s:.{digits}g}"}
        for d, o, s in zip(("SAMP", "LINE"), self.image_offset, self.image_scale):
            out |= {f"{d}_OFF": f"{o:.{digits}g}", f"{d}_SCALE": f"{s:.{digits}g}"}
        return out

    def cropped(self, sample: float, line: float) -> Camera:
        """The camera of a window of the image that begins at (sample, line)."""
        return Camera(self.coeff, self.world_offset, self.world_scale, (self.image_offset[0] - sample, self.image_offset[1] - line), self.image_scale)

    def project_numpy(self, p: np.ndarray) -> np.ndarray:
        n = (p - np.array(self.world_offset)) / np.array(self.world_scale)
        t = np.stack([n[:, 0] ** a * n[:, 1] ** b * n[:, 2] ** c for a, b, c in POWERS], axis=1)
        sn, sd, ln, ld = (t @ np.array(c) for c in self.coeff)
        return np.stack([sn / sd, ln / ld], axis=1) * np.array(self.image_scale) + np.array(self.image_offset)

    def back_project_numpy(self, uv: np.ndarray, alt: np.ndarray, rounds: int = 10) -> np.ndarray:
        """Longitude and latitude at known altitudes by Newton steps with a central-difference Jacobian."""
        p = np.stack([np.full(len(uv), self.world_offset[0]), np.full(len(uv), self.world_offset[1]), alt], axis=1)
        step = np.array(self.world_scale[:2]) * 1e-4
        for _ in range(rounds):
            r = self.project_numpy(p) - uv
            j = np.empty((len(uv), 2, 2))
            for k in range(2):
                q = np.zeros(3)
                q[k] = step[k]
                j[:, :, k] = (self.project_numpy(p + q) - self.project_numpy(p - q)) / (2 * step[k])
            p[:, :2] -= np.linalg.solve(j, r[:, :, None])[:, :, 0]
        return p[:, :2]


def project(camera: Camera, lon: Column, lat: Column, alt: Column) -> tuple[Column, Column]:
    """(sample, line) columns."""
    x, y, z = ((v - F.lit(o)) / F.lit(s) for v, o, s in zip((lon, lat, alt), camera.world_offset, camera.world_scale))

    def poly(row: tuple[float, ...]) -> Column:
        out = None
        for c, (a, b, d) in zip(row, POWERS):
            if c == 0:
                continue
            t = F.lit(float(c))
            for v, k in ((x, a), (y, b), (z, d)):
                for _ in range(k):
                    t = t * v
            out = t if out is None else out + t
        return out if out is not None else F.lit(0.0)

    sn, sd, ln, ld = (poly(r) for r in camera.coeff)
    return F.try_divide(sn, sd) * F.lit(camera.image_scale[0]) + F.lit(camera.image_offset[0]), F.try_divide(ln, ld) * F.lit(camera.image_scale[1]) + F.lit(camera.image_offset[1])


def project_sql(camera: Camera, lon: str, lat: str, alt: str) -> tuple[str, str]:
    """The same as DuckDB SQL."""
    num = lambda v: f"({float(v)!r}::DOUBLE)"
    x, y, z = (f"(({v} - {num(o)}) / {num(s)})" for v, o, s in zip((lon, lat, alt), camera.world_offset, camera.world_scale))

    def poly(row: tuple[float, ...]) -> str:
        out = [" * ".join([num(c), *[x] * a, *[y] * b, *[z] * d]) for c, (a, b, d) in zip(row, POWERS) if c]
        return "(" + " + ".join(out) + ")"

    sn, sd, ln, ld = (poly(r) for r in camera.coeff)
    return f"({sn} / {sd} * {num(camera.image_scale[0])} + {num(camera.image_offset[0])})", f"({ln} / {ld} * {num(camera.image_scale[1])} + {num(camera.image_offset[1])})"
