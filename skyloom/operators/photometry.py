"""Forced photometry: a Gaussian with background fitted to image cutouts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TO_SIGMA = 1 / (2 * math.sqrt(2 * math.log(2)))


def _model(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    amp, x0, y0, sx, sy, t, bkg = p
    c, s = math.cos(t), math.sin(t)
    u, v = (x - x0) * c + (y - y0) * s, (y - y0) * c - (x - x0) * s
    return amp * np.exp(-0.5 * ((u / sx) ** 2 + (v / sy) ** 2)) + bkg


def fit_gaussian(image: np.ndarray, start: dict, fixed_position: bool = False, bound_pixels: float = 3.0, size_factor: float = 2.0, iterations: int = 200) -> dict:
    """Damped least squares within bounds: amplitude, centre, widths, angle, background, residual rms."""
    yy, xx = np.mgrid[: image.shape[0], : image.shape[1]]
    ok = np.isfinite(image)
    if ok.sum() < 10:
        return {"ok": False}
    x, y, data = xx[ok].astype(float), yy[ok].astype(float), image[ok].astype(float)
    amp = start.get("peak") or float(data.max())
    p = np.array([amp, start["x"], start["y"], max(start["sx"], 0.5), max(start["sy"], 0.5), start.get("theta", 0.0), float(np.median(data))])
    cap = max(3 * abs(amp), 3 * float(np.abs(data).max()))
    near = 0.0 if fixed_position else bound_pixels
    low = np.array([0.0, p[1] - near, p[2] - near, p[3] / size_factor, p[4] / size_factor, -np.inf, -np.inf])
    high = np.array([cap, p[1] + near, p[2] + near, p[3] * size_factor, p[4] * size_factor, np.inf, np.inf])
    free = np.flatnonzero(high > low)
    damp, off = 1e-3, data - _model(p, x, y)
    for _ in range(iterations):
        jac = np.empty((len(data), len(free)))
        for k, i in enumerate(free):
            h = 1e-6 * max(1.0, abs(p[i]))
            q = p.copy()
            q[i] += h
            jac[:, k] = (_model(q, x, y) - _model(p, x, y)) / h
        normal, right = jac.T @ jac, jac.T @ off
        moved = p.copy()
        moved[free] += np.linalg.lstsq(normal + damp * np.diag(np.diag(normal) + 1e-12), right, rcond=None)[0]
        moved = np.clip(moved, low, high)
        new = data - _model(moved, x, y)
        if new @ new < off @ off:
            gain = 1 - (new @ new) / (off @ off)
            p, off, damp = moved, new, damp / 5
            if gain < 1e-10:
                break
        else:
            damp *= 5
            if damp > 1e12:
                break
    names = ("peak", "x", "y", "sx", "sy", "theta", "background")
    return dict(zip(names, map(float, p))) | {"ok": True, "resid_rms": float(off.std())}


_FIELDS = ("peak", "x", "y", "sx", "sy", "theta", "background", "resid_rms")


def fit_cutouts(pixels: Column, width: Column, start: Column, fixed_position: bool = False) -> Column:
    """Fits of flattened cutouts (array<double>, row by row); ``start`` is a struct of peak, x, y, sx, sy, theta."""

    def run(pix: pa.Array, wide: pa.Array, first: pa.Array) -> pa.Array:
        rows = []
        for a, w, s in zip(pix, wide, first):
            if a.as_py() is None or not w.as_py():
                rows.append({"ok": False})
                continue
            image = np.array([np.nan if v is None else v for v in a.as_py()], float).reshape(-1, w.as_py())
            rows.append(fit_gaussian(image, s.as_py(), fixed_position))
        cols = [pa.array([r["ok"] for r in rows], pa.bool_())] + [pa.array([r.get(f) for r in rows], pa.float64()) for f in _FIELDS]
        return pa.StructArray.from_arrays(cols, names=["ok", *_FIELDS])

    return F.arrow_udf(run, "struct<ok:boolean," + ",".join(f"{f}:double" for f in _FIELDS) + ">")(pixels, width, start)


def total_from_fit(fit: Column, bmaj: Column, bmin: Column, pixel_deg: Column) -> Column:
    """Total flux of a fit, given the beam: peak times the ratio of areas."""
    beam = F.when((bmaj > 0) & (bmin > 0), bmaj * bmin * TO_SIGMA**2 / (pixel_deg * pixel_deg))
    return fit["peak"] * fit["sx"] * fit["sy"] / beam


def painted(width, height, sources: Column) -> Column:
    """An image (array<double>, row by row) of Gaussians: ``sources`` is an array of structs of peak, x, y, sx, sy and theta, in pixels.

    Built-in functions only; an image holds its pixels and is meant for tiles of some hundred pixels a side.
    """
    width, height = (F.lit(v) if isinstance(v, int) else v for v in (width, height))

    def value(k: Column) -> Column:
        x, y = k % width, F.floor(k / width)

        def add(total: Column, s: Column) -> Column:
            c, t = F.cos(s["theta"]), F.sin(s["theta"])
            u, v = (x - s["x"]) * c + (y - s["y"]) * t, (y - s["y"]) * c - (x - s["x"]) * t
            return total + s["peak"] * F.exp(-0.5 * (F.pow(u / s["sx"], 2) + F.pow(v / s["sy"], 2)))

        return F.aggregate(sources, F.lit(0.0), add)

    return F.transform(F.sequence(F.lit(0), (width * height - 1).cast("int")), value)


def tile_residual(observed: Column, model: Column, clip: bool = True) -> Column:
    """observed - model, pixel by pixel; what is missing stays missing, negative values become 0."""
    left = lambda o, m: F.greatest(F.lit(0.0), o - m) if clip else o - m
    return F.zip_with(observed, model, lambda o, m: F.when(o.isNull() | F.isnan(o), o).otherwise(left(o, m)))
