"""Spectra: gathering fluxes of bands, nested log-polynomial fits, selection, prediction."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import bands as B
from skyloom.functions.sphere import finite, positive

MAX_TERMS = 4


def expand(bands: Sequence[str]) -> list[str]:
    """Band names with the GLEAM alias written out, each once."""
    return list(dict.fromkeys(x for b in bands for x in (B.GLEAM_BANDS if b == "GLEAM" else (b,))))


def sed_bands(columns: Sequence[str], bands: Sequence[str] = (*B.SUBBANDS, *B.RADIO_SURVEYS, "GLEAM"), flux: str = "Total_flux") -> list[str]:
    return [b for b in expand(bands) if f"{flux}_{b}" in columns]


def gather(columns: Sequence[str], bands: Sequence[str], flux: str = "Total_flux", unconfused_only: bool = True) -> Column:
    """array of struct(nu, s, e, band): positive fluxes in the order of ``bands``.

    The origin band falls back to the columns without a suffix. An error that is missing
    or negative is null. With ``unconfused_only`` a band counts if one row claims its source.
    """
    have = lambda c: F.col(c).cast("double") if c in columns else F.lit(None).cast("double")
    points = []
    for b in bands:
        nu = B.frequency_hz(b)
        if not nu:
            continue
        own = F.col("origin_band") == b if "origin_band" in columns else F.lit(False)
        name = "n_confused_GLEAM" if b in B.GLEAM_BANDS else f"n_confused_{b}"
        one = F.coalesce(F.col(name) == 1, F.lit(False)) if name in columns else F.lit(False)
        values = [F.lit(nu).alias("nu"), have(f"{flux}_{b}").alias("s"), F.when(own, have(flux)).alias("s0"), have(f"E_{flux}_{b}").alias("e"), F.when(own, have(f"E_{flux}")).alias("e0")]
        points.append(F.struct(*values, F.lit(b).alias("band"), (one if unconfused_only else F.lit(True)).alias("ok")))
    if not points:
        return F.array_compact(F.array())
    # Each column is named once: tests that repeat it would repeat, in every use of the array, the expressions that it stands for.
    error = lambda x: F.when(finite(x) >= 0, finite(x))
    kept = lambda p: F.struct(p["nu"].alias("nu"), F.coalesce(positive(p["s"]), positive(p["s0"])).alias("s"), F.coalesce(error(p["e"]), error(p["e0"])).alias("e"), p["band"].alias("band"))
    return F.filter(F.transform(F.filter(F.array(*points), lambda p: p["ok"]), kept), lambda p: p["s"].isNotNull())


def fit_batch(x: np.ndarray, y: np.ndarray, w: np.ndarray, n: np.ndarray, max_terms: int = MAX_TERMS) -> dict[str, np.ndarray]:
    """Nested weighted fits y = sum_j a_j x^j of many padded spectra at once.

    Arrays have a row per spectrum; weights are 0 past its ``n`` points. A model near the
    best reduced chi square with the fewest terms wins, else that of least BIC.
    """
    rows = len(n)
    out = {k: np.full(rows, np.nan) for k in ("bic", "chi2_red")} | {"n_terms": np.zeros(rows, np.int64), "a": np.full((rows, MAX_TERMS), np.nan)}
    fits = []
    with np.errstate(all="ignore"):
        for k in range(2, max_terms + 1):
            ok = n >= k
            coef, chi2 = np.full((rows, k), np.nan), np.full(rows, np.nan)
            if ok.any():
                root = np.sqrt(w[ok])
                design = x[ok][:, :, None] ** np.arange(k) * root[:, :, None]
                target = y[ok] * root
                # Least squares by orthogonal factors: stable where frequencies lie close.
                q, r = np.linalg.qr(design)
                small = np.abs(np.diagonal(r, axis1=1, axis2=2)).min(1) < 1e-12 * np.abs(r).max((1, 2))
                solved = np.empty((int(ok.sum()), k))
                good = ~small
                if good.any():
                    solved[good] = np.linalg.solve(r[good], np.einsum("nij,ni->nj", q[good], target[good])[..., None])[..., 0]
                for i in np.flatnonzero(small):
                    solved[i] = np.linalg.lstsq(design[i], target[i], rcond=None)[0]
                coef[ok] = solved
                chi2[ok] = ((target - np.einsum("nij,nj->ni", design, solved)) ** 2).sum(1)
            dof = n - k
            bic = np.where(ok & (chi2 > 0), n * np.log(chi2 / n) + k * np.log(n), np.nan)
            fits.append((k, ok, coef, np.where(ok & (dof > 0), chi2 / dof, np.nan), bic))
        red = np.stack([f[3] for f in fits])
        best = np.where(np.isfinite(red), red, np.inf).min(0)
        limit = np.where(best <= 1e-8, np.maximum(1e-6, best + 1e-8), best + np.maximum(0.05, 0.1 * best))
        near = np.isfinite(red) & (red <= limit)
        bics = np.where(np.isfinite(np.stack([f[4] for f in fits])), np.stack([f[4] for f in fits]), np.inf)
        last = np.stack([f[1] for f in fits]).sum(0) - 1
        pick = np.where(near.any(0), near.argmax(0), np.where(np.isfinite(bics.min(0)), bics.argmin(0), last))
    for j, (k, ok, coef, chi, bic) in enumerate(fits):
        m = (pick == j) & ok
        out["n_terms"][m], out["chi2_red"][m], out["bic"][m] = k, chi[m], bic[m]
        out["a"][m, :k] = coef[m]
    return out


def _fitted(nu0_mhz: float, max_terms: int, use_errors: bool):
    def run(points: pa.Array) -> pa.Array:
        n = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(points), 0), np.int64)
        width = max(2, int(n.max(initial=0)))
        flat = points.flatten()
        at = (np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(k) for k in n]).astype(int) if len(n) else np.empty(0, int))
        grid = {}
        for c in ("nu", "s", "e"):
            g = np.full((len(n), width), np.nan)
            g[at] = np.asarray(flat.field(c).fill_null(np.nan), float)
            grid[c] = g
        with np.errstate(all="ignore"):
            x, y = np.log(grid["nu"] / (nu0_mhz * 1e6)), np.log(grid["s"])
            inside = np.arange(width) < n[:, None]
            weight = np.where(inside, (grid["s"] / grid["e"]) ** 2, 0.0)
        sound = (np.isfinite(weight) & (weight > 0) | ~inside).all(1) & use_errors
        weight = np.where(sound[:, None], weight, inside.astype(float))
        got = fit_batch(np.where(inside, x, 0.0), np.where(inside, y, 0.0), weight, n, max_terms)
        null = lambda v, ok: pa.array(v, pa.float64(), mask=~ok)
        cols = [pa.array(got["n_terms"], pa.int64()), null(got["bic"], np.isfinite(got["bic"])), null(got["chi2_red"], np.isfinite(got["chi2_red"])), pa.array(n, pa.int64())]
        cols += [null(got["a"][:, j], np.isfinite(got["a"][:, j])) for j in range(MAX_TERMS)]
        return pa.StructArray.from_arrays(cols, names=["n_terms", "bic", "chi2_red", "n_flux", *[f"a{j}" for j in range(MAX_TERMS)]])

    return run


def fit(meta: DataFrame, bands: Sequence[str] = B.SUBBANDS, flux: str = "Total_flux", nu0_mhz: float = B.REFERENCE_MHZ, max_terms: int = MAX_TERMS, use_errors: bool = True, unconfused_only: bool = True, prefix: str = "spec_model_") -> DataFrame:
    """``meta`` with fitted columns; rows with fewer than two fluxes have n_terms 0 and null values."""
    points = gather(meta.columns, bands, flux, unconfused_only)
    schema = "struct<n_terms:long,bic:double,chi2_red:double,n_flux:long," + ",".join(f"a{j}:double" for j in range(MAX_TERMS)) + ">"
    rows = meta.withColumn("__p", F.arrow_udf(_fitted(nu0_mhz, max(2, min(max_terms, MAX_TERMS)), use_errors), schema)(points))
    new = {f"{prefix}{c}": F.col(f"__p.{c}") for c in ("n_terms", "bic", "chi2_red", "n_flux", *[f"a{j}" for j in range(MAX_TERMS)])}
    return rows.withColumns(new | {f"{prefix}nu0_mhz": F.lit(float(nu0_mhz))}).drop("__p")


def fit_summary(fitted: DataFrame, prefix: str = "spec_model_") -> DataFrame:
    """Rows by number of terms."""
    return fitted.groupBy(F.col(f"{prefix}n_terms").alias("n_terms")).agg(F.count(F.lit(1)).alias("n"), F.percentile(f"{prefix}chi2_red", 0.5).alias("median_chi2_red"))
