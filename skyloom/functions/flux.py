"""Flux arithmetic as column expressions; missing or unphysical input gives null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.sphere import LATITUDE, _c, finite, positive


def spectral_index(a, b, nu_a: float, nu_b: float) -> Column:
    """ln(S_a / S_b) / ln(nu_a / nu_b)."""
    return F.log(positive(a) / positive(b)) / math.log(nu_a / nu_b)


def spectral_index_error(a, ea, b, eb, nu_a: float, nu_b: float) -> Column:
    ok = lambda e: F.when(finite(e) >= 0, finite(e))
    return F.sqrt(F.pow(ok(ea) / positive(a), 2) + F.pow(ok(eb) / positive(b), 2)) / abs(math.log(nu_a / nu_b))


def outer_indices(points: Column) -> tuple[Column, Column]:
    """Two-point indices at the low and the high end of an array of structs (nu, s) by rising nu."""
    two = lambda a, b: F.log(a["s"] / b["s"]) / F.log(a["nu"] / b["nu"])
    ends = lambda p: F.when(F.size(p) >= 2, F.struct(two(F.get(p, F.lit(0)), F.get(p, F.lit(1))).alias("low"), two(F.get(p, F.size(p) - 2), F.get(p, F.size(p) - 1)).alias("high")))
    both = F.get(F.transform(F.array(points), ends), F.lit(0))  # the array is made once for each
    return both["low"], both["high"]


def flux_sigma(total, peak, e_total, e_peak) -> Column:
    """(Total - Peak) in units of its error."""
    error = F.hypot(finite(e_total), finite(e_peak))
    return (finite(total) - finite(peak)) / F.when(error > 0, error)


def peak_from_total(total, bmaj, bmin, maj, min_) -> Column:
    """Peak flux of a Gaussian of this total flux and shape."""
    return finite(total) * positive(bmaj) * positive(bmin) / (positive(maj) * positive(min_))


def first_positive(*columns) -> Column:
    return F.coalesce(*[positive(c) for c in columns])


def highest_frequency(points: list[tuple[str, float, Column]]) -> Column:
    """struct(nu, flux, band) of the positive flux at the highest frequency."""
    each = [F.when(positive(s).isNotNull(), F.struct(F.lit(float(nu)).alias("nu"), positive(s).alias("flux"), F.lit(b).alias("band"))) for b, nu, s in points]
    return F.array_max(F.array_compact(F.array(*each)))


def zenith_south(dec, latitude: float = LATITUDE) -> Column:
    """Degrees south of the zenith; 0 to the north of it."""
    return F.greatest(F.lit(0.0), latitude - finite(dec))


def elongation(dec, kappa, latitude: float = LATITUDE) -> Column:
    return 1.0 + _c(kappa) * zenith_south(dec, latitude)


def scaled_beam(bmaj, bmin, dec, alpha, kappa) -> tuple[Column, Column]:
    """Beam axes after scaling by alpha and, along the major axis, the elongation; the larger first."""
    a, b = finite(bmaj) * _c(alpha) * elongation(dec, kappa), finite(bmin) * _c(alpha)
    return F.greatest(a, b), F.least(a, b)


def rescaled_total(total, dec, alpha0, kappa0, alpha1, kappa1) -> Column:
    """Total flux measured under beam scale 0 as it would be under scale 1."""
    ratio = _c(alpha0) / _c(alpha1)
    return positive(total) * ratio * ratio * elongation(dec, kappa0) / elongation(dec, kappa1)


def taylor(nu_mhz, coefficients: list, nu0_mhz: float, n_terms=None) -> Column:
    """exp(sum_j a_j ln(nu / nu0)^j); terms from ``n_terms`` on do not count."""
    x = F.log(_c(nu_mhz) / nu0_mhz)
    out = F.lit(0.0)
    for j, a in reversed(list(enumerate(coefficients))):
        term = F.coalesce(_c(a), F.lit(0.0))
        if n_terms is not None:
            term = F.when(_c(n_terms) > j, term).otherwise(0.0)
        out = out * x + term
    return F.exp(out)


def predicted_flux(nu_mhz, prefix: str = "spec_model_") -> Column:
    """Flux of a fitted row at another frequency; null without a fit."""
    x = F.log(_c(nu_mhz) / F.col(f"{prefix}nu0_mhz"))
    terms = [F.coalesce(F.col(f"{prefix}a{j}"), F.lit(0.0)) for j in range(4)]
    value = F.exp(terms[0] + x * (terms[1] + x * (terms[2] + x * terms[3])))
    return F.when(F.col(f"{prefix}n_terms") >= 2, value)


# A flat cosmology (Planck 2018).
H0, OMEGA_M, OMEGA_R, C_KM_S = 67.66, 0.30966, 9.182e-5, 299_792.458


def _distance_table(z_max: float, steps: int) -> list[float]:
    """Luminosity distance (Mpc) on an even grid of redshifts, by Simpson's rule."""
    inverse = lambda z: 1 / math.sqrt(OMEGA_M * (1 + z) ** 3 + OMEGA_R * (1 + z) ** 4 + 1 - OMEGA_M - OMEGA_R)
    h, total, out = z_max / steps, 0.0, [0.0]
    for k in range(steps):
        z = k * h
        total += h / 6 * (inverse(z) + 4 * inverse(z + h / 2) + inverse(z + h))
        out.append(C_KM_S / H0 * total * (1 + z + h))
    return out


def luminosity_distance(z, z_max: float = 8.0, steps: int = 800) -> Column:
    """Mpc, by linear interpolation in a table that is a literal of the plan."""
    table = F.array(*[F.lit(x) for x in _distance_table(z_max, steps)])
    at = finite(z) / (z_max / steps)
    low = F.least(F.floor(at), F.lit(steps - 1)).cast("int")
    a, b = F.get(table, low), F.get(table, low + 1)
    return F.when((finite(z) >= 0) & (finite(z) <= z_max), a + (b - a) * (at - low))


def radio_luminosity(flux_jy, z) -> Column:
    """W/Hz: 4 pi D_L^2 S."""
    metres = luminosity_distance(z) * 3.0856775814913673e22
    return 4 * math.pi * metres * metres * positive(flux_jy) * 1e-26


def nu_luminosity(flux_jy, nu_hz, z) -> Column:
    """erg/s: nu L_nu."""
    return radio_luminosity(flux_jy, z) * _c(nu_hz) * 1e7
