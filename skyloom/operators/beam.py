"""Beam scales estimated from the catalogue itself."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import bands as B
from skyloom.functions.flux import zenith_south
from skyloom.functions.sphere import LATITUDE, finite, positive
from skyloom.sources.sidecar import read_json, write_json


def unconfused(columns: Sequence[str], band: str) -> Column:
    """One source in the band that no other row claims; false if the counts are missing."""
    if f"n_assoc_{band}" not in columns or f"n_confused_{band}" not in columns:
        return F.lit(False)
    return F.coalesce((F.col(f"n_assoc_{band}") == 1) & (F.col(f"n_confused_{band}") == 1), F.lit(False))


def bands_with_total(columns: Sequence[str], candidates: Sequence[str] = (*B.SUBBANDS, *B.COLOR_BANDS)) -> list[str]:
    return sorted((b for b in dict.fromkeys(candidates) if f"Total_flux_{b}" in columns), key=lambda b: B.frequency_hz(b) or math.inf)


def neighbour_ratio(columns: Sequence[str], low: str, high: str, flux: str, unique: bool = True) -> Column:
    """The ratio of two bands' fluxes where both are positive (and unconfused)."""
    ratio = positive(f"{flux}_{high}") / positive(f"{flux}_{low}")
    return F.when(unconfused(columns, low) & unconfused(columns, high), ratio) if unique else ratio


def bootstrap_alpha(meta: DataFrame, scale_used: float, anchor: str = "73MHz", bands: Sequence[str] | None = None, unique: bool = True) -> tuple[list[dict], list[dict]]:
    """(scale per band, steps): the anchor band is held against VLSSR, its neighbours against each other.

    One aggregation gives all medians; the chain over the few bands is plain arithmetic.
    """
    if not (math.isfinite(scale_used) and scale_used > 0):
        raise ValueError("the scale used must be positive")
    c = meta.columns
    bands = [b for b in bands if f"Total_flux_{b}" in c] if bands else bands_with_total(c)
    if anchor not in bands:
        raise ValueError(f"no total fluxes in the anchor band {anchor}")
    vlssr = positive(f"Total_flux_{anchor}") / positive("Peak_flux_VLSSR")
    if "n_assoc_VLSSR" in c:
        vlssr = F.when(F.col("n_assoc_VLSSR") == 1, vlssr)
    aggs = [F.percentile(vlssr, 0.5).alias("v"), F.count(vlssr).alias("nv")]
    for k, (lo, hi) in enumerate(zip(bands, bands[1:])):
        for f in ("Total_flux", "Peak_flux"):
            have = f"{f}_{lo}" in c and f"{f}_{hi}" in c
            r = neighbour_ratio(c, lo, hi, f, unique) if have else F.lit(None).cast("double")
            aggs += [F.percentile(r, 0.5).alias(f"{f[0]}{k}"), F.count(r).alias(f"n{f[0]}{k}")]
    row = meta.agg(*aggs).first()
    if not row["v"] or row["v"] <= 0:
        raise ValueError("no VLSSR ratio for the anchor band")
    alpha = {anchor: scale_used * math.sqrt(row["v"])}
    at, steps = bands.index(anchor), []
    for k, up in [*((k, True) for k in range(at, len(bands) - 1)), *((k, False) for k in range(at - 1, -1, -1))]:
        lo, hi, t, p = bands[k], bands[k + 1], row[f"T{k}"], row[f"P{k}"]
        if not (t and p and t > 0 and p > 0) or (lo if up else hi) not in alpha:
            continue
        factor = math.sqrt(p / t)
        alpha[hi if up else lo] = alpha[lo] * factor if up else alpha[hi] / factor
        steps.append({"band_lo": lo, "band_hi": hi, "direction": "up" if up else "down", "n": min(row[f"nT{k}"], row[f"nP{k}"]), "median_T_hi_over_lo": t, "median_P_hi_over_lo": p, "alpha_hi_over_lo": factor, "alpha_lo": alpha[lo], "alpha_hi": alpha[hi]})
    return [{"band": b, "alpha": alpha.get(b), "nu_mhz": (B.frequency_hz(b) or math.nan) / 1e6, "alpha_over_alpha_anchor": alpha[b] / alpha[anchor] if b in alpha else None} for b in bands], steps


def compact(sources: DataFrame, peak_min: float = 1.0, s_code: str = "S", alpha_used: float = 1.0, kappa_used: float = 0.0, latitude: float = LATITUDE) -> DataFrame:
    """Single, bright sources with their size in unscaled beams and their distance south of the zenith."""
    ok = (positive("Peak_flux") >= peak_min) & finite("Maj").isNotNull() & finite("Min").isNotNull() & positive("BMAJ").isNotNull() & positive("BMIN").isNotNull() & finite("DEC").isNotNull()
    if "S_Code" in sources.columns:
        ok = ok & (F.col("S_Code") == s_code)
    u = zenith_south("DEC", latitude)
    return sources.where(ok).withColumns({"u": u, "maj_over_bmaj": alpha_used * (1 + kappa_used * u) * finite("Maj") / finite("BMAJ"), "min_over_bmin": alpha_used * finite("Min") / finite("BMIN")})


def size_groups(sizes: DataFrame) -> DataFrame:
    """Medians by band and tile, or by band and 5 degrees of declination in [-40, 70)."""
    if "tile_ipix" in sizes.columns:
        group = F.col("tile_ipix").cast("long")
    else:
        group = F.floor((F.col("DEC") + 40) / 5).cast("long")
        sizes = sizes.where((F.col("DEC") >= -40) & (F.col("DEC") < 70))
    med = lambda c, n: F.percentile(c, 0.5).alias(n)
    return sizes.groupBy("band", group.alias("bin")).agg(med("DEC", "dec"), med("u", "u"), med("maj_over_bmaj", "med_maj"), med("min_over_bmin", "med_min"), F.count(F.lit(1)).alias("n"))


def size_alpha(groups: DataFrame, half_width: float = 10.0, floor: float = 1.0, latitude: float = LATITUDE) -> DataFrame:
    """Scale of each band from its groups near the zenith."""
    zenith = F.abs(F.col("dec") - latitude) <= half_width
    med = lambda c: F.percentile(F.when(zenith, F.col(c)), 0.5)
    rows = groups.groupBy("band").agg(med("med_maj").alias("a"), med("med_min").alias("b"), F.sum(F.when(zenith, F.col("n"))).alias("n_zenith"), F.sum(F.when(F.col("u") > 0, F.col("n")).otherwise(0)).alias("n_south"))
    return rows.where("a IS NOT NULL").select("band", F.greatest(F.lit(floor), "a", "b").alias("alpha_size"), "n_zenith", "n_south")


def shared_kappa(groups: DataFrame, alpha: DataFrame) -> DataFrame:
    """One row ``kappa``: the weighted slope through the origin of growth against distance south, at least 0."""
    rows = groups.where("u > 0").join(alpha, "band")
    growth = F.col("med_maj") / F.col("alpha_size") - 1
    slope = F.sum(F.col("n") * F.col("u") * growth) / F.nullif(F.sum(F.col("n") * F.col("u") * F.col("u")), F.lit(0.0))
    return rows.agg(F.greatest(F.lit(0.0), F.coalesce(slope, F.lit(0.0))).alias("kappa"))


def best_scale(residuals: DataFrame) -> DataFrame:
    """The scale of least mean residual per band; ties go to the smaller scale."""
    mean = residuals.groupBy("band", "alpha").agg(F.avg("residual").alias("mean_residual"))
    return mean.groupBy("band").agg(F.min(F.struct("mean_residual", "alpha")).alias("m")).select("band", "m.alpha", "m.mean_residual")


def scale_literal(scales: dict, part: str = "alpha", band: str = "band") -> Column:
    """A band's scale as a literal map: values are numbers or have alpha and kappa."""
    value = lambda v: float(v if not isinstance(v, dict) else v.get(part, 0.0 if part == "kappa" else 1.0))
    pairs = [F.lit(x) for b, v in scales.items() for x in (b, value(v) if isinstance(v, dict) or part == "alpha" else 0.0)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(band)), F.lit(1.0 if part == "alpha" else 0.0))


def read_scale(spark: SparkSession, path: str) -> dict:
    """A JSON sidecar: a number, or numbers or {alpha, kappa} by band."""
    data = read_json(spark, path)
    return data if isinstance(data, dict) else {"*": float(data)}


def write_scale(spark: SparkSession, path: str, scales: dict) -> None:
    write_json(spark, path, scales)
