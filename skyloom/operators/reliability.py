"""Quality bits of catalogue rows, and the tiers that clean a catalogue or pick its best part."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import quality as Q
from skyloom.functions.bands import csv
from skyloom.functions.flux import flux_sigma
from skyloom.functions.sphere import LATITUDE, elevation, finite, positive, separation, widest_pair, wrap_ra
from skyloom.operators.skyjoin import in_cell, level_of, over_cells, sky_pairs
from skyloom.plans.shared import materialize


@dataclass(frozen=True)
class Thresholds:
    """Cuts of the quality bits and tiers."""

    resid_rms: float = 1.0
    resid_mean: float = 1.0
    percentiles: tuple[float, float] = (1.0, 99.0)
    flux_sigma: float = 3.0
    jitter_beams: float = 0.3
    offset_beams: float = 1.0
    min_elevation: float = 10.0
    ellipticity: float = 3.0
    extended_beams: float = 3.0
    sidelobe_beams: tuple[float, float] = (2.0, 4.0)
    sidelobe_ratio: float = 30.0
    complex_rms: float = 0.3
    min_images: int = 2


# Measurements that every row should have.
CORE = ("RA", "DEC", "Peak_flux", "Total_flux", "Maj", "Min", "PA", "DC_Maj", "DC_Min", "DC_PA", "n_lst_contributions", "origin_band", "bands_present", "Resid_Isl_rms", "Resid_Isl_mean", "E_Peak_flux", "E_Total_flux")
CORE_MHZ = ("RA", "DEC", "Maj", "Min", "PA", "DC_Maj", "DC_Min", "DC_PA", "n_lst_contributions", "origin_band", "bands_present", "astrometry_band", "Resid_Isl_rms", "Resid_Isl_mean")


def beam(columns: Sequence[str]) -> Column:
    have = [positive(c) for c in ("BMAJ_match", "BMAJ_full", "BMAJ") if c in columns]
    return F.coalesce(*have) if have else F.lit(None).cast("double")


def bands_in(columns: Sequence[str], prefix: str) -> list[str]:
    return [c[len(prefix) :] for c in columns if c.startswith(prefix)]


def representative_peak(columns: Sequence[str]) -> Column:
    if "Peak_flux" in columns:
        return finite("Peak_flux")
    per_band = [finite(c) for c in columns if c.startswith("Peak_flux_") and not c.startswith("Peak_flux_std")]
    return F.greatest(*per_band) if len(per_band) > 1 else per_band[0] if per_band else F.lit(None).cast("double")


def unique_bands(columns: Sequence[str]) -> Column:
    """How many bands hold exactly one source of the row. Full, which has no counts, counts; so does a present seed band without counts."""
    bands = bands_in(columns, "n_assoc_")
    each = [F.when(F.coalesce(F.col(f"n_assoc_{b}") == 1, F.lit(False)), 1).otherwise(0) for b in bands]
    out = sum(each, F.lit(0))
    if "bands_present" in columns:
        for b in {"Full"} - set(bands):
            out = out + F.when(F.array_contains(csv(F.col("bands_present")), b), 1).otherwise(0)
        if "origin_band" in columns:
            seed = F.col("origin_band")
            out = out + F.when(F.array_contains(csv(F.col("bands_present")), seed) & ~seed.isin(*bands, "Full"), 1).otherwise(0)
    return out


def confused(columns: Sequence[str]) -> Column:
    out = F.lit(False)
    for b in bands_in(columns, "n_confused_"):
        if b != "Full":
            present = F.array_contains(csv(F.col("bands_present")), b) if "bands_present" in columns else F.lit(True)
            out = out | (present & F.coalesce(F.col(f"n_confused_{b}") > 1, F.lit(False)))
    return out


def all_unique(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for b in bands_in(columns, "n_assoc_"):
        present = F.array_contains(csv(F.col("bands_present")), b) if "bands_present" in columns else F.lit(True)
        one = F.coalesce((F.col(f"n_assoc_{b}") == 1) & (F.col(f"n_confused_{b}") == 1), F.lit(False)) if f"n_confused_{b}" in columns else F.coalesce(F.col(f"n_assoc_{b}") == 1, F.lit(False))
        out = out & (~present | one)
    return out


def band_spread(columns: Sequence[str]) -> Column:
    """Largest distance among the positions of bands that are not confused."""
    each = []
    for b in bands_in(columns, "RA_"):
        if f"DEC_{b}" in columns:
            ok = finite(f"RA_{b}").isNotNull() & finite(f"DEC_{b}").isNotNull()
            if f"n_confused_{b}" in columns:
                ok = ok & ~F.coalesce(F.col(f"n_confused_{b}") > 1, F.lit(False))
            each.append(F.when(ok, F.struct(finite(f"RA_{b}").alias("ra"), finite(f"DEC_{b}").alias("dec"))))
    return widest_pair(F.array_compact(F.array(*each))) if each else F.lit(None).cast("double")


def simple_bits(columns: Sequence[str], t: Thresholds = Thresholds(), latitude: float = LATITUDE) -> dict[str, Column]:
    """Bits that need nothing but the row; what is missing leaves a bit unset."""
    has = lambda *c: all(x in columns for x in c)
    out: dict[str, Column] = {}
    core = [c for c in (CORE if has("Peak_flux") else CORE_MHZ) if c in columns]
    missing = lambda c: F.col(c).isNull() if c in ("origin_band", "bands_present", "astrometry_band") else F.isnan(F.col(c).cast("double")) | F.col(c).isNull()
    nan = F.lit(False)
    for c in core:
        nan = nan | missing(c)
    out["HAS_NAN"] = nan
    out["INVALID_ASTROMETRY"] = finite("RA").isNull() | finite("DEC").isNull() | representative_peak(columns).isNull()
    if has("n_lst_contributions"):
        out["SINGLE_LST"] = F.col("n_lst_contributions") == 1
    out["SINGLE_UNIQUE_BAND"] = unique_bands(columns) == 1
    if has("Total_flux", "Peak_flux", "E_Total_flux", "E_Peak_flux"):
        out["UNPHYSICAL_FLUX"] = flux_sigma("Total_flux", "Peak_flux", "E_Total_flux", "E_Peak_flux") < -t.flux_sigma
    if has("Resid_Isl_rms", "Resid_Isl_mean"):
        out["RESID_ABS_FAIL"] = F.coalesce(finite("Resid_Isl_rms") > t.resid_rms, F.lit(False)) | F.coalesce(F.abs(finite("Resid_Isl_mean")) > t.resid_mean, F.lit(False))
    bmaj = beam(columns)
    if has("cluster_jitter_rms_deg"):
        out["JITTER_FAIL"] = finite("cluster_jitter_rms_deg") > t.jitter_beams * bmaj
    out["CONFUSED_ASSOC"] = confused(columns)
    if has("S_Code"):
        out["SCODE_COMPLEX"] = F.col("S_Code").isin("C", "M")
        if has("Resid_Isl_rms"):
            out["COMPLEX_RESID"] = out["SCODE_COMPLEX"] & (finite("Resid_Isl_rms") > t.complex_rms)
    if has("representative_lst"):
        out["LOW_ELEVATION"] = elevation(finite("RA"), finite("DEC"), "representative_lst", latitude) < t.min_elevation
    if has("Maj", "Min"):
        out["HIGH_ELLIPTICITY"] = finite("Maj") / positive("Min") > t.ellipticity
    if has("Maj"):
        out["EXTENDED"] = finite("Maj") > t.extended_beams * bmaj
    no = F.lit(False)
    either = lambda a, b: F.coalesce(out.get(a, no), no) | F.coalesce(out.get(b, no), no)
    out["LARGE_SINGLE"] = either("EXTENDED", "HIGH_ELLIPTICITY") & either("SINGLE_UNIQUE_BAND", "SINGLE_LST")
    out["BAND_POSITION_INCONSISTENT"] = band_spread(columns) > t.offset_beams * bmaj
    if has("resid_leftover"):
        out["RESID_LEFTOVER"] = F.col("resid_leftover")
    return out


def percentile_bits(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Adds ``outside``: whether the value lies outside the percentiles of all finite ones (two at least)."""
    v = finite(column)
    limits = df.agg(F.count(v).alias("__n"), F.percentile(v, F.array(F.lit(low / 100), F.lit(high / 100))).alias("__p"))
    rows = df.crossJoin(F.broadcast(limits))  # one row
    return rows.withColumn("outside", F.coalesce((F.col("__n") >= 2) & ((v < F.col("__p")[0]) | (v > F.col("__p")[1])), F.lit(False))).drop("__n", "__p")


def _hits(f0, f1, sep, b0, t: Thresholds) -> Column:
    low, high = t.sidelobe_beams
    return (f0 >= t.sidelobe_ratio * f1) & sep.between(low * b0, high * b0)


def _reached(left: DataFrame, bright: DataFrame, t: Thresholds, few: bool) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the ids of ``left`` that some of ``bright`` reaches, and the rows of ``left`` that none does."""
    if few:  # no row of ``left`` is shuffled
        own = bright.select(F.col("id").alias("id0"), F.col("f").alias("f0"), F.col("b").alias("b0"), (F.col("b") * t.sidelobe_beams[1]).alias("reach"), wrap_ra("RA").alias("r_ra"), F.col("DEC").alias("r_dec"))
        own = own.withColumn("level", level_of(F.col("reach")))
        found = []
        for (level,) in own.select("level").distinct().collect():  # some twenty at most, two or three as a rule
            cells = F.broadcast(over_cells(own.where(F.col("level") == level), "r").drop("level", "n", "low", "high"))  # FIRST * 4 sources at most, some ten cells each
            rows = in_cell(left.withColumns({"l_ra": wrap_ra("RA"), "l_dec": F.col("DEC"), "level": F.lit(level)}), "l")
            on = (rows["zone"] == cells["zone"]) & (rows["cell"] == cells["cell"]) & (rows["id"] != cells["id0"]) & (cells["f0"] >= t.sidelobe_ratio * rows["f"]) & (F.abs(rows["l_dec"] - cells["r_dec"]) <= cells["reach"] * (1 + 1e-9) + 1e-9) & _hits(cells["f0"], rows["f"], separation("l_ra", "l_dec", "r_ra", "r_dec"), cells["b0"], t)
            found.append(materialize(rows.join(cells, on, "left_semi").select("id"), "side"))
            left = rows.join(cells, on, "left_anti").select(*left.columns)
        return found, left
    faint = left.withColumn("key", F.struct("id", "f"))
    pairs = sky_pairs(faint, bright.withColumn("key", F.struct("id", "f", "b")), "key", "key", base_radius=0.0, ref_radius="b", reach=t.sidelobe_beams[1])
    hit = (F.col("base_id.id") != F.col("ref_id.id")) & _hits(F.col("ref_id.f"), F.col("base_id.f"), F.col("sep_deg"), F.col("ref_id.b"), t)
    found = materialize(pairs.where(hit).select(F.col("base_id.id").alias("id")).distinct(), "side")
    return [found], left.join(found, "id", "left_anti")


#: So many of the brightest sources are tried first, then eight times as many, and so on.
FIRST = 1 << 15


def near_bright(df: DataFrame, id: str, t: Thresholds = Thresholds(), first: int = FIRST) -> DataFrame:
    """Ids of sources in the sidelobe annulus of one that is brighter by ``sidelobe_ratio``.

    Sources are tried as bright ones from the brightest down. What one of them reaches is
    done, and so is what no source left to try outshines, so pairs are few in a dense sky.
    """
    low, high = t.sidelobe_beams
    if not 0 <= low < high or t.sidelobe_ratio <= 1:
        raise ValueError("needs 0 <= low < high and a ratio above 1")
    rows = df.select(F.col(id).alias("id"), finite("RA").alias("RA"), finite("DEC").alias("DEC"), positive(representative_peak(df.columns)).alias("f"), beam(df.columns).alias("b")).where("f IS NOT NULL AND b IS NOT NULL AND RA IS NOT NULL AND DEC IS NOT NULL")
    rows = materialize(rows, "bright")
    n, top = rows.agg(F.count(F.lit(1)), F.max("f")).first()
    sizes = [first]
    while sizes[-1] < n:
        sizes.append(sizes[-1] * 8)
    exact = min(1 << 30, 10_000 + 8 * n // first)
    cuts = rows.agg(F.percentile_approx("f", F.array(*[F.lit(1 - k / n) for k in sizes[:-1]]), exact)).first()[0] if n > first else []
    left, band, found = rows.where(F.col("f") * t.sidelobe_ratio <= F.lit(top)), rows, []
    for cut in [*cuts, None]:
        bright = band if cut is None else band.where(F.col("f") >= cut)
        ids, left = _reached(left, bright, t, bright.count() <= 4 * first)
        found += ids
        if cut is None:
            break
        band, left = rows.where(F.col("f") < cut), materialize(left.where(F.col("f") * t.sidelobe_ratio < cut), "left")
        if not left.limit(1).count():
            break
    out = rows.select("id").limit(0)
    for more in found:
        out = out.unionByName(more)
    return out.select(F.col("id").alias(id)).distinct()


def assign_quality(meta: DataFrame, id: str = "meta_id", vlssr: DataFrame | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """``meta`` with ``quality_flag``. ``vlssr`` holds the ids with a VLSSR counterpart."""
    rows = meta
    bits = simple_bits(meta.columns, t)
    for name, c in (("RESID_PCTL_RMS", "Resid_Isl_rms"), ("RESID_PCTL_MEAN", "Resid_Isl_mean")):
        if c in meta.columns:
            rows = percentile_bits(rows, c, *t.percentiles).withColumnRenamed("outside", f"__{name}")
            bits[name] = F.col(f"__{name}")
    # Packed before the joins, which then move the columns that are asked for alone.
    rows = rows.withColumn("__q", Q.packed(bits)).select(*[c for c in meta.columns if c != "quality_flag"], "__q")
    side = near_bright(meta, id, t).select(F.col(id).alias("__side"))
    rows = rows.join(side, F.col(id) == F.col("__side"), "left")
    more = {"NEAR_BRIGHT_SIDELOBE": F.col("__side").isNotNull()}
    if vlssr is not None:
        rows = rows.join(vlssr.select(F.col(id).alias("__v")).distinct(), F.col(id) == F.col("__v"), "left")
        more["NO_VLSSR"] = F.col("__v").isNull()
    return rows.select(*[c for c in meta.columns if c != "quality_flag"], F.col("__q").bitwiseOR(Q.packed(more)).alias("quality_flag"))


EXCLUDE = ("E0", "E1", "E2", "E3", "E4", "E5")
INCLUDE = ("I0", "I1", "I2", "I3", "I4", "I5")


def tier_tests(columns: Sequence[str], t: Thresholds = Thresholds()) -> tuple[dict[str, Column], dict[str, Column]]:
    """Per tier: what it removes as known to be bad, and what it requires as known to be good."""
    bits = simple_bits(columns, t)
    yes = lambda c: F.coalesce(c, F.lit(False))
    no = F.lit(False)
    images = F.coalesce(F.col("n_lst_contributions"), F.lit(0)) if "n_lst_contributions" in columns else F.lit(0)
    many = (images >= t.min_images) | (unique_bands(columns) >= 2)
    sigma = flux_sigma("Total_flux", "Peak_flux", "E_Total_flux", "E_Peak_flux") if "E_Total_flux" in columns else F.lit(None).cast("double")
    exclude = dict(zip(EXCLUDE, (yes(bits["INVALID_ASTROMETRY"]), ~many, yes(bits.get("UNPHYSICAL_FLUX", no)), yes(bits.get("RESID_ABS_FAIL", no)), yes(bits.get("JITTER_FAIL", no)), yes(bits["CONFUSED_ASSOC"]))))
    known = yes(finite("Resid_Isl_rms").isNotNull() & finite("Resid_Isl_mean").isNotNull()) if "Resid_Isl_rms" in columns else no
    steady = yes(finite("cluster_jitter_rms_deg").isNotNull() & beam(columns).isNotNull()) & ~exclude["E4"] if "cluster_jitter_rms_deg" in columns else no
    if "n_rematch" in columns:
        steady = steady & ((images < t.min_images) | yes(F.col("n_rematch") >= 2))
    include = dict(zip(INCLUDE, (~exclude["E0"], many, yes(sigma >= -t.flux_sigma), known & ~exclude["E3"], steady, all_unique(columns))))
    return exclude, include


def through(order: Sequence[str], last: str) -> list[str]:
    if last.upper() not in order:
        raise ValueError(f"unknown tier {last!r}")
    return list(order[: order.index(last.upper()) + 1])


def filter_tiers(meta: DataFrame, last: str, t: Thresholds = Thresholds()) -> DataFrame:
    """Rows left after the tiers up to ``last`` (E.. removes, I.. requires)."""
    exclude, include = tier_tests(meta.columns, t)
    for k in through(EXCLUDE if last.upper()[0] == "E" else INCLUDE, last):
        meta = meta.where(~exclude[k] if k in exclude else include[k])
    return meta


def tier_yields(meta: DataFrame, last: str, t: Thresholds = Thresholds()) -> DataFrame:
    """(tier, n_in, n_out, n_removed) of each tier on what the ones before it left, in one pass."""
    exclude, include = tier_tests(meta.columns, t)
    tiers, keep, counts = through(EXCLUDE if last.upper()[0] == "E" else INCLUDE, last), F.lit(True), [F.count(F.lit(1)).alias("n")]
    for k in tiers:
        keep = keep & (~exclude[k] if k in exclude else include[k])
        counts.append(F.count_if(keep).alias(k))
    row = meta.agg(*counts)
    before = ["n", *tiers[:-1]]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("tier"), F.col(b).alias("n_in"), F.col(k).alias("n_out"), (F.col(b) - F.col(k)).alias("n_removed")) for b, k in zip(before, tiers)])).alias("x")
    return row.select(each).select("x.*")


def not_nested(gold: DataFrame, cleaned: DataFrame, id: str = "meta_id") -> DataFrame:
    """Ids of the gold catalogue that the cleaned one lacks: empty if nested."""
    return gold.select(id).join(cleaned.select(id), id, "left_anti")


def jitter(members: DataFrame, group: str) -> DataFrame:
    """(group, jitter_rms_deg, n): scatter of members about their mean direction."""
    from skyloom.functions.sphere import unit_vector

    ok = members.where(finite("RA").isNotNull() & finite("DEC").isNotNull())
    x, y, z = unit_vector("RA", "DEC")
    mean = ok.groupBy(group).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.avg(z).alias("z"), F.count(F.lit(1)).alias("n"))
    norm = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    mean = mean.select(group, "n", F.degrees(F.atan2("y", "x")).alias("__ra"), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("z") / F.when(norm > 0, norm))))).alias("__dec"))
    off = separation("RA", "DEC", "__ra", "__dec")
    out = ok.join(mean, group).groupBy(group).agg(F.first("n").alias("n"), F.sqrt(F.avg(off * off)).alias("r"))
    return out.select(group, "n", F.when(F.col("n") == 1, 0.0).otherwise(F.col("r")).alias("jitter_rms_deg"))
