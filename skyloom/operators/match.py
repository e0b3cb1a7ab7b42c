"""Matching a catalogue with external surveys: radii, footprints, flags, summaries, cascades.

One matcher serves all surveys; a :class:`Survey` holds what differs between them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.functions.bands import add_bands, has_band
from skyloom.functions.sphere import finite, galactic, positive
from skyloom.operators.merge import FLUX_FIELDS, associate
from skyloom.operators.skyjoin import sky_pairs
from skyloom.plans.shared import materialize

ARCSEC = 1 / 3600

# Position errors of surveys, in degrees.
SOURCE_SIGMA = {"VLSSR": 3.0 * ARCSEC, "NVSS": 7.0 * ARCSEC, "VLASS": 2.5 * ARCSEC, "LODESS": 2.5 * ARCSEC}


@dataclass(frozen=True)
class Radius:
    """How a row's match radius is found: from its beam, its position error, or fixed."""

    mode: str = "beam"
    fixed_arcsec: float | None = None
    scale: float = 1.0
    default_arcsec: float | None = None

    def __post_init__(self):
        if self.mode not in ("beam", "localization", "fixed"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.mode == "fixed" and self.fixed_arcsec is None:
            raise ValueError("a fixed radius needs fixed_arcsec")
        if self.scale <= 0:
            raise ValueError("scale must be positive")

    def describe(self) -> str:
        if self.mode == "fixed":
            base = f"fixed {self.fixed_arcsec} arcsec"
        else:
            base = "beam (BMAJ" if self.mode == "beam" else "localization (E_RA/E_DEC or jitter"
            base += f", default {self.default_arcsec} arcsec)" if self.default_arcsec is not None else ")"
        return base + (f" x {self.scale:g} sigma" if self.scale != 1 else "")

    def column(self, columns: Sequence[str]) -> Column:
        """The radius in degrees of a row with these columns."""
        has = lambda c: F.col(c) if c in columns else F.lit(None).cast("double")
        default = (self.default_arcsec or 0.0) * ARCSEC
        if self.mode == "fixed":
            return F.lit(self.fixed_arcsec * ARCSEC * self.scale)
        if self.mode == "beam":
            return F.coalesce(*[positive(has(c)) for c in ("BMAJ_match", "BMAJ_full", "BMAJ")], F.lit(default)) * self.scale
        source = F.upper(F.trim(has("match_source").cast("string")))
        known = F.create_map(*[F.lit(x) for pair in SOURCE_SIGMA.items() for x in pair])
        error = F.hypot(positive(has("E_RA")), positive(has("E_DEC")))
        return F.coalesce(positive(has("match_sigma_deg")), F.try_element_at(known, source), error, positive(has("cluster_jitter_rms_deg")), F.lit(default or ARCSEC)) * self.scale


@dataclass(frozen=True)
class Survey:
    """What is particular about matching one survey."""

    name: str
    radius: Radius
    id: str = "ref_id"
    target_radius: Radius = Radius()
    dec_min: float | None = None
    dec_max: float | None = None
    pad: float = 0.0
    box: bool = True
    western: bool = False
    prefer_match_position: bool = False
    target_band: str | None = None
    max_redshift: float | None = None
    diameter_scale: float | None = None
    where: str | None = None
    extra: tuple[str, ...] = field(default=())


_local = lambda default: Radius("localization", default_arcsec=default)

# Radii (arcseconds), footprints (degrees) and cuts of the surveys.
SURVEYS = {
    s.name: s
    for s in (
        Survey("VLSSR", Radius("fixed", fixed_arcsec=3.0), target_band="Blue", extra=("Peak_flux",)),
        Survey("NVSS", _local(7.0), dec_min=-40.0, extra=("Peak_intensity",)),
        Survey("VLASS", _local(2.5), dec_min=-40.0, extra=("Peak_flux", "Component_name")),
        Survey("LoDeSS", _local(2.5), dec_min=20.0, extra=("Peak_flux", "Total_flux")),
        Survey("GLEAM", _local(3.0), dec_max=30.0, extra=("Name", "Peak_flux", "Total_flux")),
        Survey("RFC", _local(0.01), pad=1.0, extra=("Name", "type", "FsX")),
        Survey("eRASS3", _local(4.0), box=False, western=True, extra=("DET_LIKE_0", "ML_FLUX_1")),
        Survey("Freund2022", _local(12.0), box=False, where="pstellar > 0.51 AND pij > 0.5 AND NOT coalesce(subdwarf, false)", extra=("name_2rxs", "FX")),
        Survey("Xu2022", Radius(default_arcsec=540.0), box=False, extra=("RXGCC", "Class", "z")),
        Survey("2RXS", _local(15.0), box=False, where="ExiML >= 9", extra=("name", "ExiML", "CRate")),
        Survey("TeVCat", Radius("fixed", fixed_arcsec=180.0), box=False, extra=("tevcat_name", "canonical_name", "source_type")),
        Survey("MilliQuas", Radius("fixed", fixed_arcsec=1.0), box=False, prefer_match_position=True, extra=("Name", "Type", "class_primary", "z")),
        Survey("NEDLVS", Radius("fixed", fixed_arcsec=1.0), target_radius=Radius("localization", scale=3.0, default_arcsec=5.0), prefer_match_position=True, max_redshift=0.2, diameter_scale=0.5, extra=("objname", "DistMpc", "z")),
    )
}
CASCADE = ("VLSSR", "NVSS", "VLASS", "LoDeSS")


class Match(NamedTuple):
    """Flags of every target row and every row of the reference footprint, links, and a summary row."""

    meta_flags: DataFrame
    ref_flags: DataFrame
    footprint: DataFrame
    edges: DataFrame
    summary: DataFrame


def match_position(columns: Sequence[str], prefer: bool) -> tuple[Column, Column]:
    """A row's position, from match_RA and match_DEC as a pair if both are there."""
    if not prefer or "match_RA" not in columns or "match_DEC" not in columns:
        return finite("RA"), finite("DEC")
    both = finite("match_RA").isNotNull() & finite("match_DEC").isNotNull()
    return F.when(both, finite("match_RA")).otherwise(finite("RA")), F.when(both, finite("match_DEC")).otherwise(finite("DEC"))


def match_frame(df: DataFrame, id: str, radius: Radius, prefer: bool = False, floor: Column | None = None) -> DataFrame:
    """(id, RA, DEC, BMAJ): positions and radii to match with; rows without a position are left out."""
    ra, dec = match_position(df.columns, prefer)
    r = radius.column(df.columns)
    r = F.greatest(r, F.coalesce(floor, F.lit(0.0))) if floor is not None else r
    return df.select(F.col(id).alias("id"), ra.alias("RA"), dec.alias("DEC"), F.coalesce(r, F.lit(0.0)).alias("BMAJ")).where("RA IS NOT NULL AND DEC IS NOT NULL")


def in_western(ra, dec) -> Column:
    """Whether a position lies at galactic longitudes of 180 to 360 degrees."""
    return galactic(ra, dec)[0] >= 180.0


def footprint(ref: DataFrame, target: DataFrame, survey: Survey) -> DataFrame:
    """Reference rows where the target could have a counterpart."""
    rows = ref.where(finite("RA").isNotNull() & finite("DEC").isNotNull())
    if survey.where:
        rows = rows.where(survey.where)
    if survey.max_redshift is not None and "z" in rows.columns:
        rows = rows.where(F.col("z").between(0.0, survey.max_redshift))
    if survey.western:
        rows = rows.where(in_western("RA", "DEC"))
    if survey.dec_min is not None:
        rows = rows.where(F.col("DEC") >= survey.dec_min)
    if survey.dec_max is not None:
        rows = rows.where(F.col("DEC") <= survey.dec_max)
    if survey.box:
        dec = match_position(target.columns, survey.prefer_match_position)[1]
        limits = target.agg(F.min(dec).alias("__lo"), F.max(dec).alias("__hi"))
        rows = rows.crossJoin(F.broadcast(limits)).where(F.col("DEC").between(F.col("__lo") - survey.pad, F.col("__hi") + survey.pad)).drop("__lo", "__hi")  # one row
    return rows


def match(target: DataFrame, ref: DataFrame, survey: Survey, target_id: str = "meta_id", ref_id: str = "ref_id", target_radius: Radius | None = None, frame: DataFrame | None = None) -> Match:
    """Links in both directions, computed once. ``frame`` overrides the target's positions and radii."""
    if survey.target_band and "bands_present" in target.columns:
        target = target.where(has_band(F.col("bands_present"), survey.target_band))
    if survey.western:
        target = target.withColumn("in_footprint", in_western("RA", "DEC"))
    else:
        target = target.withColumn("in_footprint", F.lit(True))
    foot = footprint(ref, target, survey)
    frame = frame if frame is not None else match_frame(target.where("in_footprint"), target_id, target_radius or survey.target_radius, survey.prefer_match_position)
    floor = survey.diameter_scale * positive("Diam") * ARCSEC if survey.diameter_scale and "Diam" in foot.columns else None
    edges = materialize(sky_pairs(frame, match_frame(foot, ref_id, survey.radius, floor=floor), "id", "id"), "edges")
    hits = edges.groupBy("base_id").agg(F.array_sort(F.collect_list("ref_id")).alias("ref_ids"))
    back = edges.groupBy("ref_id").agg(F.array_sort(F.collect_list("base_id")).alias("meta_ids"))
    none = F.array().cast(hits.schema["ref_ids"].dataType)
    flags = target.join(hits, F.col(target_id) == F.col("base_id"), "left").drop("base_id")
    flags = flags.withColumn("ref_ids", F.coalesce("ref_ids", none)).withColumn("n_ref", F.size("ref_ids").cast("long")).withColumn("matched", F.col("n_ref") > 0)
    back = back.withColumnRenamed("ref_id", "__ref")
    refs = foot.join(back, F.col(ref_id) == F.col("__ref"), "left").drop("__ref")
    refs = refs.withColumn("meta_ids", F.coalesce("meta_ids", F.array().cast(back.schema["meta_ids"].dataType))).withColumn("n_meta", F.size("meta_ids").cast("long"))
    refs = refs.withColumns({"matched": F.col("n_meta") > 0, "oversplit": F.col("n_meta") > 1})
    return Match(flags, refs, foot, edges, summarize(flags, refs))


def summarize(flags: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: completeness, unique share, recovery, oversplit and multiple matches."""
    share = lambda a, b: a / F.when(b > 0, b)
    n, m = F.count_if(F.col("in_footprint")), F.count_if(F.col("matched"))
    left = flags.agg(n.alias("n_target"), m.alias("n_matched"), F.count_if(F.col("n_ref") == 1).alias("n_unique"), F.count_if(F.col("n_ref") > 1).alias("n_multi"), F.coalesce(F.max("n_ref"), F.lit(0)).alias("max_hits"), share(m, n).alias("completeness"), share(F.count_if(F.col("n_ref") == 1), m).alias("unique_fraction"))
    r = F.count(F.lit(1))
    right = refs.agg(r.alias("n_ref_footprint"), F.count_if(F.col("matched")).alias("n_ref_matched"), F.count_if(F.col("oversplit")).alias("n_oversplit"), share(F.count_if(F.col("matched")), r).alias("recovery"))
    return left.crossJoin(right)  # one row each


def bijective(edges: DataFrame) -> DataFrame:
    """Links whose ends have no other link."""
    alone = lambda c: F.count(F.lit(1)).over(W.partitionBy(c)) == 1
    return edges.withColumns({"__b": alone("base_id"), "__r": alone("ref_id")}).where("__b AND __r").drop("__b", "__r")


def native_frame(meta: DataFrame, id: str = "meta_id", radius: Radius = Radius()) -> DataFrame:
    return meta.select(F.col(id).alias("id"), finite("RA").alias("RA"), finite("DEC").alias("DEC"), radius.column(meta.columns).alias("BMAJ"), F.lit("native").alias("match_source"))


def advance(frame: DataFrame, ref: DataFrame, pairs: DataFrame, ref_id: str, radius: Radius, source: str) -> DataFrame:
    """The frame with positions and radii of the one-to-one counterparts."""
    new = match_frame(ref, ref_id, radius).select(F.col("id").alias("__ref"), *[F.col(c).alias(f"__{c}") for c in ("RA", "DEC", "BMAJ")])
    got = pairs.select(F.col("base_id").alias("__base"), F.col("ref_id").alias("__ref")).join(new, "__ref")
    rows = frame.join(got, F.col("id") == F.col("__base"), "left")
    pick = {c: F.when(F.col("__base").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)) for c in ("RA", "DEC", "BMAJ")}
    return rows.withColumns(pick | {"match_source": F.when(F.col("__base").isNotNull(), F.lit(source)).otherwise(F.col("match_source"))}).select("id", "RA", "DEC", "BMAJ", "match_source")


def cascade(meta: DataFrame, surveys: dict[str, DataFrame], id: str = "meta_id", ref_id: str = "ref_id", order: Sequence[str] = CASCADE) -> DataFrame:
    """Match positions that move on to the counterpart of each survey in turn, where it is one to one."""
    frame = native_frame(meta, id)
    for name in order:
        if name in surveys:
            survey = SURVEYS[name]
            foot = footprint(surveys[name], meta, survey)
            edges = sky_pairs(frame, match_frame(foot, ref_id, survey.radius), "id", "id")
            frame = materialize(advance(frame, foot, bijective(edges), ref_id, survey.radius, name), "cascade")
    return frame


def attach(meta: DataFrame, ref: DataFrame, survey: Survey, ref_id: str = "ref_id", id: str = "meta_id", fields: Sequence[str] = FLUX_FIELDS, frame: DataFrame | None = None) -> DataFrame:
    """The brightest counterpart of each row as columns of a band; the rows stay as they are."""
    foot = footprint(ref, meta, survey).withColumn("BMAJ", survey.radius.column(ref.columns))
    if "Peak_flux" not in foot.columns and "Peak_intensity" in foot.columns:
        foot = foot.withColumn("Peak_flux", F.col("Peak_intensity"))
    frame = (frame if frame is not None else native_frame(meta, id)).select(F.col("id").alias("__id"), F.col("RA").alias("__m_ra"), F.col("DEC").alias("__m_dec"), F.col("BMAJ").alias("__m_r"))
    rows = meta.join(frame, F.col(id) == F.col("__id"), "left").drop("__id")
    out = associate(rows, foot, ref_id, survey.name, fields=fields, append=False, grow_radius=False, representative="peak_flux", key=id, base=("__m_ra", "__m_dec", "__m_r"))
    return out.drop("__m_ra", "__m_dec", "__m_r")


def attach_radio(meta: DataFrame, surveys: dict[str, DataFrame], ref_id: str = "ref_id", id: str = "meta_id", cascaded: bool = False) -> DataFrame:
    """All surveys attached, with match_RA, match_DEC, match_sigma_deg and match_source."""
    frame, out = native_frame(meta, id), meta
    for name in CASCADE:
        if name not in surveys:
            continue
        survey = SURVEYS[name]
        out = materialize(attach(out, surveys[name], survey, ref_id, id, frame=frame), "attach")
        if cascaded:
            foot = footprint(surveys[name], meta, survey)
            edges = sky_pairs(frame, match_frame(foot, ref_id, survey.radius), "id", "id")
            frame = materialize(advance(frame, foot, bijective(edges), ref_id, survey.radius, name), "cascade")
    final = frame.select(F.col("id").alias("__id"), F.col("RA").alias("match_RA"), F.col("DEC").alias("match_DEC"), F.col("BMAJ").alias("match_sigma_deg"), "match_source")
    return out.join(final, F.col(id) == F.col("__id"), "left").drop("__id")


def attach_narrow(meta: DataFrame, ref: DataFrame, survey: Survey, bands: Sequence[str], ref_id: str = "ref_id", id: str = "meta_id") -> DataFrame:
    """One counterpart that carries the fluxes of many bands."""
    fields = [f"{f}_{b}" for b in bands for f in ("Peak_flux", "Total_flux", "E_Peak_flux", "E_Total_flux")]
    out = attach(meta, ref, survey, ref_id, id, fields=fields)
    out = out.withColumnsRenamed({f"{f}_{survey.name}": f for f in fields})
    for b in bands:
        if f"Total_flux_{b}" in out.columns:
            out = out.withColumn("bands_present", F.when(finite(f"Total_flux_{b}") > 0, add_bands(F.col("bands_present"), b)).otherwise(F.col("bands_present")))
    return out


def attach_best(meta: DataFrame, ref: DataFrame, survey: Survey, order: Sequence[Column], columns: Sequence[str], ref_id: str = "ref_id", id: str = "meta_id", suffix: str = "") -> DataFrame:
    """The best counterpart of each row by ``order``, then distance, then id."""
    found = match(meta, ref, survey, id, ref_id).edges
    found = found.withColumnRenamed("ref_id", "__ref")
    rows = found.join(ref, F.col("__ref") == F.col(ref_id))
    first = W.partitionBy("base_id").orderBy(*order, "sep_deg", "__ref")
    rows = rows.withColumns({"__n": F.row_number().over(first), "n_hits": F.count(F.lit(1)).over(W.partitionBy("base_id"))}).where("__n = 1")
    hit = rows.select(F.col("base_id").alias("__base"), F.col("n_hits").alias(f"n_hits{suffix}"), F.col("sep_deg").alias(f"sep_deg{suffix}"), *[F.col(c).alias(f"{c}{suffix}") for c in columns])
    return meta.join(hit, F.col(id) == F.col("__base"), "left").drop("__base").withColumn(f"n_hits{suffix}", F.coalesce(f"n_hits{suffix}", F.lit(0).cast("long")))


def nearest_reference(base: DataFrame, ref: DataFrame, id: str, ref_id: str, radius="BMAJ") -> DataFrame:
    """The nearest reference row within the larger radius, per base row."""
    edges = sky_pairs(base, ref, id, ref_id, radius, radius)
    return edges.groupBy("base_id").agg(F.min(F.struct("sep_deg", "ref_id")).alias("m")).select("base_id", "m.ref_id", "m.sep_deg")
