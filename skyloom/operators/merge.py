"""From repeated detections to one row per source, and from bands to one wide catalogue.

Picks are total orders that end in an id, so results do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.functions import bands as B
from skyloom.functions.flux import spectral_index, spectral_index_error
from skyloom.functions.sphere import elevation, finite, lst_hours, near_transit, separation, unit_vector, wrap_ra_columns
from skyloom.operators.components import connected_components
from skyloom.operators.skyjoin import sky_neighbours, sky_pairs
from skyloom.plans.numbering import numbered
from skyloom.plans.shared import materialize

FLUX_FIELDS = ("Peak_flux", "Total_flux", "E_Peak_flux", "E_Total_flux")
BAND_FIELDS = (*FLUX_FIELDS, "Peak_flux_std", "RA", "DEC", "Maj", "Min", "PA", "DC_Maj", "DC_Min", "DC_PA")
SHAPE = ("RA", "DEC", "Maj", "Min", "PA", "DC_Maj", "DC_Min", "DC_PA")
QA = ("cluster_jitter_rms_deg", "Resid_Isl_rms", "Resid_Isl_mean", "E_Peak_flux", "E_Total_flux", "S_Code")
POSITION_QA = QA[:3]


def cluster(df: DataFrame, id: str, radius="BMAJ", other_group: str | None = None, narrow: bool = False) -> DataFrame:
    """``df`` with ``root``: the smallest id of its chain of neighbours. Rows without a position are dropped.

    With ``narrow`` only the columns that tell a cluster's figures, written once.
    """
    located = df.where(finite("RA").isNotNull() & finite("DEC").isNotNull())
    links = sky_neighbours(located, id, radius, other_group=other_group)
    roots = connected_components(links, "id1", "id2")
    if narrow:
        located = located.select(id, "RA", "DEC", *[c for c in (*_fluxes(df.columns), "lst_hour") if c in df.columns])
    out = located.join(roots, F.col(id) == F.col("node"), "left")
    out = out.withColumn("root", F.coalesce("component", F.col(id))).drop("node", "component")
    return materialize(out, "members") if narrow else out


def _fluxes(columns: Sequence[str]) -> list[str]:
    return [c for c in ("Total_flux", "Peak_flux", "Peak_intensity") if c in columns]


def _brightness(fluxes: Sequence[str]) -> Column:
    """Key of the brightest: the first flux that is positive for some member of the group, told by ``__any_*``."""
    key = F.lit(0.0)
    for c in reversed(fluxes):
        key = F.when(F.col(f"__any_{c}") == 1, F.coalesce(finite(c), F.lit(float("-inf")))).otherwise(key)
    return key


def _ranked(members: DataFrame, group: list[str], id: str, by_elevation: bool, lst: str | None) -> DataFrame:
    """Adds ``__rank``, 1 for the representative of each group."""
    win = W.partitionBy(*group)
    members = members.withColumns({f"__any_{c}": F.max(F.when(finite(c) > 0, 1).otherwise(0)).over(win) for c in _fluxes(members.columns)})
    key = _brightness(_fluxes(members.columns))
    if by_elevation and lst:
        members = members.withColumns({"__ra": F.percentile("RA", 0.5).over(win), "__dec": F.percentile("DEC", 0.5).over(win), "__labelled": F.min(lst_hours(lst).isNotNull().cast("int")).over(win)})
        high = F.coalesce(elevation("__ra", "__dec", lst), F.lit(float("-inf")))
        key = F.when(F.col("__labelled") == 1, high).otherwise(key)
    members = members.withColumn("__key", key)
    return members.withColumn("__rank", F.row_number().over(win.orderBy(F.desc_nulls_last("__key"), id))).drop("__key", "__ra", "__dec", "__labelled", *[f"__any_{c}" for c in _fluxes(members.columns)])


def _merged(rows: DataFrame, id: str, by_elevation: bool, other_group: str | None = None) -> DataFrame:
    """The representative row of each cluster, with the cluster's figures.

    Clusters are summed up over narrow rows; a wide row is shuffled once, to meet the pick
    that it is.
    """
    members = cluster(rows, id, other_group=other_group, narrow=True)
    fluxes = _fluxes(members.columns)
    hours = "lst_hour" in members.columns
    x, y, z = unit_vector("RA", "DEC")
    figures = [F.avg(v).alias(f"__{n}") for n, v in (("x", x), ("y", y), ("z", z))]
    figures += [F.stddev_samp(finite("Peak_flux")).alias("Peak_flux_std"), F.count(F.lit(1)).alias("n_members")]
    figures += [F.max(F.when(finite(c) > 0, 1).otherwise(0)).alias(f"__any_{c}") for c in fluxes]
    if hours:
        figures.append(F.array_sort(F.collect_set(F.col("lst_hour").cast("string"))).alias("__hours"))
    if by_elevation and hours:
        figures += [F.percentile("RA", 0.5).alias("__ra"), F.percentile("DEC", 0.5).alias("__dec"), F.min(lst_hours("lst_hour").isNotNull().cast("int")).alias("__labelled")]
    of = materialize(members.groupBy("root").agg(*figures), "clusters")
    norm = F.sqrt(F.col("__x") ** 2 + F.col("__y") ** 2 + F.col("__z") ** 2)
    mean_ra = F.degrees(F.atan2("__y", "__x"))
    mean_dec = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("__z") / F.when(norm > 0, norm)))))
    key = _brightness(fluxes)
    if by_elevation and hours:
        key = F.when(F.col("__labelled") == 1, F.coalesce(elevation("__ra", "__dec", "lst_hour"), F.lit(float("-inf")))).otherwise(key)
    off = separation("RA", "DEC", mean_ra, mean_dec)
    first = F.min(F.struct((-key).alias("k"), F.col(id).alias("id")))["id"]
    picks = members.join(of.drop("Peak_flux_std", "__hours"), "root").groupBy("root").agg(first.alias("__pick"), F.sqrt(F.avg(off * off)).alias("__scatter"))
    picks = picks.join(of.select("root", "Peak_flux_std", "n_members", *["__hours"] * hours), "root")
    picks = picks.withColumn("cluster_jitter_rms_deg", F.when(F.col("n_members") == 1, F.lit(0.0)).otherwise(F.col("__scatter"))).drop("__scatter")
    return rows.join(picks, F.col(id) == F.col("__pick")).drop("__pick")


def lst_merge(detections: DataFrame, id: str, band: str, transit_window_hr: float | None = None) -> DataFrame:
    """One row per source of a band: chains of detections within the beam.

    The representative is the member highest above the horizon at the chain's median
    position, or the brightest if a member has no hour label.
    """
    rows = wrap_ra_columns(detections)
    if transit_window_hr is not None:
        rows = rows.where(near_transit("RA", "lst_hour", transit_window_hr))
    out = _merged(rows, id, True)
    return out.withColumns({"band": F.lit(band), "n_lst_contributions": F.size("__hours").cast("long"), "lst_hours": F.array_join("__hours", ","), "representative_lst": F.col("lst_hour")}).drop("__hours")


def tile_merge(detections: DataFrame, id: str, band: str) -> DataFrame:
    """One row per source of overlapping tiles: only detections of different tiles link."""
    if "tile_ipix" not in detections.columns:
        raise ValueError("tile_merge needs tile_ipix")
    if detections.where(finite("tile_ipix").isNull()).limit(1).count():
        raise ValueError("tile_merge needs a finite tile_ipix in every row")
    out = _merged(wrap_ra_columns(detections), id, False, "tile_ipix")
    if "__hours" in out.columns:
        out = out.drop("__hours")
    return out.withColumns({"band": F.lit(band), "n_lst_contributions": F.lit(1).cast("long"), "lst_hours": F.lit(""), "representative_lst": F.lit("healpix")})


def best_hits(edges: DataFrame, ref: DataFrame, ref_id: str, representative: str = "elevation") -> DataFrame:
    """The picked reference row of each base_id, with ``n_assoc`` and ``n_confused``."""
    hits = edges.withColumns({"n_confused": F.count(F.lit(1)).over(W.partitionBy("ref_id")), "n_assoc": F.count(F.lit(1)).over(W.partitionBy("base_id"))})
    hits = hits.withColumnRenamed("ref_id", "__ref")
    rows = hits.join(ref, F.col("__ref") == F.col(ref_id))
    lst = next((c for c in ("lst_hour", "representative_lst") if c in ref.columns), None)
    return _ranked(rows, ["base_id"], "__ref", representative == "elevation", lst).where("__rank = 1").drop("__rank")


def _value(columns: Sequence[str], c: str, prefix: str = "") -> Column:
    return F.col(f"{prefix}{c}") if c in columns else F.lit(None).cast("string" if c in ("S_Code", "source_file") else "double")


def seed_rows(band_rows: DataFrame, id: str, band: str, source: int, fields: Sequence[str], primary_flux: bool, seed_band: str) -> DataFrame:
    """Catalogue rows of a band's own sources, keyed by ``__key`` = (source, id)."""
    c = band_rows.columns
    lst = next((x for x in ("lst_hours", "lst_hour") if x in c), None)
    rep = next((x for x in ("representative_lst", "lst_hour") if x in c), None)
    out = {
        "__key": F.struct(F.lit(source).alias("source"), F.col(id).cast("long").alias("id")),
        "origin_band": F.lit(band),
        "bands_present": F.lit(band),
        **{x: _value(c, x) for x in SHAPE},
        "BMAJ_match": finite("BMAJ"),
        "BMAJ_full": finite("BMAJ") if band == seed_band else F.lit(None).cast("double"),
        "n_lst_contributions": F.coalesce(F.col("n_lst_contributions").cast("long"), F.lit(1)) if "n_lst_contributions" in c else F.lit(1).cast("long"),
        "lst_hours": F.col(lst).cast("string") if lst else F.lit(""),
        "representative_lst": F.col(rep).cast("string") if rep else F.lit(""),
        **{x: _value(c, x) for x in (QA if primary_flux else POSITION_QA)},
        "astrometry_band": F.lit(band),
        **band_block(c, band, fields, F.lit(1).cast("long"), F.lit(1).cast("long")),
    }
    if primary_flux:
        out |= {x: _value(c, x) for x in ("Peak_flux", "Total_flux", "Peak_flux_std")}
    return band_rows.select(*[v.alias(k) for k, v in out.items()])


def band_block(columns: Sequence[str], band: str, fields: Sequence[str], n_assoc: Column, n_confused: Column, prefix: str = "") -> dict[str, Column]:
    """The columns of a row's hit in one band."""
    return {f"n_assoc_{band}": n_assoc, f"n_confused_{band}": n_confused, **{f"{f}_{band}": _value(columns, f, prefix) for f in fields}, f"source_file_{band}": _value(columns, "source_file", prefix)}


def associate(
    meta: DataFrame,
    band_rows: DataFrame,
    id: str,
    band: str,
    *,
    source: int = 0,
    fields: Sequence[str] = BAND_FIELDS,
    order: Sequence[str] = B.COLOR_BANDS,
    seed_band: str = "Full",
    primary_flux: bool = True,
    highest_frequency: bool = False,
    append: bool = True,
    grow_radius: bool = True,
    representative: str = "elevation",
    key: str = "__key",
    base=("RA", "DEC", "BMAJ_match"),
) -> DataFrame:
    """A band's sources on the catalogue: the picked hit of each row, and rows of its own for sources without any.

    A source counts as matched if any row reaches it, picked or not.
    """
    edges = materialize(sky_pairs(meta, band_rows, key, id, base[2], "BMAJ", base[0], base[1]), "edges")
    best = best_hits(edges, band_rows, id, representative)
    c = band_rows.columns
    block = band_block(c, band, fields, F.col("n_assoc").cast("long"), F.col("n_confused").cast("long"), "__b_")
    hit = best.select(F.col("base_id").alias("__base"), "n_assoc", "n_confused", *[F.col(x).alias(f"__b_{x}") for x in c])
    rows = meta.join(hit, F.col(key) == F.col("__base"), "left")
    found = F.col("__base").isNotNull()
    new = {k: v for k, v in block.items()}
    new["bands_present"] = F.when(found, B.add_bands(F.col("bands_present"), band, order=order)).otherwise(F.col("bands_present"))
    if "n_lst_contributions" in meta.columns and "n_lst_contributions" in c:
        new["n_lst_contributions"] = F.col("n_lst_contributions") + F.coalesce(F.col("__b_n_lst_contributions").cast("long"), F.lit(0))
    if grow_radius:
        new["BMAJ_match"] = F.when(found, F.greatest("BMAJ_match", finite("__b_BMAJ"))).otherwise(F.col("BMAJ_match"))
    if highest_frequency:
        take = _nearer(found, F.col("astrometry_band"), band)
        for x in (*SHAPE, *POSITION_QA):
            if x in c and x in meta.columns:
                new[x] = F.when(take, F.col(f"__b_{x}")).otherwise(F.col(x))
        new["astrometry_band"] = F.when(take, F.lit(band)).otherwise(F.col("astrometry_band"))
    rows = rows.withColumns(new).select(*dict.fromkeys([*meta.columns, *block]))
    if append:
        rest = band_rows.join(edges.select(F.col("ref_id").alias("__ref")).distinct(), F.col(id) == F.col("__ref"), "left_anti")
        rows = rows.unionByName(seed_rows(rest, id, band, source, fields, primary_flux, seed_band), allowMissingColumns=True)
    return rows


def add_spectral_indices(meta: DataFrame, pairs=B.SPECTRAL_PAIRS, flux: str = "Total_flux") -> DataFrame:
    new = {}
    for label, a, b in pairs:
        names = [f"{flux}_{a}", f"E_{flux}_{a}", f"{flux}_{b}", f"E_{flux}_{b}"]
        na, nb = B.frequency_hz(a), B.frequency_hz(b)
        missing = F.lit(None).cast("double")
        new[f"alpha_{label}"] = spectral_index(names[0], names[2], na, nb) if names[0] in meta.columns and names[2] in meta.columns else missing
        new[f"E_alpha_{label}"] = spectral_index_error(*names, na, nb) if all(n in meta.columns for n in names) else missing
    return meta.withColumns(new) if new else meta


def fuse(catalogs: dict[str, DataFrame], id: str, seed_band: str = "Full", assoc: Sequence[str] = B.ASSOC_BANDS, fields: Sequence[str] = BAND_FIELDS, order: Sequence[str] = B.COLOR_BANDS, pairs=B.SPECTRAL_PAIRS, primary_flux: bool = True, highest_frequency: bool = False) -> DataFrame:
    """One wide row per position over all bands, joined band after band.

    Later bands see the radii (and, by highest frequency, the positions) that earlier ones
    left, so the bands are joined in turn. What a step needs and changes are the key, position
    and radius of each row: these are written from band to band, with the hits. The wide
    columns of all bands are joined once, at the end. ``meta_id`` numbers the rows in the
    order in which they came up.
    """
    start = lambda band, n, df: df.select(F.struct(F.lit(n).alias("source"), F.col(id).cast("long").alias("id")).alias("__key"), "RA", "DEC", finite("BMAJ").alias("BMAJ_match"), F.lit(band).alias("astrometry_band"))
    now, wide, hits = start(seed_band, 0, catalogs[seed_band]), seed_rows(catalogs[seed_band], id, seed_band, 0, fields, primary_flux, seed_band), {}
    for k, band in enumerate(assoc):
        rows = catalogs[band]
        edges = materialize(sky_pairs(now, rows, "__key", id, "BMAJ_match", "BMAJ"), "edges")
        lst = [c for c in ("lst_hour", "representative_lst") if c in rows.columns][:1]
        slim = rows.select(id, "RA", "DEC", "BMAJ", *_fluxes(rows.columns), *lst)
        best = best_hits(edges, slim, id).select(F.col("base_id").alias("__base"), F.col("__ref"), "n_assoc", "n_confused", F.col("RA").alias("__RA"), F.col("DEC").alias("__DEC"), F.col("BMAJ").alias("__BMAJ"))
        hits[band] = best = materialize(best, "hits")
        now = now.join(best, F.col("__key") == F.col("__base"), "left")
        found = F.col("__base").isNotNull()
        new = {"BMAJ_match": F.when(found, F.greatest("BMAJ_match", finite("__BMAJ"))).otherwise(F.col("BMAJ_match"))}
        if highest_frequency:
            take = _nearer(found, F.col("astrometry_band"), band)
            new |= {x: F.when(take, F.col(f"__{x}")).otherwise(F.col(x)) for x in ("RA", "DEC")} | {"astrometry_band": F.when(take, F.lit(band)).otherwise(F.col("astrometry_band"))}
        own = rows.join(edges.select(F.col("ref_id").alias("__seen")).distinct(), F.col(id) == F.col("__seen"), "left_anti")
        now = materialize(now.withColumns(new).select("__key", "RA", "DEC", "BMAJ_match", "astrometry_band").unionByName(start(band, k + 1, own)), "fuse")
        wide = wide.unionByName(seed_rows(own, id, band, k + 1, fields, primary_flux, seed_band), allowMissingColumns=True)
    wide = wide.drop("BMAJ_match").join(now.select("__key", "BMAJ_match"), "__key")
    for band in assoc:
        wide = _with_hit(wide, hits[band], catalogs[band], id, band, fields, order, highest_frequency)
    rows = wrap_ra_columns(add_spectral_indices(wide, pairs))
    rows = numbered(rows, "meta_id", "__key").drop("__key")
    if not highest_frequency:
        rows = rows.drop("astrometry_band")
    peaks = [f"Peak_flux_{b}" for b in order if f"Peak_flux_{b}" in rows.columns]
    bright = F.col("Peak_flux") if primary_flux else F.greatest(*peaks) if len(peaks) > 1 else F.col(peaks[0])
    return rows.select("meta_id", *[c for c in rows.columns if c != "meta_id"]).orderBy(bright.desc_nulls_last(), "meta_id")


def _nearer(found: Column, astrometry_band: Column, band: str) -> Column:
    """Whether a band's hit takes over the position: its frequency is as high as that of the band it came from."""
    return found & (F.lit(B.frequency_hz(band) or 0.0) >= F.coalesce(B.frequency_column(astrometry_band), F.lit(0.0)))


def _with_hit(wide: DataFrame, hits: DataFrame, rows: DataFrame, id: str, band: str, fields: Sequence[str], order: Sequence[str], highest_frequency: bool) -> DataFrame:
    """The columns of a band's picked hits on the wide rows."""
    c = rows.columns
    hit = hits.select("__base", "__ref", "n_assoc", "n_confused").join(rows.select(*[F.col(x).alias(f"__b_{x}") for x in c]), F.col("__ref") == F.col(f"__b_{id}"))
    out = wide.join(hit, F.col("__key") == F.col("__base"), "left")
    found = F.col("__base").isNotNull()
    block = band_block(c, band, fields, F.col("n_assoc").cast("long"), F.col("n_confused").cast("long"), "__b_")
    # A row that came up in this band keeps its own columns of it.
    new = {k: F.when(found, v).otherwise(F.col(k)) if k in wide.columns else v for k, v in block.items()}
    new["bands_present"] = F.when(found, B.add_bands(F.col("bands_present"), band, order=order)).otherwise(F.col("bands_present"))
    if "n_lst_contributions" in c:
        new["n_lst_contributions"] = F.col("n_lst_contributions") + F.coalesce(F.col("__b_n_lst_contributions").cast("long"), F.lit(0))
    if highest_frequency:
        take = _nearer(found, F.col("astrometry_band"), band)
        new |= {x: F.when(take, F.col(f"__b_{x}")).otherwise(F.col(x)) for x in (*SHAPE, *POSITION_QA) if x in c and x in wide.columns}
        new["astrometry_band"] = F.when(take, F.lit(band)).otherwise(F.col("astrometry_band"))
    return out.withColumns(new).select(*dict.fromkeys([*wide.columns, *block]))


def fuse_subbands(catalogs: dict[str, DataFrame], id: str) -> DataFrame:
    """Subbands onto the highest one; fluxes per band, positions from the highest band of each row."""
    bands = B.in_order(list(catalogs))
    seed = B.seed_band(bands)
    rest = [b for b in reversed(bands) if b != seed]
    return fuse(catalogs, id, seed, rest, FLUX_FIELDS, bands, (), False, True)
