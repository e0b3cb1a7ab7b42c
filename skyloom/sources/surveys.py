"""Loaders of external surveys: one table each with RA, DEC, errors and fluxes in degrees and Jy."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.bands import GLEAM_BANDS
from skyloom.functions.sphere import finite, positive
from skyloom.functions.text import clean, code, field, milliquas_class, milliquas_flags, number, sexagesimal, without_sentinel
from skyloom.operators.summary import first_per_key
from skyloom.sources.fits import read_table

ARCSEC = 1 / 3600
# Beams in arcseconds.
BEAM = {"VLSSR": 80.0, "NVSS": 45.0, "VLASS": 2.5, "LoDeSS": 45.0, "GLEAM": 120.0}


def _located(df: DataFrame) -> DataFrame:
    return df.withColumns({"RA": finite("RA"), "DEC": finite("DEC")}).where("RA IS NOT NULL AND DEC IS NOT NULL")


def _beam(df: DataFrame, survey: str) -> DataFrame:
    return df.withColumns({"BMAJ": F.lit(BEAM[survey] * ARCSEC), "BMIN": F.lit(BEAM[survey] * ARCSEC)})


def _any(spark: SparkSession, path: str) -> DataFrame:
    """A table in the format that its suffix tells."""
    low = path.lower().rstrip("/")
    if low.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    if low.endswith((".csv", ".csv.gz")):
        return spark.read.csv(path, header=True)
    if low.endswith((".fits", ".fit")):
        return read_table(spark, path)
    raise ValueError(f"unknown format: {path}")


def _is_table(path: str) -> bool:
    return path.lower().endswith((".parquet", ".pq", ".csv", ".csv.gz", ".fits", ".fit"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))


def _radial(c: Column, default_arcsec: float) -> dict[str, Column]:
    """Axis errors of a radial error in arcseconds."""
    r = F.coalesce(positive(c), F.lit(default_arcsec))
    return {"E_RA": r * ARCSEC / math.sqrt(2), "E_DEC": r * ARCSEC / math.sqrt(2), "POS_ERR": r}


def _pick(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of several column names that a table has, whatever their case."""
    lower = {c.lower(): c for c in df.columns}
    for n in names:
        if n in df.columns or n.lower() in lower:
            return F.col(f"`{n if n in df.columns else lower[n.lower()]}`")
    return F.lit(None).cast("double")


def vlssr(spark: SparkSession, path: str) -> DataFrame:
    """White-space text: RA, Dec, peak in Jy, below one header line."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(*[F.get(p, F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(("RA", "DEC", "Peak_flux"))])
    return _beam(_located(rows), "VLSSR")


# Places (from 1, ends included) in the lines of the NVSS table.
NVSS = {"Field": (1, 8), "Xpos": (10, 16), "Ypos": (18, 24), "RAh": (31, 32), "RAm": (34, 35), "RAs": (37, 41), "DE": (43, 43), "DEd": (44, 45), "DEm": (47, 48), "DEs": (50, 53)}


def nvss(spark: SparkSession, path: str, places: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """A table, or fixed-width lines with sexagesimal positions, errors in s and arcsec, fluxes in mJy."""
    if _is_table(path):
        rows = _any(spark, path)
        flux = _pick(rows, ("Peak_intensity", "Total_flux", "S1.4"))
        rows = rows.withColumn("Peak_intensity", flux.cast("double"))
    else:
        at = NVSS | (places or {"e_RAs": (55, 59), "e_DEs": (61, 64), "S14": (66, 73), "e_S14": (75, 81), "Maj": (86, 90), "Min": (95, 99), "PA": (104, 108), "Pol": (118, 124)})
        n = lambda k: number(F.col("value"), *at[k])
        t = lambda k: field(F.col("value"), *at[k])
        dec = sexagesimal(t("DEd"), t("DEm"), t("DEs"), t("DE"))
        rows = _lines(spark, path).select(
            (sexagesimal(t("RAh"), t("RAm"), t("RAs")) * 15).alias("RA"), dec.alias("DEC"), (n("e_RAs") * 15 * F.cos(F.radians(dec)) * ARCSEC).alias("E_RA"), (n("e_DEs") * ARCSEC).alias("E_DEC"),
            (n("S14") / 1000).alias("Total_flux"), (n("S14") / 1000).alias("Peak_intensity"), (n("e_S14") / 1000).alias("E_Total_flux"), (n("Maj") * ARCSEC).alias("Maj"), (n("Min") * ARCSEC).alias("Min"), n("PA").alias("PA"), (n("Pol") / 1000).alias("Pol_flux"), t("Field").alias("Field"),
        )
    return _beam(_located(rows), "NVSS")


def vlass(spark: SparkSession, path: str, max_duplicate: int = 1, qualities: Sequence[int] = (0, 4), empty_code: str = "E") -> DataFrame:
    """Components without duplicates, low quality and empty islands; mJy and arcseconds become Jy and degrees."""
    df = spark.read.csv(path, header=True)
    num = lambda c: F.col(c).try_cast("double")
    ok = (num("Duplicate_flag") <= max_duplicate) & num("Quality_flag").isin(*map(float, qualities)) & (F.col("S_Code") != empty_code)
    keep = {"RA": num("RA"), "DEC": num("DEC"), "E_RA": num("E_RA"), "E_DEC": num("E_DEC")}
    keep |= {c: num(c) / 1000 for c in ("Peak_flux", "Total_flux", "E_Peak_flux", "E_Total_flux") if c in df.columns}
    keep |= {c: num(c) * ARCSEC for c in ("Maj", "Min", "BMAJ", "BMIN") if c in df.columns} | {c: num(c) for c in ("PA", "BPA") if c in df.columns}
    rows = df.where(ok).select("Component_name", "S_Code", *[v.alias(k) for k, v in keep.items()])
    return _located(rows if "BMAJ" in rows.columns else _beam(rows, "VLASS"))


def lodess(spark: SparkSession, path: str) -> DataFrame:
    return _beam(_located(_any(spark, path)), "LoDeSS")


def gleam(spark: SparkSession, path: str) -> DataFrame:
    """Wide-band and 20 narrow-band fluxes under one set of names."""
    df = _any(spark, path)
    out = {
        "Name": _pick(df, ("GLEAM", "Name")).cast("string"), "RA": _pick(df, ("RAJ2000", "RA", "ra")), "DEC": _pick(df, ("DEJ2000", "DEC", "dec")),
        "E_RA": _pick(df, ("err_RAJ2000", "e_RAJ2000", "E_RA")), "E_DEC": _pick(df, ("err_DEJ2000", "e_DEJ2000", "E_DEC")),
        "Peak_flux": _pick(df, ("peak_flux_wide", "Fpwide", "Peak_flux")), "Total_flux": _pick(df, ("int_flux_wide", "Fintwide", "Total_flux")),
        "BMAJ": _pick(df, ("psf_a_wide", "psfawide")).cast("double") * ARCSEC, "BMIN": _pick(df, ("psf_b_wide", "psfbwide")).cast("double") * ARCSEC,
    }
    for b in GLEAM_BANDS:
        m = b[5:].zfill(3)
        for ours, theirs in (("Peak_flux", "peak_flux"), ("Total_flux", "int_flux"), ("E_Peak_flux", "err_peak_flux"), ("E_Total_flux", "err_int_flux")):
            out[f"{ours}_{b}"] = _pick(df, (f"{theirs}_{m}",)).cast("double")
    rows = _located(df.select(*[v.alias(k) for k, v in out.items()]))
    # Errors above one degree can only be arcseconds.
    limit = rows.agg(F.percentile(F.abs(finite("E_RA")), 0.5).alias("__m"))
    scale = F.when(F.col("__m") > 0.1, ARCSEC).otherwise(1.0)
    rows = rows.crossJoin(F.broadcast(limit)).withColumns({c: finite(c) * scale for c in ("E_RA", "E_DEC")}).drop("__m")  # one row
    return rows.withColumns({c: F.coalesce(positive(c), F.lit(BEAM["GLEAM"] * ARCSEC)) for c in ("BMAJ", "BMIN")})


# Places in the lines of the RFC tables.
RFC = {"Name": (1, 14), "Comnam": (17, 24), "RAh": (27, 28), "RAm": (30, 31), "RAs": (33, 41), "DE": (43, 43), "DEd": (44, 45), "DEm": (47, 48), "DEs": (50, 57), "eRA": (60, 65), "eDE": (67, 72), "FsS": (105, 110), "FsX": (149, 154)}
RFC_COMPANION = {"Name": (1, 14), "PA_jet": (625, 630), "z": (633, 638), "type": (662, 668)}


def rfc(spark: SparkSession, path: str, companion: str | None = None) -> DataFrame:
    """VLBI positions with fluxes, joined by name with types, redshifts and jet angles."""
    if _is_table(path):
        rows = _any(spark, path)
    else:
        n = lambda k: number(F.col("value"), *RFC[k])
        t = lambda k: field(F.col("value"), *RFC[k])
        mas = ARCSEC / 1000
        rows = _lines(spark, path).select(t("Name").alias("Name"), t("Comnam").alias("Comnam"), (sexagesimal(t("RAh"), t("RAm"), t("RAs")) * 15).alias("RA"), sexagesimal(t("DEd"), t("DEm"), t("DEs"), t("DE")).alias("DEC"), (n("eRA") * mas).alias("E_RA"), (n("eDE") * mas).alias("E_DEC"), without_sentinel(n("FsS")).alias("FsS"), without_sentinel(n("FsX")).alias("FsX"))
    rows = _located(rows)
    if companion is None:
        return rows
    if _is_table(companion):
        more = _any(spark, companion)
    else:
        more = _lines(spark, companion).select(*[(number if k in ("PA_jet", "z") else field)(F.col("value"), *p).alias(k) for k, p in RFC_COMPANION.items()])
    more = first_per_key(more.where(F.trim("Name") != "").withColumns({"Name": F.trim("Name"), "type": clean(F.col("type"))}), ["Name"], "type", "z")
    return rows.drop("type", "z", "PA_jet").join(more.select("Name", *[c for c in ("type", "z", "PA_jet") if c in more.columns]), "Name", "left")


ERASS3_COLUMNS = ("IAUNAME", "RA", "DEC", "POS_ERR", "DET_LIKE_0", "ML_FLUX_1", "LS10_OBJID", "class_gal_exgal", "is_blazar_in_simbad", "main_id_simbad")


def erass3(spark: SparkSession, path: str, names: Sequence[str] = ERASS3_COLUMNS) -> DataFrame:
    """A few columns of a very wide table; blazars are marked in the class."""
    df = read_table(spark, path, list(names)) if not _is_table(path) or path.lower().endswith((".fits", ".fit")) else _any(spark, path)
    rows = _located(df)
    if "POS_ERR" in rows.columns:
        rows = rows.withColumns(_radial(F.col("POS_ERR"), 4.0))
    if "is_blazar_in_simbad" in rows.columns and "class_gal_exgal" in rows.columns:
        rows = rows.withColumn("class_gal_exgal", F.when(F.coalesce(F.col("is_blazar_in_simbad").cast("boolean"), F.lit(False)), "blazar").otherwise(F.col("class_gal_exgal").cast("string")))
    return rows


# Places in the lines of the ROSAT tables.
FREUND = {"name_2rxs": (1, 21), "Match": (23, 44), "ePos": (46, 51), "Sep": (53, 58), "pstellar": (60, 65), "pij": (67, 72), "RA": (74, 83), "DEC": (85, 95), "FX": (97, 104), "HR": (106, 110), "Gmag": (112, 117), "BP_RP": (119, 124), "plx": (126, 132), "subdwarf": (134, 138)}
TWORXS = {"name": (1, 21), "Seq": (23, 28), "IndDet": (30, 32), "ExiML": (34, 42), "Cts": (44, 52), "e_Cts": (54, 63), "CRate": (65, 72), "e_CRate": (74, 80), "ExpTime": (82, 89), "RA": (91, 99), "DEC": (101, 109), "Ext": (177, 185), "e_Ext": (187, 193), "ExtML": (195, 201), "HR1": (203, 208), "e_HR1": (210, 217), "HR2": (219, 224), "e_HR2": (226, 234), "Sflag": (242, 244), "Fluxp": (463, 472), "e_Xima": (756, 763), "e_Yima": (765, 772)}


def freund2022(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(spark, path).select(*[(field if k in ("name_2rxs", "Match", "subdwarf") else number)(F.col("value"), *p).alias(k) for k, p in FREUND.items()])
    flag = F.lower("subdwarf")
    rows = rows.withColumn("subdwarf", F.when(flag == "true", True).when(flag == "false", False))
    return _located(rows.withColumns(_radial(F.col("ePos"), 12.0)))


def tworxs(spark: SparkSession, path: str) -> DataFrame:
    """X-ray sources; image errors in pixels of 45 arcseconds become a radial error."""
    rows = _lines(spark, path).select(*[(field if k == "name" else number)(F.col("value"), *p).alias(k) for k, p in TWORXS.items()])
    error = 45.0 * F.hypot(finite("e_Xima"), finite("e_Yima"))
    return _located(rows.withColumns(_radial(error, 15.0)))


def xu2022(spark: SparkSession, path: str) -> DataFrame:
    """X-ray clusters; the beam is their extent in arcminutes, or 9."""
    df = read_table(spark, path)
    extent = F.coalesce(positive(_pick(df, ("R500*",))), positive(_pick(df, ("R500",))), positive(_pick(df, ("Ext",))), F.lit(9.0))
    out = {"RXGCC": _pick(df, ("RXGCC",)), "RA": _pick(df, ("RAdeg", "RA")), "DEC": _pick(df, ("DEdeg", "DEC")), "Class": code(_pick(df, ("Class",)).cast("string")), "z": _pick(df, ("z",)), "BMAJ": extent / 60}
    return _located(df.select(*[v.alias(k) for k, v in out.items()]))


def tevcat(spark: SparkSession, path: str) -> DataFrame:
    """A VOTable of gamma-ray sources: rows of cells, named by its fields."""
    names = [r[0] for r in spark.read.format("xml").option("rowTag", "FIELD").load(path).select("_name").collect()]
    cells = spark.read.format("xml").option("rowTag", "TR").option("nullValue", "").schema("TD array<string>").load(path)
    rows = cells.select(*[code(F.get("TD", F.lit(k))).alias(n) for k, n in enumerate(names)])
    size = F.greatest(*[F.coalesce(positive(_pick(rows, (c,)).try_cast("double")), F.lit(0.0)) for c in ("size_x", "size_y")])
    rows = rows.withColumns({"RA": _pick(rows, ("ra", "RA")).try_cast("double"), "DEC": _pick(rows, ("dec", "DEC")).try_cast("double"), "BMAJ": F.when(size > 0, size).otherwise(3.0 / 60)})
    return _located(rows)


def milliquas(spark: SparkSession, path: str) -> DataFrame:
    """Quasars with their class letter and associations; names of radio and X-ray sources differ by case and are kept apart."""
    df = _any(spark, path) if _is_table(path) else read_table(spark, path)
    spark_names = {c: f"radio_{c}" if c == "RName" else f"redshift_{c}" if c == "rName" else c for c in df.columns}
    df = df.toDF(*[spark_names[c] for c in df.columns])
    kind = code(F.col("Type").cast("string"))
    rows = df.withColumns({"RA": _pick(df, ("RAdeg", "RA")), "DEC": _pick(df, ("DEdeg", "DEC")), "Name": code(F.col("Name").cast("string")), "Type": kind})
    return _located(rows.withColumns({"class_primary": milliquas_class(F.col("Type")), "class_label": F.col("Type"), **milliquas_flags(F.col("Type"))}))


def nedlvs(spark: SparkSession, path: str) -> DataFrame:
    df = _any(spark, path)
    return _located(df.withColumns({"RA": _pick(df, ("ra", "RA")), "DEC": _pick(df, ("dec", "DEC"))}))


LOADERS = {"VLSSR": vlssr, "NVSS": nvss, "VLASS": vlass, "LoDeSS": lodess, "GLEAM": gleam, "RFC": rfc, "eRASS3": erass3, "Freund2022": freund2022, "Xu2022": xu2022, "2RXS": tworxs, "TeVCat": tevcat, "MilliQuas": milliquas, "NEDLVS": nedlvs}
