"""Queries that write a table or file into the shared folder and read it back through the engine's readers.

What comes back is compared with SQL over the driver's tables, so each query covers a
writer and a reader. Names of folders are random; nothing is left when the process ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import quality as Q
from skyloom.functions import text as TX
from skyloom.operators import associations as A
from skyloom.operators import beam, healpix
from skyloom.plans import catalog  # noqa: F401  its queries come first
from skyloom.plans.adapters import CUSTOMERS, DETECTIONS, PARTS, SUPPLIERS, relation
from skyloom.plans.base import _C, _D, _REFS, _SQL, _cat, _det, _query, _r
from skyloom.plans.shared import materialize, shared_dir
from skyloom.sources import fits, images, layout, sidecar, surveys

ARCSEC = surveys.ARCSEC


def _place(s: SparkSession, label: str) -> str:
    return f"{shared_dir(s)}/{label}-{uuid.uuid4().hex}"


def _layout(s: SparkSession) -> layout.Layout:
    return layout.Layout(_place(s, "layout"))


def _lines(rows: DataFrame, places: dict, values: dict) -> DataFrame:
    """Fixed-width lines: each value right-adjusted in its columns."""
    line, at = F.lit(""), 0
    for k, (a, z) in sorted(((k, places[k]) for k in values), key=lambda x: x[1]):
        line = F.concat(line, F.lpad(F.lit(""), a - 1 - at, " ") if a - 1 > at else F.lit(""), F.lpad(F.coalesce(values[k].cast("string"), F.lit("")), z - a + 1, " "))
        at = z
    return rows.select(line.alias("value"))


def _text(rows: DataFrame, label: str, suffix: str = ".dat") -> str:
    path = _place(rows.sparkSession, label) + suffix
    rows.write.text(path)
    return path


def _fits(rows: DataFrame, label: str, order: str) -> str:
    """A small table as one FITS file."""
    path = _place(rows.sparkSession, label) + ".fits"
    got = rows.orderBy(order).toPandas()
    fits.write_table(path, {c: got[c].to_numpy() if got[c].dtype.kind in "fiub" else got[c].fillna("").astype(str).to_numpy() for c in got.columns}, rows.sparkSession)
    return path


# ---- layers


@_query("layer_of_one_band", f"WITH {_D} SELECT det_id, lst_hour, round(RA, 6) AS RA, round(BMAJ, 6) AS BMAJ, TRUE AS no_maj FROM det WHERE band = 'Blue'")
def layer_of_one_band(s, d):
    lay = _layout(s)
    lay.write(_det(s, d), "sources")
    rows = lay.read(s, "sources", band="Blue")
    return rows.select("det_id", "lst_hour", _r("RA"), _r("BMAJ"), F.col("Maj").isNull().alias("no_maj"))


@_query("layer_partition_replaced", f"WITH {_D} SELECT band, lst_hour, count(*) AS n, min(det_id) AS first FROM det WHERE band <> 'Blue' OR k % 2 = 0 GROUP BY band, lst_hour")
def layer_partition_replaced(s, d):
    lay = _layout(s)
    lay.write(_det(s, d), "sources")
    lay.write(_det(s, d).where("band = 'Blue' AND k % 2 = 0"), "sources")
    return lay.read(s, "sources").groupBy("band", "lst_hour").agg(F.count(F.lit(1)).alias("n"), F.min("det_id").alias("first"))


@_query("layer_appended", f"WITH {_D} SELECT det_id, band, lst_hour, round(CASE WHEN k % 4 = 1 THEN Peak_flux + 1 ELSE Peak_flux END, 6) AS Peak_flux FROM det WHERE k % 4 < 2 OR band = 'Red'")
def layer_appended(s, d):
    det, lay = _det(s, d), _layout(s)
    lay.append(det.where("k % 4 = 0 OR band = 'Red'"), "sources", "det_id")
    more = det.where("k % 4 = 1").withColumn("Peak_flux", F.col("Peak_flux") + 1)
    for _ in range(2):  # the same rows twice
        lay.append(more, "sources", "det_id")
    return lay.read(s, "sources").select("det_id", "band", "lst_hour", _r("Peak_flux"))


@_query("layer_bands", "SELECT unnest(['Full', 'Blue', 'Green', 'Red']) AS band, unnest(range(4)) AS n")
def layer_bands(s, d):
    lay = _layout(s)
    lay.write(_det(s, d).groupBy("band").agg(F.min("RA").alias("RA"), F.min("DEC").alias("DEC")), "lst_merged")
    return s.createDataFrame([(b, n) for n, b in enumerate(lay.bands(s))], "band string, n long")


@_query("missing_slots", f"WITH {_D}, e AS (SELECT b.band, concat(lpad(CAST(h.h AS VARCHAR), 2, '0'), 'h') AS lst_hour FROM (SELECT unnest(['Full', 'Blue', 'Green', 'Red']) AS band) b, (SELECT unnest(range(24)) AS h) h) SELECT * FROM e EXCEPT SELECT band, lst_hour FROM det")
def missing_slots(s, d):
    lay = _layout(s)
    lay.write(_det(s, d), "sources")
    bands = s.createDataFrame([("Full",), ("Blue",), ("Green",), ("Red",)], "band string")
    slots = bands.select("band", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h")).select("band", F.concat(F.lpad(F.col("h").cast("string"), 2, "0"), F.lit("h")).alias("lst_hour"))
    return lay.missing_slots(s, slots)


@_query("layer_columns_dropped", f"WITH {_D} SELECT det_id, band, TRUE AS gone FROM det WHERE band = 'Red'")
def layer_columns_dropped(s, d):
    lay = _layout(s)
    lay.write(_det(s, d).withColumns({"E_RA": F.lit(1.0), "Gaus_id": F.lit(2)}), "sources")
    planned = lay.drop_columns(s, "sources", dry_run=True)
    done = lay.drop_columns(s, "sources")
    rows = lay.read(s, "sources", band="Red")
    return rows.select("det_id", "band", F.lit(planned == done == ["E_RA", "Gaus_id"] and not {"E_RA", "Gaus_id"} & set(rows.columns)).alias("gone"))


@_query("schema_of_layers", "SELECT unnest(['RA', 'DEC', 'S_Code', 'lst_hour', 'Source_id']) AS name, unnest(['double', 'double', 'string', 'string', 'bigint']) AS kind, 0 AS n")
def schema_of_layers(s, d):
    rows = layout.empty(s)
    kinds = dict(rows.dtypes)
    return s.createDataFrame([(c, kinds[c], rows.count()) for c in ("RA", "DEC", "S_Code", "lst_hour", "Source_id")], "name string, kind string, n int")


@_query("catalogue_without_bad_rows", f"WITH {_C} SELECT meta_id, bands_present FROM cat WHERE quality_flag & {Q.DEFAULT_MASK} = 0")
def catalogue_without_bad_rows(s, d):
    lay = _layout(s)
    lay.write(_cat(s, d), "metacatalog")
    return lay.metacatalog(s).select("meta_id", "bands_present")


@_query("spectral_catalogue_preferred", f"WITH {_C} SELECT meta_id FROM cat WHERE Peak_flux > 20")
def spectral_catalogue_preferred(s, d):
    lay = _layout(s)
    lay.write(_cat(s, d), "metacatalog")
    lay.write(_cat(s, d).where("Peak_flux > 20"), "metacatalog_spectral")
    return lay.metacatalog(s, mask=None, prefer_spectral=True).select("meta_id")


@_query("residual_sidecars", f"WITH {_D} SELECT band, count(*) AS n FROM det WHERE band IN ('Red', 'Green') GROUP BY band")
def residual_sidecars(s, d):
    lay = _layout(s)
    lay.write(_det(s, d).where("band <> 'Blue'"), "residual_matched")
    return lay.read(s, "residual_matched", band=["Red", "Green", "Blue"]).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@_query("catalogue_files_inventory", f"WITH {_D} SELECT concat('sources_', lst_hour, '_', band, '.parquet') AS file, count(*) AS n_rows, 'sources' AS kind, lst_hour, band FROM det WHERE j < 4 GROUP BY ALL")
def catalogue_files_inventory(s, d):
    root = _place(s, "tree")
    det = materialize(_det(s, d).where("j < 4"), "det")
    for r in det.select("lst_hour", "band").distinct().collect():  # a few slots
        det.where((F.col("lst_hour") == r[0]) & (F.col("band") == r[1])).write.parquet(f"{root}/sources_{r[0]}_{r[1]}.parquet")
    return layout.inventory(s, root).select("file", "n_rows", "kind", "lst_hour", "band")


@_query("legacy_csv", f"WITH {_D} SELECT round(RA, 6) AS RA, round(Peak_flux, 6) AS Peak_flux, CASE WHEN k % 3 = 0 THEN NULL ELSE S_Code END AS S_Code, band, TRUE AS no_maj FROM det")
def legacy_csv(s, d):
    path = _place(s, "old") + ".csv"
    _det(s, d).select("RA", "DEC", "Peak_flux", F.expr("CASE WHEN k % 3 = 0 THEN '  ' ELSE concat(' ', S_Code) END").alias("S_Code"), "band", F.lit("x").alias("Maj")).write.csv(path, header=True)
    rows = layout.legacy_csv(s, path)
    return rows.select(_r("RA"), _r("Peak_flux"), "S_Code", "band", F.col("Maj").isNull().alias("no_maj"))


@_query("legacy_migration", f"WITH {_D} SELECT band, lst_hour, count(*) AS n FROM det WHERE j < 3 GROUP BY ALL")
def legacy_migration(s, d):
    root, lay = _place(s, "csv"), _layout(s)
    _det(s, d).where("j < 3").select("RA", "DEC", "band", "lst_hour", "Peak_flux").coalesce(1).write.csv(root, header=True)
    layout.migrate(s, root, lay, dry_run=True)
    layout.migrate(s, root, lay)
    return lay.read(s, "sources").groupBy("band", "lst_hour").agg(F.count(F.lit(1)).alias("n"))


@_query("associations_on_disk", "SELECT CASE l_linenumber WHEN 1 THEN 'RFC' ELSE 'NVSS' END AS catalog, count(*) AS n FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY 1")
def associations_on_disk(s, d):
    path = _place(s, "associations")
    rows = s.read.parquet(f"{d}/lineitem.parquet")
    pick = lambda n: rows.where(f"l_linenumber = {n}").select(F.col("l_orderkey").alias("meta_id"), F.col("l_partkey").cast("string").alias("ref_id"))
    for catalog, new in (("RFC", pick(3)), ("NVSS", pick(2)), ("TeVCat", pick(4)), ("RFC", pick(1)), ("TeVCat", pick(4).limit(0))):
        A.write_catalog(path, new, catalog)
    return s.read.parquet(path).groupBy("catalog").agg(F.count(F.lit(1)).alias("n"))


@_query("json_sidecars", "SELECT unnest(['73MHz', '41MHz', '18MHz']) AS band, unnest([1.25, 1.1, 1.0]) AS alpha, unnest([0.02, 0.0, 0.0]) AS kappa, unnest(['RA', 'DEC', '']) AS shown")
def json_sidecars(s, d):
    path = _place(s, "sidecar")
    beam.write_scale(s, f"{path}/scale.json", {"73MHz": {"alpha": 1.25, "kappa": 0.02}, "41MHz": 1.1})
    sidecar.save_columns(s, f"{path}/columns.json", ["RA", "gone", "DEC", "RA"])
    scales, shown = beam.read_scale(s, f"{path}/scale.json"), [*sidecar.load_columns(s, f"{path}/columns.json", ["DEC", "RA"]), ""]
    rows = s.createDataFrame(list(zip(("73MHz", "41MHz", "18MHz"), shown)), "band string, shown string")
    return rows.select("band", beam.scale_literal(scales).alias("alpha"), beam.scale_literal(scales, "kappa").alias("kappa"), "shown")


# ---- beams and maps


@_query("beams_filled_in", f"WITH {_D} SELECT det_id, round(CASE WHEN k % 2 = 0 THEN BMAJ WHEN band = 'Red' THEN NULL ELSE j / 100.0 END, 6) AS BMAJ FROM det")
def beams_filled_in(s, d):
    rows = _det(s, d)
    beams = rows.where("band <> 'Red'").select("band", "lst_hour", (F.col("j") / 100).alias("BMAJ"), F.lit(1.0).alias("BMIN"), F.lit(0.0).alias("BPA")).distinct()
    rows = rows.withColumn("BMAJ", F.when(F.col("k") % 2 == 0, F.col("BMAJ")))
    return layout.with_beams(rows, beams).select("det_id", _r("BMAJ"))


def _image(path: str, s: SparkSession, bmaj: float | None) -> None:
    cards = [("SIMPLE", "T"), ("BITPIX", "-32"), ("NAXIS", "0")] + ([("BMAJ", repr(bmaj)), ("BMIN", repr(bmaj / 2)), ("BPA", "10.0")] if bmaj else [])
    fits.write_bytes(path, fits.card_block(cards), s)


@_query("beams_of_images", "SELECT concat('image_', s_suppkey, '.fits') AS file, round(CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey / 1000.0 END, 6) AS BMAJ, round(CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey / 2000.0 END, 6) AS BMIN FROM supplier WHERE s_suppkey <= 8")
def beams_of_images(s, d):
    return _beams(s, d).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), _r("BMAJ"), _r("BMIN"))


def _beams(s, d):
    root = _place(s, "images")
    for r in s.read.parquet(f"{d}/supplier.parquet").where("s_suppkey <= 8").select("s_suppkey").collect():  # eight small files
        _image(f"{root}/image_{r[0]}.fits", s, r[0] / 1000 if r[0] % 3 else None)
    return fits.read_beams(s, root)


@_query("median_beam", "SELECT round(quantile_cont(s_suppkey / 1000.0, 0.5), 6) AS BMAJ, round(quantile_cont(s_suppkey / 2000.0, 0.5), 6) AS BMIN, 10.0 AS BPA FROM supplier WHERE s_suppkey <= 8 AND s_suppkey % 3 <> 0")
def median_beam(s, d):
    return fits.median_beam(_beams(s, d)).select(_r("BMAJ"), _r("BMIN"), "BPA")


@_query("healpix_map_file", "SELECT count(*) AS n, round(sum(ipix * value), 3) AS moment, round(sum(value), 3) AS total FROM (SELECT range AS ipix, (range * 7 % 31) / 3.0 AS value FROM range(192)) WHERE ipix % 31 <> 0")
def healpix_map_file(s, d):
    path = _place(s, "map") + ".fits"
    import numpy as np

    n = np.arange(192)
    fits.write_table(path, {"T": np.where(n % 31 == 0, np.nan, n * 7 % 31 / 3)}, s, [("NSIDE", 4), ("ORDERING", "'NESTED'")])
    rows = fits.read_healpix(s, path).where("value IS NOT NULL")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("ipix") * F.col("value")), 3).alias("moment"), F.round(F.sum("value"), 3).alias("total"))


@_query("ring_map_file", "SELECT 192 AS n, 192 AS n_pixels, round(abs(sum(asin(z))), 6) AS latitudes, TRUE AS sorted FROM (SELECT CASE WHEN r <= 4 THEN 1 - r * r / 48.0 WHEN r < 12 THEN (8 - r) / 6.0 ELSE (16 - r) * (16 - r) / 48.0 - 1 END AS z, least(least(r, 16 - r), 4) * 4 AS m FROM (SELECT range AS r FROM range(1, 16))), LATERAL (SELECT unnest(range(m)) AS x)")
def ring_map_file(s, d):
    """A map in ring order: pixel numbers rise from north to south, so their latitudes fall."""
    import numpy as np

    path = _place(s, "map") + ".fits"
    fits.write_table(path, {"T": np.arange(192.0)}, s, [("NSIDE", 4), ("ORDERING", "'RING'")])
    rows = fits.read_healpix(s, path).select("ipix", "value", F.round(healpix.centre(F.col("ipix"), 4)[1], 6).alias("dec"))
    bands = rows.groupBy("dec").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("c"))
    ok = bands.agg(F.min((F.col("hi") - F.col("lo") + 1 == F.col("c")).cast("int")).alias("ok"))
    out = rows.agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_distinct("ipix").cast("int").alias("n_pixels"), F.round(F.abs(F.sum(F.radians("dec"))), 6).alias("latitudes"))
    return out.crossJoin(ok).select("n", "n_pixels", "latitudes", (F.col("ok") == 1).alias("sorted"))


@_query("detector_plugin", "SELECT concat('Blue_I_LST0', s_suppkey, 'h.fits') AS source_file, concat('0', s_suppkey, 'h') AS lst_hour, CASE WHEN s_suppkey % 4 = 0 THEN 'failed: no' WHEN s_suppkey % 2 = 0 THEN 'retried: first' ELSE 'ok' END AS status, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey AS DOUBLE) END AS RA FROM supplier WHERE s_suppkey BETWEEN 1 AND 8")
def detector_plugin(s, d):
    import pandas as pd

    root = _place(s, "images")
    for k in range(1, 9):
        fits.write_bytes(f"{root}/Blue_I_LST0{k}h.fits", b"x" * k, s)

    def first(path, content):
        if len(content) % 2 == 0:
            raise ValueError("first")
        return pd.DataFrame({"RA": [float(len(content))]})

    def again(path, content):
        if len(content) % 4 == 0:
            raise ValueError("no")
        return pd.DataFrame({"RA": [float(len(content))]})

    return images.labelled(images.detect(s, root, first, "RA double", retry=again)).select("source_file", "lst_hour", "status", "RA")


@_query("image_discovery", "SELECT concat('0', s_suppkey, 'h') AS lst_hour, 'Red' AS band, CAST(s_suppkey AS BIGINT) AS length FROM supplier WHERE s_suppkey BETWEEN 1 AND 6")
def image_discovery(s, d):
    root = _place(s, "images")
    for k in range(1, 7):
        fits.write_bytes(f"{root}/0{k}h_Red/Red_I_deep.fits", b"x" * k, s)
    fits.write_bytes(f"{root}/notes.txt", b"x", s)
    return layout.discover(s, root).select("lst_hour", "band", "length")


# ---- surveys


def _sup(s, d):
    return relation(s, d, SUPPLIERS)


def _par(s, d):
    return relation(s, d, PARTS)


@_query("fits_table", f"WITH {_REFS} SELECT ref_id, round(RA, 9) AS RA, kind, ref_id % 2 = 0 AS even FROM par")
def fits_table(s, d):
    rows = _par(s, d).select("ref_id", "RA", "kind", (F.col("ref_id") % 2 == 0).alias("even"), F.lit(1.0).alias("unread"))
    return fits.read_table(s, _fits(rows, "table", "ref_id"), ["ref_id", "RA", "kind", "even"]).select("ref_id", _r("RA", 9), "kind", "even")


_RA, _DEC = "15 * (ref_id % 24 + (ref_id % 60) / 60.0 + (ref_id % 50) / 3600.0)", "(CASE WHEN ref_id % 2 = 0 THEN -1 ELSE 1 END) * (ref_id % 80 + (ref_id % 60) / 60.0 + (ref_id % 50) / 3600.0)"


def _hms(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("*", "CAST(ref_id % 24 AS STRING) AS h", "CAST(ref_id % 60 AS STRING) AS m", "CAST(ref_id % 50 AS STRING) AS s", "CASE WHEN ref_id % 2 = 0 THEN '-' ELSE '+' END AS sign", "CAST(ref_id % 80 AS STRING) AS dd")


@_query("survey_vlssr", f"WITH {_REFS} SELECT round(RA, 4) AS RA, round(DEC, 4) AS DEC, round(Peak_flux, 5) AS Peak_flux, round(80 / 3600e0, 9) AS BMAJ FROM cust")
def survey_vlssr(s, d):
    # All digits: values that the file has rounded would be rounded twice.
    rows = relation(s, d, CUSTOMERS).select(F.format_string("  %s   %s %s", *[F.col(c).cast("string") for c in ("RA", "DEC", "Peak_flux")]).alias("value"))
    path = _text(rows.unionByName(s.createDataFrame([('RA(2000) DEC(2000) "PEAK INT"',)], "value string")), "vlssr", ".txt")
    return surveys.vlssr(s, path).select(_r("RA", 4), _r("DEC", 4), _r("Peak_flux", 5), _r("BMAJ", 9))


@_query("survey_nvss", f"WITH {_REFS} SELECT round({_RA}, 6) AS RA, round({_DEC}, 6) + 0.0 AS DEC, round(ref_id / 1000e0, 6) AS Total_flux, round(0.5 * 15 * cos(radians({_DEC})) / 3600, 9) AS E_RA, round(1.5 / 3600e0, 9) AS E_DEC FROM par")
def survey_nvss(s, d):
    places = {"e_RAs": (55, 59), "e_DEs": (61, 64), "S14": (66, 73), "e_S14": (75, 81), "Maj": (86, 90), "Min": (95, 99), "PA": (104, 108), "Pol": (118, 124)}
    values = {"RAh": F.col("h"), "RAm": F.col("m"), "RAs": F.col("s"), "DE": F.col("sign"), "DEd": F.col("dd"), "DEm": F.col("m"), "DEs": F.col("s"), "e_RAs": F.lit("0.50"), "e_DEs": F.lit("1.5"), "S14": F.col("ref_id"), "Pol": F.lit("1.0")}
    path = _text(_lines(_hms(_par(s, d)), surveys.NVSS | places, values), "nvss")
    return surveys.nvss(s, path).select(_r("RA"), (F.round("DEC", 6) + 0.0).alias("DEC"), _r("Total_flux"), _r("E_RA", 9), _r("E_DEC", 9))


@_query(
    "survey_rfc",
    f"""WITH {_REFS} SELECT concat('J', ref_id) AS "Name", round({_RA}, 6) AS RA, round({_DEC}, 6) + 0.0 AS DEC, round(CASE WHEN ref_id % 5 <> 0 THEN ref_id / 10e0 END, 6) AS "FsX",
CASE WHEN ref_id % 3 = 0 THEN NULL WHEN ref_id % 3 = 1 THEN 'QSO' ELSE '' END AS type, round(CASE WHEN ref_id % 3 > 0 THEN (ref_id % 40) / 10e0 END, 6) AS z FROM par""",
)
def survey_rfc(s, d):
    rows = _hms(_par(s, d)).withColumn("name", F.concat(F.lit("J"), "ref_id"))
    values = {"Name": F.col("name"), "RAh": F.col("h"), "RAm": F.col("m"), "RAs": F.col("s"), "DE": F.col("sign"), "DEd": F.col("dd"), "DEm": F.col("m"), "DEs": F.col("s"), "eRA": F.lit("1.0"), "eDE": F.lit("1.0"), "FsX": F.expr("CASE WHEN ref_id % 5 = 0 THEN '-9.99' ELSE CAST(ref_id / 10 AS STRING) END")}
    more = {"Name": F.col("name"), "z": F.expr("CAST((ref_id % 40) / 10 AS STRING)"), "type": F.expr("CASE WHEN ref_id % 3 = 1 THEN 'QSO' ELSE 'nan' END")}
    main, second = _text(_lines(rows, surveys.RFC, values), "rfc", ".txt"), _text(_lines(rows.where("ref_id % 3 > 0"), surveys.RFC_COMPANION, more), "rfx", ".txt")
    return surveys.rfc(s, main, second).select("Name", _r("RA"), (F.round("DEC", 6) + 0.0).alias("DEC"), _r("FsX"), "type", _r("z"))


@_query("survey_vlass", f"WITH {_REFS} SELECT concat('c', ref_id) AS \"Component_name\", round(Peak_flux / 1000, 9) AS Peak_flux, round(1 / 3600e0, 9) AS Maj FROM par WHERE ref_id % 4 <= 1 AND ref_id % 6 IN (0, 4) AND ref_id % 7 <> 0")
def survey_vlass(s, d):
    path = _place(s, "vlass") + ".csv"
    _par(s, d).selectExpr("concat('c', ref_id) AS Component_name", "RA", "DEC", "E_RA", "E_DEC", "Peak_flux", "Total_flux", "1.0D AS Maj", "1.0D AS Min", "ref_id % 4 AS Duplicate_flag", "ref_id % 6 AS Quality_flag", "CASE WHEN ref_id % 7 = 0 THEN 'E' ELSE 'S' END AS S_Code").write.csv(path, header=True)
    return surveys.vlass(s, path).select("Component_name", _r("Peak_flux", 9), _r("Maj", 9))


@_query("survey_gleam", f"WITH {_REFS} SELECT concat('G', ref_id) AS \"Name\", round((1 + ref_id % 5) / 3600e0, 9) AS E_RA, round(Total_flux, 6) AS Total_flux, round(Total_flux * 2, 6) AS \"Total_flux_GLEAM76\", round(CASE WHEN ref_id % 2 = 0 THEN 0.05 ELSE 120 / 3600e0 END, 9) AS BMAJ FROM par")
def survey_gleam(s, d):
    rows = _par(s, d).selectExpr("ref_id", "concat('G', ref_id) AS GLEAM", "RA AS RAJ2000", "DEC AS DEJ2000", "CAST(1 + ref_id % 5 AS DOUBLE) AS err_RAJ2000", "CAST(1 + ref_id % 5 AS DOUBLE) AS err_DEJ2000", "Peak_flux AS peak_flux_wide", "Total_flux AS int_flux_wide", "Total_flux * 2 AS int_flux_076", "CASE WHEN ref_id % 2 = 0 THEN 180D ELSE -1D END AS psf_a_wide", "120D AS psf_b_wide")
    path = _place(s, "gleam") + ".parquet"
    rows.write.parquet(path)
    return surveys.gleam(s, path).select("Name", _r("E_RA", 9), _r("Total_flux"), _r("Total_flux_GLEAM76"), _r("BMAJ", 9))


@_query("survey_lodess", f"WITH {_REFS} SELECT ref_id, round(RA, 6) AS RA, round(45 / 3600e0, 9) AS BMAJ FROM par WHERE ref_id % 3 <> 0")
def survey_lodess(s, d):
    rows = _par(s, d).select("ref_id", F.when(F.col("ref_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("RA")).alias("RA"), "DEC")
    return surveys.lodess(s, _fits(rows, "lodess", "ref_id")).select("ref_id", _r("RA"), _r("BMAJ", 9))


@_query("survey_milliquas", f"WITH {_REFS} SELECT ref_id, nullif(regexp_extract(type, '[QABKNS]'), '') AS class_primary, type LIKE '%R%' AS has_radio, type LIKE '%X%' AS has_xray, type LIKE '%2%' AS has_double_lobe, regexp_matches(type, '[KN]') AS type_ii FROM par")
def survey_milliquas(s, d):
    rows = _par(s, d).selectExpr("ref_id", "RA AS RAdeg", "DEC AS DEdeg", "kind AS Name", "type AS Type")
    return surveys.milliquas(s, _fits(rows, "milliquas", "ref_id")).select("ref_id", "class_primary", "has_radio", "has_xray", "has_double_lobe", "type_ii")


@_query("survey_nedlvs", f"WITH {_REFS} SELECT ref_id, round(RA, 6) AS RA, round(DEC, 6) AS DEC FROM sup WHERE ref_id % 4 <> 0")
def survey_nedlvs(s, d):
    rows = _sup(s, d).selectExpr("ref_id", "RA AS ra", "CASE WHEN ref_id % 4 = 0 THEN double('nan') ELSE DEC END AS dec")
    return surveys.nedlvs(s, _fits(rows, "ned", "ref_id")).select("ref_id", _r("RA"), _r("DEC"))


@_query("survey_freund", f"WITH {_REFS} SELECT concat('2RXS J', ref_id) AS name_2rxs, round((CASE WHEN ref_id % 3 = 0 THEN 12 ELSE ref_id % 10 + 1 END) / 3600e0 / sqrt(2e0), 9) AS E_RA, CASE ref_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'true' ELSE 'false' END AS subdwarf FROM par")
def survey_freund(s, d):
    values = {"name_2rxs": F.expr("concat('2RXS J', ref_id)"), "ePos": F.expr("CASE WHEN ref_id % 3 = 0 THEN '' ELSE CAST(ref_id % 10 + 1 AS STRING) END"), "pstellar": F.lit("0.9"), "RA": F.round("RA", 5), "DEC": F.round("DEC", 5), "subdwarf": F.expr("CASE ref_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'True' ELSE 'False' END")}
    return surveys.freund2022(s, _text(_lines(_par(s, d), surveys.FREUND, values), "freund")).select("name_2rxs", _r("E_RA", 9), F.col("subdwarf").cast("string").alias("subdwarf"))


@_query("survey_2rxs", f"WITH {_REFS} SELECT concat('2RXS J', ref_id) AS name, CAST(ref_id % 20 AS DOUBLE) AS \"ExiML\", round(CASE WHEN ref_id % 3 = 0 THEN 15 ELSE 45 * sqrt(0.09 + 0.16) END, 6) AS \"POS_ERR\" FROM par")
def survey_2rxs(s, d):
    blank = lambda v: F.expr(f"CASE WHEN ref_id % 3 = 0 THEN '' ELSE '{v}' END")
    values = {"name": F.expr("concat('2RXS J', ref_id)"), "ExiML": F.col("ref_id") % 20, "RA": F.round("RA", 4), "DEC": F.round("DEC", 4), "e_Xima": blank("0.3"), "e_Yima": blank("0.4")}
    return surveys.tworxs(s, _text(_lines(_par(s, d), surveys.TWORXS, values), "tworxs")).select("name", "ExiML", _r("POS_ERR"))


@_query("survey_erass3", f"WITH {_REFS} SELECT ref_id, CASE WHEN ref_id % 4 = 0 THEN 'blazar' ELSE CAST(ref_id % 3 - 1 AS VARCHAR) END AS class_gal_exgal, round((CASE WHEN ref_id % 5 = 0 THEN 4 ELSE ref_id % 5 END) / 3600e0 / sqrt(2e0), 9) AS E_RA FROM par")
def survey_erass3(s, d):
    rows = _par(s, d).selectExpr("ref_id", "RA", "DEC", "CAST(ref_id % 5 AS DOUBLE) AS POS_ERR", "ref_id % 3 - 1 AS class_gal_exgal", "ref_id % 4 = 0 AS is_blazar_in_simbad", "1.0D AS unread")
    return surveys.erass3(s, _fits(rows, "erass", "ref_id"), ["ref_id", "RA", "DEC", "POS_ERR", "class_gal_exgal", "is_blazar_in_simbad"]).select("ref_id", "class_gal_exgal", _r("E_RA", 9))


@_query("survey_xu2022", f"WITH {_REFS} SELECT ref_id AS \"RXGCC\", round((CASE WHEN ref_id % 3 = 0 THEN ref_id % 7 + 1 WHEN ref_id % 3 = 1 THEN 6 ELSE 9 END) / 60e0, 9) AS BMAJ, CASE WHEN ref_id % 2 = 0 THEN 'S' END AS \"Class\" FROM par")
def survey_xu2022(s, d):
    rows = _par(s, d).selectExpr("ref_id AS RXGCC", "RA AS RAdeg", "DEC AS DEdeg", "CASE WHEN ref_id % 3 = 0 THEN ref_id % 7 + 1D ELSE 0D END AS R500", "CASE WHEN ref_id % 3 = 1 THEN 6D ELSE -1D END AS Ext", "CASE WHEN ref_id % 2 = 0 THEN 'S ' ELSE '' END AS Class")
    return surveys.xu2022(s, _fits(rows, "xu", "RXGCC")).select("RXGCC", _r("BMAJ", 9), "Class")


@_query("survey_tevcat", f"WITH {_REFS} SELECT concat('TeV J', ref_id) AS tevcat_name, round(RA, 5) AS RA, round(CASE WHEN ref_id % 2 = 0 THEN (ref_id % 5 + 1) / 10e0 ELSE 0.05 END, 6) AS BMAJ FROM sup")
def survey_tevcat(s, d):
    cells = F.concat(*[F.concat(F.lit("<TD>"), c.cast("string"), F.lit("</TD>")) for c in (F.col("ref_id"), F.expr("concat('TeV J', ref_id)"), F.round("RA", 9), F.round("DEC", 9), F.expr("CASE WHEN ref_id % 2 = 0 THEN (ref_id % 5 + 1) / 10 ELSE 0 END"))])
    rows = _sup(s, d).orderBy("ref_id").agg(F.concat_ws("", F.collect_list(F.concat(F.lit("<TR>"), cells, F.lit("</TR>"))))).first()[0]  # a small table
    fields = "".join(f'<FIELD name="{n}" datatype="char"/>' for n in ("id", "tevcat_name", "ra", "dec", "size_x"))
    path = _place(s, "tevcat") + ".vot"
    fits.write_bytes(path, f"<VOTABLE><RESOURCE><TABLE>{fields}<DATA><TABLEDATA>{rows}</TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>".encode(), s)
    return surveys.tevcat(s, path).select("tevcat_name", _r("RA", 5), _r("BMAJ"))


@_query("parquet_paths", "SELECT unnest(['a/b.parquet', 'a/b.pq', 'a/b', 'a/b.csv', 'a/b.fits']) AS path, unnest([TRUE, TRUE, TRUE, FALSE, FALSE]) AS ok")
def parquet_paths(s, d):
    def ok(path: str) -> bool:
        try:
            return layout.parquet_path(path) == path
        except ValueError:
            return False

    return s.createDataFrame([(p, ok(p)) for p in ("a/b.parquet", "a/b.pq", "a/b", "a/b.csv", "a/b.fits")], "path string, ok boolean")


@_query("fixed_width_fields", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, nullif(trim(substr(p_type, 1, 6)), '') AS kind FROM part")
def fixed_width_fields(s, d):
    rows = s.read.parquet(f"{d}/part.parquet").withColumn("line", F.concat(F.lpad(F.col("p_size").cast("string"), 5, " "), F.rpad("p_type", 25, " ")))
    return rows.select("p_partkey", TX.number(F.col("line"), 1, 5).alias("size"), TX.field(F.col("line"), 6, 11).alias("kind"))


# ---- streams


@_query("streaming_windows", "SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_windows(s, d):
    """Events read as a stream, counted in windows, kept as a table that each batch replaces."""
    from skyloom.streaming.ingest import windowed_counts

    place = _place(s, "stream")
    events = s.readStream.schema(s.read.parquet(f"{d}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    counts = windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp")))
    keep = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{place}/counts")
    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{place}/counts").withColumn("start", F.col("start").cast("timestamp_ntz"))


@_query("streamed_merge", _SQL["lst_merge"].replace(_D, f"all_det AS ({DETECTIONS}), det AS (SELECT * FROM all_det WHERE band = 'Blue')").replace("'Full' AS band", "'Blue' AS band"))
def streamed_merge(s, d):
    """Detections of one band that come in two batches, the first of them twice: merged as if they had come together."""
    from skyloom.streaming.ingest import merge_batch

    lay, blue = _layout(s), _det(s, d).where("band = 'Blue'")
    step = merge_batch(lay)
    parts = [blue.where("j = 1"), blue.where("j = 5")]
    for n, part in enumerate([*parts, parts[0]]):
        step(part, n)
    out = lay.read(s, "lst_merged", band="Blue")
    return out.select("det_id", "root", _r("RA"), _r("DEC"), _r("Peak_flux"), "n_lst_contributions", "lst_hours", "representative_lst", _r("Peak_flux_std"), _r("cluster_jitter_rms_deg"), "band")
