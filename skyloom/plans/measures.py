"""Queries of column functions: positions, labels, codes, bands, fluxes, selections.

Where the tables have no such column, its values are made alike by the query and its SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import bands as B
from skyloom.functions import flux as X
from skyloom.functions import selection as SEL
from skyloom.functions import sphere as S
from skyloom.functions import text as TX
from skyloom.operators import beam, match, outliers, reliability, spectral, summary
from skyloom.plans.adapters import PARTS, SPECTRA, relation, separation
from skyloom.plans.base import _C, _D, _REFS, _cat, _det, _query, _r
from skyloom.sources import layout

_NAN, _INF = "CAST('NaN' AS DOUBLE)", "CAST('Infinity' AS DOUBLE)"


def _part(s, d, *columns: str):
    return s.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey", *columns)


# ---- positions


@_query("wrapped_positions", f"WITH {_D} SELECT det_id, round((((RA * 3 - 400) % 360) + 360) % 360, 6) AS RA, round((((RA - 360) % 360) + 360) % 360, 6) AS RA_Blue, round(RA - 360, 6) AS E_RA FROM det")
def wrapped_positions(s, d):
    rows = _det(s, d).selectExpr("det_id", "RA * 3 - 400 AS RA", "RA - 360 AS RA_Blue", "RA - 360 AS E_RA")
    return S.wrap_ra_columns(rows).select("det_id", _r("RA"), _r("RA_Blue"), _r("E_RA"))


_HOLES = f"CASE WHEN k % 7 = 0 THEN {_NAN} ELSE RA END AS RA, CASE WHEN k % 11 = 0 THEN {_INF} WHEN k % 13 = 0 THEN NULL ELSE DEC END AS DEC"


@_query("finite_positions", f"WITH {_D}, h AS (SELECT det_id, {_HOLES} FROM det) SELECT det_id, round(RA, 6) AS RA, round(DEC, 6) AS DEC FROM h WHERE isfinite(RA) AND isfinite(DEC)")
def finite_positions(s, d):
    rows = _det(s, d).selectExpr("det_id", *_HOLES.replace("END AS RA, ", "END AS RA|").split("|"))
    return rows.where(S.finite("RA").isNotNull() & S.finite("DEC").isNotNull()).select("det_id", _r("RA"), _r("DEC"))


_MOVED = f"CASE WHEN meta_id % 3 = 0 THEN NULL ELSE RA + 0.25e0 END AS match_RA, CASE WHEN meta_id % 5 = 0 THEN {_NAN} ELSE DEC / 2e0 END AS match_DEC"
_BOTH = "match_RA IS NOT NULL AND match_DEC IS NOT NULL AND isfinite(match_DEC)"


def _moved(s, d):
    return _cat(s, d).selectExpr("*", *_MOVED.replace("match_RA, ", "match_RA|").split("|"))


@_query("match_positions", f"WITH {_C}, m AS (SELECT *, {_MOVED} FROM cat) SELECT meta_id, round(CASE WHEN {_BOTH} THEN match_RA ELSE RA END, 6) AS RA, round(CASE WHEN {_BOTH} THEN match_DEC ELSE DEC END, 6) AS DEC FROM m")
def match_positions(s, d):
    rows = _moved(s, d)
    ra, dec = match.match_position(rows.columns, True)
    return rows.select("meta_id", F.round(ra, 6).alias("RA"), F.round(dec, 6).alias("DEC"))


@_query("match_footprint", f"WITH {_C}, {_REFS}, m AS (SELECT *, {_MOVED} FROM cat WHERE meta_id % 3 <> 0 AND meta_id % 5 <> 0), f AS (SELECT min(match_DEC) + 20 AS lo, max(match_DEC) - 20 AS hi FROM m) SELECT ref_id FROM par, f WHERE DEC BETWEEN lo AND hi")
def match_footprint(s, d):
    near = match.Survey("X", match.Radius(), prefer_match_position=True, pad=-20.0)
    return match.footprint(relation(s, d, PARTS), _moved(s, d).where("meta_id % 3 <> 0 AND meta_id % 5 <> 0"), near).select("ref_id")


_SEXA = "(k % 24 + (k % 60) / 60e0 + j * 7.25e0 / 3600e0)"


@_query("sexagesimal_positions", f"WITH {_D} SELECT det_id, round(15 * {_SEXA}, 8) AS ra, round(CASE WHEN j % 2 = 0 THEN -1 ELSE 1 END * {_SEXA}, 8) AS dec FROM det")
def sexagesimal_positions(s, d):
    part = [F.expr(x).cast("string") for x in ("k % 24", "k % 60", "j * 7.25D")]
    sign = F.when(F.col("j") % 2 == 0, "-").otherwise("+")
    return _det(s, d).select("det_id", F.round(TX.sexagesimal(*part) * 15, 8).alias("ra"), F.round(TX.sexagesimal(*part, sign), 8).alias("dec"))


@_query("position_labels", f"WITH {_C} SELECT meta_id, printf('%.6f %.6f', RA, DEC) AS label, printf('%.6f,%.6f', RA, DEC) AS key FROM cat")
def position_labels(s, d):
    return _cat(s, d).select("meta_id", S.position_label("RA", "DEC").alias("label"), S.position_key("RA", "DEC").alias("key"))


_WIDE = "w AS (SELECT f.k, f.RA AS ra1, f.DEC AS dec1, b.RA AS ra2, b.DEC AS dec2, g.RA AS ra3, g.DEC AS dec3, f.k % 2 = 1 AS crowded, f.BMAJ FROM det f LEFT JOIN det b ON b.k = f.k AND b.j = 1 LEFT JOIN det g ON g.k = f.k AND g.j = 2 WHERE f.j = 4)"


def _between(i: int, j: int, ok: str = "TRUE") -> str:
    sep = separation("p", "q").replace("p.RA", f"ra{i}").replace("p.DEC", f"dec{i}").replace("q.RA", f"ra{j}").replace("q.DEC", f"dec{j}")
    return f"CASE WHEN {ok} AND ra{i} IS NOT NULL AND ra{j} IS NOT NULL THEN {sep} END"


@_query("widest_band_offset", f"WITH {_D}, {_WIDE} SELECT k, round(greatest({_between(1, 2, 'NOT crowded')}, {_between(1, 3)}, {_between(2, 3, 'NOT crowded')}), 6) AS spread FROM w")
def widest_band_offset(s, d):
    det = _det(s, d)
    one = lambda j, b: det.where(f"j = {j}").select("k", F.col("RA").alias(f"RA_{b}"), F.col("DEC").alias(f"DEC_{b}"))
    rows = one(4, "Full").join(one(1, "Blue"), "k", "left").join(one(2, "Green"), "k", "left").withColumn("n_confused_Blue", 1 + F.col("k") % 2)
    return rows.select("k", F.round(reliability.band_spread(rows.columns), 6).alias("spread"))


# ---- texts and labels


_CODES = ("concat(' ', p_brand, ' ')", "CASE WHEN p_partkey % 3 = 0 THEN '   ' ELSE p_name END")


@_query("text_codes", f"SELECT p_partkey, nullif(trim({_CODES[0]}), '') AS brand, nullif(trim({_CODES[1]}), '') AS name, nullif(trim(p_type), '') AS kind FROM part")
def text_codes(s, d):
    rows = _part(s, d, f"{_CODES[0]} AS a", f"{_CODES[1]} AS b", "p_type")
    return rows.select("p_partkey", TX.code(F.col("a")).alias("brand"), TX.code(F.col("b")).alias("name"), TX.decoded(F.col("p_type").cast("binary")).alias("kind"))


_IDS = ("CASE p_partkey % 4 WHEN 0 THEN 'nan' WHEN 1 THEN ' ' WHEN 2 THEN NULL ELSE p_brand END", "CASE p_partkey % 3 WHEN 0 THEN '<NA>' WHEN 1 THEN 'None' ELSE p_name END")


@_query("first_ids", f"SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN p_brand WHEN p_partkey % 3 = 2 THEN p_name ELSE '' END AS id FROM part")
def first_ids(s, d):
    rows = _part(s, d, f"{_IDS[0]} AS a", f"{_IDS[1]} AS b")
    return rows.select("p_partkey", TX.first_id(F.col("a"), F.col("b")).alias("id"))


@_query("sentinel_fluxes", "SELECT p_partkey, round(CASE WHEN p_partkey % 5 <> 0 THEN p_size / 3e0 END, 6) AS flux FROM part")
def sentinel_fluxes(s, d):
    rows = _part(s, d, "CASE WHEN p_partkey % 5 = 0 THEN -9.99D ELSE p_size / 3D END AS f")
    return rows.select("p_partkey", F.round(TX.without_sentinel(F.col("f")), 6).alias("flux"))


@_query("factorized", "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS DOUBLE) AS code FROM part")
def factorized(s, d):
    return outliers.factorized(_part(s, d, "p_brand"), "p_brand", "code").select("p_partkey", "code")


_FILE = "concat('/data/', lst_hour, CASE WHEN j % 2 = 0 THEN concat('_', band) ELSE '' END, '/', CASE WHEN k % 5 = 0 THEN lower(band) ELSE band END, '_I_deep_', CAST(20240100 + k % 28 AS VARCHAR(8)), CASE WHEN k % 3 = 0 THEN concat('_LST', CAST(j * 3 AS VARCHAR(2)), 'h') ELSE '' END, '_t000', CAST(j AS VARCHAR(1)), CASE WHEN k % 11 = 0 THEN '.txt' ELSE '.fits' END)"


@_query("image_names", f"WITH {_D} SELECT det_id, lst_hour, band, CASE WHEN k % 3 = 0 THEN concat(CAST(20240100 + k % 28 AS VARCHAR), '_', lst_hour, '_t000', CAST(j AS VARCHAR)) END AS time_key FROM det WHERE k % 11 <> 0")
def image_names(s, d):
    rows = _det(s, d).selectExpr("det_id", f"{_FILE} AS path")
    return layout.parsed_names(rows).select("det_id", "lst_hour", "band", "time_key")


@_query("one_image_per_slot", f"WITH {_D} SELECT lst_hour, band, min(det_id) AS det_id FROM det GROUP BY ALL")
def one_image_per_slot(s, d):
    rows = _det(s, d).groupBy("lst_hour", "band").agg(F.min("det_id").alias("det_id"))
    return layout.one_per_slot(rows).select("lst_hour", "band", "det_id")


_MAPS = "concat('/maps/', CAST(18 + k % 9 * 5 AS VARCHAR(2)), 'MHz/map_', CASE WHEN j % 3 = 0 THEN 'deep_' ELSE '' END, CAST(k AS VARCHAR(12)), '_', CAST(j AS VARCHAR(1)), '.fits')"


@_query("prebuilt_maps", f"WITH {_D}, m AS (SELECT {_MAPS} AS path, concat(CAST(18 + k % 9 * 5 AS VARCHAR), 'MHz') AS band, CASE WHEN j % 3 = 0 THEN 0 ELSE 1 END AS rank FROM det) SELECT band, path, c > 1 AS ambiguous FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY rank, path) AS n, count(*) OVER (PARTITION BY band, rank) AS c FROM m) WHERE n = 1")
def prebuilt_maps(s, d):
    return layout.prebuilt_maps(_det(s, d).selectExpr(f"{_MAPS} AS path"), "deep")


@_query("catalog_files", f"WITH {_D} SELECT det_id, CASE j % 4 WHEN 0 THEN 'lst_merged' WHEN 1 THEN 'sources' WHEN 2 THEN 'metacatalog' ELSE 'other' END AS kind, CASE WHEN j % 4 = 1 THEN lst_hour END AS lst_hour, CASE WHEN j % 4 < 2 THEN band END AS band FROM det")
def catalog_files(s, d):
    name = "CASE j % 4 WHEN 0 THEN concat('metacatalog_lst_', band, '.parquet') WHEN 1 THEN concat('sources_', lst_hour, '_', band, '.parquet') WHEN 2 THEN 'metacatalog_spectral.parquet' ELSE concat(band, '.parquet') END"
    return layout.classified(_det(s, d).selectExpr("det_id", f"{name} AS file")).select("det_id", "kind", "lst_hour", "band")


# ---- bands


_LABEL = "CASE p_partkey % 6 WHEN 0 THEN ' full ' WHEN 1 THEN 'BLUE' WHEN 2 THEN 'green' WHEN 3 THEN concat(CAST(p_size AS VARCHAR(4)), 'mhz') WHEN 4 THEN concat('0', CAST(p_size AS VARCHAR(4)), 'MHz') ELSE p_brand END"
_KNOWN = " ".join(f"WHEN '{b}' THEN {B.FREQUENCY_HZ[b]!r}" for b in B.COLOR_BANDS)


@_query("band_labels", f"WITH l AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Full' WHEN 1 THEN 'Blue' WHEN 2 THEN 'Green' WHEN 5 THEN NULL ELSE concat(CAST(p_size AS VARCHAR), 'MHz') END AS band, p_size FROM part) SELECT p_partkey, band, round(CASE band {_KNOWN} ELSE CASE WHEN band IS NOT NULL THEN p_size * 1e6 END END, 3) AS hz FROM l")
def band_labels(s, d):
    rows = _part(s, d, f"{_LABEL} AS label").withColumn("band", B.normalize_column(F.col("label")))
    return rows.select("p_partkey", "band", F.round(B.frequency_column(F.col("band")), 3).alias("hz"))


def _shade(k: int) -> str:
    low, high = (int(B.COLORS[b][k : k + 2], 16) for b in ("Red", "Blue"))
    return f"format('{{:02x}}', CAST(round({low} + ({high} - {low}) * share) AS INTEGER))"


@_query("band_colors", f"SELECT p_partkey, concat('#', {', '.join(_shade(k) for k in (1, 3, 5))}) AS color FROM (SELECT p_partkey, greatest(0, least(1, (2 * p_size - 18) / 64e0)) AS share FROM part)")
def band_colors(s, d):
    rows = _part(s, d, "concat(2 * p_size, 'MHz') AS band")
    return rows.select("p_partkey", B.color_column(F.col("band")).alias("color"))


@_query("file_bands", f"WITH {_D} SELECT det_id, CASE WHEN k % 3 = 2 THEN NULL ELSE band END AS band FROM det")
def file_bands(s, d):
    name = F.expr("CASE k % 3 WHEN 0 THEN concat('metacatalog_lst_', band, '.parquet') WHEN 1 THEN concat(lower(band), '-sources.csv') ELSE concat('x', band, 'y.csv') END")
    return _det(s, d).select("det_id", B.band_of_catalog(name).alias("band"))


@_query("band_membership", f"WITH {_C} SELECT meta_id, list_contains(string_split(bands_present, ','), 'Red') AS red FROM cat WHERE list_contains(string_split(bands_present, ','), 'Blue')")
def band_membership(s, d):
    has = lambda b: B.has_band(F.col("bands_present"), b)
    return _cat(s, d).where(has("Blue")).select("meta_id", has("Red").alias("red"))


_IN = {b: f"list_contains(string_split(bands_present, ','), '{b}')" for b in ("Blue", "Red")}


@_query(
    "association_counts",
    f"""WITH {_C} SELECT meta_id, CAST(CASE WHEN "n_assoc_Blue" = 1 THEN 1 ELSE 0 END + CASE WHEN "n_assoc_Red" = 1 THEN 1 ELSE 0 END + 1 AS INTEGER) AS unique_bands,
({_IN["Blue"]} AND "n_confused_Blue" > 1) OR ({_IN["Red"]} AND "n_confused_Red" > 1) AS confused,
(NOT {_IN["Blue"]} OR ("n_assoc_Blue" = 1 AND "n_confused_Blue" = 1)) AND (NOT {_IN["Red"]} OR ("n_assoc_Red" = 1 AND "n_confused_Red" = 1)) AS all_unique FROM cat""",
)
def association_counts(s, d):
    rows = _cat(s, d)
    c = rows.columns
    return rows.select("meta_id", reliability.unique_bands(c).cast("int").alias("unique_bands"), reliability.confused(c).alias("confused"), reliability.all_unique(c).alias("all_unique"))


@_query("neighbouring_bands", "SELECT band, n, other FROM (VALUES ('18MHz', 1, '23MHz'), ('55MHz', 1, '50MHz'), ('55MHz', 2, '59MHz'), ('82MHz', 1, '78MHz')) t(band, n, other)")
def neighbouring_bands(s, d):
    from skyloom.operators.detection import adjacent_seeds

    rows = [(b, n, o) for b in ("18MHz", "55MHz", "82MHz") for n, o in enumerate(adjacent_seeds(B.SUBBANDS, b), 1)]
    return s.createDataFrame(rows, "band string, n int, other string")


@_query("seed_bands", "SELECT bands, seed FROM (VALUES ('18MHz,82MHz', '82MHz'), ('Full,Blue', 'Full'), ('Blue,Red', 'Blue')) t(bands, seed)")
def seed_bands(s, d):
    lists = (["82MHz", "18MHz"], ["Blue", "Full"], ["Red", "Blue"])
    rows = [(",".join(B.in_order(x)), B.seed_band(B.in_order(x))) for x in lists]
    return s.createDataFrame(rows, "bands string, seed string")


@_query("sed_band_names", "SELECT unnest(['18MHz', '41MHz', '55MHz', '73MHz', 'GLEAM76', 'GLEAM84']) AS band, unnest(range(6)) AS n")
def sed_band_names(s, d):
    rows = relation(s, d, SPECTRA)
    return s.createDataFrame([(b, n) for n, b in enumerate(spectral.sed_bands([*rows.columns, "Total_flux_GLEAM76", "Total_flux_GLEAM84"]))], "band string, n long")


# ---- fluxes


_MHZ = (18, 41, 55, 73)
_POINTS = " UNION ALL ".join(f'SELECT meta_id, ln({m}e6) AS x, ln("Total_flux_{m}MHz") AS y FROM spec WHERE "Total_flux_{m}MHz" > 0 AND "n_confused_{m}MHz" = 1' for m in _MHZ)


@_query(
    "outer_spectral_indices",
    f"""WITH spec AS ({SPECTRA}), l AS ({_POINTS}), a AS (SELECT meta_id, list(x ORDER BY x) AS x, list(y ORDER BY x) AS y, count(*) AS n FROM l GROUP BY meta_id)
SELECT meta_id, round((y[1] - y[2]) / (x[1] - x[2]), 6) AS low, round((y[n - 1] - y[n]) / (x[n - 1] - x[n]), 6) AS high FROM spec JOIN a USING (meta_id) WHERE n >= 2""",
)
def outer_spectral_indices(s, d):
    rows = relation(s, d, SPECTRA)
    low, high = X.outer_indices(spectral.gather(rows.columns, [f"{m}MHz" for m in _MHZ]))
    return rows.select("meta_id", F.round(low, 6).alias("low"), F.round(high, 6).alias("high")).where("low IS NOT NULL")


_Z = "(meta_id % 400) / 200e0"
_E = "1 / sqrt({om} * pow(1 + {z}, 3) + {orad} * pow(1 + {z}, 4) + {ol})"


def _inverse(z: str) -> str:
    return _E.format(z=f"({z})", om=X.OMEGA_M, orad=X.OMEGA_R, ol=1 - X.OMEGA_M - X.OMEGA_R)


#: Luminosity distances on a grid of 0.01 in redshift, by Simpson's rule.
_DISTANCES = f"""steps AS (SELECT CAST(range AS DOUBLE) AS k FROM range(0, 800)),
tot AS (SELECT k + 1 AS i, sum(0.01 / 6 * ({_inverse('k * 0.01')} + 4 * {_inverse('k * 0.01 + 0.005')} + {_inverse('k * 0.01 + 0.01')})) OVER (ORDER BY k) AS t FROM steps),
dist AS (SELECT 0e0 AS i, 0e0 AS dl UNION ALL SELECT i, {X.C_KM_S} / {X.H0} * t * (1 + i * 0.01) FROM tot)"""


def _luminosity(flux: str, z: str, rows: str) -> str:
    """log10 of 4 pi D_L^2 S of rows that have ``flux`` and ``z``."""
    at = f"least(floor({z} / 0.01), 799)"
    dl = f"(a.dl + (b.dl - a.dl) * ({z} / 0.01 - {at})) * 3.0856775814913673e22"
    return f"SELECT q.*, log10(4 * pi() * pow({dl}, 2) * {flux} * 1e-26) AS lum FROM {rows} q JOIN dist a ON a.i = {at} JOIN dist b ON b.i = {at} + 1 WHERE {z} > 0"


@_query("radio_luminosities", f"WITH {_C}, {_DISTANCES}, src AS (SELECT meta_id, Peak_flux, {_Z} AS z FROM cat), l AS ({_luminosity('Peak_flux', 'z', 'src')}) SELECT meta_id, round(lum, 6) AS log_w_hz, round(lum + log10(1.4e9) + 7, 6) AS log_erg_s FROM l")
def radio_luminosities(s, d):
    rows = _cat(s, d).selectExpr("meta_id", "Peak_flux", f"{_Z} AS z").where("z > 0")
    return rows.select("meta_id", F.round(F.log10(X.radio_luminosity("Peak_flux", "z")), 6).alias("log_w_hz"), F.round(F.log10(X.nu_luminosity("Peak_flux", 1.4e9, "z")), 6).alias("log_erg_s"))


_STRETCH = f"(1 + 0.03e0 * greatest(0, {S.LATITUDE} - DEC))"


@_query("scaled_beams", f"WITH {_D} SELECT det_id, round(greatest(BMAJ * 1.2 * {_STRETCH}, BMAJ * 1.5 * 1.2), 9) AS a, round(least(BMAJ * 1.2 * {_STRETCH}, BMAJ * 1.5 * 1.2), 9) AS b FROM det")
def scaled_beams(s, d):
    a, b = X.scaled_beam("BMAJ", F.col("BMAJ") * 1.5, "DEC", 1.2, 0.03)
    return _det(s, d).select("det_id", F.round(a, 9).alias("a"), F.round(b, 9).alias("b"))


@_query("diameter_floor", f"WITH {_REFS} SELECT ref_id, round(greatest(CASE WHEN ref_id % 4 = 0 THEN 0 ELSE 0.5 * \"DET_LIKE_0\" / 3600 END, 1 / 3600e0), 9) AS radius FROM par")
def diameter_floor(s, d):
    rows = relation(s, d, PARTS).withColumn("Diam", F.when(F.col("ref_id") % 4 != 0, F.col("DET_LIKE_0")))
    survey = match.SURVEYS["NEDLVS"]
    floor = survey.diameter_scale * S.positive("Diam") * match.ARCSEC
    return match.match_frame(rows, "ref_id", survey.radius, floor=floor).select(F.col("id").alias("ref_id"), F.round("BMAJ", 9).alias("radius"))


@_query("resolved_beams", f"WITH {_C} SELECT meta_id, round(CASE WHEN meta_id % 3 = 0 THEN BMAJ_match WHEN meta_id % 3 = 1 THEN 0.07 ELSE 0.09 END, 6) AS beam FROM cat")
def resolved_beams(s, d):
    rows = _cat(s, d).withColumns({"BMAJ_match": F.expr("CASE WHEN meta_id % 3 = 0 THEN BMAJ_match WHEN meta_id % 3 = 1 THEN -1D END"), "BMAJ_full": F.expr("CASE WHEN meta_id % 3 = 1 THEN 0.07D END"), "BMAJ": F.lit(0.09)})
    return rows.select("meta_id", F.round(reliability.beam(rows.columns), 6).alias("beam"))


# ---- selections


_NEAR = ("CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size / 100e0 - 0.05e0 END AS z", "p_retailprice AS DistMpc")


@_query("nearby_galaxies", f"SELECT p_partkey FROM (SELECT p_partkey, {', '.join(_NEAR)} FROM part) WHERE z BETWEEN 0 AND 0.2 AND DistMpc <= 1500")
def nearby_galaxies(s, d):
    return _part(s, d, *_NEAR).where(SEL.nearby(0.2, 1500.0)).select("p_partkey")


_STARS = ("p_size / 50e0 AS pstellar", "(p_partkey % 10) / 10e0 AS pij", "CASE p_partkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS subdwarf")


@_query("science_sample", f"SELECT p_partkey FROM (SELECT p_partkey, {', '.join(_STARS)} FROM part) WHERE pstellar > 0.51 AND pij > 0.5 AND NOT coalesce(subdwarf, FALSE)")
def science_sample(s, d):
    return _part(s, d, *_STARS).where(SEL.science_sample()).select("p_partkey")


@_query("compact_sources", f"WITH {_D} SELECT det_id, round(greatest(0, {S.LATITUDE} - DEC), 6) AS u, round(1.1 * (1 + 0.01 * greatest(0, {S.LATITUDE} - DEC)) * Peak_flux * 0.001 / 0.02, 4) AS maj_over_bmaj FROM det WHERE S_Code = 'S' AND Peak_flux >= 20")
def compact_sources(s, d):
    rows = _det(s, d).withColumns({"Maj": F.col("Peak_flux") * 0.001, "Min": F.lit(0.01), "BMAJ": F.lit(0.02), "BMIN": F.lit(0.02)})
    return beam.compact(rows, 20.0, alpha_used=1.1, kappa_used=0.01).select("det_id", _r("u"), _r("maj_over_bmaj", 4))


@_query("visible_ellipses", f"WITH {_C} SELECT meta_id FROM cat WHERE Maj >= 100 * 0.002")
def visible_ellipses(s, d):
    return _cat(s, d).where(SEL.ellipse_visible(100.0)).select("meta_id")


@_query("display_columns", f"WITH {_C} SELECT meta_id, round(DEC, 6) AS DEC, round(RA, 6) AS RA, round(BMAJ_match, 6) AS BMAJ_match, E_Peak_flux FROM cat")
def display_columns(s, d):
    rows = _cat(s, d).withColumns({c: F.round(c, 6) for c in ("RA", "DEC", "BMAJ_match")})
    return summary.ordered_columns(rows, ["meta_id", "DEC", "RA", "missing"], 5)


@_query("value_ranges", f"WITH {_C} SELECT meta_id FROM cat WHERE Peak_flux BETWEEN 5 AND 20 AND Maj <= 0.15 AND PA IS NOT NULL")
def value_ranges(s, d):
    return summary.in_range(_cat(s, d), {"Peak_flux": (5.0, 20.0), "Maj": (None, 0.15), "PA": (None, None)}).select("meta_id")
