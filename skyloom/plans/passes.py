"""Queries of whole passes: fusion, greedy picks, cross-band fills, spectral fits, pixels, photometry.

SQL has no loops over sets here, so sequential passes are written out round by round.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skyloom.functions import bands as B
from skyloom.functions import flux as X
from skyloom.functions import sphere as S
from skyloom.operators import associations as A
from skyloom.operators import detection, healpix, match, photometry, trace
from skyloom.plans.adapters import ASSOCIATIONS, CUSTOMERS, PARTS, SPECTRA, relation, separation
from skyloom.plans.base import _C, _D, _REFS, _SQL, _cat, _det, _query, _r
from skyloom.plans.catalog import _bands, _pairs_sql
from skyloom.plans.measures import _DISTANCES, _luminosity
from skyloom.plans.shared import materialize

# ---- fusion


def _fusion(seed: str, rest: list[str], of: dict[str, str]) -> str:
    """CTEs s0, s1, ...: the rows after each band. ``of`` tells the detections' band of each name."""
    names = [seed, *rest]
    block = lambda own, prefix="": ", ".join(
        f"1 AS na_{n}, 1 AS nc_{n}, {prefix}Total_flux AS t_{n}, {prefix}E_Total_flux AS e_{n}, {prefix}Peak_flux AS p_{n}" if n == own else f"NULL AS na_{n}, NULL AS nc_{n}, NULL AS t_{n}, NULL AS e_{n}, NULL AS p_{n}" for n in names
    )
    first = lambda n, k: f"SELECT {k} AS src, det_id AS id, '{n}' AS ob, RA, DEC, BMAJ AS r, Peak_flux AS pk, {block(n)} FROM det WHERE band = '{of[n]}'"
    of_band = lambda n: f"(SELECT * FROM det WHERE band = '{of[n]}')"
    out = [f"s0 AS MATERIALIZED ({first(seed, 0)})"]
    for k, n in enumerate(rest, 1):
        kept = ", ".join(f"s.na_{m}, s.nc_{m}, s.t_{m}, s.e_{m}, s.p_{m}" if m != n else f"b.na AS na_{m}, b.nc AS nc_{m}, b.t AS t_{m}, b.e AS e_{m}, b.p AS p_{m}" for m in names)
        out += [
            f"e{k} AS MATERIALIZED (SELECT a.src, a.id, b.det_id AS ref {_pairs_sql(f's{k - 1}', of_band(n), 'a.r', 'b.BMAJ', 0.03)})",
            f"h{k} AS (SELECT *, count(*) OVER (PARTITION BY src, id) AS na, count(*) OVER (PARTITION BY ref) AS nc FROM e{k})",
            f"b{k} AS MATERIALIZED (SELECT * FROM (SELECT h.*, d.Total_flux AS t, d.E_Total_flux AS e, d.Peak_flux AS p, d.BMAJ AS bb, row_number() OVER (PARTITION BY src, id ORDER BY d.Total_flux DESC, ref) AS n FROM h{k} h JOIN det d ON d.det_id = ref) WHERE n = 1)",
            f"s{k} AS MATERIALIZED (SELECT s.src, s.id, s.ob, s.RA, s.DEC, CASE WHEN b.ref IS NULL THEN s.r ELSE greatest(s.r, b.bb) END AS r, s.pk, {kept} FROM s{k - 1} s LEFT JOIN b{k} b ON b.src = s.src AND b.id = s.id UNION ALL ({first(n, k)} AND det_id NOT IN (SELECT ref FROM e{k})))",
        ]
    return ", ".join(out)


def _present(names: list[str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN na_{n} IS NOT NULL THEN '{n}' END" for n in names) + "], lambda x: x IS NOT NULL), ',')"


_NUMBER = "row_number() OVER (ORDER BY src, id) - 1 AS meta_id"


def _alpha(a: str, b: str) -> tuple[str, str]:
    log = math.log(B.FREQUENCY_HZ[a] / B.FREQUENCY_HZ[b])
    return f"round(ln(t_{a} / t_{b}) / {log!r}, 6)", f"round(sqrt(pow(e_{a} / t_{a}, 2) + pow(e_{b} / t_{b}, 2)) / {abs(log)!r}, 6)"


_SQL["fuse_global"] = f"""WITH {_D}, {_fusion("Full", ["Blue", "Green", "Red"], {b: b for b in B.COLOR_BANDS})}
SELECT {_NUMBER}, ob AS origin_band, {_present(list(B.COLOR_BANDS))} AS bands_present, round(RA, 6) AS RA, round(DEC, 6) AS DEC, round(pk, 6) AS Peak_flux, CAST(1 AS BIGINT) AS n_lst_contributions,
na_Blue AS "n_assoc_Blue", nc_Blue AS "n_confused_Blue", na_Green AS "n_assoc_Green", na_Red AS "n_assoc_Red", {_alpha("Red", "Green")[0]} AS "alpha_RG", {_alpha("Red", "Green")[1]} AS "E_alpha_RG", {_alpha("Green", "Blue")[0]} AS "alpha_GB", round(r, 6) AS "BMAJ_match" FROM s3"""

_SUB = {"73MHz": "Full", "55MHz": "Blue", "41MHz": "Green", "18MHz": "Red"}
_SQL["fuse_subbands"] = f"""WITH {_D}, {_fusion("73MHz", ["55MHz", "41MHz", "18MHz"], _SUB)}
SELECT {_NUMBER}, ob AS origin_band, ob AS astrometry_band, {_present(["18MHz", "41MHz", "55MHz", "73MHz"])} AS bands_present, round(RA, 6) AS RA, round(DEC, 6) AS DEC, {", ".join(f'round(p_{n}, 6) AS "Peak_flux_{n}"' for n in _SUB)} FROM s3"""


# ---- greedy passes


def _greedy(edges: str, rounds: int = 12) -> str:
    """CTEs d0, d1, ...: what each round drops of the links e0 (id, over) from fainter to brighter rows."""
    out = [f"g0 AS MATERIALIZED ({edges})"]
    for k in range(rounds):
        out += [
            f"d{k} AS MATERIALIZED (SELECT DISTINCT id FROM g{k} WHERE over IN (SELECT over FROM g{k} EXCEPT SELECT id FROM g{k}))",
            f"g{k + 1} AS MATERIALIZED (SELECT id, over FROM g{k} WHERE id NOT IN (SELECT id FROM d{k}) AND over NOT IN (SELECT id FROM d{k}))",
        ]
    return ", ".join([*out, "dropped AS (" + " UNION ALL ".join(f"SELECT id FROM d{k}" for k in range(rounds)) + ")"])


_OVER = "(b.f > a.f OR (b.f = a.f AND b.det_id < a.det_id))"
_SQL["greedy_dedupe"] = f"""WITH {_D}, l AS (SELECT det_id, RA, DEC, BMAJ, Peak_flux AS f FROM det), {_greedy(f"SELECT a.det_id AS id, b.det_id AS over {_pairs_sql('l', 'l', 'a.BMAJ', 'b.BMAJ', 0.03)} AND a.det_id <> b.det_id AND {_OVER}")}
SELECT det_id, round(f, 6) AS Peak_flux FROM l WHERE det_id NOT IN (SELECT id FROM dropped)"""

_HALF = separation("a", "b")
_SQL["crossband_actions"] = f"""WITH {_D}, sb AS (SELECT det_id, band, RA, DEC, BMAJ, Peak_flux AS f FROM det WHERE band IN ('Blue', 'Red')), t AS (SELECT * FROM det WHERE band = 'Green'),
x AS (SELECT a.det_id AS sid, b.det_id AS ref, {_HALF} AS sep, greatest(a.BMAJ, b.BMAJ) AS g, b.Peak_flux AS tp {_pairs_sql("sb", "t", "a.BMAJ", "b.BMAJ", 0.03)}),
fst AS (SELECT * FROM (SELECT *, sep <= 0.5 * g AS near, row_number() OVER (PARTITION BY sid ORDER BY sep <= 0.5 * g DESC, sep, tp DESC, ref) AS n FROM x) WHERE n = 1),
rw AS MATERIALIZED (SELECT sb.*, fst.ref, fst.near, fst.tp FROM sb LEFT JOIN fst ON sid = det_id),
cl AS MATERIALIZED (SELECT ref, array_to_string(list_sort(list(DISTINCT band)), ',') AS seed_band, arg_min(det_id, band || lpad(CAST(det_id AS VARCHAR), 15, '0')) AS seed_id, quantile_cont(f, 0.5) AS seed_peak, min(tp) AS tp FROM rw WHERE near GROUP BY ref),
taken AS (SELECT t.RA, t.DEC, t.BMAJ FROM t JOIN cl ON cl.ref = t.det_id),
lone AS MATERIALIZED (SELECT * FROM rw a WHERE NOT coalesce(near, FALSE) AND NOT EXISTS (SELECT 1 FROM taken b WHERE b.DEC BETWEEN a.DEC - 0.03 AND a.DEC + 0.03 AND {_HALF} <= 0.5 * greatest(a.BMAJ, b.BMAJ))),
{_greedy(f"SELECT a.det_id AS id, b.det_id AS over FROM lone a JOIN lone b ON b.DEC BETWEEN a.DEC - 0.03 AND a.DEC + 0.03 WHERE {_HALF} <= 0.5 * greatest(a.BMAJ, b.BMAJ) AND a.det_id <> b.det_id AND {_OVER}")}
SELECT CASE WHEN tp / seed_peak < 0.5 THEN 'replace' ELSE 'skip' END AS action, seed_band, seed_id, ref AS target_id, round(seed_peak, 6) AS seed_peak, round(tp, 6) AS target_peak, CASE WHEN tp / seed_peak < 0.5 THEN 'phot_dip' ELSE 'peak_ok' END AS reason FROM cl
UNION ALL SELECT 'insert', band, det_id, NULL, round(f, 6), round(tp, 6), CASE WHEN near IS NULL THEN 'no_beam_hit' ELSE 'offset_only' END FROM lone WHERE det_id NOT IN (SELECT id FROM dropped)"""


_FORCED = "abs(RA - 180) / 2 AS rms, Peak_flux * 1.5 AS p"


@_query(
    "crossband_applied",
    f"""WITH {_D}, t AS (SELECT * FROM det WHERE band = 'Green'), a AS (SELECT 'replace' AS action, det_id, k, Peak_flux, 'Blue' AS src, abs(RA - 180) / 2 AS rms FROM t WHERE k % 3 = 0 UNION ALL SELECT 'insert', det_id, k, Peak_flux, 'Red', abs(RA - 180) / 2 FROM det WHERE band = 'Red'),
ok AS (SELECT * FROM a WHERE rms <= greatest(1, 0.5 * abs(Peak_flux * 1.5)))
SELECT t.det_id, round(CASE WHEN ok.det_id IS NULL THEN t.Peak_flux ELSE t.Peak_flux * 1.5 END, 6) AS Peak_flux, ok.det_id IS NOT NULL AS forced, CASE WHEN ok.det_id IS NOT NULL THEN 'replace' END AS forced_mode, ok.src AS forced_from_band FROM t LEFT JOIN ok ON ok.action = 'replace' AND ok.det_id = t.det_id
UNION ALL SELECT -1 - row_number() OVER (ORDER BY Peak_flux DESC, src, det_id), round(Peak_flux * 1.5, 6), TRUE, 'insert', src FROM ok WHERE action = 'insert'""",
)
def crossband_applied(s, d):
    c = _bands(s, d)
    act = lambda rows, action, band, target: rows.select(F.lit(action).alias("action"), target.alias("target_id"), F.lit(band).alias("seed_band"), F.col("det_id").alias("seed_id"), F.col("Peak_flux").alias("seed_peak"), "RA", "DEC")
    actions = act(c["Green"].where("k % 3 = 0"), "replace", "Blue", F.col("det_id")).unionByName(act(c["Red"], "insert", "Red", F.lit(None).cast("long")))
    fit = lambda a: a.withColumns({"ok": F.lit(True), "forced_Peak": F.col("seed_peak") * 1.5, "forced_Total": F.col("seed_peak") * 2, "forced_RA": F.col("RA"), "forced_DEC": F.col("DEC"), "forced_resid_rms": F.abs(F.col("RA") - 180) / 2})
    return detection.apply_crossband(c["Green"], actions, "det_id", fit).select("det_id", _r("Peak_flux"), "forced", "forced_mode", "forced_from_band")


@_query("leftovers_marked", f"WITH {_C}, {_REFS}, hit AS (SELECT DISTINCT a.meta_id {_pairs_sql('cat', 'cust', 'a.BMAJ_match', 'b.BMAJ', 0.09)}) SELECT meta_id, meta_id IN (SELECT meta_id FROM hit) AS resid_leftover FROM cat")
def leftovers_marked(s, d):
    matched = relation(s, d, CUSTOMERS).select(F.col("RA").alias("RA_stage2"), F.col("DEC").alias("DEC_stage2"), F.col("BMAJ").alias("BMAJ_stage2"))
    return detection.mark_leftovers(_cat(s, d), matched).select("meta_id", "resid_leftover")


@_query("detection_offsets", f"WITH {_D}, o AS (SELECT det_id, RA + 0.01 * (k % 3) AS RA, DEC - 0.02 AS DEC FROM det) SELECT det_id, round({separation('det', 'o')}, 6) AS sep_deg FROM det JOIN o USING (det_id)")
def detection_offsets(s, d):
    other = _det(s, d).withColumns({"RA": F.expr("RA + 0.01D * (k % 3)"), "DEC": F.col("DEC") - 0.02})
    return detection.detection_distance(_det(s, d), other, "det_id").select("det_id", _r("sep_deg"))


# ---- following sources


_RE = f"""fu AS (SELECT * FROM det WHERE band = 'Full'), bl AS (SELECT *, lst_hour || ',03h, 15h' AS lst_hours FROM det WHERE band = 'Blue'),
e AS (SELECT a.det_id AS i, b.det_id AS j, abs(b.Peak_flux - a.Peak_flux) AS dp, {separation("a", "b")} AS sep {_pairs_sql("fu", "bl", "a.BMAJ", "b.BMAJ", 0.03)}),
rm AS (SELECT i, j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dp, sep, j) AS n FROM e) WHERE n = 1)"""


def _followed(s, d):
    c = _bands(s, d)
    blue = _det(s, d).where("band = 'Blue'").withColumns({"lst_id": F.col("det_id"), "lst_hours": F.concat("lst_hour", F.lit(",03h, 15h"))})
    return c["Full"].withColumns({"meta_id": F.col("det_id"), "band": F.lit("Blue")}), blue


@_query("rematch_hours", f"WITH {_D}, {_RE}, h AS (SELECT rm.i, bl.*, trim(unnest(string_split(lst_hours, ','))) AS hour FROM rm JOIN bl ON bl.det_id = rm.j) SELECT DISTINCT a.i AS meta_id, a.det_id AS lst_id, b.lst_hour, b.det_id AS source_id FROM h a JOIN det b ON b.band = 'Blue' AND b.lst_hour = a.hour AND b.DEC BETWEEN a.DEC - 0.03 AND a.DEC + 0.03 WHERE {separation('a', 'b')} <= greatest(a.BMAJ, b.BMAJ)")
def rematch_hours(s, d):
    rows, blue = _followed(s, d)
    sources = _det(s, d).withColumn("source_id", F.col("det_id"))
    return trace.rematch_hours(rows, blue, sources).select("meta_id", "lst_id", "lst_hour", "source_id").distinct()


@_query("positions_filled_in", f"WITH {_D}, {_RE} SELECT fu.det_id AS meta_id, round(CASE WHEN fu.k % 2 = 0 THEN fu.RA ELSE bl.RA END, 6) AS \"RA_Blue\", round(CASE WHEN fu.k % 2 = 0 THEN fu.DEC ELSE bl.DEC END, 6) AS \"DEC_Blue\" FROM fu LEFT JOIN rm ON rm.i = fu.det_id LEFT JOIN bl ON bl.det_id = rm.j")
def positions_filled_in(s, d):
    rows, blue = _followed(s, d)
    have = lambda c: F.when(F.col("k") % 2 == 0, F.col(c))
    meta = rows.drop("band").withColumns({"bands_present": F.lit("Full,Blue"), "RA_Blue": have("RA"), "DEC_Blue": have("DEC"), "Peak_flux_Blue": F.col("Peak_flux")})
    return trace.fill_positions(meta, blue, ["Blue"]).select("meta_id", _r("RA_Blue"), _r("DEC_Blue"))


# ---- surveys attached


_GLEAM = ("GLEAM76", "GLEAM151")


@_query(
    "narrow_bands_attached",
    f"""WITH {_C}, {_REFS}, e AS (SELECT a.meta_id AS base_id, b.ref_id, b.Total_flux {_pairs_sql("cat", "par", "a.BMAJ_match", "sqrt(b.E_RA * b.E_RA + b.E_DEC * b.E_DEC)", 0.09)} AND b.DEC <= 30 AND b.DEC >= (SELECT min(DEC) FROM cat)),
h AS (SELECT *, count(*) OVER (PARTITION BY base_id) AS n_assoc FROM e), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY Total_flux DESC, ref_id) AS n FROM h) WHERE n = 1)
SELECT meta_id, n_assoc AS "n_assoc_GLEAM", round(CASE WHEN ref_id % 4 <> 0 THEN b.Total_flux * 2 END, 6) AS "Total_flux_GLEAM76", round(b.Total_flux * 3, 6) AS "Total_flux_GLEAM151",
CASE WHEN base_id IS NULL THEN bands_present ELSE bands_present || ',GLEAM' || CASE WHEN ref_id % 4 <> 0 THEN ',GLEAM76' ELSE '' END || ',GLEAM151' END AS bands_present FROM cat LEFT JOIN b ON base_id = meta_id""",
)
def narrow_bands_attached(s, d):
    ref = relation(s, d, PARTS).withColumns({"Total_flux_GLEAM76": F.when(F.col("ref_id") % 4 != 0, F.col("Total_flux") * 2), "Total_flux_GLEAM151": F.col("Total_flux") * 3})
    out = match.attach_narrow(_cat(s, d), ref, match.SURVEYS["GLEAM"], _GLEAM)
    return out.select("meta_id", "n_assoc_GLEAM", _r("Total_flux_GLEAM76"), _r("Total_flux_GLEAM151"), "bands_present")


_ONE = f"""e AS (SELECT a.meta_id AS base_id, b.ref_id, b.RA, b.DEC, {separation("a", "b")} AS sep {_pairs_sql("cat", "par", "a.BMAJ_match", "sqrt(b.E_RA * b.E_RA + b.E_DEC * b.E_DEC)", 0.09)} AND b.DEC >= -40 AND b.DEC BETWEEN (SELECT min(DEC) FROM cat) AND (SELECT max(DEC) FROM cat)),
u AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY base_id) AS n FROM e) WHERE n = 1)"""


@_query("attached_associations", f"WITH {_C}, {_REFS}, {_ONE} SELECT base_id AS meta_id, 'NVSS' AS catalog, round(RA, 6) AS ref_ra, round(sep * 3600, 3) AS sep_arcsec FROM u")
def attached_associations(s, d):
    out = match.attach(_cat(s, d), relation(s, d, PARTS), match.SURVEYS["NVSS"], fields=("RA", "DEC", "Total_flux"))
    return A.from_attach(out, "NVSS").select("meta_id", "catalog", _r("ref_ra"), _r("sep_arcsec", 3))


@_query("unique_xray_joined", f"WITH {_C}, asc0 AS ({ASSOCIATIONS}), f AS (SELECT meta_id, min(ref_id) AS ref_id, arg_min(sep_arcsec, ref_id) AS sep FROM asc0 WHERE catalog = 'eRASS3' GROUP BY 1) SELECT meta_id, f.sep AS sep_arcsec, f.ref_id FROM cat LEFT JOIN f USING (meta_id)")
def unique_xray_joined(s, d):
    # Of an id given twice the SQL takes the row that stands first.
    return A.join_unique(_cat(s, d), relation(s, d, ASSOCIATIONS, place=True), "eRASS3", ["sep_arcsec", "ref_id"], ["__place"]).select("meta_id", "sep_arcsec", "ref_id")


@_query("luminosity_pairs", f"WITH {_C}, asc0 AS ({ASSOCIATIONS}), {_DISTANCES}, f AS (SELECT meta_id, arg_min(sep_arcsec, ref_id) / 100.0 AS z, min(ref_id) AS ref_id FROM asc0 WHERE catalog = 'MilliQuas' GROUP BY 1), src AS (SELECT meta_id, Total_flux, z, ref_id FROM cat JOIN f USING (meta_id)), l AS ({_luminosity('Total_flux', 'z', 'src')}) SELECT meta_id, ref_id, round(lum, 6) AS log_w_hz FROM l")
def luminosity_pairs(s, d):
    out = A.join_unique(_cat(s, d), relation(s, d, ASSOCIATIONS, place=True), "MilliQuas", ["sep_arcsec", "ref_id"], ["__place"]).where("ref_id IS NOT NULL")
    return out.select("meta_id", "ref_id", F.round(F.log10(X.radio_luminosity("Total_flux", F.col("sep_arcsec") / 100)), 6).alias("log_w_hz"))


# ---- spectral fits


_W = "CASE WHEN every THEN pow(s / err, 2) ELSE 1 END"
_FIT = " UNION ALL ".join(f'SELECT meta_id, ln({m}e6 / 55e6) AS x, "Total_flux_{m}MHz" AS s, "E_Total_flux_{m}MHz" AS err FROM spec WHERE "Total_flux_{m}MHz" > 0 AND "n_confused_{m}MHz" = 1' for m in (18, 41, 55, 73))
_SUMS = ", ".join(f"sum(w * pow(x, {k})) AS m{k}" for k in range(5)) + ", " + ", ".join(f"sum(w * y * pow(x, {k})) AS v{k}" for k in range(3))
_DET = "(m0 * (m2 * m4 - m3 * m3) - m1 * (m1 * m4 - m2 * m3) + m2 * (m1 * m3 - m2 * m2))"
_SQL["taylor_fit"] = f"""WITH spec AS ({SPECTRA}), l AS ({_FIT}), q AS (SELECT *, ln(s) AS y, bool_and(err > 0) OVER (PARTITION BY meta_id) AS every FROM l), p AS (SELECT *, {_W} AS w FROM q),
u AS (SELECT meta_id, count(*) AS n, {_SUMS} FROM p GROUP BY meta_id HAVING count(*) >= 2),
c AS (SELECT *, (m2 * v0 - m1 * v1) / (m0 * m2 - m1 * m1) AS a0, (m0 * v1 - m1 * v0) / (m0 * m2 - m1 * m1) AS a1,
 CASE WHEN n > 3 THEN (v0 * (m2 * m4 - m3 * m3) - m1 * (v1 * m4 - m3 * v2) + m2 * (v1 * m3 - m2 * v2)) / {_DET} END AS b0,
 CASE WHEN n > 3 THEN (m0 * (v1 * m4 - m3 * v2) - v0 * (m1 * m4 - m3 * m2) + m2 * (m1 * v2 - v1 * m2)) / {_DET} END AS b1,
 CASE WHEN n > 3 THEN (m0 * (m2 * v2 - v1 * m3) - m1 * (m1 * v2 - v1 * m2) + v0 * (m1 * m3 - m2 * m2)) / {_DET} END AS b2 FROM u),
r AS (SELECT meta_id, any_value(n) AS n, sum(w * pow(y - a0 - a1 * x, 2)) / nullif(any_value(n) - 2, 0) AS r2, sum(w * pow(y - b0 - b1 * x - b2 * x * x, 2)) / nullif(any_value(n) - 3, 0) AS r3 FROM p JOIN c USING (meta_id) GROUP BY meta_id),
k AS (SELECT *, least(r2, r3) AS best FROM r), f AS (SELECT *, CASE WHEN n < 4 OR r2 <= CASE WHEN best <= 1e-8 THEN greatest(1e-6, best + 1e-8) ELSE best + greatest(0.05, 0.1 * best) END THEN 2 ELSE 3 END AS t FROM k)
SELECT spec.meta_id, CAST(coalesce(t, 0) AS BIGINT) AS spec_model_n_terms, (SELECT count(*) FROM l WHERE l.meta_id = spec.meta_id) AS spec_model_n_flux, round(CASE WHEN t = 2 THEN r2 ELSE r3 END, 6) AS spec_model_chi2_red,
round(CASE WHEN t = 2 THEN a0 ELSE b0 END, 6) AS spec_model_a0, round(CASE WHEN t = 2 THEN a1 ELSE b1 END, 6) AS spec_model_a1, round(CASE WHEN t = 3 THEN b2 END, 6) AS spec_model_a2, CAST(NULL AS DOUBLE) AS spec_model_a3 FROM spec LEFT JOIN f USING (meta_id) LEFT JOIN c USING (meta_id)"""


@_query("fit_summary", f"WITH {_SQL['taylor_fit'][5:].rpartition('SELECT spec.meta_id')[0]} SELECT CAST(coalesce(t, 0) AS BIGINT) AS n_terms, count(*) AS n FROM spec LEFT JOIN f USING (meta_id) GROUP BY 1")
def fit_summary(s, d):
    from skyloom.operators import spectral

    return spectral.fit_summary(spectral.fit(relation(s, d, SPECTRA), [f"{m}MHz" for m in (18, 41, 55, 73)])).select("n_terms", "n")


# ---- pixels


def _spread_sql(v: str, bits: int) -> str:
    return "(" + " + ".join(f"(({v} >> {b}) & 1) * {4**b}" for b in range(bits)) + ")"


def _pixel_sql(nside: int, rows: str, keep: str) -> str:
    """Nested pixel numbers of positions: diagonals of the equatorial belt, triangles of the caps."""
    bits = nside.bit_length() - 1
    return f"""SELECT {keep}, face * {nside * nside} + {_spread_sql("ix", bits)} + 2 * {_spread_sql("iy", bits)} AS ipix FROM (
SELECT *, CAST(CASE WHEN za <= 2 / 3e0 THEN CASE WHEN fp = fm THEN (fp & 3) + 4 WHEN fp < fm THEN fp & 3 ELSE (fm & 3) + 8 END ELSE CASE WHEN z >= 0 THEN nt ELSE nt + 8 END END AS BIGINT) AS face,
 CAST(CASE WHEN za <= 2 / 3e0 THEN jm & {nside - 1} WHEN z >= 0 THEN {nside - 1} - dn ELSE up END AS BIGINT) AS ix, CAST(CASE WHEN za <= 2 / 3e0 THEN {nside - 1} - (jp & {nside - 1}) WHEN z >= 0 THEN {nside - 1} - up ELSE dn END AS BIGINT) AS iy FROM (
SELECT *, jp // {nside} AS fp, jm // {nside} AS fm, least({nside - 1}, CAST(floor((tt - nt) * {nside} * sqrt(3 * (1 - za))) AS BIGINT)) AS up, least({nside - 1}, CAST(floor((1 - tt + nt) * {nside} * sqrt(3 * (1 - za))) AS BIGINT)) AS dn FROM (
SELECT *, CAST(floor({nside} * (0.5 + tt - z * 0.75)) AS BIGINT) AS jp, CAST(floor({nside} * (0.5 + tt + z * 0.75)) AS BIGINT) AS jm, least(3, CAST(floor(tt) AS BIGINT)) AS nt FROM (
SELECT *, sin(radians(DEC)) AS z, abs(sin(radians(DEC))) AS za, RA / 90 AS tt FROM {rows}))))"""


@_query("healpix_point_paint", f"WITH {_C}, x AS ({_pixel_sql(64, 'cat', 'Peak_flux')}) SELECT ipix, round(sum(Peak_flux), 6) AS value FROM x GROUP BY ipix")
def healpix_point_paint(s, d):
    return healpix.paint_points(_cat(s, d), 64, "Peak_flux").select("ipix", _r("value"))


@_query("healpix_tiles", f"WITH {_C}, x AS ({_pixel_sql(4, 'cat', 'Peak_flux')}) SELECT ipix AS tile, count(*) AS n, round(sum(Peak_flux), 4) AS total FROM x GROUP BY ipix")
def healpix_tiles(s, d):
    """Sums over the fine pixels inside each coarse one, and counts of its own."""
    fine = healpix.paint_points(_cat(s, d), 256, "Peak_flux")
    inside = s.range(192).select(F.col("id").alias("tile"), F.explode(healpix.children(F.col("id"), 4, 256)).alias("ipix"))
    tiles = fine.join(inside, "ipix").groupBy("tile").agg(F.sum("value").alias("v"))
    counted = _cat(s, d).select(healpix.pixel("RA", "DEC", 4).alias("tile")).groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(tiles, "tile").select("tile", "n", F.round("v", 4).alias("total"))


@_query("map_residual", f"WITH {_C}, {_REFS}, o AS (SELECT ipix, sum(Peak_flux) AS v FROM ({_pixel_sql(16, 'cat', 'Peak_flux')}) GROUP BY 1), m AS (SELECT ipix, sum(Total_flux) AS v FROM ({_pixel_sql(16, 'par', 'Total_flux')}) GROUP BY 1) SELECT ipix, round(greatest(0, o.v - 5 - coalesce(m.v, 0)), 6) AS value FROM o LEFT JOIN m USING (ipix)")
def map_residual(s, d):
    observed, model = healpix.paint_points(_cat(s, d), 16, "Peak_flux"), healpix.paint_points(relation(s, d, PARTS), 16, "Total_flux")
    return healpix.residual_map(observed, model, 5.0).select("ipix", _r("value"))


_SIDE = math.degrees(math.sqrt(4 * math.pi / (12 * 16 * 16)))
_SIGMA = 1 / (2 * math.sqrt(2 * math.log(2)))
#: Pixel centres at nside 16 from their places on a face.
_CENTRES = """cen AS (SELECT ipix, degrees(asin(z)) AS DEC, degrees((floor(CASE WHEN j > 4 * nr THEN j - 4 * nr WHEN j < 1 THEN j + 4 * nr ELSE j END) - (sh + 1) * 0.5) * (pi() / 2 / nr)) AS RA FROM (
SELECT *, (jpl * nr + ix - iy + 1 + sh) / 2 AS j FROM (SELECT *, CASE WHEN jr < 16 THEN 1 - nr * nr / 768e0 WHEN jr > 48 THEN nr * nr / 768e0 - 1 ELSE (32 - jr) / 24e0 END AS z, CASE WHEN jr < 16 OR jr > 48 THEN 0 ELSE (jr - 16) % 2 END AS sh FROM (
SELECT *, CASE WHEN jr < 16 THEN jr WHEN jr > 48 THEN 64 - jr ELSE 16 END AS nr FROM (SELECT ipix, ix, iy, (ipix // 256 // 4 + 2) * 16 - ix - iy - 1 AS jr, [1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7][ipix // 256 + 1] AS jpl FROM (
SELECT range AS ipix, (range & 1) + ((range >> 2) & 1) * 2 + ((range >> 4) & 1) * 4 + ((range >> 6) & 1) * 8 AS ix, ((range >> 1) & 1) + ((range >> 3) & 1) * 2 + ((range >> 5) & 1) * 4 + ((range >> 7) & 1) * 8 AS iy FROM range(3072)))))))"""


@_query(
    "healpix_gaussian_paint",
    f"""WITH {_C}, {_CENTRES}, src AS (SELECT RA, DEC, Peak_flux AS p, greatest(Maj * 10, Min * 10, {_SIDE!r}) AS a, greatest(least(Maj * 10, Min * 10), {_SIDE!r}) AS b, radians(coalesce(PA, 0)) AS t FROM cat),
x AS (SELECT cen.ipix, s.p, s.a, s.b, s.t, (((cen.RA - s.RA + 180) % 360) + 360) % 360 - 180 AS dra, cos(radians(s.DEC)) AS c, cen.DEC - s.DEC AS north FROM src s JOIN cen ON cen.DEC BETWEEN s.DEC - 30 AND s.DEC + 30 WHERE {separation("s", "cen")} <= greatest(s.a * {_SIGMA!r} * 5, {2 * _SIDE!r}))
SELECT ipix, round(sum(p * exp(-0.5 * (pow((north * cos(t) + dra * c * sin(t)) / (a * {_SIGMA!r}), 2) + pow((dra * c * cos(t) - north * sin(t)) / (b * {_SIGMA!r}), 2)))), 4) AS value FROM x GROUP BY ipix""",
)
def healpix_gaussian_paint(s, d):
    rows = _cat(s, d).withColumns({"Maj": F.col("Maj") * 10, "Min": F.col("Min") * 10})
    return healpix.paint_gaussians(rows, 16).select("ipix", _r("value", 4))


# ---- images


_TRUE = "1e0 + s_suppkey % 7 AS peak, 14.6 + 0.1 * (s_suppkey % 5) AS x, 15.3 - 0.1 * (s_suppkey % 4) AS y, 2.2 + 0.05 * (s_suppkey % 6) AS sx, 1.6 AS sy, 0.25 AS background"


def _cutouts(s, d):
    """Cutouts of 31 by 31 pixels with one Gaussian each, whose parameters are known."""
    rows = s.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey", *(x.strip() for x in _TRUE.replace("0.1 *", "0.1D *").replace("0.05 *", "0.05D *").split(", ")))
    one = F.struct(F.col("peak").cast("double").alias("peak"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "sx", "sy")], F.lit(0.4).alias("theta"))
    return rows.withColumn("image", F.transform(photometry.painted(31, 31, F.array(one)), lambda v: v + F.col("background").cast("double")))


@_query("forced_photometry", f"SELECT s_suppkey, TRUE AS ok, round(peak, 3) AS peak, round(x, 3) AS x, round(y, 3) AS y, round(sx * sy, 3) AS area, round(background, 3) AS background, 0.0 AS rms FROM (SELECT s_suppkey, {_TRUE} FROM supplier)")
def forced_photometry(s, d):
    start = F.struct(F.lit(3.0).alias("peak"), F.lit(15.0).alias("x"), F.lit(15.0).alias("y"), F.lit(2.0).alias("sx"), F.lit(1.8).alias("sy"), F.lit(0.3).alias("theta"))
    rows = materialize(_cutouts(s, d), "cutouts").select("s_suppkey", photometry.fit_cutouts(F.col("image"), F.lit(31), start).alias("f"))
    size = F.round(F.col("f.sx") * F.col("f.sy"), 3).alias("area")
    return rows.select("s_suppkey", "f.ok", *[F.round(f"f.{c}", 3).alias(c) for c in ("peak", "x", "y")], size, F.round("f.background", 3).alias("background"), F.round(F.abs("f.resid_rms"), 3).alias("rms"))


def _gauss_sql(peak: str, x: str, y: str, sx: str, sy: str) -> str:
    u, v = f"((k % 31 - {x}) * cos(0.4) + (k // 31 - {y}) * sin(0.4))", f"((k // 31 - {y}) * cos(0.4) - (k % 31 - {x}) * sin(0.4))"
    return f"{peak} * exp(-0.5 * (pow({u} / {sx}, 2) + pow({v} / {sy}, 2)))"


@_query(
    "tile_residuals",
    f"""WITH c AS (SELECT s_suppkey, {_TRUE} FROM supplier), p AS (SELECT s_suppkey, k, {_gauss_sql("peak", "x", "y", "sx", "sy")} + background AS o, {_gauss_sql("peak / 2.0", "x", "y", "2.0", "1.5")} + {_gauss_sql("0.5", "5.0", "25.0", "1.5", "1.5")} AS m FROM c, (SELECT range AS k FROM range(961)))
SELECT s_suppkey, count(*) AS n, round(sum(greatest(0, o - m)), 4) AS total, round(max(greatest(0, o - m)), 6) AS peak FROM p GROUP BY s_suppkey""",
)
def tile_residuals(s, d):
    src = lambda peak, x, y, sx, sy: F.struct(peak.cast("double").alias("peak"), x.cast("double").alias("x"), y.cast("double").alias("y"), sx.alias("sx"), sy.alias("sy"), F.lit(0.4).alias("theta"))
    model = photometry.painted(31, 31, F.array(src(F.col("peak") / 2, F.col("x"), F.col("y"), F.lit(2.0), F.lit(1.5)), src(F.lit(0.5), F.lit(5.0), F.lit(25.0), F.lit(1.5), F.lit(1.5))))
    left = _cutouts(s, d).select("s_suppkey", F.explode(photometry.tile_residual(F.col("image"), model)).alias("v"))
    return left.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"), F.round(F.max("v"), 6).alias("peak"))


@_query("totals_from_fits", f"SELECT s_suppkey, round(peak * sx * sy / (0.05 * 0.04 * {_SIGMA**2!r} / (0.01 * 0.01)), 6) AS total FROM (SELECT s_suppkey, {_TRUE} FROM supplier)")
def totals_from_fits(s, d):
    fit = F.struct(F.col("peak").cast("double").alias("peak"), F.col("sx").cast("double").alias("sx"), F.col("sy").cast("double").alias("sy"))
    return _cutouts(s, d).select("s_suppkey", F.round(photometry.total_from_fit(fit, F.lit(0.05), F.lit(0.04), F.lit(0.01)), 6).alias("total"))


@_query("galactic_names", "SELECT CAST(l AS BIGINT) AS l, CAST(b AS BIGINT) AS b, TRUE AS back FROM (SELECT unnest(range(0, 360, 30)) AS l) , (SELECT unnest([-60, 0, 45]) AS b)")
def galactic_names(s, d):
    """Galactic positions to equatorial ones and back."""
    rows = s.range(0, 360, 30).withColumnRenamed("id", "l").crossJoin(s.createDataFrame([(-60,), (0,), (45,)], "b long"))  # a few rows each
    ra, dec = S.equatorial(F.col("l").cast("double"), F.col("b").cast("double"))
    rows = rows.select("l", "b", ra.alias("ra"), dec.alias("dec"))
    lon, lat = S.galactic("ra", "dec")
    off = S.separation(lon, lat, F.col("l").cast("double"), F.col("b").cast("double"))
    return rows.select("l", "b", (off < 1e-6).alias("back"))
