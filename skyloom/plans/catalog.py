"""Catalogue queries over the driver's tables, with their oracle SQL.

Floating-point results are rounded to six places, since sines differ in the last bit
between engines.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import bands as B
from skyloom.functions import flux as X
from skyloom.functions import quality as Q
from skyloom.functions import selection as SEL
from skyloom.functions import sphere as S
from skyloom.functions import text as TX
from skyloom.functions.register import register
from skyloom.operators import associations as A
from skyloom.operators import beam, detection, match, merge, outliers, reliability, spectral, summary, trace
from skyloom.operators.skyjoin import nearest, sky_neighbours, sky_pairs, within_field
from skyloom.plans.adapters import ASSOCIATIONS, CATALOG, CUSTOMERS, PARTS, SPECTRA, SUPPLIERS, relation, separation
from skyloom.plans.base import _C, _D, _QUERIES, _REFS, _SQL, _cat, _det, _query, _r

def _pairs_sql(a: str, b: str, ra: str, rb: str, reach: float) -> str:
    return f"FROM {a} a JOIN {b} b ON b.DEC BETWEEN a.DEC - {reach} AND a.DEC + {reach} WHERE {separation('a', 'b')} <= greatest({ra}, {rb})"


def _closure(extra: str = "", rows: str = "det") -> str:
    """edges, components and clusters of detections, as recursive SQL."""
    return f"""
e AS (SELECT a.det_id AS i, b.det_id AS j FROM {rows} a JOIN {rows} b ON b.DEC BETWEEN a.DEC - 0.03 AND a.DEC + 0.03 AND a.det_id <> b.det_id {extra} WHERE {separation("a", "b")} <= greatest(a.BMAJ, b.BMAJ)),
reach AS (SELECT det_id AS i, det_id AS j FROM {rows} UNION SELECT reach.i, e.j FROM reach JOIN e ON reach.j = e.i),
root AS (SELECT i AS det_id, min(j) AS root FROM reach GROUP BY i),
m AS (SELECT {rows}.*, root.root FROM {rows} JOIN root USING (det_id))"""


_JITTER = """
mean AS (SELECT root, avg(cos(radians(DEC)) * cos(radians(RA))) AS x, avg(cos(radians(DEC)) * sin(radians(RA))) AS y, avg(sin(radians(DEC))) AS z FROM m GROUP BY root),
cen AS (SELECT root, degrees(atan2(y, x)) AS RA, degrees(asin(z / sqrt(x * x + y * y + z * z))) AS DEC FROM mean)"""
_OFF = f"CASE WHEN count(*) = 1 THEN 0 ELSE sqrt(avg(pow({separation('m', 'cen')}, 2))) END"


@_query(
    "lst_merge",
    f"""WITH RECURSIVE {_D}, {_closure()}, {_JITTER},
stat AS (SELECT m.root, quantile_cont(m.RA, 0.5) AS RA, quantile_cont(m.DEC, 0.5) AS DEC, count(DISTINCT lst_hour) AS n_lst_contributions, array_to_string(list_sort(list(DISTINCT lst_hour)), ',') AS lst_hours, stddev_samp(Peak_flux) AS sd, {_OFF} AS jit FROM m JOIN cen USING (root) GROUP BY m.root),
ranked AS (SELECT m.*, row_number() OVER (PARTITION BY m.root ORDER BY round(90 - {separation("stat", "z")}, 9) DESC, m.det_id) AS n FROM m JOIN stat USING (root), LATERAL (SELECT CAST(left(m.lst_hour, 2) AS DOUBLE) * 15 AS RA, {S.LATITUDE} AS DEC) z)
SELECT r.det_id, r.root, round(r.RA, 6) AS RA, round(r.DEC, 6) AS DEC, round(r.Peak_flux, 6) AS Peak_flux, n_lst_contributions, lst_hours, r.lst_hour AS representative_lst, round(sd, 6) AS Peak_flux_std, round(jit, 6) AS cluster_jitter_rms_deg, 'Full' AS band
FROM ranked r JOIN stat USING (root) WHERE n = 1""",
)
def lst_merge(s, d):
    out = merge.lst_merge(_det(s, d), "det_id", "Full")
    return out.select("det_id", "root", _r("RA"), _r("DEC"), _r("Peak_flux"), "n_lst_contributions", "lst_hours", "representative_lst", _r("Peak_flux_std"), _r("cluster_jitter_rms_deg"), "band")


@_query(
    "tile_merge",
    f"""WITH RECURSIVE {_D}, {_closure("AND a.tile_ipix <> b.tile_ipix")}, {_JITTER}, jit AS (SELECT m.root, {_OFF} AS scatter, count(*) AS n_members FROM m JOIN cen USING (root) GROUP BY m.root),
ranked AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY Total_flux DESC, det_id) AS n FROM m)
SELECT det_id, root, round(Total_flux, 8) AS Total_flux, CAST(1 AS BIGINT) AS n_lst_contributions, '' AS lst_hours, 'healpix' AS representative_lst, n_members, round(scatter, 6) AS cluster_jitter_rms_deg FROM ranked JOIN jit USING (root) WHERE n = 1""",
)
def tile_merge(s, d):
    return merge.tile_merge(_det(s, d), "det_id", "Full").select("det_id", "root", _r("Total_flux", 8), "n_lst_contributions", "lst_hours", "representative_lst", "n_members", _r("cluster_jitter_rms_deg"))


@_query("cluster_jitter", f"WITH RECURSIVE {_D}, {_closure()}, {_JITTER} SELECT m.root, count(*) AS n, round({_OFF}, 6) AS jitter_rms_deg FROM m JOIN cen USING (root) GROUP BY m.root")
def cluster_jitter(s, d):
    return reliability.jitter(merge.cluster(_det(s, d), "det_id"), "root").select("root", "n", _r("jitter_rms_deg"))


@_query("transit_window", f"WITH {_D} SELECT det_id FROM det WHERE abs((((CAST(left(lst_hour, 2) AS DOUBLE) - RA / 15 + 12) % 24) + 24) % 24 - 12) <= 2")
def transit_window(s, d):
    return _det(s, d).where(S.near_transit("RA", "lst_hour", 2.0)).select("det_id")


@_query("elevation_rank", f"WITH {_D}, e AS (SELECT det.*, 90 - {separation('z', 'det')} AS elevation FROM det, LATERAL (SELECT CAST(left(lst_hour, 2) AS DOUBLE) * 15 AS RA, {S.LATITUDE} AS DEC) z) SELECT k, det_id, round(elevation, 6) AS elevation FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(elevation, 9) DESC, det_id) AS n FROM e) WHERE n = 1")
def elevation_rank(s, d):
    rows = _det(s, d).withColumn("elevation", S.elevation("RA", "DEC", "lst_hour"))
    return summary.first_per_key(rows, ["k"], F.desc(F.round("elevation", 9)), "det_id").select("k", "det_id", _r("elevation"))


@_query("sky_pairs", f"WITH {_C}, {_REFS} SELECT a.meta_id AS base_id, b.ref_id, round({separation('a', 'b')}, 6) AS sep_deg {_pairs_sql('cat', 'cust', 'a.BMAJ_match', 'b.BMAJ', 0.09)}")
def sky_pairs_query(s, d):
    return sky_pairs(_cat(s, d), relation(s, d, CUSTOMERS), "meta_id", "ref_id", "BMAJ_match", "BMAJ").select("base_id", "ref_id", _r("sep_deg"))


@_query("sky_neighbours", f"WITH {_D} SELECT a.det_id AS id1, b.det_id AS id2, round({separation('a', 'b')}, 6) AS sep_deg {_pairs_sql('det', 'det', 'a.BMAJ', 'b.BMAJ', 0.03)} AND a.det_id < b.det_id")
def neighbours(s, d):
    return sky_neighbours(_det(s, d), "det_id").select("id1", "id2", _r("sep_deg"))


_EDGES = f"edges AS (SELECT a.meta_id AS base_id, b.ref_id, {separation('a', 'b')} AS sep {_pairs_sql('cat', 'cust', 'a.BMAJ_match', 'b.BMAJ', 0.09)})"


@_query("claim_counts", f"WITH {_C}, {_REFS}, {_EDGES} SELECT base_id, ref_id, count(*) OVER (PARTITION BY base_id) AS n_assoc, count(*) OVER (PARTITION BY ref_id) AS n_confused FROM edges")
def claim_counts(s, d):
    from pyspark.sql import Window as W

    e = sky_pairs(_cat(s, d), relation(s, d, CUSTOMERS), "meta_id", "ref_id", "BMAJ_match", "BMAJ")
    return e.select("base_id", "ref_id", F.count(F.lit(1)).over(W.partitionBy("base_id")).alias("n_assoc"), F.count(F.lit(1)).over(W.partitionBy("ref_id")).alias("n_confused"))


def _plain(name, **kw):
    return match.Survey(name, match.Radius(), box=False, **kw)


def _flag_match(s, d):
    return match.match(_cat(s, d), relation(s, d, CUSTOMERS), _plain("X"))


@_query("match_flags", f"WITH {_C}, {_REFS}, {_EDGES} SELECT meta_id, count(ref_id) AS n_ref, count(ref_id) > 0 AS matched, coalesce(min(ref_id), -1) AS first_ref FROM cat LEFT JOIN edges ON base_id = meta_id GROUP BY meta_id")
def match_flags(s, d):
    return _flag_match(s, d).meta_flags.select("meta_id", "n_ref", "matched", F.coalesce(F.array_min("ref_ids"), F.lit(-1)).alias("first_ref"))


@_query("match_reference_flags", f"WITH {_C}, {_REFS}, {_EDGES} SELECT cust.ref_id, count(base_id) AS n_meta, count(base_id) > 1 AS oversplit FROM cust LEFT JOIN edges ON edges.ref_id = cust.ref_id GROUP BY cust.ref_id")
def match_reference_flags(s, d):
    return _flag_match(s, d).ref_flags.select("ref_id", "n_meta", "oversplit")


@_query(
    "match_summary",
    f"""WITH {_C}, {_REFS}, {_EDGES}, a AS (SELECT meta_id, count(ref_id) AS n FROM cat LEFT JOIN edges ON base_id = meta_id GROUP BY 1), b AS (SELECT cust.ref_id, count(base_id) AS n FROM cust LEFT JOIN edges ON edges.ref_id = cust.ref_id GROUP BY 1)
SELECT *, round(n_matched / n_target, 6) AS completeness, round(n_unique / n_matched, 6) AS unique_fraction, round(n_ref_matched / n_ref_footprint, 6) AS recovery FROM
(SELECT count(*) AS n_target, count(*) FILTER (n > 0) AS n_matched, count(*) FILTER (n = 1) AS n_unique, count(*) FILTER (n > 1) AS n_multi, max(n) AS max_hits FROM a), (SELECT count(*) AS n_ref_footprint, count(*) FILTER (n > 0) AS n_ref_matched, count(*) FILTER (n > 1) AS n_oversplit FROM b)""",
)
def match_summary(s, d):
    out = _flag_match(s, d).summary
    return out.select(*[_r(c) if t == "double" else c for c, t in out.dtypes])


@_query("bijective_match", f"WITH {_C}, {_REFS}, {_EDGES} SELECT base_id, ref_id FROM (SELECT *, count(*) OVER (PARTITION BY base_id) AS a, count(*) OVER (PARTITION BY ref_id) AS b FROM edges) WHERE a = 1 AND b = 1")
def bijective_match(s, d):
    return match.bijective(_flag_match(s, d).edges).select("base_id", "ref_id")


_NEAREST = "SELECT base_id, ref_id, round(sep, 6) AS sep_deg FROM (SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY sep, ref_id) AS n FROM edges) WHERE n = 1"


@_query("nearest_reference", f"WITH {_C}, {_REFS}, {_EDGES} {_NEAREST}")
def nearest_reference(s, d):
    return match.nearest_reference(_cat(s, d).withColumn("BMAJ", F.col("BMAJ_match")), relation(s, d, CUSTOMERS), "meta_id", "ref_id").select("base_id", "ref_id", _r("sep_deg"))


_BANDS = "fu AS (SELECT * FROM det WHERE band = 'Full'), bl AS (SELECT * FROM det WHERE band = 'Blue')"
_ASSOC = f"""{_BANDS}, edges AS (SELECT a.det_id AS base_id, b.det_id AS ref_id {_pairs_sql("fu", "bl", "a.BMAJ", "b.BMAJ", 0.03)}),
hits AS (SELECT *, count(*) OVER (PARTITION BY base_id) AS n_assoc, count(*) OVER (PARTITION BY ref_id) AS n_confused FROM edges),
best AS (SELECT * FROM (SELECT hits.*, bl.Total_flux, bl.Peak_flux, bl.BMAJ AS bb, row_number() OVER (PARTITION BY base_id ORDER BY bl.Total_flux DESC, ref_id) AS n FROM hits JOIN bl ON bl.det_id = ref_id) WHERE n = 1)"""
_ASSOC_ROWS = "SELECT 'Full' AS origin_band, fu.det_id AS id, CASE WHEN base_id IS NULL THEN 'Full' ELSE 'Full,Blue' END AS bands_present, n_assoc, n_confused, round(best.Peak_flux, 6) AS \"Peak_flux_Blue\", round(CASE WHEN base_id IS NULL THEN fu.BMAJ ELSE greatest(fu.BMAJ, bb) END, 6) AS \"BMAJ_match\" FROM fu LEFT JOIN best ON base_id = fu.det_id"


def _bands(s, d):
    rows = _det(s, d).drop("lst_hour")
    return {b: rows.where(F.col("band") == b) for b in B.COLOR_BANDS}


def _associated(s, d, append):
    c = _bands(s, d)
    seeds = merge.seed_rows(c["Full"], "det_id", "Full", 0, merge.FLUX_FIELDS, True, "Full")
    out = merge.associate(seeds, c["Blue"], "det_id", "Blue", source=1, fields=merge.FLUX_FIELDS, append=append, grow_radius=True, representative="peak_flux")
    return out.select("origin_band", F.col("__key.id").alias("id"), "bands_present", F.col("n_assoc_Blue").alias("n_assoc"), F.col("n_confused_Blue").alias("n_confused"), _r("Peak_flux_Blue"), _r("BMAJ_match"))


@_query("associate_append", f"WITH {_D}, {_ASSOC} {_ASSOC_ROWS} UNION ALL SELECT 'Blue', det_id, 'Blue', 1, 1, round(Peak_flux, 6), round(BMAJ, 6) FROM bl WHERE det_id NOT IN (SELECT ref_id FROM edges)")
def associate_append(s, d):
    return _associated(s, d, True)


@_query("associate_only", f"WITH {_D}, {_ASSOC} {_ASSOC_ROWS}")
def associate_only(s, d):
    return _associated(s, d, False)


@_query("fuse_global")
def fuse_global(s, d):
    out = merge.fuse(_bands(s, d), "det_id")
    return out.select("meta_id", "origin_band", "bands_present", _r("RA"), _r("DEC"), _r("Peak_flux"), "n_lst_contributions", "n_assoc_Blue", "n_confused_Blue", "n_assoc_Green", "n_assoc_Red", _r("alpha_RG"), _r("E_alpha_RG"), _r("alpha_GB"), _r("BMAJ_match"))


@_query("fuse_subbands")
def fuse_subbands(s, d):
    rows = _det(s, d).drop("lst_hour")
    names = {"Full": "73MHz", "Blue": "55MHz", "Green": "41MHz", "Red": "18MHz"}
    out = merge.fuse_subbands({names[b]: rows.where(F.col("band") == b) for b in names}, "det_id")
    return out.select("meta_id", "origin_band", "astrometry_band", "bands_present", _r("RA"), _r("DEC"), *[_r(f"Peak_flux_{m}") for m in names.values()])


@_query(
    "survey_attach",
    f"""WITH {_C}, {_REFS}, e AS (SELECT a.meta_id AS base_id, b.ref_id, b.Peak_flux, b.Total_flux {_pairs_sql("cat", "par", "a.BMAJ_match", "sqrt(b.E_RA * b.E_RA + b.E_DEC * b.E_DEC)", 0.09)} AND b.DEC >= -40),
h AS (SELECT *, count(*) OVER (PARTITION BY base_id) AS n_assoc, count(*) OVER (PARTITION BY ref_id) AS n_confused FROM e), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY Total_flux DESC, ref_id) AS n FROM h) WHERE n = 1)
SELECT meta_id, n_assoc AS "n_assoc_NVSS", n_confused AS "n_confused_NVSS", round(b.Total_flux, 6) AS "Total_flux_NVSS", CASE WHEN base_id IS NULL THEN bands_present ELSE bands_present || ',NVSS' END AS bands_present FROM cat LEFT JOIN b ON base_id = meta_id""",
)
def survey_attach(s, d):
    out = match.attach(_cat(s, d), relation(s, d, PARTS), match.SURVEYS["NVSS"])
    return out.select("meta_id", "n_assoc_NVSS", "n_confused_NVSS", _r("Total_flux_NVSS"), "bands_present")


@_query(
    "attach_best_hit",
    f"""WITH {_C}, {_REFS}, e AS (SELECT a.meta_id AS base_id, b.ref_id, b."DET_LIKE_0", {separation("a", "b")} AS sep {_pairs_sql("cat", "par", "a.BMAJ_match", "b.BMAJ", 0.09)}),
b AS (SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY "DET_LIKE_0" DESC, sep, ref_id) AS n, count(*) OVER (PARTITION BY base_id) AS c FROM e)
SELECT meta_id, coalesce(c, 0) AS n_hits, "DET_LIKE_0" AS det_like, round(sep, 6) AS sep_deg FROM cat LEFT JOIN (SELECT * FROM b WHERE n = 1) ON base_id = meta_id""",
)
def attach_best_hit(s, d):
    out = match.attach_best(_cat(s, d), relation(s, d, PARTS), _plain("X"), [F.desc_nulls_last("DET_LIKE_0")], ["DET_LIKE_0"])
    return out.select("meta_id", "n_hits", F.col("DET_LIKE_0").alias("det_like"), _r("sep_deg"))


def _step(frame: str, ref: str, radius: str, name: str, where: str = "TRUE", n: int = 0) -> str:
    return f"""e{n} AS (SELECT a.id AS i, b.ref_id AS j {_pairs_sql(frame, f"(SELECT * FROM {ref} WHERE {where})", "a.r", radius, 0.09)}),
p{n} AS (SELECT i, j FROM (SELECT *, count(*) OVER (PARTITION BY i) AS x, count(*) OVER (PARTITION BY j) AS y FROM e{n}) WHERE x = 1 AND y = 1),
f{n + 1} AS (SELECT id, coalesce(b.RA, f.RA) AS RA, coalesce(b.DEC, f.DEC) AS DEC, CASE WHEN b.ref_id IS NULL THEN f.r ELSE {radius} END AS r, CASE WHEN b.ref_id IS NULL THEN f.src ELSE '{name}' END AS src FROM {frame} f LEFT JOIN p{n} ON i = id LEFT JOIN {ref} b ON b.ref_id = j)"""


_BOX = "DEC BETWEEN (SELECT min(DEC) FROM cat) AND (SELECT max(DEC) FROM cat)"
_HYPOT = "CASE WHEN b.E_RA > 0 AND b.E_DEC > 0 THEN sqrt(b.E_RA * b.E_RA + b.E_DEC * b.E_DEC) ELSE {} / 3600.0 END"


@_query(
    "cascade_bootstrap",
    f"""WITH {_C}, {_REFS}, f0 AS (SELECT meta_id AS id, RA, DEC, BMAJ_match AS r, 'native' AS src FROM cat),
{_step("f0", "sup", "(3.0 / 3600.0)", "VLSSR", _BOX, 0)}, {_step("f1", "cust", _HYPOT.format("7.0"), "NVSS", _BOX + " AND DEC >= -40", 1)}, {_step("f2", "par", _HYPOT.format("2.5"), "VLASS", _BOX + " AND DEC >= -40", 2)}
SELECT id, round(RA, 6) AS RA, round(DEC, 6) AS DEC, round(r, 6) AS BMAJ, src AS match_source FROM f3""",
)
def cascade_bootstrap(s, d):
    out = match.cascade(_cat(s, d), {"VLSSR": relation(s, d, SUPPLIERS), "NVSS": relation(s, d, CUSTOMERS), "VLASS": relation(s, d, PARTS)})
    return out.select("id", _r("RA"), _r("DEC"), _r("BMAJ"), "match_source")


#: Two passes over all detections: the second is shifted, a third of it little enough to meet the first.
_HALVES = "one AS (SELECT * FROM det), two AS (SELECT det_id + 1000000000 AS det_id, RA + 0.005 + 0.05 * (k % 3) AS RA, DEC, BMAJ, Peak_flux, S_Code FROM det)"


def _halves(s, d):
    det = _det(s, d)
    return det, det.withColumns({"det_id": F.col("det_id") + 1_000_000_000, "RA": F.expr("RA + 0.005D + 0.05D * (k % 3)")})


_SD = f"hit AS (SELECT DISTINCT b.det_id {_pairs_sql('one', 'two', 'a.BMAJ', 'b.BMAJ', 0.03)})"


@_query("shallow_deep", f"WITH {_D}, {_HALVES}, {_SD} SELECT det_id, round(RA, 6) AS RA FROM one UNION ALL SELECT det_id, round(RA, 6) FROM two WHERE det_id NOT IN (SELECT det_id FROM hit)")
def shallow_deep(s, d):
    return detection.shallow_then_deep(*_halves(s, d), "det_id").select("det_id", _r("RA"))


@_query("residual_merge", f"WITH {_D}, {_HALVES}, {_SD}, base AS (SELECT DISTINCT a.det_id {_pairs_sql('one', 'two', 'a.BMAJ', 'b.BMAJ', 0.03)}) SELECT det_id, round(RA, 6) AS RA, 2 AS detect_stage, det_id IN (SELECT det_id FROM base) AS resid_leftover FROM one UNION ALL SELECT det_id, round(RA, 6), 3, FALSE FROM two WHERE det_id NOT IN (SELECT det_id FROM hit)")
def residual_merge(s, d):
    return detection.merge_residual(*_halves(s, d), "det_id", "Full")[0].select("det_id", _r("RA"), "detect_stage", "resid_leftover")


@_query("residual_pairs", f"WITH {_D}, {_HALVES} SELECT a.det_id AS base_id, b.det_id AS ref_id, round(b.Peak_flux, 6) AS peak {_pairs_sql('one', 'two', 'a.BMAJ', 'b.BMAJ', 0.03)}")
def residual_pairs(s, d):
    return detection.merge_residual(*_halves(s, d), "det_id", "Full")[1].select("base_id", "ref_id", F.round("Peak_flux_residual", 6).alias("peak"))


@_query(
    "multiple_to_single",
    f"""WITH {_D}, {_HALVES}, e AS (SELECT a.det_id AS i, b.det_id AS j, {separation("a", "b")} AS sep, b.Peak_flux AS p {_pairs_sql("(SELECT * FROM one WHERE S_Code = 'M')", "(SELECT * FROM two WHERE S_Code = 'S')", "a.BMAJ", "b.BMAJ", 0.03)}),
h AS (SELECT i, j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(sep, 9), p DESC, j) AS n FROM e) WHERE n = 1)
SELECT det_id, round(RA, 6) AS RA FROM one WHERE det_id NOT IN (SELECT i FROM h) UNION ALL SELECT det_id, round(RA, 6) FROM two WHERE det_id IN (SELECT j FROM h)""",
)
def multiple_to_single(s, d):
    return detection.replace_multiple(*_halves(s, d), "det_id").select("det_id", _r("RA"))


@_query("greedy_dedupe")
def greedy_dedupe(s, d):
    return detection.brightest_first(_det(s, d), "det_id", "Peak_flux").select("det_id", _r("Peak_flux"))


@_query("crossband_actions")
def crossband_actions(s, d):
    c = _bands(s, d)
    out = detection.crossband_actions(c["Green"], {"Blue": c["Blue"], "Red": c["Red"]}, "det_id")
    return out.select("action", "seed_band", "seed_id", "target_id", _r("seed_peak"), _r("target_peak"), "reason")


@_query("rematch_seed", f"WITH {_D}, {_BANDS}, e AS (SELECT a.det_id AS i, b.det_id AS j, abs(b.Peak_flux - a.Peak_flux) AS dp, {separation('a', 'b')} AS sep {_pairs_sql('fu', 'bl', 'a.BMAJ', 'b.BMAJ', 0.03)}) SELECT i AS meta_id, j AS lst_id, c AS n_hits FROM (SELECT *, count(*) OVER (PARTITION BY i) AS c, row_number() OVER (PARTITION BY i ORDER BY dp, sep, j) AS n FROM e) WHERE n = 1")
def rematch_seed(s, d):
    c = _bands(s, d)
    rows = c["Full"].withColumns({"meta_id": F.col("det_id"), "band": F.lit("Blue")})
    return trace.rematch(rows, c["Blue"].withColumn("lst_id", F.col("det_id"))).select("meta_id", "lst_id", "n_hits")


_GLARE = {**{c: f"CASE WHEN meta_id % 7 = 0 THEN {c} * 100 ELSE {c} END" for c in ("Peak_flux", "Total_flux", "E_Peak_flux", "E_Total_flux")}, "BMAJ_match": "BMAJ_match * 4"}
#: The catalogue with some very bright sources and wider beams.
_GC = f"cat AS (SELECT * REPLACE ({', '.join(f'{v} AS {k}' for k, v in _GLARE.items())}) FROM ({CATALOG}))"


def _glaring(s, d):
    return _cat(s, d).withColumns({k: F.expr(v) for k, v in _GLARE.items()})


_SIDE = f"side AS (SELECT DISTINCT b.meta_id FROM cat a JOIN cat b ON b.DEC BETWEEN a.DEC - 1.3 AND a.DEC + 1.3 AND a.meta_id <> b.meta_id WHERE a.Peak_flux >= 30 * b.Peak_flux AND {separation('a', 'b')} BETWEEN 2 * a.BMAJ_match AND 4 * a.BMAJ_match)"


@_query("sidelobe_flag", f"WITH {_GC}, {_SIDE} SELECT meta_id FROM side")
def sidelobe_flag(s, d):
    return reliability.near_bright(_glaring(s, d), "meta_id")


@_query("nearest_k", f"WITH {_C}, q AS (SELECT 150.0 AS RA, 20.0 AS DEC) SELECT meta_id, round(sep * 60, 4) AS sep_arcmin, round(sep, 6) AS sep_deg FROM (SELECT meta_id, {separation('q', 'cat')} AS sep FROM cat, q) ORDER BY sep, meta_id LIMIT 25")
def nearest_k(s, d):
    return nearest(_cat(s, d), 150.0, 20.0, 25, id="meta_id").select("meta_id", "sep_arcmin", "sep_deg")


@_query("field_of_view", f"WITH {_C}, q AS (SELECT 40.0 AS RA, -10.0 AS DEC) SELECT meta_id, round({separation('q', 'cat')}, 6) AS sep_deg FROM cat, q WHERE {separation('q', 'cat')} <= 10.5")
def field_of_view(s, d):
    return within_field(_cat(s, d), 40.0, -10.0, 20.0, 0.5).select("meta_id", _r("sep_deg"))


@_query("spectral_index", f"WITH {_C} SELECT meta_id, round(ln(\"Total_flux_Red\" / \"Total_flux_Blue\") / ln({B.FREQUENCY_HZ['Red']} / {B.FREQUENCY_HZ['Blue']}), 6) AS alpha, round(sqrt(pow(\"E_Total_flux_Red\" / \"Total_flux_Red\", 2) + pow(\"E_Total_flux_Blue\" / \"Total_flux_Blue\", 2)) / abs(ln({B.FREQUENCY_HZ['Red']} / {B.FREQUENCY_HZ['Blue']})), 6) AS e_alpha FROM cat")
def spectral_index(s, d):
    out = merge.add_spectral_indices(_cat(s, d), (("RB", "Red", "Blue"),))
    return out.select("meta_id", F.round("alpha_RB", 6).alias("alpha"), F.round("E_alpha_RB", 6).alias("e_alpha"))


@_query("flux_sigma", f"WITH {_C} SELECT meta_id, round((Total_flux - Peak_flux) / sqrt(E_Total_flux * E_Total_flux + E_Peak_flux * E_Peak_flux), 6) AS sigma FROM cat")
def flux_sigma(s, d):
    return _cat(s, d).select("meta_id", F.round(X.flux_sigma("Total_flux", "Peak_flux", "E_Total_flux", "E_Peak_flux"), 6).alias("sigma"))


@_query("peak_from_total", f"WITH {_C} SELECT meta_id, round(Total_flux * BMAJ_match * BMAJ_match / (Maj * Min), 4) AS peak FROM cat")
def peak_from_total(s, d):
    return _cat(s, d).select("meta_id", F.round(X.peak_from_total("Total_flux", "BMAJ_match", "BMAJ_match", "Maj", "Min"), 4).alias("peak"))


def _bits(s, d):
    return _cat(s, d).drop("quality_flag")


_BITS = f"""bits AS (SELECT meta_id, PA IS NULL AS "HAS_NAN", n_lst_contributions = 1 AS "SINGLE_LST",
 (CASE WHEN "n_assoc_Blue" = 1 THEN 1 ELSE 0 END + CASE WHEN "n_assoc_Red" = 1 THEN 1 ELSE 0 END + 1) = 1 AS "SINGLE_UNIQUE_BAND",
 (Total_flux - Peak_flux) / sqrt(E_Total_flux * E_Total_flux + E_Peak_flux * E_Peak_flux) < -3 AS "UNPHYSICAL_FLUX",
 Resid_Isl_rms > 1 OR abs(Resid_Isl_mean) > 1 AS "RESID_ABS_FAIL", cluster_jitter_rms_deg > 0.3 * BMAJ_match AS "JITTER_FAIL",
 (bands_present LIKE '%Blue%' AND "n_confused_Blue" > 1) OR (bands_present LIKE '%Red%' AND "n_confused_Red" > 1) AS "CONFUSED_ASSOC", S_Code IN ('C', 'M') AS "SCODE_COMPLEX",
 90 - {separation("z", "cat")} < 10 AS "LOW_ELEVATION", Maj / Min > 3 AS "HIGH_ELLIPTICITY", Maj > 3 * BMAJ_match AS "EXTENDED", S_Code IN ('C', 'M') AND Resid_Isl_rms > 0.3 AS "COMPLEX_RESID"
 FROM cat, LATERAL (SELECT CAST(left(representative_lst, 2) AS DOUBLE) * 15 AS RA, {S.LATITUDE} AS DEC) z)"""
_PACK = " + ".join(f'CASE WHEN "{n}" THEN {Q.VALUE[n]} ELSE 0 END' for n in ("HAS_NAN", "SINGLE_LST", "SINGLE_UNIQUE_BAND", "UNPHYSICAL_FLUX", "RESID_ABS_FAIL", "JITTER_FAIL", "CONFUSED_ASSOC", "SCODE_COMPLEX", "LOW_ELEVATION", "HIGH_ELLIPTICITY", "EXTENDED", "COMPLEX_RESID"))
_LARGE = f'CASE WHEN ("EXTENDED" OR "HIGH_ELLIPTICITY") AND ("SINGLE_UNIQUE_BAND" OR "SINGLE_LST") THEN {Q.VALUE["LARGE_SINGLE"]} ELSE 0 END'


@_query("quality_pack", f"WITH {_C}, {_BITS} SELECT meta_id, CAST({_PACK} + {_LARGE} AS BIGINT) AS quality_flag FROM bits")
def quality_pack(s, d):
    rows = _bits(s, d)
    return rows.select("meta_id", Q.packed(reliability.simple_bits(rows.columns)).alias("quality_flag"))


_PCT = f"p AS (SELECT quantile_cont(Resid_Isl_rms, 0.01) AS a, quantile_cont(Resid_Isl_rms, 0.99) AS b, quantile_cont(Resid_Isl_mean, 0.01) AS c, quantile_cont(Resid_Isl_mean, 0.99) AS d FROM cat)"
@_query(
    "quality_assign",
    f"""WITH {_GC}, {_REFS}, {_BITS}, {_PCT}, {_SIDE} SELECT bits.meta_id, CAST({_PACK} + {_LARGE} + CASE WHEN Resid_Isl_rms < a OR Resid_Isl_rms > b THEN {Q.VALUE["RESID_PCTL_RMS"]} ELSE 0 END + CASE WHEN Resid_Isl_mean < c OR Resid_Isl_mean > d THEN {Q.VALUE["RESID_PCTL_MEAN"]} ELSE 0 END
+ CASE WHEN bits.meta_id IN (SELECT meta_id FROM side) THEN {Q.VALUE["NEAR_BRIGHT_SIDELOBE"]} ELSE 0 END + CASE WHEN bits.meta_id IN (SELECT ref_id FROM cust) THEN 0 ELSE {Q.VALUE["NO_VLSSR"]} END AS BIGINT) AS quality_flag FROM bits JOIN cat USING (meta_id), p""",
)
def quality_assign(s, d):
    seen = relation(s, d, CUSTOMERS).select(F.col("ref_id").alias("meta_id"))
    return reliability.assign_quality(_glaring(s, d).drop("quality_flag"), vlssr=seen).select("meta_id", "quality_flag")


@_query("quality_mask", f"WITH {_C} SELECT meta_id FROM cat WHERE quality_flag & 247 = 0")
def quality_mask(s, d):
    return Q.clear(_cat(s, d)).select("meta_id")


def _mask_sql(names, test):
    return f"WITH {_C} SELECT meta_id FROM cat WHERE quality_flag & {Q.mask_of(names)} {test.format(Q.mask_of(names))}"


for _how, _test in (("any", "<> 0"), ("all", "= {}"), ("none", "= 0")):
    _query(f"quality_bits_{_how}", _mask_sql(("SINGLE_LST", "EXTENDED"), _test))(lambda s, d, how=_how: Q.with_bits(_cat(s, d), ["single_lst", "extended"], how).select("meta_id"))


@_query("quality_or_hesl", f"WITH {_C} SELECT meta_id FROM cat WHERE NOT (quality_flag & {Q.mask_of(Q.OR_HESL)} <> 0 OR quality_flag & {Q.VALUE['HIGH_ELLIPTICITY'] | Q.VALUE['SINGLE_LST']} = {Q.VALUE['HIGH_ELLIPTICITY'] | Q.VALUE['SINGLE_LST']})")
def quality_or_hesl(s, d):
    return Q.without_or_hesl(_cat(s, d)).select("meta_id")


@_query("quality_core_clean", f"WITH {_C} SELECT meta_id FROM cat WHERE quality_flag & 495843 = 0")
def quality_core_clean(s, d):
    return Q.clear(_cat(s, d), Q.mask_of(Q.CORE_CLEAN)).select("meta_id")


@_query("quality_bit_counts", f"WITH {_C}, b AS (SELECT unnest([{', '.join(repr(n) for n in Q.NAMES)}]) AS name, unnest(range(20)) AS bit) SELECT name, CAST(bit AS INTEGER) AS bit, count(*) FILTER (quality_flag & (CAST(1 AS BIGINT) << bit) <> 0) AS n, round(count(*) FILTER (quality_flag & (CAST(1 AS BIGINT) << bit) <> 0) / count(*), 6) AS fraction FROM b, cat GROUP BY name, bit UNION ALL SELECT 'ALL_CLEAR', -1, count(*) FILTER (quality_flag = 0), round(count(*) FILTER (quality_flag = 0) / count(*), 6) FROM cat")
def quality_bit_counts(s, d):
    return Q.bit_counts(_cat(s, d)).select("name", "bit", "n", _r("fraction"))


@_query("quality_decode", f"WITH {_C} SELECT meta_id, array_to_string(list_filter([{', '.join(f'CASE WHEN quality_flag & {v} <> 0 THEN {n!r} END' for n, v in Q.VALUE.items())}], lambda x: x IS NOT NULL), ',') AS names FROM cat")
def quality_decode(s, d):
    return _cat(s, d).select("meta_id", F.array_join(Q.decoded(F.col("quality_flag")), ",").alias("names"))


@_query("residual_percentile", f"WITH {_C}, {_PCT} SELECT meta_id FROM cat, p WHERE Resid_Isl_rms < a OR Resid_Isl_rms > b")
def residual_percentile(s, d):
    return reliability.percentile_bits(_cat(s, d), "Resid_Isl_rms", 1.0, 99.0).where("outside").select("meta_id")


_UNIQ = '(CASE WHEN "n_assoc_Blue" = 1 THEN 1 ELSE 0 END + CASE WHEN "n_assoc_Red" = 1 THEN 1 ELSE 0 END + 1)'
_TIERS = f"""t AS (SELECT cat.*, n_lst_contributions >= 2 OR {_UNIQ} >= 2 AS many, bits.* FROM cat JOIN bits USING (meta_id)),
x AS (SELECT *, NOT FALSE AS e0, many AS e1, NOT "UNPHYSICAL_FLUX" AS e2, NOT "RESID_ABS_FAIL" AS e3, NOT "JITTER_FAIL" AS e4 FROM t)"""


@_query("tier_yields", f"WITH {_C}, {_BITS}, {_TIERS}, n AS (SELECT count(*) AS n, count(*) FILTER (e0) AS a, count(*) FILTER (e0 AND e1) AS b, count(*) FILTER (e0 AND e1 AND e2) AS c, count(*) FILTER (e0 AND e1 AND e2 AND e3) AS d, count(*) FILTER (e0 AND e1 AND e2 AND e3 AND e4) AS e FROM x) SELECT 'E0' AS tier, n AS n_in, a AS n_out, n - a AS n_removed FROM n UNION ALL SELECT 'E1', a, b, a - b FROM n UNION ALL SELECT 'E2', b, c, b - c FROM n UNION ALL SELECT 'E3', c, d, c - d FROM n UNION ALL SELECT 'E4', d, e, d - e FROM n")
def tier_yields(s, d):
    return reliability.tier_yields(_bits(s, d), "E4")


@_query("tier_gold", f"WITH {_C}, {_BITS}, {_TIERS} SELECT meta_id FROM x WHERE e0 AND e1 AND e2 AND e3 AND e4 AND (bands_present NOT LIKE '%Blue%' OR (\"n_assoc_Blue\" = 1 AND \"n_confused_Blue\" = 1)) AND (bands_present NOT LIKE '%Red%' OR (\"n_assoc_Red\" = 1 AND \"n_confused_Red\" = 1))")
def tier_gold(s, d):
    return reliability.filter_tiers(_bits(s, d), "I5").select("meta_id")


@_query("gold_in_cleaned", f"WITH {_C}, {_BITS}, {_TIERS} SELECT meta_id FROM x WHERE \"S_Code\" = 'S' AND NOT (e0 AND e1 AND e2 AND e3 AND e4) UNION ALL SELECT -1 FROM (SELECT 1)")
def gold_in_cleaned(s, d):
    """Simple sources that the cleaned catalogue lacks, and one row that says that the gold catalogue lacks none."""
    rows = _bits(s, d)
    cleaned = reliability.filter_tiers(rows, "E4")
    nested = reliability.not_nested(reliability.filter_tiers(rows, "I5"), cleaned).agg(F.count(F.lit(1)).alias("n")).select((-1 - F.col("n")).alias("meta_id"))
    return reliability.not_nested(rows.where("S_Code = 'S'"), cleaned).unionByName(nested)


_AS = f"asc0 AS ({ASSOCIATIONS}), har AS (SELECT *, CASE catalog WHEN 'MilliQuas' THEN CASE WHEN class_native = 'S' THEN 'star' ELSE 'agn' END WHEN 'eRASS3' THEN CASE class_native WHEN '-1' THEN 'star' WHEN '2' THEN 'galaxy' WHEN 'blazar' THEN 'agn' ELSE 'xray' END WHEN 'RFC' THEN CASE class_native WHEN 'QSO' THEN 'agn' WHEN 'GClstr' THEN 'cluster' ELSE 'radio' END WHEN 'TeVCat' THEN CASE WHEN class_native = 'hbl' THEN 'agn' ELSE 'tev' END WHEN 'NVSS' THEN 'radio' WHEN 'Xu2022' THEN 'cluster' ELSE 'galaxy' END AS h FROM asc0)"


def _assoc(s, d):
    return relation(s, d, ASSOCIATIONS)


@_query("harmonise", f"WITH {_AS} SELECT catalog, class_native, h AS class_harmonized, count(*) AS n FROM har GROUP BY ALL")
def harmonise(s, d):
    return A.harmonize(_assoc(s, d)).groupBy("catalog", "class_native", "class_harmonized").agg(F.count(F.lit(1)).alias("n"))


@_query("class_conflicts", f"WITH {_AS} SELECT meta_id, count(*) AS n_associations, count(DISTINCT h) AS n_harmonized, array_to_string(list_sort(list(DISTINCT h)), ',') AS harmonized_labels, count(DISTINCT h) >= 2 AS conflict FROM har GROUP BY meta_id")
def class_conflicts(s, d):
    return A.conflicts(_assoc(s, d))


@_query("classes_any", f"WITH {_AS} SELECT DISTINCT meta_id FROM har WHERE h IN ('agn', 'star')")
def classes_any(s, d):
    return A.ids_of_classes(_assoc(s, d), ["agn", "star"])


@_query("classes_exclusive", f"WITH {_AS} SELECT meta_id FROM har GROUP BY meta_id HAVING bool_and(h IN ('agn', 'star', 'galaxy'))")
def classes_exclusive(s, d):
    return A.ids_of_classes(_assoc(s, d), ["agn", "star", "galaxy"], exclusive=True)


@_query("classes_without_conflicts", f"WITH {_AS} SELECT meta_id FROM har GROUP BY meta_id HAVING count(DISTINCT h) = 1 AND min(h) = 'agn'")
def classes_without_conflicts(s, d):
    return A.ids_of_classes(_assoc(s, d), ["agn"], exclude_conflicts=True)


@_query("class_and_range", f"WITH {_C}, {_AS} SELECT meta_id FROM cat WHERE meta_id IN (SELECT meta_id FROM har WHERE h = 'cluster') AND Peak_flux >= 5 AND Peak_flux <= 20")
def class_and_range(s, d):
    return A.select_classes(_cat(s, d), _assoc(s, d), ["cluster"], {"Peak_flux": (5.0, 20.0), "RA": (None, None)}).select("meta_id")


@_query("replace_by_key", f"WITH {_AS} SELECT meta_id, catalog, ref_id FROM asc0 WHERE catalog <> 'RFC' UNION ALL SELECT meta_id, 'RFC', ref_id FROM asc0 WHERE catalog = 'NVSS'")
def replace_by_key(s, d):
    rows = _assoc(s, d)
    return A.replace_catalog(rows, rows.where("catalog = 'NVSS'"), "RFC").select("meta_id", "catalog", "ref_id")


_CLASSES = ("agn", "cluster", "galaxy", "radio", "star", "tev", "unknown", "xray")


@_query("class_crosstab", f"WITH {_AS} SELECT catalog, {', '.join(f'count(*) FILTER (h = {c!r}) AS {c}' for c in _CLASSES)} FROM har GROUP BY catalog")
def class_crosstab(s, d):
    return A.class_table(_assoc(s, d))


@_query("association_rows", f"WITH {_C}, {_REFS}, {_EDGES} SELECT base_id AS meta_id, 'MilliQuas' AS catalog, kind AS ref_id, round(sep * 3600, 4) AS sep_arcsec FROM (SELECT *, count(*) OVER (PARTITION BY base_id) AS n FROM edges) JOIN cust USING (ref_id) WHERE n = 1")
def association_rows(s, d):
    found = match.match(_cat(s, d), relation(s, d, CUSTOMERS).withColumn("Name", F.col("kind")), _plain("MilliQuas"))
    return A.from_match(found, A.SPECS["MilliQuas"]).select("meta_id", "catalog", "ref_id", _r("sep_arcsec", 4))


_SP = f"spec AS ({SPECTRA})"
_MHZ = (18, 41, 55, 73)
_BANDS_MHZ = [f"{m}MHz" for m in _MHZ]
_LONG = " UNION ALL ".join(f'SELECT meta_id, ln({m}e6 / 55e6) AS x, ln("Total_flux_{m}MHz") AS y FROM spec WHERE "Total_flux_{m}MHz" > 0 AND "n_confused_{m}MHz" = 1' for m in _MHZ)


def _spec(s, d):
    return relation(s, d, SPECTRA)


@_query("sed_gather", f"WITH {_SP}, l AS ({_LONG}) SELECT meta_id, (SELECT count(*) FROM l WHERE l.meta_id = spec.meta_id) AS n_flux FROM spec")
def sed_gather(s, d):
    rows = _spec(s, d)
    return rows.select("meta_id", F.size(spectral.gather(rows.columns, _BANDS_MHZ)).cast("long").alias("n_flux"))


@_query(
    "taylor_fit_two_terms",
    f"""WITH {_SP}, l AS ({_LONG}), s AS (SELECT meta_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM l GROUP BY meta_id),
c AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS a1 FROM s WHERE n >= 2)
SELECT spec.meta_id, CAST(CASE WHEN c.n IS NULL THEN 0 ELSE 2 END AS BIGINT) AS n_terms, round((sy - a1 * sx) / c.n, 6) AS a0, round(a1, 6) AS a1 FROM spec LEFT JOIN c USING (meta_id)""",
)
def taylor_fit_two_terms(s, d):
    out = spectral.fit(_spec(s, d), _BANDS_MHZ, max_terms=2, use_errors=False)
    return out.select("meta_id", F.col("spec_model_n_terms").alias("n_terms"), F.round("spec_model_a0", 6).alias("a0"), F.round("spec_model_a1", 6).alias("a1"))


@_query("taylor_fit")
def taylor_fit(s, d):
    out = spectral.fit(_spec(s, d), _BANDS_MHZ)
    return out.select("meta_id", "spec_model_n_terms", "spec_model_n_flux", _r("spec_model_chi2_red"), *[_r(f"spec_model_a{j}") for j in range(4)])


@_query("predicted_flux", f"WITH {_SP}, l AS ({_LONG}), s AS (SELECT meta_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM l GROUP BY meta_id HAVING count(*) >= 2), c AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS a1 FROM s) SELECT meta_id, round(exp((sy - a1 * sx) / n + a1 * ln(1400.0 / 55.0)), 6) AS flux FROM c")
def predicted_flux(s, d):
    out = spectral.fit(_spec(s, d), _BANDS_MHZ, max_terms=2, use_errors=False).where("spec_model_n_terms = 2")
    return out.select("meta_id", F.round(X.predicted_flux(1400.0), 6).alias("flux"))


@_query(
    "mahalanobis",
    """WITH v AS (SELECT l_orderkey, l_quantity AS x, l_extendedprice AS y FROM lineitem), s AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c FROM v),
q AS (SELECT l_orderkey, (b * (x - mx) * (x - mx) - 2 * c * (x - mx) * (y - my) + a * (y - my) * (y - my)) / (a * b - c * c) AS d2 FROM v, s)
SELECT l_orderkey, round(d2, 6) AS d2, d2 >= (SELECT quantile_cont(d2, 0.99) FROM q) AS is_outlier FROM q""",
)
def mahalanobis(s, d):
    out = outliers.mahalanobis(s.read.parquet(f"{d}/lineitem.parquet"), ["l_quantity", "l_extendedprice"])
    return out.select("l_orderkey", F.round("mahalanobis_d2", 6).alias("d2"), "is_outlier")


def _ratio(f, lo, hi):
    ok = " AND ".join(f'"n_assoc_{m}MHz" = 1 AND "n_confused_{m}MHz" = 1' for m in (lo, hi))
    return f'quantile_cont("{f}_{hi}MHz" / "{f}_{lo}MHz", 0.5) FILTER ({ok} AND "{f}_{hi}MHz" > 0 AND "{f}_{lo}MHz" > 0)'


@_query("beam_alpha_chain", f"WITH {_SP}, m AS (SELECT sqrt(quantile_cont(\"Total_flux_73MHz\" / \"Peak_flux_VLSSR\", 0.5) FILTER (\"n_assoc_VLSSR\" = 1 AND \"Total_flux_73MHz\" > 0)) AS a73, sqrt({_ratio('Peak_flux', 55, 73)} / {_ratio('Total_flux', 55, 73)}) AS f3, sqrt({_ratio('Peak_flux', 41, 55)} / {_ratio('Total_flux', 41, 55)}) AS f2, sqrt({_ratio('Peak_flux', 18, 41)} / {_ratio('Total_flux', 18, 41)}) AS f1 FROM spec) SELECT '73MHz' AS band, round(a73, 6) AS alpha FROM m UNION ALL SELECT '55MHz', round(a73 / f3, 6) FROM m UNION ALL SELECT '41MHz', round(a73 / f3 / f2, 6) FROM m UNION ALL SELECT '18MHz', round(a73 / f3 / f2 / f1, 6) FROM m")
def beam_alpha_chain(s, d):
    rows, _ = beam.bootstrap_alpha(_spec(s, d), 1.0)
    return s.createDataFrame([(r["band"], round(r["alpha"], 6)) for r in rows], "band string, alpha double")


_SIZES = "siz AS (SELECT band, DEC, greatest(0, 37.239777 - DEC) AS u, Peak_flux * 0.001 / 0.02 AS a, Total_flux * 0.001 / 0.02 AS b FROM det WHERE S_Code = 'S' AND Peak_flux >= 1 AND DEC >= -40 AND DEC < 70)"
_GROUPS = "grp AS (SELECT band, CAST(floor((DEC + 40) / 5) AS BIGINT) AS bin, quantile_cont(DEC, 0.5) AS dec, quantile_cont(u, 0.5) AS u, quantile_cont(a, 0.5) AS a, quantile_cont(b, 0.5) AS b, count(*) AS n FROM siz GROUP BY 1, 2)"


def _sizes(s, d):
    rows = _det(s, d).drop("tile_ipix").withColumns({"Maj": F.col("Peak_flux") * 0.001, "Min": F.col("Total_flux") * 0.001, "BMAJ": F.lit(0.02), "BMIN": F.lit(0.02)})
    return beam.size_groups(beam.compact(rows))


@_query("beam_size_groups", f"WITH {_D}, {_SIZES}, {_GROUPS} SELECT band, bin, round(dec, 6) AS dec, round(a, 6) AS med_maj, n FROM grp")
def beam_size_groups(s, d):
    return _sizes(s, d).select("band", "bin", _r("dec"), _r("med_maj"), "n")


@_query("beam_kappa", f"WITH {_D}, {_SIZES}, {_GROUPS}, al AS (SELECT band, greatest(1, quantile_cont(a, 0.5), quantile_cont(b, 0.5)) AS al FROM grp WHERE abs(dec - 37.239777) <= 10 GROUP BY band) SELECT round(greatest(0, sum(n * u * (a / al - 1)) / sum(n * u * u)), 6) AS kappa FROM grp JOIN al USING (band) WHERE u > 0")
def beam_kappa(s, d):
    groups = _sizes(s, d)
    return beam.shared_kappa(groups, beam.size_alpha(groups)).select(_r("kappa"))


@_query("best_beam_scale", f"WITH {_D}, m AS (SELECT band, j * 0.1 AS alpha, avg(Resid_Isl_rms) AS r FROM det GROUP BY 1, 2) SELECT band, round(alpha, 6) AS alpha, round(r, 6) AS mean_residual FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY round(r, 12), alpha) AS n FROM m) WHERE n = 1")
def best_beam_scale(s, d):
    rows = _det(s, d).select("band", (F.col("j") * 0.1).alias("alpha"), F.col("Resid_Isl_rms").alias("residual"))
    return beam.best_scale(rows).select("band", _r("alpha"), _r("mean_residual"))


@_query("rescaled_total", f"WITH {_D} SELECT det_id, round(Total_flux * pow(1.2 / 1.1, 2) * (1 + 0.002 * greatest(0, 37.239777 - DEC)) / (1 + 0.001 * greatest(0, 37.239777 - DEC)), 6) AS total FROM det")
def rescaled_total(s, d):
    return _det(s, d).select("det_id", F.round(X.rescaled_total("Total_flux", "DEC", 1.2, 0.002, 1.1, 0.001), 6).alias("total"))


@_query("sky_histogram", f"WITH {_C} SELECT CAST(floor(RA / 10) AS BIGINT) AS ra_bin, CAST(floor((DEC + 90) / 10) AS BIGINT) AS dec_bin, count(*) AS n FROM cat GROUP BY 1, 2")
def sky_histogram(s, d):
    return summary.sky_histogram(_cat(s, d), 10.0)


@_query("densest_bins", f"WITH {_C} SELECT CAST(floor(RA / 10) AS BIGINT) AS ra_bin, CAST(floor((DEC + 90) / 10) AS BIGINT) AS dec_bin, count(*) AS n FROM cat GROUP BY 1, 2 ORDER BY n DESC, ra_bin, dec_bin LIMIT 10")
def densest_bins(s, d):
    return summary.sky_histogram(_cat(s, d), 10.0, top=10)


@_query("value_counts", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def value_counts(s, d):
    return summary.value_counts(s.read.parquet(f"{d}/events.parquet"), "event_type")


@_query("band_counts", f"WITH {_C} SELECT band, count(*) AS n FROM (SELECT unnest(string_split(bands_present, ',')) AS band FROM cat) GROUP BY band")
def band_counts(s, d):
    return summary.band_counts(_cat(s, d))


@_query("crosstab", f"WITH {_C} SELECT S_Code, count(*) FILTER (bands_present = 'Full') AS \"Full\", count(*) FILTER (bands_present = 'Full,Blue') AS \"Full,Blue\" FROM cat GROUP BY S_Code")
def crosstab(s, d):
    return summary.crosstab(_cat(s, d), "S_Code", "bands_present", ["Full", "Full,Blue"])


@_query("recovery_curve", "WITH e AS (SELECT p_size, p_partkey % 3 = 0 AS hit FROM part), g AS (SELECT p_size, count(*) FILTER (hit) AS m, count(*) AS n FROM e GROUP BY 1) SELECT p_size, CAST(sum(m) OVER w AS BIGINT) AS n_matched, CAST(sum(n) OVER w AS BIGINT) AS n_total, round(sum(m) OVER w / sum(n) OVER w, 6) AS recovery FROM g WINDOW w AS (ORDER BY p_size)")
def recovery_curve(s, d):
    rows = s.read.parquet(f"{d}/part.parquet").withColumn("hit", F.col("p_partkey") % 3 == 0)
    return summary.recovery_curve(rows, "p_size", "hit", "p_partkey").select("p_size", "n_matched", "n_total", _r("recovery"))


@_query("match_radius", f"WITH {_REFS} SELECT ref_id, round(3 * CASE WHEN E_DEC > 0 THEN sqrt(E_RA * E_RA + E_DEC * E_DEC) ELSE 7.0 / 3600 END, 9) AS radius FROM cust")
def match_radius(s, d):
    rows = relation(s, d, CUSTOMERS)
    return rows.select("ref_id", F.round(match.Radius("localization", scale=3.0, default_arcsec=7.0).column(rows.columns), 9).alias("radius"))


@_query("footprint_box", f"WITH {_C}, {_REFS} SELECT ref_id FROM par WHERE DEC >= -40 AND DEC BETWEEN (SELECT min(DEC) FROM cat) AND (SELECT max(DEC) FROM cat)")
def footprint_box(s, d):
    return match.footprint(relation(s, d, PARTS), _cat(s, d), match.SURVEYS["VLASS"]).select("ref_id")


_G = S.GALACTIC
_XYZ = ("cos(radians(DEC)) * cos(radians(RA))", "cos(radians(DEC)) * sin(radians(RA))", "sin(radians(DEC))")
_GX, _GY, _GZ = (" + ".join(f"({k}) * {v}" for k, v in zip(row, _XYZ)) for row in _G)


@_query("galactic_footprint", f"WITH {_C} SELECT meta_id, round(((degrees(atan2({_GY}, {_GX})) % 360) + 360) % 360, 6) AS l, round(degrees(asin({_GZ})), 6) AS b FROM cat WHERE ((degrees(atan2({_GY}, {_GX})) % 360) + 360) % 360 >= 180")
def galactic_footprint(s, d):
    lon, lat = S.galactic("RA", "DEC")
    return _cat(s, d).where(match.in_western("RA", "DEC")).select("meta_id", F.round(lon, 6).alias("l"), F.round(lat, 6).alias("b"))


@_query("first_positive", f"WITH {_REFS} SELECT ref_id, round(CASE WHEN Peak_flux > 0 THEN Peak_flux WHEN -Peak_flux > 0 THEN -Peak_flux END, 6) AS flux FROM cust")
def first_positive(s, d):
    return relation(s, d, CUSTOMERS).select("ref_id", F.round(X.first_positive("Peak_flux", -F.col("Peak_flux")), 6).alias("flux"))


@_query("highest_frequency", f"WITH {_SP} SELECT meta_id, CASE WHEN \"Total_flux_73MHz\" > 0 THEN '73MHz' WHEN \"Total_flux_55MHz\" > 0 THEN '55MHz' WHEN \"Total_flux_41MHz\" > 0 THEN '41MHz' ELSE '18MHz' END AS band, round(coalesce(\"Total_flux_73MHz\", \"Total_flux_55MHz\", \"Total_flux_41MHz\", \"Total_flux_18MHz\"), 6) AS flux FROM spec")
def highest_frequency(s, d):
    best = X.highest_frequency([(f"{m}MHz", m * 1e6, F.col(f"Total_flux_{m}MHz")) for m in _MHZ])
    return _spec(s, d).select("meta_id", best["band"].alias("band"), F.round(best["flux"], 6).alias("flux"))


@_query("milliquas_class", "SELECT p_partkey, nullif(regexp_extract(p_type, '[QABKNS]'), '') AS class FROM part")
def milliquas_class(s, d):
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", TX.milliquas_class(F.col("p_type")).alias("class"))


@_query("band_offsets", f"WITH {_D}, {_BANDS} SELECT fu.k, round((bl.RA - fu.RA) * cos(radians(fu.DEC)), 6) AS dra, round(bl.DEC - fu.DEC, 6) AS ddec, round(sqrt(pow((bl.RA - fu.RA) * cos(radians(fu.DEC)), 2) + pow(bl.DEC - fu.DEC, 2)), 6) AS sep FROM fu JOIN bl ON fu.k = bl.k")
def band_offsets(s, d):
    c = _bands(s, d)
    rows = c["Full"].select("k", "RA", "DEC").join(c["Blue"].select("k", F.col("RA").alias("ra2"), F.col("DEC").alias("dec2")), "k")
    x, y, r = S.offsets("RA", "DEC", "ra2", "dec2")
    return rows.select("k", F.round(x, 6).alias("dra"), F.round(y, 6).alias("ddec"), F.round(r, 6).alias("sep"))


@_query("query_filter", f"WITH {_C} SELECT meta_id FROM cat WHERE (S_Code = 'S' AND Peak_flux > 10) OR NOT (Maj < 0.2)")
def query_filter(s, d):
    return summary.select_rows(_cat(s, d), "(S_Code == 'S' & Peak_flux > 10) | ~(Maj < 0.2)").select("meta_id")


@_query("header_filter", f"WITH {_C} SELECT meta_id FROM cat WHERE Peak_flux >= 8.1 AND Maj <= 0.15")
def header_filter(s, d):
    rows = _cat(s, d)
    return rows.where(TX.header_filter(F.col("Peak_flux"), "8.1") & TX.header_filter(F.col("Maj"), "<=0.15")).select("meta_id")


@_query("id_selection", f"WITH {_C} SELECT meta_id, S_Code FROM cat WHERE meta_id IN (SELECT c_custkey FROM customer)")
def id_selection(s, d):
    ids = relation(s, d, CUSTOMERS).select(F.col("ref_id").alias("meta_id"))
    return summary.select_rows(_cat(s, d), ids).select("meta_id", "S_Code")


@_query("bag_union", f"WITH {_D}, {_C} SELECT det_id AS id, RA, NULL AS priority FROM (SELECT det_id, round(RA, 6) AS RA FROM det) UNION ALL SELECT meta_id, round(RA, 6), priority FROM cat")
def bag_union(s, d):
    return summary.union_all(_det(s, d).select(F.col("det_id").alias("id"), _r("RA")), _cat(s, d).select(F.col("meta_id").alias("id"), _r("RA"), "priority"))


@_query("numbered_rows", f"WITH {_C} SELECT meta_id, row_number() OVER (ORDER BY Peak_flux DESC, meta_id) - 1 AS n FROM cat")
def numbered_rows(s, d):
    from skyloom.plans.numbering import numbered

    return numbered(_cat(s, d), "n", F.desc("Peak_flux"), "meta_id").select("meta_id", "n")


@_query("map_residual_stats", f"WITH {_D} SELECT round(sqrt(avg(pow(Resid_Isl_mean - 0.05, 2))), 6) AS rms, round(avg(Resid_Isl_mean - 0.05), 6) AS mean, round(quantile_cont(abs(Resid_Isl_mean - 0.05), 0.95), 6) AS p95_abs, round(max(abs(Resid_Isl_mean - 0.05)), 6) AS peak_abs FROM det")
def map_residual_stats(s, d):
    from skyloom.operators import healpix

    out = healpix.map_stats(_det(s, d).select((F.col("Resid_Isl_mean") - 0.05).alias("value")))
    return out.select(*[_r(c) for c in out.columns])


@_query("shape_complete", f"WITH {_C} SELECT meta_id FROM cat WHERE Maj > 0 AND Min > 0 AND PA IS NOT NULL")
def shape_complete(s, d):
    return _cat(s, d).where(SEL.shape_complete()).select("meta_id")


@_query("flux_or_peak", f"WITH {_SP} SELECT meta_id, round(coalesce(\"Total_flux_41MHz\", \"Peak_flux_41MHz\"), 6) AS flux FROM spec")
def flux_or_peak(s, d):
    rows = _spec(s, d)
    return rows.select("meta_id", F.round(SEL.band_flux(rows.columns, "41MHz"), 6).alias("flux"))


@_query("above_elevation", f"WITH {_C} SELECT meta_id FROM cat, LATERAL (SELECT CAST(left(representative_lst, 2) AS DOUBLE) * 15 AS RA, {S.LATITUDE} AS DEC) z WHERE 90 - {separation('z', 'cat')} > 40")
def above_elevation(s, d):
    return _cat(s, d).where(SEL.above_elevation("RA", "DEC", "representative_lst", 40.0)).select("meta_id")


@_query("class_filter", "SELECT p_partkey FROM part WHERE upper(trim(p_brand)) IN ('BRAND#11', 'BRAND#12')")
def class_filter(s, d):
    return s.read.parquet(f"{d}/part.parquet").where(SEL.folded("p_brand", ["brand#11 ", "Brand#12"])).select("p_partkey")


@_query("sql_functions", f"WITH {_C}, q AS (SELECT 12.0 AS RA, 34.0 AS DEC) SELECT meta_id, round({separation('q', 'cat')}, 6) AS sep, quality_flag & 16 <> 0 AS bit4, bands_present LIKE '%Blue%' AS blue FROM cat, q")
def sql_functions(s, d):
    register(s)
    return s.sql("SELECT meta_id, round(sky_sep_deg(12D, 34D, RA, DEC), 6) AS sep, has_quality_bit(quality_flag, 4) AS bit4, has_band(bands_present, 'Blue') AS blue FROM {cat}", cat=_cat(s, d))


def _load() -> None:
    for module in ("measures", "readers", "passes"):
        importlib.import_module(f"skyloom.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
