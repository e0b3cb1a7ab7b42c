"""Sky joins, clustering and fusion against brute force and hand-made cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import bands as B
from skyloom.functions import sphere as S
from skyloom.operators import detection, match, merge
from skyloom.operators.components import connected_components
from skyloom.operators.skyjoin import nearest, sky_neighbours, sky_pairs, within_field
from skyloom.plans.numbering import numbered


def _sep(a, b):
    (r1, d1), (r2, d2) = np.radians(a), np.radians(b)
    h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin((r2 - r1) / 2) ** 2
    return math.degrees(2 * math.asin(min(1, math.sqrt(h))))


def _points(n, seed, poles=True):
    rng = np.random.default_rng(seed)
    ra, dec = rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
    if poles:
        dec[: n // 4] = 90 - rng.uniform(0, 2, n // 4)
        dec[n // 4 : n // 3] = -90 + rng.uniform(0, 0.5, n // 3 - n // 4)
        ra[n // 3 : n // 2] = rng.choice([359.9, 0.05, 0.0, 359.99], n // 2 - n // 3)
    radius = rng.choice([0.0, 0.01, 0.3, 2.0, 7.0], n, p=[0.1, 0.4, 0.3, 0.15, 0.05])
    return [(int(i), float(a), float(d), float(r)) for i, (a, d, r) in enumerate(zip(ra, dec, radius))]


def test_pairs_equal_brute_force_at_poles_and_wrap(spark):
    a, b = _points(300, 1), _points(260, 2)
    cols = "id long, RA double, DEC double, BMAJ double"
    got = {(r[0], r[1]) for r in sky_pairs(spark.createDataFrame(a, cols), spark.createDataFrame(b, cols), "id", "id").collect()}
    want = {(x[0], y[0]) for x in a for y in b if _sep(x[1:3], y[1:3]) <= max(x[3], y[3])}
    assert got == want and len(want) > 500


def test_pairs_skip_missing_positions_and_keep_exact_radius(spark):
    cols = "id long, RA double, DEC double, BMAJ double"
    a = spark.createDataFrame([(1, 10.0, 0.0, 1.0), (2, None, 0.0, 1.0), (3, float("nan"), 1.0, 1.0), (4, 50.0, 0.0, None), (5, 50.0, 0.0, float("inf"))], cols)
    b = spark.createDataFrame([(7, 10.0, 0.5, 0.5), (8, 50.0, 0.0, 0.0), (9, 10.0, 1.2, 0.1)], cols)
    assert {(r[0], r[1]) for r in sky_pairs(a, b, "id", "id").collect()} == {(1, 7), (4, 8), (5, 8)}
    assert sky_pairs(a.limit(0), b, "id", "id").count() == 0


def test_neighbours_within_groups(spark):
    rows = spark.createDataFrame([(1, 10.0, 0.0, 0.1, 1), (2, 10.05, 0.0, 0.1, 1), (3, 10.02, 0.05, 0.1, 2)], "id long, RA double, DEC double, BMAJ double, g int")
    assert {(r[0], r[1]) for r in sky_neighbours(rows, "id").collect()} == {(1, 2), (1, 3), (2, 3)}
    assert {(r[0], r[1]) for r in sky_neighbours(rows, "id", other_group="g").collect()} == {(1, 3), (2, 3)}


def test_components_of_chain_star_and_nulls(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (None, 3), (200, 201), (201, 200)], "src long, dst long")
    got = dict(tuple(r) for r in connected_components(edges).collect())
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[201] == 200
    assert connected_components(edges.limit(0)).count() == 0


def _rows(spark, rows):
    cols = "det_id long, RA double, DEC double, BMAJ double, Peak_flux double, Total_flux double, lst_hour string"
    return spark.createDataFrame(rows, cols).withColumns({c: F.lit(1.0) for c in ("Maj", "Min", "PA", "E_Peak_flux", "E_Total_flux")})


def test_lst_merge_takes_the_highest_member_and_counts_hours(spark):
    ra = 30.0
    out = merge.lst_merge(_rows(spark, [(1, ra, 37.0, 0.5, 5.0, 5.0, "08h"), (2, ra + 0.1, 37.0, 0.5, 1.0, 1.0, "02h"), (3, ra + 0.5, 37.0, 0.5, 2.0, 2.0, "02h"), (4, 200.0, 0.0, 0.5, 9.0, 9.0, "01h"), (5, 10.0, None, 0.5, 1.0, 1.0, "01h")]), "det_id", "Full")
    rows = {r["root"]: r for r in out.collect()}
    assert set(rows) == {1, 4} and rows[1]["det_id"] == 2
    assert rows[1]["n_lst_contributions"] == 2 and rows[1]["lst_hours"] == "02h,08h" and rows[1]["n_members"] == 3
    assert rows[4]["cluster_jitter_rms_deg"] == 0.0 and rows[4]["Peak_flux_std"] is None


def test_lst_merge_without_hours_takes_the_brightest(spark):
    out = merge.lst_merge(_rows(spark, [(1, 30.0, 0.0, 0.5, 5.0, None, "healpix"), (2, 30.1, 0.0, 0.5, 1.0, 7.0, "02h")]), "det_id", "Full").collect()
    assert [r["det_id"] for r in out] == [2]


def test_tile_merge_keeps_neighbours_of_one_tile(spark):
    rows = _rows(spark, [(1, 30.0, 0.0, 0.5, 1.0, 1.0, None), (2, 30.2, 0.0, 0.5, 2.0, 2.0, None), (3, 30.9, 0.0, 0.5, 3.0, 3.0, None)]).withColumn("tile_ipix", F.when(F.col("det_id") < 3, 1).otherwise(2))
    assert {r["root"] for r in merge.tile_merge(rows.where("det_id < 3"), "det_id", "Full").collect()} == {1, 2}
    with pytest.raises(ValueError):
        merge.tile_merge(rows.withColumn("tile_ipix", F.lit(None).cast("double")), "det_id", "Full")


def _band(spark, rows):
    return _rows(spark, [(*r, None) for r in rows]).drop("lst_hour").withColumn("n_lst_contributions", F.lit(2).cast("long"))


def test_fusion_appends_grows_and_numbers(spark):
    full = _band(spark, [(1, 10.0, 0.0, 0.1, 5.0, 5.0), (2, 11.0, 0.0, 0.1, 9.0, 9.0)])
    blue = _band(spark, [(1, 10.05, 0.0, 0.3, 3.0, 3.0), (2, 50.0, 0.0, 0.1, 1.0, 1.0)])
    green = _band(spark, [(1, 10.25, 0.0, 0.1, 2.0, 2.0)])
    red = _band(spark, [])
    rows = {r["meta_id"]: r for r in merge.fuse({"Full": full, "Blue": blue, "Green": green, "Red": red}, "det_id").collect()}
    assert len(rows) == 3
    one = rows[0]
    assert one["bands_present"] == "Full,Blue,Green" and one["BMAJ_match"] == 0.3 and one["n_lst_contributions"] == 6
    assert one["n_assoc_Blue"] == 1 and one["n_confused_Blue"] == 1 and one["alpha_GB"] == pytest.approx(math.log(2 / 3) / math.log(B.FREQUENCY_HZ["Green"] / B.FREQUENCY_HZ["Blue"]))
    assert rows[2]["origin_band"] == "Blue" and rows[1]["alpha_RG"] is None


def test_subbands_take_positions_of_the_highest_frequency(spark):
    out = merge.fuse_subbands({"18MHz": _band(spark, [(1, 10.02, 0.0, 0.1, 5.0, 5.0), (2, 90.0, 1.0, 0.1, 1.0, 1.0)]), "82MHz": _band(spark, [(1, 10.0, 0.0, 0.1, 1.0, 1.0)])}, "det_id")
    rows = {r["meta_id"]: r for r in out.collect()}
    assert rows[0]["astrometry_band"] == "82MHz" and rows[0]["RA"] == 10.0 and rows[0]["bands_present"] == "18MHz,82MHz" and rows[1]["origin_band"] == "18MHz"


@pytest.mark.parametrize("max_rounds", [40, 2, 0])
def test_greedy_dedupe_equals_the_sequential_pass(spark, max_rounds):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.uniform(0, 3)), float(rng.uniform(0, 3)), 0.3, float(rng.integers(0, 40))) for i in range(150)]
    rows += [(200 + i, 100 + 0.2 * i, 0.0, 0.3, 100.0 - i) for i in range(30)]  # a gradient along a chain
    got = {r[0] for r in detection.brightest_first(spark.createDataFrame(rows, "id long, RA double, DEC double, BMAJ double, f double"), "id", "f", max_rounds=max_rounds).select("id").collect()}
    want, gone = set(), set()
    for r in sorted(rows, key=lambda r: (-r[4], r[0])):
        if r[0] not in gone:
            want.add(r[0])
            gone |= {q[0] for q in rows if _sep(r[1:3], q[1:3]) <= 0.3}
    assert got == want


def test_crossband_reasons(spark):
    cols = "id long, RA double, DEC double, BMAJ double, Peak_flux double"
    target = spark.createDataFrame([(1, 10.0, 0.0, 0.4, 1.0), (2, 20.0, 0.0, 0.4, 9.0)], cols)
    seeds = {"Blue": spark.createDataFrame([(1, 10.01, 0.0, 0.4, 10.0), (2, 20.01, 0.0, 0.4, 9.0), (3, 40.0, 0.0, 0.4, 5.0), (4, 20.35, 0.0, 0.4, 2.0)], cols)}
    got = {(r["action"], r["reason"], r["seed_id"]) for r in detection.crossband_actions(target, seeds, "id").collect()}
    assert got == {("replace", "phot_dip", 1), ("skip", "peak_ok", 2), ("insert", "no_beam_hit", 3), ("insert", "offset_only", 4)}


def test_radius_modes(spark):
    rows = spark.createDataFrame([(1, 0.5, None, None, None), (2, None, 0.01, None, None), (3, None, None, "LoDeSS", None), (4, None, None, None, 0.2)], "id long, BMAJ double, match_sigma_deg double, match_source string, cluster_jitter_rms_deg double")
    beam = [r[0] for r in rows.orderBy("id").select(match.Radius(default_arcsec=3600.0).column(rows.columns)).collect()]
    local = [r[0] for r in rows.orderBy("id").select(match.Radius("localization", scale=2.0, default_arcsec=36.0).column(rows.columns)).collect()]
    assert beam == [0.5, 1.0, 1.0, 1.0] and local == pytest.approx([0.02, 0.02, 5.0 / 3600, 0.4])
    with pytest.raises(ValueError):
        match.Radius("fixed")


def test_cascade_moves_on_only_where_one_to_one(spark):
    meta = spark.createDataFrame([(0, 10.0, 0.0, 0.1), (1, 20.0, 0.0, 0.1), (2, 20.05, 0.0, 0.1)], "meta_id long, RA double, DEC double, BMAJ_match double")
    vl = spark.createDataFrame([(5, 10.02, 0.0), (6, 20.02, 0.0)], "ref_id long, RA double, DEC double")
    got = {r["id"]: r for r in match.cascade(meta, {"VLSSR": vl}).collect()}
    assert got[0]["match_source"] == "VLSSR" and got[0]["RA"] == 10.02 and got[0]["BMAJ"] == pytest.approx(3 / 3600) and got[1]["match_source"] == "native"


def test_field_nearest_numbering(spark):
    rows = spark.createDataFrame([(i, float(i), 0.0) for i in range(50)], "id long, RA double, DEC double")
    assert [r["id"] for r in nearest(rows, 7.2, 0.0, 3, id="id").collect()] == [7, 8, 6]
    assert within_field(rows, 7.0, 0.0, 4.0, max_rows=2).count() == 2
    ties = spark.createDataFrame([(k, 7.0 + (-1) ** k, 0.0) for k in range(40)], "id long, RA double, DEC double")
    assert [r["id"] for r in within_field(ties, 7.0, 0.0, 4.0, max_rows=3, id="id").collect()] == [0, 1, 2]
    assert [r["n"] for r in numbered(rows, "n", F.desc("id")).orderBy(F.desc("id")).collect()] == list(range(50))


def test_positions_and_galactic(spark):
    assert S.parse_position("10:00:00 -20:30:00") == (150.0, -20.5) and S.parse_position("370 5") == (10.0, 5.0)
    lon, lat = S.galactic(F.lit(266.405), F.lit(-28.936))
    ra, dec = S.equatorial(F.lit(0.0), F.lit(90.0))
    row = spark.range(1).select(lon.alias("l"), lat.alias("b"), ra.alias("ra"), dec.alias("dec")).first()
    assert min(row["l"], 360 - row["l"]) < 0.02 and abs(row["b"]) < 0.02
    assert row["ra"] == pytest.approx(192.859, abs=0.01) and row["dec"] == pytest.approx(27.128, abs=0.01)
