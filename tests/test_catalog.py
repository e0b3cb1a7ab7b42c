"""Quality bits, spectra, outliers, pixels, sources, streaming, and every query against its SQL."""

import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skyloom.functions import bands as B
from skyloom.functions import flux as X
from skyloom.functions import quality as Q
from skyloom.functions import text as T
from skyloom.operators import beam, healpix, outliers, photometry, reliability, spectral, summary
from skyloom.plans import catalog
from skyloom.sources import fits, layout, surveys

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df):
    df = df[sorted(df.columns)]
    rows = df.map(lambda x: round(x, 9) if isinstance(x, float) else x).astype(str)
    return rows.sort_values(list(rows.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    got, want = canonical(catalog.queries()[name](spark, SF).toPandas()), canonical(duck.sql(catalog.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and got.shape == want.shape
    assert got.equals(want), got[(got != want).any(axis=1)].head()


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_masks():
    assert Q.mask_of(Q.CORE_CLEAN) == 495843 and Q.mask_of(Q.OR_HESL) == 4595 and Q.decode(5) == ["HAS_NAN", "SINGLE_LST"]
    with pytest.raises(ValueError):
        Q.mask_of(["nope"])


def test_bits_are_soft(spark):
    rows = spark.createDataFrame([(0, 10.0, 1.0, 5.0, "Full")], "meta_id long, RA double, DEC double, Peak_flux double, bands_present string")
    bits = reliability.simple_bits(rows.columns)
    row = rows.select(Q.packed(bits).alias("q")).first()
    assert Q.decode(row["q"]) == ["SINGLE_UNIQUE_BAND"]
    assert reliability.assign_quality(rows).count() == 1


def _numpy_fit(nu, s, e, nu0=55e6):
    x, y = np.log(np.array(nu) / nu0), np.log(s)
    ok = e is not None and np.all(np.isfinite(e)) and np.all(np.array(e) > 0)
    w = (np.array(s) / e) ** 2 if ok else np.ones(len(x))
    out = []
    for k in range(2, min(4, len(x)) + 1):
        d = np.vander(x, k, increasing=True)
        c = np.linalg.lstsq(d * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        chi = float(((y - d @ c) ** 2 * w).sum())
        out.append((k, c, chi / (len(x) - k) if len(x) > k else math.nan))
    return out


def test_fits_equal_numpy_and_choose_the_simplest(spark):
    bands = B.SUBBANDS[::2]
    rng = np.random.default_rng(4)
    rows, truth = [], {}
    for i in range(30):
        nu = [B.frequency_hz(b) for b in bands]
        x = np.log(np.array(nu) / 55e6)
        s = np.exp(1.0 - 0.7 * x + (0.5 * x**2 if i % 2 else 0) + rng.normal(0, 0.01, len(x)))
        truth[i] = (nu, s, s * 0.01)
        rows.append((i, *map(float, s), *map(float, s * 0.01)))
    cols = "meta_id long, " + ", ".join(f"Total_flux_{b} double" for b in bands) + ", " + ", ".join(f"E_Total_flux_{b} double" for b in bands)
    out = {r["meta_id"]: r for r in spectral.fit(spark.createDataFrame(rows, cols), bands, unconfused_only=False).collect()}
    for i, (nu, s, e) in truth.items():
        fits_ = _numpy_fit(nu, s, e)
        best = min(c for _, _, c in fits_ if math.isfinite(c))
        k, c, chi = next(f for f in fits_ if math.isfinite(f[2]) and f[2] <= best + max(0.05, 0.1 * best))
        assert out[i]["spec_model_n_terms"] == k and out[i]["spec_model_chi2_red"] == pytest.approx(chi, rel=1e-6)
        assert [out[i][f"spec_model_a{j}"] for j in range(k)] == pytest.approx(list(c), abs=1e-8)


def test_fit_needs_two_fluxes_and_ignores_bad_errors(spark):
    df = spark.createDataFrame([(0, 1.0, None, 0.1), (1, 1.0, 2.0, None), (2, -1.0, float("nan"), 0.1)], "meta_id long, Total_flux_18MHz double, Total_flux_82MHz double, E_Total_flux_18MHz double")
    out = {r["meta_id"]: r for r in spectral.fit(df, ["18MHz", "82MHz"], unconfused_only=False).collect()}
    assert [out[i]["spec_model_n_terms"] for i in range(3)] == [0, 2, 0]
    assert out[1]["spec_model_a1"] == pytest.approx(math.log(2) / math.log(82 / 18)) and out[0]["spec_model_a0"] is None


def test_mahalanobis_equals_numpy(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 3)) @ np.array([[1, 0.4, 0], [0, 1, 0.2], [0, 0, 1]])
    v[0] = 20
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)] + [(400, None, 1.0, 1.0)], "id long, a double, b double, c double")
    out = {r["id"]: r for r in outliers.mahalanobis(df, ["a", "b", "c"], 99.5).collect()}
    d = v - v.mean(0)
    want = np.einsum("ni,ij,nj->n", d, np.linalg.inv(np.cov(v.T)), d)
    assert [out[i]["mahalanobis_d2"] for i in range(400)] == pytest.approx(list(want), rel=1e-8)
    assert out[0]["is_outlier"] and out[400]["mahalanobis_d2"] is None
    assert outliers.mahalanobis(df, ["a", "b", "c"], impute=True).where("id = 400").first()["mahalanobis_d2"] is not None
    with pytest.raises(ValueError):
        outliers.moments(df.limit(2), ["a", "b", "c"])
    codes = outliers.factorized(spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "t string"), "t", "k").collect()
    assert sorted((r["t"] or "", r["k"]) for r in codes) == [("", None), ("a", 0.0), ("b", 1.0), ("b", 1.0)]


@pytest.mark.parametrize("nside", [1, 2, 8, 64])
def test_pixels_round_trip_and_have_equal_area(spark, nside):
    n = 12 * nside * nside
    ra, dec = healpix.centre(F.col("id"), nside)
    out = spark.range(n).select("id", ra.alias("ra"), dec.alias("dec")).select("id", healpix.pixel("ra", "dec", nside).alias("p"))
    assert out.where("id <> p").count() == 0
    rings = spark.range(n).select(healpix.ring_to_nest(F.col("id"), nside).alias("p"))
    assert rings.distinct().count() == n


def test_painting(spark):
    df = spark.createDataFrame([(10.0, 20.0, 2.0, 3.0, 2.0, 30.0)], "RA double, DEC double, Peak_flux double, Maj double, Min double, PA double")
    m = healpix.paint_gaussians(df, 64).orderBy(F.desc("value")).collect()
    assert 1.7 < m[0]["value"] <= 2.0 and len(m) > 5
    assert healpix.paint_points(df, 64, "Peak_flux").first()["value"] == 2.0
    out = healpix.residual_map(spark.createDataFrame([(1, 5.0), (2, 1.0)], "ipix long, value double"), spark.createDataFrame([(1, 2.0), (2, 9.0)], "ipix long, value double")).collect()
    assert {r["ipix"]: r["value"] for r in out} == {1: 3.0, 2: 0.0}


def test_every_source_is_painted(spark):
    schema = "RA double, DEC double, Peak_flux double, Maj double, Min double, PA double"
    axes = [(None, None), (0.0, 0.0), (-0.1, 0.05), (0.1, None), (float("nan"), 0.1), (0.5, 0.9)]
    side = np.degrees(np.sqrt(4 * np.pi / (12 * 64 * 64)))
    pixels = [tuple(r) for r in spark.range(12 * 64 * 64).select("id", *healpix.centre(F.col("id"), 64)).collect()]
    ids, ra, dec = (np.array(x) for x in zip(*pixels))
    u, d, near = (ra - 100.0) * np.cos(np.radians(20.0)), dec - 20.0, np.cos(np.radians(dec)) * np.cos(np.radians(20.0)) * np.cos(np.radians(ra - 100.0)) + np.sin(np.radians(dec)) * np.sin(np.radians(20.0))
    sigma = side / (2 * np.sqrt(2 * np.log(2)))
    inside = np.degrees(np.arccos(np.clip(near, -1, 1))) <= max(5 * sigma, 2 * side)
    value = 2.0 * np.exp(-0.5 * (u**2 + d**2) / sigma**2)
    rows = [(100.0, 20.0, 2.0, a, b, None) for a, b in axes] + [(100.0, 20.0, 0.0, 1.0, 1.0, None), (100.0, 20.0, None, 1.0, 1.0, None)]
    got = {r["ipix"]: r["value"] for r in healpix.paint_gaussians(spark.createDataFrame(rows, schema), 64).collect()}
    assert set(got) == set(ids[inside].tolist())
    assert all(abs(got[i] - len(axes) * v) < 1e-9 for i, v in zip(ids[inside].tolist(), value[inside]))


def test_gaussian_fit_recovers_a_source(spark):
    y, x = np.mgrid[:31, :31]
    image = photometry._model(np.array([3.0, 14.6, 15.3, 2.2, 1.6, 0.4, 0.1]), x, y)
    rows = spark.createDataFrame([(0, [float(v) for v in image.ravel()], 31), (1, None, 31)], "id long, pix array<double>, w int")
    start = F.struct(F.lit(2.5).alias("peak"), F.lit(15.0).alias("x"), F.lit(15.0).alias("y"), F.lit(2.0).alias("sx"), F.lit(1.5).alias("sy"), F.lit(0.3).alias("theta"))
    out = {r["id"]: r["f"] for r in rows.select("id", photometry.fit_cutouts(F.col("pix"), F.col("w"), start).alias("f")).collect()}
    assert out[0]["ok"] and out[0]["peak"] == pytest.approx(3.0, rel=1e-4) and out[0]["x"] == pytest.approx(14.6, abs=1e-3) and not out[1]["ok"]


def test_beam_chain(spark):
    cols = "Peak_flux_VLSSR double, Total_flux_55MHz double, Peak_flux_55MHz double, Total_flux_73MHz double, Peak_flux_73MHz double"
    df = spark.createDataFrame([(1.0, 2.0, 1.0, 4.0, 1.0)] * 3, cols)
    rows, steps = beam.bootstrap_alpha(df, 1.5, unique=False)
    assert {r["band"]: r["alpha"] for r in rows} == pytest.approx({"73MHz": 3.0, "55MHz": 3.0 / math.sqrt(0.5)}) and steps[0]["direction"] == "down"


def test_luminosity_distance(spark):
    row = spark.range(1).select(X.luminosity_distance(F.lit(0.1)).alias("d"), X.luminosity_distance(F.lit(1.0)).alias("e"), X.luminosity_distance(F.lit(-1.0)).alias("n")).first()
    assert row["d"] == pytest.approx(475.8, rel=2e-3) and row["e"] == pytest.approx(6791, rel=3e-3) and row["n"] is None


def test_text_helpers(spark):
    assert T.query_expression("a == 'x=y' & ~(b > 1 | c in ['p','q'])") == "a = 'x=y'  and   not (b > 1  or  c in ('p','q'))"
    assert T.header_filter(F.lit(1), ">") is None and B.color("18MHz") == B.COLORS["Red"] and B.seed_band(["18MHz", "82MHz"]) == "82MHz"
    row = spark.range(1).select(T.first_id(F.lit("nan"), F.lit(" "), F.lit("x")).alias("i"), B.add_bands(F.lit("Red,Full"), "Blue").alias("b")).first()
    assert row["i"] == "x" and row["b"] == "Full,Blue,Red"


def test_layout_round_trip(spark, tmp_path):
    lay = layout.Layout(str(tmp_path))
    df = spark.createDataFrame([(10.0, 1.0, "Full", "01h", 1), (11.0, 1.0, "Blue", "02h", 2)], "RA double, DEC double, band string, lst_hour string, extra int")
    lay.write(df, "sources")
    lay.write(df.where("band = 'Blue'").withColumn("RA", F.lit(99.0)), "sources")
    got = {r["band"]: r["RA"] for r in lay.read(spark, "sources").collect()}
    assert got == {"Full": 10.0, "Blue": 99.0} and lay.read(spark, "sources", band="Full").count() == 1
    assert lay.drop_columns(spark, "sources", ["extra"], dry_run=True) == ["extra"] and "extra" in lay.read(spark, "sources").columns
    lay.drop_columns(spark, "sources", ["extra"])
    assert "extra" not in lay.read(spark, "sources").columns
    slots = spark.createDataFrame([("Full", "01h"), ("Full", "09h")], "band string, lst_hour string")
    assert [r["lst_hour"] for r in lay.missing_slots(spark, slots).collect()] == ["09h"]
    with pytest.raises(ValueError):
        layout.validate(df)
    with pytest.raises(ValueError):
        layout.parquet_path("a.csv")


def test_replacing_associations_on_disk(spark, tmp_path):
    from skyloom.operators.associations import write_catalog

    rows = spark.createDataFrame([(1, "a")], "meta_id long, ref_id string")
    path = str(tmp_path / "assoc")
    write_catalog(path, rows, "RFC")
    write_catalog(path, rows, "NVSS")
    write_catalog(path, rows.limit(0), "RFC")
    assert [r["catalog"] for r in spark.read.parquet(path).collect()] == ["NVSS"]


def test_file_names(spark):
    names = ["/d/01h/Blue_I_deep_20240101_LST1h_t0003.fits", "/d/03h_18MHz/18MHz_I_x.fits", "/d/x.fits", "/d/Red_I_LST12h.fits"]
    got = {r["path"]: (r["lst_hour"], r["band"], r["time_key"]) for r in layout.parsed_names(spark.createDataFrame([(n,) for n in names], "path string")).collect()}
    assert got == {names[0]: ("01h", "Blue", "20240101_01h_t0003"), names[1]: ("03h", "18MHz", None), names[3]: ("12h", "Red", None)}
    kinds = {r["file"]: (r["kind"], r["band"]) for r in layout.classified(spark.createDataFrame([("metacatalog_lst_Full.parquet",), ("sources_01h_Red.parquet",), ("metacatalog.parquet",), ("z.parquet",)], "file string")).collect()}
    assert kinds["metacatalog_lst_Full.parquet"] == ("lst_merged", "Full") and kinds["sources_01h_Red.parquet"] == ("sources", "Red") and kinds["z.parquet"][0] == "other"


def test_fits_tables(spark, tmp_path):
    p = str(tmp_path / "t.fits")
    fits.write_table(p, {"Name": ["a", "bb"], "RA": [1.5, np.nan], "DEC": [2.0, 3.0], "n": [7, 8], "ok": [True, False]})
    rows = fits.read_table(spark, p).orderBy("n").collect()
    assert [tuple(r) for r in rows] == [("a", 1.5, 2.0, 7, True), ("bb", None, 3.0, 8, False)]
    assert fits.read_table(spark, p, ["n"]).columns == ["n"]
    with pytest.raises(ValueError):
        fits.read_table(spark, p, ["zzz"])
    assert surveys.lodess(spark, p).count() == 1


def test_fits_tables_are_read_by_ranges_of_rows(spark, tmp_path):
    p = str(tmp_path / "t.fits")
    n = np.arange(5000)
    fits.write_table(p, {"n": n, "x": n / 7, "s": np.char.add("k", n.astype(str)), "odd": n % 2 == 1})
    rows = fits.read_table(spark, p, ["n", "s", "odd"], range_bytes=1000)
    assert rows.rdd.getNumPartitions() > 100
    assert sorted(map(tuple, rows.collect())) == [(int(k), f"k{k}", bool(k % 2)) for k in n]
    (tmp_path / "many").mkdir()
    for k in range(3):  # a folder comes through the whole-file reader
        fits.write_table(str(tmp_path / "many" / f"{k}.fits"), {"n": n[k * 10 : k * 10 + 10]})
    assert sorted(r["n"] for r in fits.read_table(spark, str(tmp_path / "many")).collect()) == list(range(30))
    with pytest.raises(FileNotFoundError):
        fits.read_table(spark, str(tmp_path / "none.fits"))


def _line(places, values):
    out = [" "] * 900
    for k, v in values.items():
        a, b = places[k]
        out[a - 1 : b] = list(str(v).rjust(b - a + 1)[: b - a + 1])
    return "".join(out)


def test_text_surveys(spark, tmp_path):
    (tmp_path / "v.txt").write_text('RA(2000) DEC(2000) "PEAK INT"\n 10.5 20.5 1.25\n nan 1 2\n')
    got = surveys.vlssr(spark, str(tmp_path / "v.txt")).collect()
    assert len(got) == 1 and got[0]["Peak_flux"] == 1.25 and got[0]["BMAJ"] == pytest.approx(80 / 3600)
    line = _line(surveys.RFC, {"Name": "J0001+1234", "Comnam": "x", "RAh": "01", "RAm": "30", "RAs": "00.0", "DE": "-", "DEd": "10", "DEm": "30", "DEs": "0.0", "eRA": "1.0", "eDE": "2.0", "FsS": "-9.99", "FsX": "0.5"})
    (tmp_path / "rfc.txt").write_text("# head\n" + line + "\n")
    (tmp_path / "x.txt").write_text(_line(surveys.RFC_COMPANION, {"Name": "J0001+1234", "z": "0.5", "type": "QSO"}) + "\n")
    row = surveys.rfc(spark, str(tmp_path / "rfc.txt"), str(tmp_path / "x.txt")).first()
    assert (row["RA"], row["DEC"], row["FsS"], row["FsX"], row["type"], row["z"]) == (22.5, -10.5, None, 0.5, "QSO", 0.5)
    (tmp_path / "f.dat").write_text(_line(surveys.FREUND, {"name_2rxs": "2RXS J1", "ePos": "6.0", "RA": "10.0", "DEC": "5.0", "pstellar": "0.9", "subdwarf": "False"}) + "\n")
    row = surveys.freund2022(spark, str(tmp_path / "f.dat")).first()
    assert row["E_RA"] == pytest.approx(6 / 3600 / math.sqrt(2)) and row["subdwarf"] is False
    (tmp_path / "w.csv").write_text("Component_name,RA,DEC,E_RA,E_DEC,Peak_flux,Total_flux,Maj,Min,PA,Duplicate_flag,Quality_flag,S_Code\na,1,2,0.1,0.1,1000,2000,3600,3600,0,0,0,S\nb,1,2,0.1,0.1,1,1,1,1,0,2,0,S\n")
    row = surveys.vlass(spark, str(tmp_path / "w.csv")).collect()
    assert len(row) == 1 and row[0]["Peak_flux"] == 1.0 and row[0]["Maj"] == 1.0


def test_fits_surveys(spark, tmp_path):
    p = str(tmp_path / "m.fits")
    fits.write_table(p, {"RAdeg": [1.0, 2.0], "DEdeg": [3.0, 4.0], "Name": ["a", "b"], "Type": ["QR2X", "A"], "z": [0.5, np.nan], "rName": ["z1", "z2"], "RName": ["r1", ""]})
    rows = {r["Name"]: r for r in surveys.milliquas(spark, p).collect()}
    assert rows["a"]["class_primary"] == "Q" and rows["a"]["has_double_lobe"] and rows["b"]["has_radio"] is False and rows["a"]["radio_RName"] == "r1" and rows["b"]["z"] is None
    fits.write_table(p, {"RAdeg": [1.0], "DEdeg": [3.0], "RXGCC": [7], "R500": [0.0], "Ext": [6.0], "Class": ["S "]})
    row = surveys.xu2022(spark, p).first()
    assert row["BMAJ"] == pytest.approx(0.1) and row["Class"] == "S"
    fits.write_table(p, {"RA": [1.0], "DEC": [3.0], "POS_ERR": [2.0], "class_gal_exgal": [1], "is_blazar_in_simbad": [True], "other": [1.0]})
    row = surveys.erass3(spark, p, ["RA", "DEC", "POS_ERR", "class_gal_exgal", "is_blazar_in_simbad"]).first()
    assert row["class_gal_exgal"] == "blazar" and row["E_RA"] == pytest.approx(2 / 3600 / math.sqrt(2)) and "other" not in row.asDict()
    fits.write_table(p, {"Name": ["G1"], "RAJ2000": [1.0], "DEJ2000": [3.0], "err_RAJ2000": [3.0], "err_DEJ2000": [3.0], "peak_flux_wide": [1.0], "int_flux_wide": [2.0], "int_flux_076": [5.0], "psf_a_wide": [180.0], "psf_b_wide": [120.0]})
    row = surveys.gleam(spark, p).first()
    assert row["Total_flux_GLEAM76"] == 5.0 and row["BMAJ"] == pytest.approx(0.05) and row["E_RA"] == pytest.approx(3 / 3600)
    fits.write_table(p, {"objname": ["g"], "ra": [1.0], "dec": [2.0], "z": [0.1]})
    assert surveys.nedlvs(spark, p).first()["RA"] == 1.0
    line = _line(surveys.NVSS | {"e_RAs": (55, 59), "e_DEs": (61, 64), "S14": (66, 73)}, {"RAh": "10", "RAm": "00", "RAs": "00.00", "DE": "+", "DEd": "60", "DEm": "00", "DEs": "00.0", "e_RAs": "0.10", "e_DEs": "0.5", "S14": "500.0"})
    (tmp_path / "nvss.dat").write_text(line + "\n")
    row = surveys.nvss(spark, str(tmp_path / "nvss.dat")).first()
    assert (row["RA"], row["DEC"], row["Peak_intensity"]) == (150.0, 60.0, 0.5) and row["E_RA"] == pytest.approx(0.1 * 15 * 0.5 / 3600)
    line = _line(surveys.TWORXS, {"name": "2RXS J1", "ExiML": "9.5", "RA": "10.0", "DEC": "5.0", "e_Xima": "0.3", "e_Yima": "0.4"})
    (tmp_path / "x.dat").write_text(line + "\n")
    assert surveys.tworxs(spark, str(tmp_path / "x.dat")).first()["POS_ERR"] == pytest.approx(22.5)


def test_votable(spark, tmp_path):
    (tmp_path / "t.vot").write_text('<VOTABLE><RESOURCE><TABLE><FIELD name="id" datatype="int"/><FIELD name="tevcat_name" datatype="char"/><FIELD name="ra" datatype="double"/><FIELD name="dec" datatype="double"/><DATA><TABLEDATA><TR><TD>1</TD><TD>TeV J1</TD><TD>10.0</TD><TD>-5.0</TD></TR><TR><TD>2</TD><TD>TeV J2</TD><TD>20.0</TD><TD>5.0</TD></TR></TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>')
    rows = surveys.tevcat(spark, str(tmp_path / "t.vot")).orderBy("RA").collect()
    assert [(r["tevcat_name"], r["RA"], r["DEC"]) for r in rows] == [("TeV J1", 10.0, -5.0), ("TeV J2", 20.0, 5.0)] and rows[0]["BMAJ"] == pytest.approx(0.05)


def test_scale_sidecar(spark, tmp_path):
    path = str(tmp_path / "beam_scale.json")
    beam.write_scale(spark, path, {"73MHz": {"alpha": 1.2, "kappa": 0.01}, "18MHz": 1.1})
    assert beam.read_scale(spark, path) == json.loads((tmp_path / "beam_scale.json").read_text())
    df = spark.createDataFrame([("73MHz",), ("18MHz",), ("x",)], "band string")
    assert [r[0] for r in df.select(beam.scale_literal(beam.read_scale(spark, path))).collect()] == [1.2, 1.1, 1.0]


def test_streamed_detections_are_merged(spark, tmp_path):
    from skyloom.streaming import ingest

    schema = "det_id long, RA double, DEC double, BMAJ double, Peak_flux double, Total_flux double, band string, lst_hour string"
    rows = [(1, 30.0, 37.0, 0.5, 1.0, 1.0, "Full", "02h"), (2, 30.1, 37.0, 0.5, 2.0, 2.0, "Full", "03h")]
    incoming, lay = str(tmp_path / "in"), layout.Layout(str(tmp_path / "cat"))
    for r in rows:
        spark.createDataFrame([r], schema).write.mode("append").parquet(incoming)
        ingest.start(spark, incoming, lay, str(tmp_path / "cp"), spark.createDataFrame([], schema).schema).awaitTermination()
    out = lay.read(spark, "lst_merged").collect()
    assert len(out) == 1 and out[0]["n_lst_contributions"] == 2


def test_streamed_detections_of_one_hour_are_all_kept(spark, tmp_path):
    """Batches of one (band, hour), a chain that a later batch closes, and a batch that comes again."""
    from skyloom.operators.merge import lst_merge
    from skyloom.streaming import ingest

    schema = "det_id long, RA double, DEC double, BMAJ double, Peak_flux double, Total_flux double, band string, lst_hour string"
    batches = [
        [(1, 30.0, 37.0, 0.05, 1.0, 1.0, "Full", "01h"), (5, 80.0, 10.0, 0.05, 1.0, 1.0, "Full", "01h")],
        [(2, 30.08, 37.0, 0.05, 2.0, 2.0, "Full", "01h"), (7, 80.0, 10.0, 0.05, 3.0, 3.0, "Red", "01h")],
        [(3, 30.04, 37.0, 0.05, 9.0, 9.0, "Full", "01h"), (4, 200.0, -20.0, 0.05, 1.0, 1.0, "Full", "02h")],
    ]
    lay, frames = layout.Layout(str(tmp_path / "cat")), [spark.createDataFrame(b, schema) for b in batches]
    step = ingest.merge_batch(lay)
    for n in (0, 1, 1, 2, 0):
        step(frames[n], n)
    every = [r for b in batches for r in b]
    assert sorted(r["det_id"] for r in lay.read(spark, "sources").collect()) == sorted(r[0] for r in every)
    for band in ("Full", "Red"):
        got = sorted((r["det_id"], r["n_members"], r["lst_hours"], round(r["cluster_jitter_rms_deg"], 9)) for r in lay.read(spark, "lst_merged", band=band).collect())
        whole = lst_merge(spark.createDataFrame([r for r in every if r[6] == band], schema), "det_id", band)
        assert got == sorted((r["det_id"], r["n_members"], r["lst_hours"], round(r["cluster_jitter_rms_deg"], 9)) for r in whole.collect())
    assert {r["det_id"]: r["root"] for r in lay.read(spark, "members", band="Full").collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_an_interrupted_rewrite_loses_nothing(spark, tmp_path):
    lay = layout.Layout(str(tmp_path))
    df = spark.createDataFrame([(10.0, "Full", "01h", 1.0)], "RA double, band string, lst_hour string, E_RA double")
    lay.write(df, "sources")
    (tmp_path / "sources").rename(tmp_path / "sources.old")
    assert lay.drop_columns(spark, "sources") == ["E_RA"] and lay.read(spark, "sources").first()["RA"] == 10.0
    assert sorted(p.name for p in tmp_path.iterdir()) == ["sources"]


def test_images_and_sidecars(spark, tmp_path):
    import pandas as pd

    from skyloom.sources import images, sidecar

    for name in ("Blue_I_LST01h.fits", "Red_I_LST02h.fits"):
        (tmp_path / name).write_bytes(name.encode())

    def detector(path, content):
        if "Red" in path:
            raise ValueError("bad image")
        return pd.DataFrame({"RA": [float(len(content))], "DEC": [1.0]})

    out = images.labelled(images.detect(spark, str(tmp_path), detector, "RA double, DEC double")).collect()
    assert {(r["band"], r["lst_hour"], r["RA"], r["status"]) for r in out} == {("Blue", "01h", 18.0, "ok"), ("Red", "02h", None, "failed: bad image")}
    path = str(tmp_path / "prefs.json")
    assert sidecar.load_columns(spark, path) == []
    sidecar.save_columns(spark, path, ["RA", "x", "RA"])
    assert sidecar.load_columns(spark, path, ["RA", "DEC"]) == ["RA"]


def test_apply_crossband(spark):
    from skyloom.operators.detection import apply_crossband

    target = spark.createDataFrame([(1, 10.0, 0.0, 1.0, 1.0), (2, 20.0, 0.0, 5.0, 5.0)], "id long, RA double, DEC double, Peak_flux double, Total_flux double")
    actions = spark.createDataFrame([("replace", 1, "Blue", 7, 9.0), ("insert", None, "Red", 8, 3.0), ("insert", None, "Red", 9, 2.0), ("skip", 2, "Red", 3, 1.0)], "action string, target_id long, seed_band string, seed_id long, seed_peak double")
    fit = lambda a: a.withColumns({"ok": F.lit(True), "forced_Peak": F.col("seed_peak"), "forced_Total": F.col("seed_peak") * 1.05, "forced_RA": F.lit(30.0), "forced_DEC": F.lit(1.0), "forced_resid_rms": F.when(F.col("seed_id") == 9, 50.0).otherwise(0.05)})
    out = {r["id"]: r for r in apply_crossband(target, actions, "id", fit).collect()}
    assert set(out) == {1, 2, -2} and out[1]["Peak_flux"] == 9.0 and out[1]["forced_mode"] == "replace" and out[-2]["Total_flux"] == pytest.approx(3.15) and out[2]["forced"] is False


def test_selection(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "meta_id long, x double")
    assert summary.select_rows(df, [2]).count() == 1 and summary.select_rows(df, "x == 2.0").count() == 1
    with pytest.raises(KeyError):
        summary.select_rows(df, [2, 5])
    assert summary.in_range(df, {"x": (2.5, None)}).count() == 1
