"""Queries and operators on values at the edge: roundings, repeated ids."""

import duckdb
import numpy as np

from skyloom.functions import sphere as S
from skyloom.llm import simhash
from skyloom.operators import reliability
from skyloom.plans import catalog



def against_sql(spark, tmp_path, name, **tables):
    """Rows of a query and of its SQL over small tables, which are DuckDB's SQL."""
    con = duckdb.connect()
    for t, rows in tables.items():
        con.execute(f"COPY ({rows}) TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    out = catalog.queries()[name](spark, str(tmp_path))
    columns = ", ".join(f'"{c}"' for c in out.columns)
    want = con.execute(f"SELECT {columns} FROM ({catalog.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, out.collect()), key=str), sorted(want, key=str)


def test_position_labels_round_the_binary_value(spark):
    values = [(45 * m / 2**17, -45 * m / 2**17) for m in range(1, 200, 2)] + [(0.3515625, 1e-7), (200.1234565, -0.0), (5e-7, 359.9999995), (12.0000005, 89.9999999)]
    rows = spark.createDataFrame(values, "a double, b double").select("a", "b", S.position_label("a", "b").alias("l"), S.position_key("a", "b").alias("k"))
    for r in rows.collect():
        assert (r["l"], r["k"]) == ("%.6f %.6f" % (r["a"], r["b"]), "%.6f,%.6f" % (r["a"], r["b"]))
    odd = spark.createDataFrame([(None, 1.0), (float("nan"), float("-inf"))], "a double, b double").select(S.position_label("a", "b").alias("l"))
    assert [r["l"] for r in odd.collect()] == [None, "nan -inf"]


def test_vlssr_text_keeps_all_digits(spark, tmp_path):
    """A right ascension just below a half at the fourth place, found among larger keys."""
    got, want = against_sql(spark, tmp_path, "survey_vlssr", customer="SELECT unnest([406176, 705004, 200740, 457502, 1]) AS c_custkey, 711.56::DOUBLE AS c_acctbal, 'MACHINERY' AS c_mktsegment")
    assert got == want and len(got) == 5


_ORDERS = "SELECT k AS o_orderkey, k AS o_custkey, 1000.0::DOUBLE * k AS o_totalprice, '1-URGENT' AS o_orderpriority FROM range(1, 60) t(k)"


def _lines(number):
    """Each order has one part three times, in falling and rising quantities, and parts that come later."""
    return f"SELECT k AS l_orderkey, {number}::INT AS l_linenumber, 1000 + p // 3 AS l_partkey, k AS l_suppkey, CASE WHEN k % 2 = 0 THEN 9 - p ELSE 1 + p END::DOUBLE AS l_quantity FROM range(1, 50) t(k), range(6) u(p) ORDER BY p, k"


def test_xray_of_an_id_given_twice(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "unique_xray_joined", orders=_ORDERS, lineitem=_lines(2))
    assert got == want and len(got) == 59


def test_luminosity_of_an_id_given_twice(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "luminosity_pairs", orders=_ORDERS, lineitem=_lines(1))
    assert got == want and len(got) == 49


def test_outer_indices_name_each_column_a_few_times(spark):
    """The plan does not repeat the expressions of the fluxes in every test of them."""
    plan = catalog.queries()["outer_spectral_indices"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EXP(") < 60


def test_near_bright_by_rounds(spark):
    """However many are tried first, the ids are those of all pairs; a dense field makes no pair twice."""
    rng = np.random.default_rng(5)
    n = 700
    ra, dec, f = rng.random(n) * 6 - 3, rng.random(n) * 6 - 3, 10 ** rng.normal(0, 1.2, n)
    b = np.where(np.arange(n) % 50 == 0, 1.0, 0.05 + 0.1 * rng.random(n))
    f[::40] = f[0]
    rows = spark.createDataFrame([(i, float(ra[i] % 360), float(dec[i]), float(f[i]), float(b[i])) for i in range(n)] + [(n, None, 1.0, 1e9, 9.0)], "id long, RA double, DEC double, Peak_flux double, BMAJ double")
    x = np.stack([np.cos(np.radians(dec)) * np.cos(np.radians(ra)), np.cos(np.radians(dec)) * np.sin(np.radians(ra)), np.sin(np.radians(dec))], 1)
    sep = np.degrees(2 * np.arcsin(np.minimum(1, np.linalg.norm(x[:, None] - x, axis=2) / 2)))
    want = ((f[:, None] >= 30 * f) & (sep >= 2 * b[:, None]) & (sep <= 4 * b[:, None])).any(0)
    for first in (2, 1 << 15):
        got = [r["id"] for r in reliability.near_bright(rows, "id", first=first).collect()]
        assert sorted(got) == np.flatnonzero(want).tolist() and 50 < len(got) < n
    assert reliability.near_bright(rows.limit(0), "id").count() == 0


def test_all_pairs_within_two_bits_are_verified(spark):
    """A group larger than a cell that sends all its links, with equal fingerprints of unlike texts."""
    fps = [0b11 << 2 * (k % 12) if k % 3 else 1 << k % 5 for k in range(40)] + [(1 << 40) - 1]
    rows = [(k, 100 + k % 30, [fp, fp ^ (k % 2) * 0xFFFF0000]) for k, fp in enumerate(fps)]
    near = lambda a, b: any((x ^ y).bit_count() <= simhash.WIDE for x, y in zip(a[2], b[2])) and 5 * min(a[1], b[1]) >= 4 * max(a[1], b[1])
    for dense in (simhash.DENSE, 12):
        got = sorted(map(tuple, simhash.candidates(spark.createDataFrame(rows, "sig long, n int, fps array<long>"), dense=dense).collect()))
        assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[0] > b[0] and near(a, b))
