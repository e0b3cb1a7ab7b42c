"""The driver's tables seen as sky catalogues, in SQL that two engines read alike.

Positions come from two multipliers whose multiples fill a square evenly. Text that is
valid in both dialects is shared: it defines the inputs; results are computed apart.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()

_U, _V = "((CAST({k} AS DOUBLE) * 0.7548776662466927e0) % 1e0)", "((CAST({k} AS DOUBLE) * 0.5698402909980532e0) % 1e0)"


def _position(k: str, dra: str = "0e0", ddec: str = "0e0") -> str:
    u, v = _U.format(k=k), _V.format(k=k)
    return f"(({u} * 360e0) + {dra} + 360e0) % 360e0 AS RA, degrees(asin(1.8e0 * {v} - 0.9e0)) + {ddec} AS DEC"


DETECTIONS = f"""
SELECT k * 8 + j AS det_id, k, j, {_position("k", "0.004e0 * (j - 4)", "0.003e0 * ((j * 3) % 7 - 3)")},
  0.014e0 + 0.003e0 * (k % 3) AS BMAJ, price / 1e3 AS Peak_flux, price / 1e3 * (1e0 + tax) AS Total_flux, 5e-5 * price AS E_Peak_flux, 5e-5 * price AS E_Total_flux,
  CASE j % 4 WHEN 0 THEN 'Full' WHEN 1 THEN 'Blue' WHEN 2 THEN 'Green' ELSE 'Red' END AS band, concat(lpad(CAST(j * 3 AS VARCHAR(8)), 2, '0'), 'h') AS lst_hour,
  k % 5 AS tile_ipix, CASE WHEN j % 3 = 0 THEN 'M' ELSE 'S' END AS S_Code, discount * 2e0 AS Resid_Isl_rms, discount AS Resid_Isl_mean
FROM (SELECT CAST(l_orderkey AS BIGINT) AS k, CAST(l_linenumber AS BIGINT) AS j, max(l_extendedprice) AS price, max(l_tax) AS tax, max(l_discount) AS discount FROM lineitem GROUP BY l_orderkey, l_linenumber) g
"""

CATALOG = f"""
SELECT CAST(o_orderkey AS BIGINT) AS meta_id, {_position("o_orderkey")}, o_totalprice / 1e4 AS Peak_flux, o_totalprice / 1e4 * (0.7e0 + 0.1e0 * (o_custkey % 9)) AS Total_flux,
  o_totalprice / 4e5 AS E_Peak_flux, o_totalprice / 3e5 AS E_Total_flux, 0.05e0 + 0.01e0 * (o_orderkey % 4) AS BMAJ_match,
  0.03e0 * (1 + o_custkey % 8) AS Maj, 0.02e0 * (1 + o_custkey % 3) AS Min, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE 10e0 END AS PA,
  (o_custkey % 100) / 80e0 AS Resid_Isl_rms, (o_custkey % 37) / 40e0 - 0.3e0 AS Resid_Isl_mean, 0.002e0 * (o_custkey % 16) AS cluster_jitter_rms_deg,
  CAST(1 + o_orderkey % 3 AS BIGINT) AS n_lst_contributions, concat(lpad(CAST(o_orderkey % 24 AS VARCHAR(8)), 2, '0'), 'h') AS representative_lst,
  CASE o_custkey % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'M' ELSE 'C' END AS S_Code, 'Full' AS origin_band,
  CASE o_orderkey % 4 WHEN 0 THEN 'Full' WHEN 1 THEN 'Full,Blue' WHEN 2 THEN 'Full,Blue,Red' ELSE 'Full,Red' END AS bands_present,
  CAST(o_custkey % 3 AS BIGINT) AS n_assoc_Blue, CAST(1 + o_custkey % 2 AS BIGINT) AS n_confused_Blue, CAST(1 + o_orderkey % 2 AS BIGINT) AS n_assoc_Red, CAST(1 AS BIGINT) AS n_confused_Red,
  o_totalprice / 1.1e4 AS Total_flux_Blue, o_totalprice / 9e3 * (1e0 + 0.1e0 * (o_custkey % 5)) AS Total_flux_Red, o_totalprice / 2e5 AS E_Total_flux_Blue, o_totalprice / 2e5 AS E_Total_flux_Red,
  o_totalprice / 1.2e4 AS Peak_flux_Blue, o_totalprice / 1e4 AS Peak_flux_Red, o_orderpriority AS priority, CAST((o_orderkey * 2654435761) % 1048576 AS BIGINT) AS quality_flag
FROM orders
"""

_SHIFT = "0.012e0 * ({k} % 5 - 2)", "0.009e0 * ({k} % 3 - 1)"
CUSTOMERS = f"SELECT CAST(c_custkey AS BIGINT) AS ref_id, {_position('c_custkey', *(s.format(k='c_custkey') for s in _SHIFT))}, 0.01e0 + 0.01e0 * (c_custkey % 3) AS BMAJ, 1e-3 * c_acctbal AS Peak_flux, 2e-3 * c_acctbal AS Total_flux, 0.1e0 AS E_Peak_flux, 0.1e0 AS E_Total_flux, 0.002e0 AS E_RA, 0.001e0 * (c_custkey % 4) AS E_DEC, c_mktsegment AS kind FROM customer"
PARTS = f"SELECT CAST(p_partkey AS BIGINT) AS ref_id, {_position('p_partkey', *(s.format(k='p_partkey') for s in _SHIFT))}, 0.02e0 AS BMAJ, p_retailprice / 1e3 AS Peak_flux, p_retailprice / 5e2 AS Total_flux, 0.1e0 AS E_Peak_flux, 0.1e0 AS E_Total_flux, 0.004e0 AS E_RA, 0.003e0 AS E_DEC, CAST(p_size AS DOUBLE) AS DET_LIKE_0, p_brand AS kind, p_type AS type FROM part"
SUPPLIERS = f"SELECT CAST(s_suppkey AS BIGINT) AS ref_id, {_position('s_suppkey', '0.001e0', '0.001e0')}, 0.03e0 AS BMAJ, s_acctbal / 1e3 AS Peak_flux, s_acctbal / 1e3 AS Total_flux, 0.1e0 AS E_Peak_flux, 0.1e0 AS E_Total_flux, 0.002e0 AS E_RA, 0.002e0 AS E_DEC FROM supplier"

#: Fluxes in four subbands of a bent power law; one in eleven is missing.
SPECTRA = """
SELECT meta_id, RA, DEC, origin_band, Peak_flux_VLSSR, n_assoc_VLSSR, {cols} FROM (
  SELECT CAST(o_orderkey AS BIGINT) AS meta_id, {position}, '55MHz' AS origin_band, o_totalprice / 1.05e4 AS Peak_flux_VLSSR, CAST(1 + o_custkey % 2 AS BIGINT) AS n_assoc_VLSSR,
  o_totalprice / 1e4 AS s, -0.4e0 - 0.1e0 * (o_custkey % 6) AS a, 0.3e0 * (o_orderkey % 3 - 1) AS b, o_orderkey AS k FROM orders) q
""".format(
    position=_position("o_orderkey"),
    cols=", ".join(
        f"CASE WHEN (k + {m}) % 11 = 0 THEN NULL ELSE s * exp(a * ln({m}e0 / 55e0) + b * ln({m}e0 / 55e0) * ln({m}e0 / 55e0) + 0.02e0 * ((k * {m}) % 7 - 3)) END AS Total_flux_{m}MHz, "
        f"s * exp((a + 0.1e0) * ln({m}e0 / 55e0)) AS Peak_flux_{m}MHz, s * 0.05e0 AS E_Total_flux_{m}MHz, CAST(1 AS BIGINT) AS n_assoc_{m}MHz, CAST(1 + (k + {m}) % 2 * (k % 2) AS BIGINT) AS n_confused_{m}MHz"
        for m in (18, 41, 55, 73)
    ),
)

ASSOCIATIONS = """
SELECT CAST(l_orderkey AS BIGINT) AS meta_id, CASE l_linenumber WHEN 1 THEN 'MilliQuas' WHEN 2 THEN 'eRASS3' WHEN 3 THEN 'RFC' WHEN 4 THEN 'TeVCat' WHEN 5 THEN 'NVSS' WHEN 6 THEN 'Xu2022' ELSE 'Other' END AS catalog,
  CAST(l_partkey AS VARCHAR(20)) AS ref_id, CAST(l_suppkey AS DOUBLE) AS ref_ra, 0e0 AS ref_dec,
  CASE l_linenumber WHEN 1 THEN CASE WHEN l_partkey % 2 = 0 THEN 'QR' ELSE 'S' END WHEN 2 THEN CASE l_partkey % 4 WHEN 0 THEN '-1' WHEN 1 THEN '2' WHEN 2 THEN 'blazar' ELSE '' END
    WHEN 3 THEN CASE l_partkey % 3 WHEN 0 THEN 'QSO' WHEN 1 THEN 'GClstr' ELSE '' END WHEN 4 THEN CASE WHEN l_partkey % 2 = 0 THEN 'hbl' ELSE 'PWN' END WHEN 5 THEN 'x' WHEN 6 THEN 'S' ELSE 'G' END AS class_native,
  l_quantity AS sep_arcsec, CAST(1 AS BIGINT) AS n_ref FROM lineitem
"""


def relation(spark: SparkSession, sf_dir: str, text: str, place: bool = False) -> DataFrame:
    """An adapter over the Parquet tables of a folder; with ``place`` also ``__place``, where a row of its one table stands."""
    used = sorted(set(re.findall(rf"\b(?:FROM|JOIN)\s+({'|'.join(_TABLES)})\b", text)))
    text = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(used)})\b", r"\1 {\2}", text)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    if place:
        (name,) = used
        tables[name] = tables[name].select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("__place"))
        text = re.sub(rf"(\s+FROM\s+\{{{name}\}})", r", __place\1", text)
    return spark.sql(text, **tables)


def separation(a: str, b: str) -> str:
    """Great-circle distance of two rows, for the oracle."""
    return f"degrees(2 * asin(least(1, sqrt(pow(sin(radians({b}.DEC - {a}.DEC) / 2), 2) + cos(radians({a}.DEC)) * cos(radians({b}.DEC)) * pow(sin(radians({b}.RA - {a}.RA) / 2), 2)))))"
