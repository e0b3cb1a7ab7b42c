"""Functions for SQL users, registered as SQL: the optimizer sees through them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyloom.functions.sphere import LATITUDE

_SEP = "degrees(2 * asin(least(1D, sqrt(power(sin(radians(dec2 - dec1) / 2), 2) + cos(radians(dec1)) * cos(radians(dec2)) * power(sin(radians(ra2 - ra1) / 2), 2)))))"

FUNCTIONS = {
    "sky_sep_deg": ("ra1 DOUBLE, dec1 DOUBLE, ra2 DOUBLE, dec2 DOUBLE", "DOUBLE", _SEP),
    "wrap_ra": ("ra DOUBLE", "DOUBLE", "pmod(ra, 360D)"),
    "lst_hour_number": ("label STRING", "DOUBLE", "try_cast(rtrim('h', lower(trim(label))) AS DOUBLE)"),
    "sky_elevation_deg": ("ra DOUBLE, dec DOUBLE, lst STRING", "DOUBLE", f"90 - sky_sep_deg(lst_hour_number(lst) * 15, {LATITUDE}D, ra, dec)"),
    "has_quality_bit": ("mask BIGINT, bit INT", "BOOLEAN", "(shiftright(mask, bit) & 1) = 1"),
    "has_band": ("bands STRING, band STRING", "BOOLEAN", "array_contains(split(coalesce(bands, ''), ','), band)"),
    "spectral_index": ("s1 DOUBLE, s2 DOUBLE, nu1 DOUBLE, nu2 DOUBLE", "DOUBLE", "CASE WHEN s1 > 0 AND s2 > 0 THEN ln(s1 / s2) / ln(nu1 / nu2) END"),
}


def register(spark: SparkSession) -> list[str]:
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)


def register_match(name: str, base: DataFrame, ref: DataFrame, base_id: str, ref_id: str, **how) -> DataFrame:
    """A view of the pairs of two catalogues, for joins in SQL."""
    from skyloom.operators.skyjoin import sky_pairs

    pairs = sky_pairs(base, ref, base_id, ref_id, **how)
    pairs.createOrReplaceTempView(name)
    return pairs
