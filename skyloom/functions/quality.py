"""The quality mask: twenty bits in a fixed layout, and filters on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bit names in the order of their bits, and what they mean.
BITS = {
    "HAS_NAN": "a core measurement is missing",
    "INVALID_ASTROMETRY": "position or peak flux is not finite",
    "SINGLE_LST": "seen in one image only",
    "SINGLE_UNIQUE_BAND": "uniquely associated in exactly one band",
    "UNPHYSICAL_FLUX": "total flux below peak flux by over three sigma",
    "RESID_ABS_FAIL": "residual above the absolute cut",
    "RESID_PCTL_RMS": "residual rms outside the percentiles",
    "RESID_PCTL_MEAN": "residual mean outside the percentiles",
    "JITTER_FAIL": "positions scatter by over 0.3 beams",
    "CONFUSED_ASSOC": "a band's source is claimed more than once",
    "NO_VLSSR": "no VLSSR counterpart",
    "SCODE_COMPLEX": "fitted with several components",
    "LOW_ELEVATION": "too near the horizon",
    "HIGH_ELLIPTICITY": "axes differ by over a factor of three",
    "EXTENDED": "larger than three beams",
    "LARGE_SINGLE": "extended or elliptic, and seen once",
    "NEAR_BRIGHT_SIDELOBE": "in the sidelobe annulus of a far brighter source",
    "BAND_POSITION_INCONSISTENT": "positions of bands differ by over a beam",
    "COMPLEX_RESID": "several components and a high residual",
    "RESID_LEFTOVER": "flux left over under the source",
}
NAMES = tuple(BITS)
VALUE = {name: 1 << k for k, name in enumerate(NAMES)}
DEFAULT_MASK = 247
CORE_CLEAN = ("HAS_NAN", "INVALID_ASTROMETRY", "RESID_ABS_FAIL", "RESID_PCTL_RMS", "RESID_PCTL_MEAN", "LOW_ELEVATION", "LARGE_SINGLE", "NEAR_BRIGHT_SIDELOBE", "BAND_POSITION_INCONSISTENT", "COMPLEX_RESID")
OR_HESL = ("HAS_NAN", "INVALID_ASTROMETRY", "UNPHYSICAL_FLUX", "RESID_ABS_FAIL", "RESID_PCTL_RMS", "RESID_PCTL_MEAN", "JITTER_FAIL", "LOW_ELEVATION")


def mask_of(names: Sequence[str]) -> int:
    out = 0
    for n in names:
        key = str(n).strip().upper()
        if key not in VALUE:
            raise ValueError(f"unknown quality flag {n!r}")
        out |= VALUE[key]
    return out


def packed(flags: dict[str, Column]) -> Column:
    """The mask of named conditions; null counts as not set."""
    out = F.lit(0).cast("long")
    for name, c in flags.items():
        out = out.bitwiseOR(F.when(F.coalesce(c, F.lit(False)), F.lit(VALUE[name])).otherwise(0).cast("long"))
    return out


def decoded(mask: Column) -> Column:
    """Names of the bits that are set."""
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(v).cast("long")) != 0, F.lit(n)) for n, v in VALUE.items()]))


def decode(value: int) -> list[str]:
    return [n for n, v in VALUE.items() if value & v]


def has_bits(mask: Column, names: Sequence[str], how: str = "any") -> Column:
    wanted = F.lit(mask_of(names)).cast("long")
    bits = mask.cast("long").bitwiseAND(wanted)
    if how not in ("any", "all", "none"):
        raise ValueError(f"unknown mode {how!r}")
    return bits != 0 if how == "any" else bits == wanted if how == "all" else bits == 0


def clear(df: DataFrame, mask: int = DEFAULT_MASK, flag: str = "quality_flag") -> DataFrame:
    """Rows with none of the mask's bits; all rows if there is no mask column. A null mask fails."""
    return df.where(F.col(flag).cast("long").bitwiseAND(F.lit(mask).cast("long")) == 0) if flag in df.columns else df


def with_bits(df: DataFrame, names: Sequence[str], how: str = "any", flag: str = "quality_flag") -> DataFrame:
    return df.where(has_bits(F.col(flag), names, how)) if names and flag in df.columns else df


def without_or_hesl(df: DataFrame, mask: int | None = None, flag: str = "quality_flag") -> DataFrame:
    """Drops rows with any bit of the mask, or with high ellipticity in a single image."""
    if flag not in df.columns:
        return df
    q = F.col(flag).cast("long")
    both = F.lit(VALUE["HIGH_ELLIPTICITY"] | VALUE["SINGLE_LST"]).cast("long")
    bad = (q.bitwiseAND(F.lit(mask_of(OR_HESL) if mask is None else mask).cast("long")) != 0) | (q.bitwiseAND(both) == both)
    return df.where(~bad)


def legend(spark) -> DataFrame:
    return spark.createDataFrame([(k, 1 << k, n, BITS[n]) for k, n in enumerate(NAMES)], "bit int, value long, name string, meaning string")


def bit_counts(df: DataFrame, flag: str = "quality_flag") -> DataFrame:
    """Rows with each bit, and with none, with their share."""
    q = F.col(flag).cast("long")
    counts = [F.count_if(q.bitwiseAND(F.lit(v).cast("long")) != 0).alias(n) for n, v in VALUE.items()] + [F.count_if(q == 0).alias("ALL_CLEAR")]
    row = df.agg(*counts, F.count(F.lit(1)).alias("__n"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("bit"), F.col(n).alias("n")) for k, n in [*enumerate(NAMES), (-1, "ALL_CLEAR")]])).alias("x")
    return row.select(each, "__n").select("x.*", (F.col("x.n") / F.when(F.col("__n") > 0, F.col("__n"))).alias("fraction"))
