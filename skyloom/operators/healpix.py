"""HEALPix pixels as whole-number arithmetic on columns, and maps as tables of (ipix, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.sphere import finite


def _spread(v: Column) -> Column:
    """The bits with a zero after each: binary digits read to base four."""
    return F.conv(F.bin(v), 4, 10).cast("long")


def _gather(v: Column) -> Column:
    """Every other bit: what is left of the digits to base four, read as binary ones."""
    return F.conv(F.conv(v.bitwiseAND(F.lit(0x5555555555555555)).cast("string"), 10, 4), 2, 10).cast("long")


def pixel(ra, dec, nside: int) -> Column:
    """Pixel number in the nested scheme of a position; ``nside`` is a power of two."""
    if nside < 1 or nside & (nside - 1):
        raise ValueError("nside must be a power of two")
    z = F.sin(F.radians(finite(dec)))
    tt = F.pmod(finite(ra), F.lit(360.0)) / 90.0
    za = F.abs(z)
    # Equatorial belt: lines of rising and falling diagonals.
    jp = F.floor(nside * (0.5 + tt - z * 0.75)).cast("long")
    jm = F.floor(nside * (0.5 + tt + z * 0.75)).cast("long")
    ifp, ifm = F.floor(jp / nside).cast("long"), F.floor(jm / nside).cast("long")
    face_eq = F.when(ifp == ifm, ifp.bitwiseAND(F.lit(3).cast("long")) + 4).when(ifp < ifm, ifp.bitwiseAND(F.lit(3).cast("long"))).otherwise(ifm.bitwiseAND(F.lit(3).cast("long")) + 8)
    ix_eq, iy_eq = F.pmod(jm, F.lit(nside)), nside - F.pmod(jp, F.lit(nside)) - 1
    # Polar caps.
    ntt = F.least(F.lit(3), F.floor(tt)).cast("long")
    tp, tmp = tt - ntt, nside * F.sqrt(3 * (1 - za))
    up = F.least(F.lit(nside - 1), F.floor(tp * tmp)).cast("long")
    down = F.least(F.lit(nside - 1), F.floor((1 - tp) * tmp)).cast("long")
    face_po = F.when(z >= 0, ntt).otherwise(ntt + 8)
    ix_po, iy_po = F.when(z >= 0, nside - down - 1).otherwise(up), F.when(z >= 0, nside - up - 1).otherwise(down)
    belt = za <= 2 / 3
    face, ix, iy = F.when(belt, face_eq).otherwise(face_po), F.when(belt, ix_eq).otherwise(ix_po), F.when(belt, iy_eq).otherwise(iy_po)
    return (face * (nside * nside) + _spread(ix.cast("long")) + F.shiftleft(_spread(iy.cast("long")), 1)).cast("long")


def _face_xy(ipix: Column, nside: int) -> tuple[Column, Column, Column]:
    inner = F.pmod(ipix, F.lit(nside * nside)).cast("long")
    return F.floor(ipix / (nside * nside)).cast("long"), _gather(inner), _gather(F.shiftright(inner, 1))


def centre(ipix: Column, nside: int) -> tuple[Column, Column]:
    """(RA, Dec) of a nested pixel's centre."""
    face, ix, iy = _face_xy(ipix, nside)
    jrll = F.floor(face / 4).cast("long") + 2
    jpll = F.element_at(F.array(*[F.lit(x) for x in (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)]), (face + 1).cast("int"))
    jr = jrll * nside - ix - iy - 1
    nr = F.when(jr < nside, jr).when(jr > 3 * nside, 4 * nside - jr).otherwise(nside)
    z = F.when(jr < nside, 1 - nr * nr / (3.0 * nside * nside)).when(jr > 3 * nside, nr * nr / (3.0 * nside * nside) - 1).otherwise((2 * nside - jr) * 2 / (3.0 * nside))
    shift = F.when((jr < nside) | (jr > 3 * nside), F.lit(0)).otherwise(F.pmod(jr - nside, F.lit(2)))
    jp = (jpll * nr + ix - iy + 1 + shift) / 2
    jp = F.floor(F.when(jp > 4 * nr, jp - 4 * nr).when(jp < 1, jp + 4 * nr).otherwise(jp))
    phi = (jp - (shift + 1) * 0.5) * (math.pi / 2 / nr)
    return F.pmod(F.degrees(phi), F.lit(360.0)), F.degrees(F.asin(z))


def ring_to_nest(ipix: Column, nside: int) -> Column:
    """The nested number of a pixel in ring order."""
    ra, dec = ring_centre(ipix, nside)
    return pixel(ra, dec, nside)


def ring_centre(ipix: Column, nside: int) -> tuple[Column, Column]:
    npix, cap = 12 * nside * nside, 2 * nside * (nside - 1)
    north, south = ipix < cap, ipix >= npix - cap
    p = F.when(south, npix - ipix).otherwise(ipix + 1)
    ring = F.floor(0.5 * (1 + F.sqrt(1.0 + 2 * (p - 1)))).cast("long")
    polar_phi = F.when(north, ipix + 1 - 2 * ring * (ring - 1)).otherwise(4 * ring + 1 - (npix - ipix - 2 * ring * (ring - 1)))
    t = ipix - cap
    belt_ring = F.floor(t / (4 * nside)).cast("long") + nside
    belt_phi = F.pmod(t, F.lit(4 * nside)) + 1
    odd = F.when(F.pmod(belt_ring + nside, F.lit(2)) == 0, 0.5).otherwise(0.0)
    polar = north | south
    z = F.when(north, 1 - ring * ring / (3.0 * nside * nside)).when(south, ring * ring / (3.0 * nside * nside) - 1).otherwise((2 * nside - belt_ring) * 2 / (3.0 * nside))
    phi = F.when(polar, (polar_phi - 0.5) * (math.pi / 2) / ring).otherwise((belt_phi - 1 + odd) * (math.pi / 2) / nside)
    return F.pmod(F.degrees(phi), F.lit(360.0)), F.degrees(F.asin(z))


def children(tile: Column, nside_tile: int, nside: int) -> Column:
    """The pixels of a finer map inside a nested tile."""
    f = (nside // nside_tile) ** 2
    return F.sequence(tile * f, (tile + 1) * f - 1)


def paint_points(df: DataFrame, nside: int, value: str, ra: str = "RA", dec: str = "DEC") -> DataFrame:
    """A map of sums of point sources."""
    rows = df.select(pixel(ra, dec, nside).alias("ipix"), finite(value).alias("v")).where("ipix IS NOT NULL AND v IS NOT NULL")
    return rows.groupBy("ipix").agg(F.sum("v").alias("value"))


def paint_gaussians(df: DataFrame, nside: int, peak: str = "Peak_flux", maj: str = "Maj", min_: str = "Min", pa: str = "PA", ra: str = "RA", dec: str = "DEC", reach: float = 5.0) -> DataFrame:
    """A map of elliptical Gaussians (FWHM axes, position angle north to east).

    Every source with a peak is painted: axes that are missing or below a pixel are raised to
    one pixel. Each meets the pixel centres within ``reach`` sigma of its larger axis, at least two pixels.
    """
    from skyloom.operators.skyjoin import sky_pairs

    spark = df.sparkSession
    to_sigma = 1 / (2 * math.sqrt(2 * math.log(2)))
    rows = df.select(finite(ra).alias("RA"), finite(dec).alias("DEC"), finite(peak).alias("p"), finite(maj).alias("a"), F.coalesce(finite(min_), finite(maj)).alias("b"), F.coalesce(finite(pa), F.lit(0.0)).alias("t")).where("p <> 0")
    side = math.degrees(math.sqrt(4 * math.pi / (12 * nside * nside)))
    a, b = (F.greatest(F.abs(F.coalesce(F.col(c), F.lit(side))), F.lit(side)) for c in ("a", "b"))
    rows = rows.withColumns({"a": a, "b": b}).withColumns({"a": F.greatest("a", "b"), "b": F.least("a", "b")})
    rows = rows.withColumn("src", F.struct("RA", "DEC", "p", "a", "b", "t"))
    pixels = spark.range(12 * nside * nside).withColumnRenamed("id", "ipix")
    pr, pd = centre(F.col("ipix"), nside)
    pixels = pixels.select("ipix", pr.alias("RA"), pd.alias("DEC")).withColumn("px", F.struct("ipix", "RA", "DEC"))
    pairs = sky_pairs(rows, pixels, "src", "px", base_radius=F.greatest(F.col("a") * to_sigma * reach, F.lit(2 * side)), ref_radius=0.0)
    s, x = F.col("base_id"), F.col("ref_id")
    east = (F.pmod(x["RA"] - s["RA"] + 180, F.lit(360.0)) - 180) * F.cos(F.radians(s["DEC"]))
    north = x["DEC"] - s["DEC"]
    t = F.radians(s["t"])
    along, across = north * F.cos(t) + east * F.sin(t), east * F.cos(t) - north * F.sin(t)
    q = F.pow(along / (s["a"] * to_sigma), 2) + F.pow(across / (s["b"] * to_sigma), 2)
    return pairs.select(x["ipix"].alias("ipix"), (s["p"] * F.exp(-q / 2)).alias("v")).groupBy("ipix").agg(F.sum("v").alias("value"))


def residual_map(observed: DataFrame, model: DataFrame, background: float = 0.0, clip: bool = True) -> DataFrame:
    """observed - background - model per pixel; missing pixels stay missing, negative ones become 0."""
    rows = observed.join(model.select("ipix", F.col("value").alias("m")), "ipix", "left")
    left = F.col("value") - background - F.coalesce("m", F.lit(0.0))
    return rows.select("ipix", (F.when(F.isnan("value"), F.col("value")).otherwise(F.greatest(F.lit(0.0), left)) if clip else left).alias("value"))


def map_stats(residual: DataFrame, value: str = "value") -> DataFrame:
    """rms, mean, 95th percentile and peak of the finite values' size."""
    v = finite(value)
    return residual.agg(F.sqrt(F.avg(v * v)).alias("rms"), F.avg(v).alias("mean"), F.percentile(F.abs(v), 0.95).alias("p95_abs"), F.max(F.abs(v)).alias("peak_abs"))
