"""Range join on the sphere: pairs within the larger of two radii.

Radii are classed by powers of two. A pair is joined at the level of its larger class, in
cells whose height is that level's size: declination zones, each cut into right ascension
cells no narrower than the size at the zone's far edge. One side lies in one cell per
level, the other is repeated over the cells its search circle meets, wrapped at 360
degrees and at the poles, so the join is an equality on cells with the exact distance as a
residual. One large radius costs only the level it belongs to.

Rows without a finite position are left out; missing and infinite radii count as 0, where
only equal positions meet. Pairs at exactly the radius are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.sphere import finite, separation, wrap_ra
from skyloom.plans.shared import materialize

#: Smallest level: cells of 2**-12 degrees, below one arcsecond.
FINEST = -12


def level_of(r: Column) -> Column:
    return F.when(r > 2.0**FINEST, F.ceil(F.log2(r)).cast("int")).otherwise(FINEST)


def _side(df: DataFrame, key: list[str], ra: str, dec: str, radius, name: str) -> DataFrame:
    r = radius if isinstance(radius, Column) else F.col(radius) if isinstance(radius, str) else F.lit(float(radius))
    r = F.greatest(F.lit(0.0), F.coalesce(finite(r), F.lit(0.0)))
    rows = df.select(*[F.col(k).alias(f"{name}{n}") for n, k in enumerate(key)], wrap_ra(finite(ra)).alias(f"{name}_ra"), finite(dec).alias(f"{name}_dec"), r.alias(f"{name}_r"))
    return rows.where(F.col(f"{name}_ra").isNotNull() & F.col(f"{name}_dec").isNotNull()).withColumn(f"{name}_level", level_of(F.col(f"{name}_r")))


def _cells_in_zone(zone: Column, size: Column) -> Column:
    """Right ascension cells of a zone: at least ``size`` wide at its edge nearest a pole."""
    edge = F.least(F.lit(90.0), F.greatest(F.abs(zone * size), F.abs((zone + 1) * size)))
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(edge)) / size).cast("int"))


def in_cell(rows: DataFrame, name: str) -> DataFrame:
    """Adds zone and cell of a row's position at its ``level``."""
    size = F.pow(F.lit(2.0), F.col("level"))
    rows = rows.withColumn("zone", F.floor(F.col(f"{name}_dec") / size).cast("int"))
    n = _cells_in_zone(F.col("zone"), size)
    return rows.withColumn("cell", F.least(n - 1, F.floor(F.col(f"{name}_ra") / (360.0 / n)).cast("int")))


def over_cells(rows: DataFrame, name: str) -> DataFrame:
    """A row for each zone and cell at its ``level`` that a circle of radius ``reach`` meets."""
    ra, dec, size = F.col(f"{name}_ra"), F.col(f"{name}_dec"), F.pow(F.lit(2.0), F.col("level"))
    reach = F.col("reach") * (1 + 1e-9) + 1e-9  # rounding must not lose a pair at the radius
    zone_of = lambda d: F.floor(d / size).cast("int")
    rows = rows.withColumn("zone", F.explode(F.sequence(zone_of(dec - reach), zone_of(dec + reach))))
    n = _cells_in_zone(F.col("zone"), size)
    edge = F.least(F.lit(90.0), F.greatest(F.abs(F.col("zone") * size), F.abs((F.col("zone") + 1) * size)))
    narrow = F.sqrt(F.cos(F.radians(edge)) * F.cos(F.radians(dec)))
    half = F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.least(reach, F.lit(180.0))) / 2) / F.greatest(narrow, F.lit(1e-12)))))
    width = 360.0 / n
    low, high = F.floor((ra - half) / width).cast("int"), F.floor((ra + half) / width).cast("int")
    rows = rows.withColumns({"n": n, "low": low, "high": F.least(high, low + n - 1)})  # no cell twice
    return rows.withColumn("cell", F.explode(F.sequence("low", "high"))).withColumn("cell", F.pmod("cell", "n"))


def sky_pairs(base: DataFrame, ref: DataFrame, base_id: str | list = "base_id", ref_id: str | list = "ref_id", base_radius="BMAJ", ref_radius="BMAJ", base_ra: str = "RA", base_dec: str = "DEC", ref_ra: str = "RA", ref_dec: str = "DEC", extra=(), reach: float = 1.0) -> DataFrame:
    """(base_id, ref_id, sep_deg) with sep <= max(radius of base, radius of ref).

    ``extra`` lists columns that both sides must share. ``reach`` multiplies the radii.
    An id may be a struct, which then carries what a later test of the pair needs.
    """
    extra, factor = list(extra), reach
    scale = lambda r: (r if isinstance(r, Column) else F.col(r) if isinstance(r, str) else F.lit(float(r))) * factor
    # Narrow rows are written once, unless they come from a written table: they are read for the levels and for each side.
    once = lambda df, side: side if hasattr(df, "_shared_path") else materialize(side, "sky")
    b = once(base, _side(base, [base_id, *extra], base_ra, base_dec, scale(base_radius), "b"))
    alike = base is ref and (base_id, base_ra, base_dec) == (ref_id, ref_ra, ref_dec) and base_radius is ref_radius
    if alike:
        r = b.select(*[F.col(c).alias("r" + c[1:]) for c in b.columns])
    else:
        r = once(ref, _side(ref, [ref_id, *extra], ref_ra, ref_dec, scale(ref_radius), "r"))
    # At most some twenty classes of radius exist: the levels that the data need, with the
    # largest radius of each.
    radii = b.groupBy(F.lit("b").alias("side"), F.col("b_level").alias("l")).agg(F.max("b_r").alias("m")).union(r.groupBy(F.lit("r"), "r_level").agg(F.max("r_r"))).collect()
    least = max((min((x["l"] for x in radii if x["side"] == side), default=FINEST) for side in "br"))  # no pair is joined below
    found = {k: max(x["m"] for x in radii if x["l"] == k) for k in {x["l"] for x in radii} if k >= least} or {FINEST: 0.0}
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(m).alias("reach")) for k, m in sorted(found.items())])).alias("x")
    b = b.select("*", every).where("x.level >= b_level").select(*b.columns, "x.level")
    r = r.select("*", every).where("x.level >= r_level").select(*r.columns, "x.level", "x.reach")
    b, r = in_cell(b, "b"), over_cells(r, "r")
    on = (b["level"] == r["level"]) & (b["zone"] == r["zone"]) & (b["cell"] == r["cell"])
    for k in range(len(extra)):
        on = on & (b[f"b{k + 1}"] == r[f"r{k + 1}"])
    sep = separation("b_ra", "b_dec", "r_ra", "r_dec")
    out = b.join(r, on).where((F.greatest("b_level", "r_level") == b["level"]) & (sep <= F.greatest("b_r", "r_r")))
    return out.select(F.col("b0").alias("base_id"), F.col("r0").alias("ref_id"), *[F.col(f"b{k + 1}").alias(x) for k, x in enumerate(extra)], sep.alias("sep_deg"))


def sky_neighbours(df: DataFrame, id: str, radius="BMAJ", ra: str = "RA", dec: str = "DEC", other_group: str | None = None, extra=(), reach: float = 1.0) -> DataFrame:
    """(id1, id2, sep_deg) with id1 < id2; with ``other_group`` only pairs of different groups."""
    if other_group:
        keyed = df.withColumn("__key", F.struct(F.col(id).alias("id"), F.col(other_group).alias("g")))
        pairs = sky_pairs(keyed, keyed, "__key", "__key", radius, radius, ra, dec, ra, dec, extra, reach)
        pairs = pairs.where((F.col("base_id.id") < F.col("ref_id.id")) & ~F.col("base_id.g").eqNullSafe(F.col("ref_id.g")))
        return pairs.select(F.col("base_id.id").alias("id1"), F.col("ref_id.id").alias("id2"), *extra, "sep_deg")
    pairs = sky_pairs(df, df, id, id, radius, radius, ra, dec, ra, dec, extra, reach).where("base_id < ref_id")
    return pairs.select(F.col("base_id").alias("id1"), F.col("ref_id").alias("id2"), *extra, "sep_deg")


def within_field(df: DataFrame, ra0: float, dec0: float, fov_deg: float, margin_deg: float = 0.0, max_rows: int | None = None, ra: str = "RA", dec: str = "DEC", id: str | None = None) -> DataFrame:
    """Rows inside a circular field with their distance; with ``max_rows`` the nearest of them, ties by ``id``, else by position."""
    reach = fov_deg / 2 + margin_deg
    near = df.where(F.col(dec).between(dec0 - reach, dec0 + reach)).withColumn("sep_deg", separation(F.lit(float(ra0)), F.lit(float(dec0)), finite(ra), finite(dec)))
    near = near.where(F.col("sep_deg") <= reach)
    return near if max_rows is None else near.orderBy("sep_deg", *([id] if id else [ra, dec])).limit(max_rows)


def nearest(df: DataFrame, ra0: float, dec0: float, n: int, ra: str = "RA", dec: str = "DEC", id: str | None = None) -> DataFrame:
    """The n rows nearest a position, with the distance in arcminutes and degrees."""
    sep = separation(F.lit(float(ra0)), F.lit(float(dec0)), finite(ra), finite(dec))
    out = df.withColumn("__sep", sep).where("__sep IS NOT NULL").orderBy("__sep", *([id] if id else [])).limit(n)
    return out.withColumns({"sep_arcmin": F.round(F.col("__sep") * 60, 4), "sep_deg": F.round("__sep", 6)}).drop("__sep")
