"""Counts, histograms and curves over a catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.functions.bands import csv
from skyloom.functions.sphere import finite


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows by value, null included."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def band_counts(df: DataFrame, column: str = "bands_present") -> DataFrame:
    """Rows by band of a comma-separated list."""
    return df.select(F.explode(csv(F.col(column))).alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def sky_histogram(df: DataFrame, bin_deg: float, ra: str = "RA", dec: str = "DEC", top: int | None = None) -> DataFrame:
    """Rows by sky bin; the last bins include 360 and 90 degrees. ``top`` reports the densest."""
    at = lambda c, low, size: F.least(F.floor((finite(c) - low) / bin_deg), F.lit(int(size / bin_deg) - 1)).cast("long")
    out = df.select(at(ra, 0.0, 360.0).alias("ra_bin"), at(dec, -90.0, 180.0).alias("dec_bin")).where("ra_bin IS NOT NULL AND dec_bin IS NOT NULL").groupBy("ra_bin", "dec_bin").agg(F.count(F.lit(1)).alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), "ra_bin", "dec_bin").limit(top)


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def recovery_curve(df: DataFrame, by: str, matched: str, id: str) -> DataFrame:
    """Share of matched rows among those up to each value of ``by``.

    Running sums go over distinct values, dealt by range, with one row per range added up in
    one place, so no task orders all rows.
    """
    from skyloom.plans.shared import materialize

    each = df.groupBy(by).agg(F.sum(F.col(matched).cast("long")).alias("m"), F.count(F.lit(1)).alias("n")).where(F.col(by).isNotNull())
    each = materialize(each.repartitionByRange(by).withColumn("__p", F.spark_partition_id()), "curve")
    parts = each.groupBy("__p").agg(F.sum("m").alias("pm"), F.sum("n").alias("pn"))
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    parts = F.broadcast(parts.select("__p", F.coalesce(F.sum("pm").over(before), F.lit(0)).alias("bm"), F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("bn")))  # one row per partition
    run = W.partitionBy("__p").orderBy(by).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = each.join(parts, "__p").withColumns({"n_matched": F.col("bm") + F.sum("m").over(run), "n_total": F.col("bn") + F.sum("n").over(run)})
    return out.select(by, "n_matched", "n_total", (F.col("n_matched") / F.col("n_total")).alias("recovery"))


def in_range(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Rows whose columns lie within (low, high), ends included; None is open."""
    for c, (low, high) in ranges.items():
        ok = finite(c).isNotNull()
        ok = ok if low is None else ok & (finite(c) >= low)
        df = df.where(ok if high is None else ok & (finite(c) <= high))
    return df


def any_finite(*columns: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | finite(c).isNotNull()
    return out


def first_per_key(df: DataFrame, key: Sequence[str], *order: Column | str) -> DataFrame:
    """One row of each key: the first by ``order``."""
    n = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def select_rows(df: DataFrame, where: str | Column | DataFrame | Sequence | None = None, id: str = "meta_id", strict: bool = True) -> DataFrame:
    """Rows by a query text, a condition, or a list or table of ids; missing ids raise if ``strict``."""
    from skyloom.functions.text import query_expression

    if where is None:
        return df
    if isinstance(where, Column):
        return df.where(where)
    if isinstance(where, str):
        return df.where(query_expression(where))
    ids = where.select(id).distinct() if isinstance(where, DataFrame) else df.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(where)], df.select(id).schema)
    if strict and ids.join(df.select(id), id, "left_anti").limit(1).count():
        raise KeyError("ids that the table lacks")
    return df.join(ids, id, "left_semi")


def ordered_columns(df: DataFrame, preferred: Sequence[str], most: int | None = None) -> DataFrame:
    """Preferred columns first, the rest by name."""
    names = [c for c in preferred if c in df.columns] + sorted(c for c in df.columns if c not in preferred)
    return df.select(*[F.col(f"`{c}`") for c in (names if most is None else names[:most])])
