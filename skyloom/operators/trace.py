"""Following catalogue rows back to the detections they came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.functions.bands import csv
from skyloom.functions.sphere import finite
from skyloom.operators.reliability import beam
from skyloom.operators.skyjoin import sky_pairs
from skyloom.plans.shared import materialize


def rematch(rows: DataFrame, merged: DataFrame, id: str = "meta_id", merged_id: str = "lst_id", band: str = "band", peak: str = "Peak_flux") -> DataFrame:
    """(id, band, merged_id, sep_deg, n_hits): the band's source whose peak is nearest the row's, then the nearest.

    ``rows`` has one row per id and band; all bands are matched in one join.
    """
    base = rows.withColumn("__k", F.struct(F.col(id), F.col(band)))
    pairs = sky_pairs(base, merged, "__k", merged_id, base_radius=beam(rows.columns), extra=[band])
    pairs = pairs.select(F.col(f"base_id.{id}").alias(id), F.col(band), F.col("ref_id"), "sep_deg")
    pairs = pairs.join(rows.select(id, band, finite(peak).alias("__p")), [id, band]).join(merged.select(F.col(merged_id).alias("ref_id"), finite("Peak_flux").alias("__q")), "ref_id")
    off = F.when(F.col("__p").isNull(), 0.0).otherwise(F.coalesce(F.abs(F.col("__q") - F.col("__p")), F.lit(float("inf"))))
    group = W.partitionBy(id, band)
    pairs = pairs.withColumns({"n_hits": F.count(F.lit(1)).over(group), "__n": F.row_number().over(group.orderBy(off, "sep_deg", "ref_id"))})
    return pairs.where("__n = 1").select(id, band, F.col("ref_id").alias(merged_id), "sep_deg", "n_hits")


def rematch_hours(rows: DataFrame, merged: DataFrame, sources: DataFrame, id: str = "meta_id", merged_id: str = "lst_id", source_id: str = "source_id") -> DataFrame:
    """All detections, in the hours that the rematched source lists, within the beam of it."""
    found = materialize(rematch(rows, merged, id, merged_id), "rematch")
    seeds = found.join(merged.select(merged_id, "RA", "DEC", "BMAJ", csv(F.col("lst_hours")).alias("h")), merged_id)
    seeds = seeds.withColumn("lst_hour", F.explode("h")).withColumn("__k", F.struct(id, merged_id))
    pairs = sky_pairs(seeds, sources, "__k", source_id, extra=["band", "lst_hour"])
    return pairs.select(F.col(f"base_id.{id}").alias(id), F.col(f"base_id.{merged_id}").alias(merged_id), "band", "lst_hour", F.col("ref_id").alias(source_id), "sep_deg")


def fill_positions(meta: DataFrame, merged: DataFrame, bands: list[str], id: str = "meta_id", merged_id: str = "lst_id") -> DataFrame:
    """Positions of claimed bands that the row lacks, from rematched sources."""
    out = meta
    for b in bands:
        want = meta.where(F.array_contains(csv(F.col("bands_present")), b) & (finite(f"RA_{b}").isNull() | finite(f"DEC_{b}").isNull()))
        want = want.withColumns({"band": F.lit(b), "Peak_flux": F.col(f"Peak_flux_{b}") if f"Peak_flux_{b}" in meta.columns else F.lit(None).cast("double")})
        got = rematch(want, merged, id, merged_id).join(merged.select(merged_id, F.col("RA").alias("__ra"), F.col("DEC").alias("__dec")), merged_id).select(F.col(id).alias("__id"), "__ra", "__dec")
        out = out.join(got, F.col(id) == F.col("__id"), "left").withColumns({f"RA_{b}": F.coalesce(finite(f"RA_{b}"), "__ra"), f"DEC_{b}": F.coalesce(finite(f"DEC_{b}"), "__dec")}).drop("__id", "__ra", "__dec")
    return out
