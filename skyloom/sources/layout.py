"""Catalogue tables on disk: schemas, partitioned layers, replacement, inventory, legacy import."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.functions import bands as B
from skyloom.functions.quality import DEFAULT_MASK, clear
from skyloom.functions.text import code
from skyloom.operators.merge import BAND_FIELDS
from skyloom.plans.shared import delete, materialize

# Columns of the layers.
FLOATS = ("RA", "DEC", "Total_flux", "E_Total_flux", "Peak_flux", "E_Peak_flux", "Maj", "Min", "PA", "DC_Maj", "DC_Min", "DC_PA", "Resid_Isl_rms", "Resid_Isl_mean")
IDS = ("Source_id", "Isl_id")
DROPPED = ("E_RA", "E_DEC", "E_Maj", "E_Min", "E_PA", "Gaus_id")
REQUIRED = ("RA", "DEC", "Peak_flux", "origin_band", "bands_present")
REQUIRED_MHZ = ("RA", "DEC", "origin_band", "bands_present", "astrometry_band")


def _schema(doubles: Sequence[str], longs: Sequence[str] = (), strings: Sequence[str] = ()) -> T.StructType:
    kinds = [(doubles, T.DoubleType()), (longs, T.LongType()), (strings, T.StringType())]
    return T.StructType([T.StructField(n, k) for names, k in kinds for n in names])


SOURCES = _schema((*FLOATS, "BMAJ", "BMIN", "BPA"), IDS, ("S_Code", "lst_hour", "band", "source_file", "time_key"))
LST_MERGED = T.StructType([*SOURCES.fields, *_schema(("Peak_flux_std", "cluster_jitter_rms_deg"), ("n_lst_contributions",), ("lst_hours", "representative_lst")).fields])


def metacatalog_schema(bands: Sequence[str] = B.ASSOC_BANDS, fields: Sequence[str] = BAND_FIELDS) -> T.StructType:
    """The wide schema of a set of bands."""
    top = _schema((*FLOATS, "BMAJ_match", "BMAJ_full", "Peak_flux_std", "alpha_RG", "E_alpha_RG", "alpha_GB", "E_alpha_GB"), ("meta_id", "n_lst_contributions", "quality_flag"), ("origin_band", "bands_present", "lst_hours", "representative_lst", "S_Code"))
    per = [f for b in bands for f in _schema([f"{x}_{b}" for x in fields], (f"n_assoc_{b}", f"n_confused_{b}"), (f"source_file_{b}",)).fields]
    return T.StructType([*top.fields, *per])


ASSOCIATIONS = T.StructType([T.StructField(n, k) for n, k in (("meta_id", T.LongType()), ("catalog", T.StringType()), ("ref_id", T.StringType()), ("ref_ra", T.DoubleType()), ("ref_dec", T.DoubleType()), ("class_native", T.StringType()), ("sep_arcsec", T.DoubleType()), ("n_ref", T.LongType()))])


#: Partition columns of the layers.
PARTS = {"sources": ("band", "lst_hour"), "lst_merged": ("band",), "members": ("band",), "residual_matched": ("band",), "associations": ("catalog",)}


def conform(df: DataFrame, schema: T.StructType, extras: bool = True) -> DataFrame:
    """Columns of the schema, cast, with nulls for those missing; other columns follow."""
    have = set(df.columns)
    cols = [(F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
    named = set(schema.names)
    return df.select(*cols, *[F.col(f"`{c}`") for c in df.columns if extras and c not in named])


def validate(df: DataFrame, required: Sequence[str] | None = None) -> DataFrame:
    """``df``, or an error that names the columns it lacks. The subband layout is told by the absence of Peak_flux."""
    required = required or (REQUIRED if "Peak_flux" in df.columns else REQUIRED_MHZ)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def empty(spark: SparkSession, schema: T.StructType = SOURCES) -> DataFrame:
    return spark.createDataFrame([], schema)


def parquet_path(path: str) -> str:
    """The path, if its suffix is one of Parquet's or none (a table folder)."""
    suffix = re.search(r"\.(\w+)$", path.rstrip("/").rpartition("/")[2])
    if suffix and suffix[1].lower() not in ("parquet", "pq"):
        raise ValueError(f"not a Parquet path: {path}")
    return path


@dataclass(frozen=True)
class Layout:
    """The tables of a catalogue below one root."""

    root: str

    def table(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def write(self, df: DataFrame, layer: str) -> None:
        """Replaces the partitions of a layer that ``df`` holds."""
        schema, parts = {"sources": SOURCES, "lst_merged": LST_MERGED, "associations": ASSOCIATIONS}.get(layer), PARTS.get(layer, ())
        out = conform(df, schema) if schema else df
        writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(*parts) if parts else writer).parquet(self.table(layer))

    def append(self, df: DataFrame, layer: str, id: str) -> None:
        """Adds rows to the partitions they belong to; rows whose ``id`` is stored there replace those.

        Written again, the same rows leave the same table. Only partitions that ``df`` touches
        are read and replaced, and what replaces them is written in full before.
        """
        spark, parts = df.sparkSession, list(PARTS.get(layer, ()))
        new = materialize(df.dropDuplicates([*parts, id]), "arrived")
        if self.exists(spark, layer):
            touched = [r.asDict() for r in new.select(*parts).distinct().collect()] if parts else []  # partitions of one batch
            old = self.read(spark, layer)
            if parts:
                here = F.lit(False)
                for r in touched:
                    one = F.lit(True)
                    for c, v in r.items():
                        one = one & F.col(c).eqNullSafe(F.lit(v))
                    here = here | one
                old = old.where(here)
            new = old.join(new.select(*parts, id), [*parts, id], "left_anti").unionByName(new, allowMissingColumns=True)
            new = materialize(new, "stored")
        self.write(new, layer)

    def read(self, spark: SparkSession, layer: str, **where) -> DataFrame:
        """A layer, with partition filters such as band="Full"; missing files are skipped."""
        df = spark.read.option("ignoreMissingFiles", "true").option("mergeSchema", "true").parquet(parquet_path(self.table(layer)))
        for c, v in where.items():
            df = df.where(F.col(c).isin(*v) if isinstance(v, (list, tuple)) else F.col(c) == v)
        return df

    def exists(self, spark: SparkSession, layer: str) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.table(layer))
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def metacatalog(self, spark: SparkSession, mask: int | None = DEFAULT_MASK, prefer_spectral: bool = False) -> DataFrame:
        """The wide catalogue, or its spectral subset if there is one, without rows that have a bit of the mask."""
        layer = "metacatalog_spectral" if prefer_spectral and self.exists(spark, "metacatalog_spectral") else "metacatalog"
        df = validate(self.read(spark, layer))
        return df if mask is None else clear(df, mask)

    def bands(self, spark: SparkSession) -> list[str]:
        """Bands of the merged layer in their order: partition values, not rows, are read."""
        return B.in_order([r[0] for r in self.read(spark, "lst_merged").select("band").distinct().collect()])

    def missing_slots(self, spark: SparkSession, expected: DataFrame, layer: str = "sources") -> DataFrame:
        """Expected (band, lst_hour) without a partition: none if the cache is complete."""
        keys = [c for c in ("band", "lst_hour") if c in expected.columns]
        return expected.join(self.read(spark, layer).select(*keys).distinct(), keys, "left_anti")

    def drop_columns(self, spark: SparkSession, layer: str, columns: Sequence[str] = DROPPED, dry_run: bool = False) -> list[str]:
        """Columns of a layer that are, or would be, rewritten away.

        The old table is moved aside, the new one moved in, then the old one deleted: at every
        moment one of them is whole, and :meth:`recover` puts it in place.
        """
        self.recover(spark, layer)
        df = self.read(spark, layer)
        found = [c for c in columns if c in df.columns]
        if found and not dry_run:
            parts = PARTS.get(layer, ())
            writer = df.drop(*found).write.mode("overwrite")
            (writer.partitionBy(*parts) if parts else writer).parquet(self.table(f"{layer}.new"))
            self._move(spark, layer, f"{layer}.old")
            self._move(spark, f"{layer}.new", layer)
            delete(spark, self.table(f"{layer}.old"))
        return found

    def recover(self, spark: SparkSession, layer: str) -> None:
        """Puts back a layer that a rewrite has moved away and not replaced, and removes what it left."""
        if not self.exists(spark, layer) and self.exists(spark, f"{layer}.old"):
            self._move(spark, f"{layer}.old", layer)
        for end in ("new", "old"):
            delete(spark, self.table(f"{layer}.{end}"))

    def _move(self, spark: SparkSession, layer: str, to: str) -> None:
        here, there = (spark._jvm.org.apache.hadoop.fs.Path(self.table(x)) for x in (layer, to))
        if not here.getFileSystem(spark._jsc.hadoopConfiguration()).rename(here, there):
            raise OSError(f"cannot move {here} to {there}")


def with_beams(df: DataFrame, beams: DataFrame, on: Sequence[str] = ("band", "lst_hour")) -> DataFrame:
    """Beam columns filled from a table of beams, where the catalogue has none."""
    have = [c for c in ("BMAJ", "BMIN", "BPA") if c in df.columns]
    extra = beams.select(*on, *[F.col(c).alias(f"__{c}") for c in ("BMAJ", "BMIN", "BPA")])
    rows = df.join(extra, list(on), "left")
    return rows.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) if c in have else F.col(f"__{c}") for c in ("BMAJ", "BMIN", "BPA")}).drop("__BMAJ", "__BMIN", "__BPA")


_NAMES = (
    ("lst_merged", r"^metacatalog_lst_([^.]+)\.parquet$"),
    ("sources", r"^sources_(\d{2}h)_([^.]+)\.parquet$"),
    ("metacatalog", r"^metacatalog(?:_\w+)?\.parquet$"),
)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Catalogue files below a folder: kind, hour, band, rows and size."""
    files = spark.read.parquet(f"{root.rstrip('/')}/*.parquet").select("_metadata.file_path", "_metadata.file_size")
    rows = files.groupBy("file_path").agg(F.first("file_size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
    name = F.regexp_extract("file_path", r"([^/]+\.parquet)(?:/[^/]*)?$", 1)
    rows = rows.groupBy(name.alias("file")).agg(F.sum("n_rows").alias("n_rows"), F.round(F.sum("bytes") / 1e6, 2).alias("size_mb"))
    return classified(rows)


def classified(rows: DataFrame, file: str = "file") -> DataFrame:
    """Adds kind, lst_hour and band of catalogue file names."""
    c, (lst, src, meta) = F.col(file), [p for _, p in _NAMES]
    kind = F.when(c.rlike(lst), "lst_merged").when(c.rlike(src), "sources").when(c.rlike(meta), "metacatalog").otherwise("other")
    hour = F.when(c.rlike(src), F.regexp_extract(c, src, 1))
    band = F.when(c.rlike(lst), F.regexp_extract(c, lst, 1)).when(c.rlike(src), F.regexp_extract(c, src, 2))
    return rows.withColumns({"kind": kind, "lst_hour": hour, "band": band})


def legacy_csv(spark: SparkSession, path: str, schema: T.StructType = SOURCES) -> DataFrame:
    """An old CSV catalogue as the layer's schema; blank codes are null."""
    df = spark.read.csv(path, header=True)
    cast = {f.name: (code(F.col(f.name)) if isinstance(f.dataType, T.StringType) else F.trim(F.col(f.name)).try_cast("double").cast(f.dataType)) for f in schema.fields if f.name in df.columns}
    return conform(df.withColumns(cast), schema)


def migrate(spark: SparkSession, root: str, layout: Layout, dry_run: bool = False) -> list[tuple[str, str]]:
    """Old CSV files of a folder written as layers; returns what goes where."""
    files = [r[0] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(root).select("path").collect()]
    plan = [(p, "lst_merged" if "metacatalog_lst" in p else "metacatalog" if "metacatalog" in p else "sources") for p in sorted(files)]
    if not dry_run:
        for p, layer in plan:
            layout.write(legacy_csv(spark, p, {"sources": SOURCES, "lst_merged": LST_MERGED}.get(layer, metacatalog_schema())), layer)
    return plan


# ---- discovery of images by name

_HOUR = r"(?i)LST(\d{1,2})h"


def parsed_names(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds lst_hour, band and time_key of image paths; rows whose name is not known are dropped.

    The hour comes from the name, else from a parent folder such as ``01h`` or ``01h_Blue``.
    """
    p = F.col(path)
    name = F.regexp_extract(p, r"([^/]+)$", 1)
    folder = F.regexp_extract(p, r"(?i)/(\d{2})h(?:_[^/]+)?/[^/]*$", 1)
    hour = F.coalesce(F.nullif(F.regexp_extract(name, _HOUR, 1), F.lit("")), F.nullif(folder, F.lit("")))
    band = B.normalize_column(F.regexp_extract(name, r"(?i)^(Full|Blue|Green|Red|\d+MHz)_I_.*\.fits$", 1))
    date, slot = F.regexp_extract(name, r"(?i)_(\d{8})_LST", 1), F.regexp_extract(name, r"(?i)_(t\d+)\.fits$", 1)
    hour = F.when(hour.isNotNull(), F.concat(F.lpad(hour.cast("int").cast("string"), 2, "0"), F.lit("h")))
    key = F.when((date != "") & (slot != ""), F.concat_ws("_", date, hour, slot))
    return files.withColumns({"lst_hour": hour, "band": band, "time_key": key}).where("lst_hour IS NOT NULL AND band IS NOT NULL")


def discover(spark: SparkSession, root: str, pattern: str = "*.fits") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select("path", "length")
    return parsed_names(files)


def one_per_slot(found: DataFrame, keys: Sequence[str] = ("lst_hour", "band")) -> DataFrame:
    """The image of each slot; slots with several raise."""
    twice = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(3).collect()
    if twice:
        raise ValueError(f"several images for {[tuple(r[k] for k in keys) for r in twice]}")
    return found


def prebuilt_maps(files: DataFrame, prefer: str = "") -> DataFrame:
    """One map file per subband folder, those with ``prefer`` in their name first; an undecided choice is marked ambiguous."""
    from pyspark.sql import Window as W

    rows = files.withColumn("band", B.normalize_column(F.regexp_extract("path", r"(?i)/(\d+MHz)/", 1))).where("band IS NOT NULL")
    rows = rows.withColumn("rank", F.when(F.instr("path", prefer) > 0, 0).otherwise(1))
    same = W.partitionBy("band", "rank")
    rows = rows.withColumns({"ambiguous": F.count(F.lit(1)).over(same) > 1, "n": F.row_number().over(W.partitionBy("band").orderBy("rank", "path"))})
    return rows.where("n = 1").select("band", "path", "ambiguous")
