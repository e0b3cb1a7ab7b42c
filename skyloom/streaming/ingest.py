"""Detections that arrive as files, merged into a per-band catalogue as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators.merge import cluster, lst_merge
from skyloom.operators.skyjoin import sky_pairs
from skyloom.plans.shared import materialize
from skyloom.sources.layout import SOURCES, Layout


def read_detections(spark: SparkSession, path: str, schema=SOURCES) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def merge_batch(layout: Layout, id: str = "det_id") -> Callable[[DataFrame, int], None]:
    """A batch's detections are added to their partitions and the chains that they touch merged again.

    The layer ``members`` tells the chain (``root``) of each stored detection. New detections are
    joined to the stored ones of their band; the chains of those within reach and the new
    detections are clustered anew, all other chains and merged sources stay as they are. A
    batch that is delivered again, or a detection that comes twice, changes nothing.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch = materialize(batch.dropDuplicates([id]), "batch")
        bands = [r[0] for r in batch.select("band").distinct().collect()]  # one row a band
        if not bands:
            return
        layout.append(batch, "sources", id)
        for band in bands:
            rows = layout.read(spark, "sources", band=band)
            kept_members = kept_merged = None
            if layout.exists(spark, "members"):
                members = layout.read(spark, "members", band=band).select(id, "root")
                new = batch.where(F.col("band") == band)
                near = sky_pairs(new, rows, id, id).select(F.col("ref_id").alias(id)).unionByName(new.select(id)).distinct()
                touched = materialize(members.join(near, id, "left_semi").select("root").distinct(), "touched")
                kept_members = members.join(touched, "root", "left_anti")
                kept_merged = layout.read(spark, "lst_merged", band=band).join(touched, "root", "left_anti") if layout.exists(spark, "lst_merged") else None
                stale = members.join(touched, "root", "left_semi").select(id)
                rows = rows.join(stale.unionByName(new.select(id)).distinct(), id, "left_semi")
            rows = materialize(rows, "touched")
            merged = lst_merge(rows, id, band)
            chains = cluster(rows, id).select(id, "root")
            if kept_merged is not None:
                merged = kept_merged.unionByName(merged, allowMissingColumns=True)
            if kept_members is not None:
                chains = kept_members.unionByName(chains)
            layout.write(materialize(merged, "merged"), "lst_merged")
            layout.write(materialize(chains.withColumn("band", F.lit(band)), "members"), "members")

    return run


def start(spark: SparkSession, incoming: str, layout: Layout, checkpoint: str, schema=SOURCES, id: str = "det_id", once: bool = True):
    stream = read_detections(spark, incoming, schema).writeStream.foreachBatch(merge_batch(layout, id)).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def windowed_counts(events: DataFrame, ts: str = "ts", width: str = "10 minutes", late: str = "30 minutes", by: str = "event_type") -> DataFrame:
    """Rows per time window and type; rows later than ``late`` are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")
