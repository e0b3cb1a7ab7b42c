"""Images to detections by a detector of the caller's, one image per call, failures as status."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.sources.layout import parsed_names


def detect(spark: SparkSession, path: str, detector: Callable[[str, bytes], pd.DataFrame], schema: str, pattern: str = "*.fits", retry: Callable[[str, bytes], pd.DataFrame] | None = None) -> DataFrame:
    """Rows of ``detector(path, bytes)`` with source_file and status.

    An image on which it fails is tried once with ``retry``; if that fails too, one row with
    the error as status stands for it. Each image is a row of its own task slice, so lost
    executors repeat single images.
    """
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]

    def run(batches):
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                status = "ok"
                try:
                    rows = detector(p, bytes(content))
                except Exception as e:  # a bad image must not end the job
                    try:
                        if retry is None:
                            raise
                        rows, status = retry(p, bytes(content)), f"retried: {e}"
                    except Exception as again:
                        rows, status = pd.DataFrame([{}]), f"failed: {again}"
                rows = rows.reindex(columns=names)
                rows["source_file"], rows["status"] = p, status
                yield rows

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, f"{schema}, source_file string, status string")


def labelled(detections: DataFrame) -> DataFrame:
    """Adds lst_hour, band and time_key from the file names."""
    return parsed_names(detections, "source_file").withColumn("source_file", F.regexp_extract("source_file", r"([^/]+)$", 1))
