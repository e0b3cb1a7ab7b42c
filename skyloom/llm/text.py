"""Text helpers that several operators share."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that parts words: space and the control characters 9 to 13.
GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Words of the whole text, 0 for null: pieces between gaps, less the empty outer ones."""
    pieces = F.size(F.split(text, GAP, -1))
    outer = F.substring(text, 1, 1).rlike(GAP).cast("int") + F.substring(text, -1, 1).rlike(GAP).cast("int")
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(pieces - outer).cast("long")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


@functools.cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not every C library has it
        return lambda _: 0


def tidy() -> None:
    """Gives back to the system what batches of texts have freed: workers that wait for the next task stay small."""
    pa.default_memory_pool().release_unused()
    _trim()(0)
