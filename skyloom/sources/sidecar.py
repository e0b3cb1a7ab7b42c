"""Small JSON files beside the tables, on any store that Spark reaches."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


def read_json(spark: SparkSession, path: str, default: Any = None) -> Any:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file):
        return default
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # one small file


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(spark._jsc.hadoopConfiguration()).create(file, True)
    stream.write(bytearray(json.dumps(value, indent=1, sort_keys=True).encode()))
    stream.close()


def save_columns(spark: SparkSession, path: str, columns: list[str]) -> None:
    """Preferred display columns."""
    write_json(spark, path, {"columns": list(dict.fromkeys(columns))})


def load_columns(spark: SparkSession, path: str, available: list[str] | None = None) -> list[str]:
    """Saved display columns that a table has; none if there is no file."""
    saved = read_json(spark, path, {"columns": []})["columns"]
    return [c for c in saved if available is None or c in available]
