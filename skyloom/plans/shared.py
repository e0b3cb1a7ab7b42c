"""Tables in the folder that driver and executors share.

Iterative plans cut their lineage here: a written table survives the loss of any
executor, which blocks kept on executors would not.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_written: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for local masters."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError(f"{_KEY} must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="skyloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set(_KEY, f"file://{own}")
    return f"file://{own}"


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that it is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    _written.add(path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, if it is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    _written.discard(path)


def discard(df: DataFrame) -> None:
    """Remove what :func:`materialize` wrote; nothing lazy may still read it."""
    path = getattr(df, "_shared_path", None)
    if path:
        delete(df.sparkSession, path)


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """The written result of ``make``; whatever else that wrote is deleted."""
    before = set(_written)
    out = materialize(make(), label)
    for path in sorted(_written - before - {out._shared_path}):
        delete(out.sparkSession, path)
    return out


def purge(spark: SparkSession) -> int:
    """Remove all that this process has written to the shared folder, once results have been consumed."""
    paths = sorted(_written)
    for path in paths:
        delete(spark, path)
    return len(paths)
