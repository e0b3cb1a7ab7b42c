"""Row numbers in a total order without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.plans.shared import materialize


def numbered(df: DataFrame, name: str, *order: Column | str, start: int = 0) -> DataFrame:
    """Adds ``name``: start, start + 1, ... by ``order``, which must tell rows apart.

    Rows are dealt by range and numbered within their range; what is added up in one place
    is a count per range.
    """
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = materialize(df.repartitionByRange(*cols).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = F.broadcast(sizes.select("__part", before.alias("__before")))  # one row per partition
    own = F.row_number().over(W.partitionBy("__part").orderBy(*cols)) - 1
    return dealt.join(sizes, "__part").withColumn(name, F.col("__before") + own + start).drop("__part", "__before")
