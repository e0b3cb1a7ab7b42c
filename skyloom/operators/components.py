"""Connected components by alternating large-star and small-star steps.

Each step keeps, for a node, only the link to the smallest neighbour, so a hub of any
degree stays a list of pairs and never becomes one row. Minima are combined before the
shuffle; the join back is an ordinary equi-join that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.plans.shared import discard, materialize


def _pairs(df: DataFrame, u, v) -> DataFrame:
    return df.select(u.cast("long").alias("u"), v.cast("long").alias("v"))


def _step(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    rest = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Nulls and self-links are ignored, repeated links count once, an empty table gives an
    empty one. Nodes without links are left to the caller.
    """
    a, b = F.col(src), F.col(dst)
    now = _pairs(edges.where(a.isNotNull() & b.isNotNull() & (a != b)), F.greatest(a, b), F.least(a, b)).distinct()
    now, seen = materialize(now, "cc"), None
    mark = F.struct(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)))
    for _ in range(max_rounds):
        new = materialize(_step(now), "cc")
        discard(now)
        now, was, seen = new, seen, tuple(new.agg(mark).first()[0])
        if seen == was or not seen[0]:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
