"""Outliers by Mahalanobis distance."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.sphere import finite


def factorized(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the rank, from 0, of a text among the sorted distinct ones; null stays null."""
    from skyloom.plans.numbering import numbered

    labels = numbered(df.select(F.col(column).cast("string").alias("__l")).where("__l IS NOT NULL").distinct(), "__c", "__l")
    return df.join(labels, F.col(column).cast("string") == F.col("__l"), "left").withColumn(name, F.col("__c").cast("double")).drop("__l", "__c")


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and sample covariance of rows with all columns, from one aggregation; d * d numbers reach the driver."""
    full = df.select(*[finite(c).alias(f"v{k}") for k, c in enumerate(columns)]).na.drop()
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = full.agg(F.count(F.lit(1)), *[F.avg(f"v{k}") for k in range(d)], *[F.covar_samp(f"v{i}", f"v{j}") for i, j in pairs]).first()
    n = int(row[0])
    if n <= d:
        raise ValueError(f"{n} complete rows for {d} columns")
    cov = np.empty((d, d))
    for (i, j), v in zip(pairs, row[1 + d :]):
        cov[i, j] = cov[j, i] = v
    return np.array(row[1 : 1 + d], float), cov, n


def mahalanobis(df: DataFrame, columns: Sequence[str], percentile: float = 99.0, impute: bool = False, name: str = "mahalanobis_d2") -> DataFrame:
    """Adds the squared distance and ``is_outlier``: at or above the percentile of complete rows.

    The fit uses complete rows. With ``impute`` missing values are replaced by medians, else
    incomplete rows have no distance.
    """
    mean, cov, n = moments(df, columns)
    condition = np.linalg.cond(cov)
    if not condition < 1e12:
        warnings.warn(f"covariance has condition {condition:.3g}", stacklevel=2)
    precision = np.linalg.pinv(cov)
    values = [finite(c) for c in columns]
    rows = df
    whole = F.lit(True)
    for v in values:
        whole = whole & v.isNotNull()
    if impute:
        medians = df.agg(*[F.percentile(v, 0.5).alias(f"__m{k}") for k, v in enumerate(values)]).first()
        values = [F.coalesce(v, F.lit(float(m))) for v, m in zip(values, medians)]
    off = [v - float(m) for v, m in zip(values, mean)]
    d2 = F.lit(0.0)
    for i in range(len(columns)):
        for j in range(len(columns)):
            d2 = d2 + off[i] * off[j] * float(precision[i, j])
    rows = rows.withColumns({name: d2, "__whole": whole})
    limit = rows.where("__whole").agg(F.percentile(name, percentile / 100).alias("__limit"))
    rows = rows.crossJoin(F.broadcast(limit))  # one row
    return rows.withColumn("is_outlier", F.coalesce(F.col(name) >= F.col("__limit"), F.lit(False))).drop("__limit", "__whole")
