"""The registry of queries, and the inputs that several query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.plans.adapters import CATALOG, CUSTOMERS, DETECTIONS, PARTS, SUPPLIERS, relation

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _r(c: str | Column, n: int = 6, name: str | None = None) -> Column:
    return F.round(c, n).alias(name or c)


def _det(s: SparkSession, d: str) -> DataFrame:
    return relation(s, d, DETECTIONS)


def _cat(s: SparkSession, d: str) -> DataFrame:
    return relation(s, d, CATALOG)


_D, _C = f"det AS ({DETECTIONS})", f"cat AS ({CATALOG})"
_REFS = f"cust AS ({CUSTOMERS}), par AS ({PARTS}), sup AS ({SUPPLIERS})"
