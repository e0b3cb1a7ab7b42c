"""The queries of this subpackage and those that SQL can express."""

from __future__ import annotations

import importlib

_MODULES = ["mixing", "packing", "pii", "quality", "langid", "suffix_dedup", "chat", "toxicity", "simhash", "vector_dedup"]


def _loaded():
    return [importlib.import_module(f"skyloom.llm.{m}") for m in _MODULES]


def queries() -> dict:
    return {m.NAME: m.query for m in _loaded()}


def oracle_sql() -> dict:
    return {m.NAME: m.ORACLE_SQL for m in _loaded() if m.ORACLE_SQL}
