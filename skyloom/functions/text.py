"""Cleaning and parsing of text columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.sphere import finite


def clean(c: Column) -> Column:
    """Trimmed text; what stands for no value becomes empty."""
    text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(text).isin("nan", "none", "<na>", "nat", "null"), "").otherwise(text)


def code(c: Column) -> Column:
    """A trimmed text, null if blank."""
    text = F.trim(c.cast("string"))
    return F.when(text != "", text)


def decoded(c: Column) -> Column:
    """Bytes or text as trimmed text, null if blank."""
    return code(F.decode(c.cast("binary"), "utf-8"))


def first_id(*columns: Column) -> Column:
    """The first that is not blank; empty if all are."""
    return F.coalesce(*[F.when(clean(c) != "", clean(c)) for c in columns], F.lit(""))


def without_sentinel(c: Column, sentinel: float = -9.99, within: float = 1e-6) -> Column:
    return F.when(F.abs(finite(c) - sentinel) >= within, finite(c))


def sexagesimal(hours_or_degrees: Column, minutes: Column, seconds: Column, sign: Column | None = None) -> Column:
    """Degrees (or hours) of three parts; the sign applies to all of them."""
    value = F.abs(hours_or_degrees.try_cast("double")) + minutes.try_cast("double") / 60 + seconds.try_cast("double") / 3600
    return value if sign is None else F.when(sign == "-", -value).otherwise(value)


def field(line: Column, start: int, end: int) -> Column:
    """Columns ``start`` to ``end`` of a fixed-width line, from 1, trimmed; null if blank."""
    return code(F.substring(line, start, end - start + 1))


def number(line: Column, start: int, end: int) -> Column:
    return field(line, start, end).try_cast("double")


def milliquas_class(kind: Column) -> Column:
    """The optical class letter of a type code."""
    found = F.regexp_extract(kind, "[QABKNS]", 0)
    return F.when(found != "", found)


def milliquas_flags(kind: Column) -> dict[str, Column]:
    """Which associations a type code claims."""
    has = lambda letter: F.coalesce(kind.contains(letter), F.lit(False))
    return {"has_radio": has("R"), "has_xray": has("X"), "has_double_lobe": has("2"), "type_ii": F.coalesce(kind.rlike("[KN]"), F.lit(False))}


_FILTER = re.compile(r"^\s*(>=|<=|>|<|=)?\s*(-?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|-?\.\d+)\s*$")


def header_filter(column: Column, text: str) -> Column | None:
    """A typed filter such as ``>5``; a bare number means at least; unfinished text filters nothing."""
    found = _FILTER.match(text or "")
    if not found:
        return None
    value = float(found[2])
    return {">": column > value, "<": column < value, "<=": column <= value, "=": column == value}.get(found[1], column >= value)


def query_expression(text: str) -> str:
    """A pandas-like row query as SQL: ==, &, |, ~, in [..], not in [..]."""
    out, quoted = [], False
    for part in re.split(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")", text):
        quoted = part[:1] in ("'", '"')
        if quoted:
            out.append("'" + part[1:-1].replace("'", "''") + "'")
            continue
        part = part.replace("==", "=").replace("&&", " and ").replace("&", " and ").replace("||", " or ").replace("|", " or ")
        part = re.sub(r"~\s*", " not ", part)
        out.append(re.sub(r"\[", "(", part).replace("]", ")"))
    return "".join(out)
