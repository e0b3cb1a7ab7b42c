"""Observing bands: names, frequencies, colours."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band names, centre frequencies in Hz, overlay colours.
COLOR_BANDS = ("Full", "Blue", "Green", "Red")
ASSOC_BANDS = ("Blue", "Green", "Red")
SUBBANDS = tuple(f"{m}MHz" for m in (18, 23, 27, 32, 36, 41, 46, 50, 55, 59, 64, 69, 73, 78, 82))
GLEAM_BANDS = tuple(f"GLEAM{m}" for m in (76, 84, 92, 99, 107, 115, 122, 130, 143, 151, 158, 166, 174, 181, 189, 197, 204, 212, 220, 227))
RADIO_SURVEYS = ("VLSSR", "NVSS", "VLASS", "LoDeSS")
FREQUENCY_HZ = {
    "Full": 57_200_637.276411,
    "Blue": 73_956_883.683421,
    "Green": 51_675_007.041984,
    "Red": 34_599_742.150104,
    "VLSSR": 74e6,
    "NVSS": 1.4e9,
    "VLASS": 3.0e9,
    "LoDeSS": 23e6,
    **{b: float(b[5:]) * 1e6 for b in GLEAM_BANDS},
}
COLORS = {"Full": "#fdd835", "Blue": "#42a5f5", "Green": "#66bb6a", "Red": "#ff5252"}
REFERENCE_MHZ = 55.0
SPECTRAL_PAIRS = (("RG", "Red", "Green"), ("GB", "Green", "Blue"))

_MHZ = re.compile(r"^(\d+)MHz$", re.IGNORECASE)


def normalize(label: str) -> str | None:
    """A colour band or ``{n}MHz`` in canonical spelling, else None."""
    text = str(label).strip()
    named = {b.lower(): b for b in COLOR_BANDS}.get(text.lower())
    found = _MHZ.match(text)
    return named or (f"{int(found[1])}MHz" if found else None)


def frequency_hz(band: str) -> float | None:
    key = str(band).strip()
    found = _MHZ.match(key)
    return FREQUENCY_HZ.get(key) or (float(found[1]) * 1e6 if found else None)


def normalize_column(label: Column) -> Column:
    text = F.trim(label)
    out = F.when(text.rlike(r"(?i)^\d+MHz$"), F.concat(F.regexp_extract(text, r"^(\d+)", 1).cast("long").cast("string"), F.lit("MHz")))
    for b in COLOR_BANDS:
        out = F.when(F.lower(text) == b.lower(), F.lit(b)).otherwise(out)
    return out


def frequency_column(label: Column) -> Column:
    text = F.trim(label)
    known = F.create_map(*[F.lit(x) for pair in FREQUENCY_HZ.items() for x in pair])
    return F.coalesce(F.try_element_at(known, text), F.regexp_extract(text, r"(?i)^(\d+)MHz$", 1).try_cast("double") * 1e6)


def in_order(bands: list[str]) -> list[str]:
    """Discovered bands: colour bands in their order, or subbands by rising frequency."""
    colours = [b for b in COLOR_BANDS if b in bands]
    return colours + sorted((b for b in bands if b not in colours), key=lambda b: (frequency_hz(b) or float("inf"), b))


def seed_band(bands: list[str]) -> str:
    """The band that starts a fusion: the highest subband, else Full, else the first."""
    if not bands:
        raise ValueError("no band")
    mhz = [b for b in bands if _MHZ.match(b)]
    return max(mhz, key=frequency_hz) if mhz else "Full" if "Full" in bands else bands[0]


def color(band: str, low: float = 18.0, high: float = 82.0) -> str | None:
    """Overlay colour: red at the low end of the subbands, blue at the high end."""
    name = normalize(band)
    if name is None or name in COLORS:
        return COLORS.get(name)
    share = 0.5 if high <= low else min(1.0, max(0.0, (frequency_hz(name) / 1e6 - low) / (high - low)))
    ends = [[int(COLORS[b][k : k + 2], 16) for k in (1, 3, 5)] for b in ("Red", "Blue")]
    return "#" + "".join(f"{round(a + (b - a) * share):02x}" for a, b in zip(*ends))


def color_column(band: Column, low: float = 18.0, high: float = 82.0) -> Column:
    mhz = F.regexp_extract(F.trim(band), r"(?i)^(\d+)MHz$", 1).try_cast("double")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (mhz - low) / (high - low)))
    parts = [F.lpad(F.lower(F.hex(F.round(int(COLORS["Red"][k : k + 2], 16) + (int(COLORS["Blue"][k : k + 2], 16) - int(COLORS["Red"][k : k + 2], 16)) * share).cast("long"))), 2, "0") for k in (1, 3, 5)]
    return F.concat(F.lit("#"), *parts)


def band_of_catalog(name: Column) -> Column:
    """The band a catalogue file is named after."""
    return normalize_column(F.regexp_extract(name, r"(?i)(?:^|[_.\-/])(Full|Blue|Green|Red|\d+MHz)(?=$|[_.\-])", 1))


def csv(column: Column) -> Column:
    """Parts of a comma-separated list, without blanks and ``nan``."""
    parts = F.transform(F.split(F.coalesce(column, F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: (x != "") & (F.lower(x) != "nan"))


def has_band(bands_present: Column, band: str) -> Column:
    return F.array_contains(csv(bands_present), band)


def add_bands(bands_present: Column, *bands: str, order=COLOR_BANDS) -> Column:
    """The list with more bands: those of ``order`` first, then as they came."""
    every = F.array_distinct(F.concat(csv(bands_present), F.array(*[F.lit(b) for b in bands])))
    first = F.filter(F.array(*[F.lit(b) for b in order]), lambda x: F.array_contains(every, x))
    return F.array_join(F.array_distinct(F.concat(first, every)), ",")
