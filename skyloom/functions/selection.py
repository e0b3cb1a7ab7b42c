"""Row predicates that select parts of a catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.sphere import elevation, finite, positive


def shape_complete(maj: str = "Maj", min_: str = "Min", pa: str = "PA") -> Column:
    """Whether a row has both axes and an angle."""
    return positive(maj).isNotNull() & positive(min_).isNotNull() & finite(pa).isNotNull()


def ellipse_visible(fov_deg: float, least_fraction: float = 0.002, maj: str = "Maj") -> Column:
    """Whether an ellipse is large enough to be seen in a field."""
    return F.coalesce(positive(maj) >= fov_deg * least_fraction, F.lit(False))


def has_flux(columns: Sequence[str], band: str | None = None) -> Column:
    """Whether a row has a flux: the total of a band, else its peak; without a band any flux at all."""
    end = f"_{band}" if band else ""
    names = [c for c in (f"Total_flux{end}", f"Peak_flux{end}") if c in columns]
    if band is None:
        names += [c for c in columns if c.startswith(("Total_flux_", "Peak_flux_")) and not c.startswith("Peak_flux_std")]
    out = F.lit(False)
    for c in names:
        out = out | finite(c).isNotNull()
    return out


def band_flux(columns: Sequence[str], band: str) -> Column:
    """Total flux of a band, else its peak."""
    have = [finite(f"{f}_{band}") for f in ("Total_flux", "Peak_flux") if f"{f}_{band}" in columns]
    return F.coalesce(*have) if have else F.lit(None).cast("double")


def above_elevation(ra, dec, lst, least_deg: float) -> Column:
    """Strictly above an elevation at a labelled hour."""
    return F.coalesce(elevation(ra, dec, lst) > least_deg, F.lit(False))


def folded(column: str, wanted: Sequence[str]) -> Column:
    """Whether a text is one of several, whatever the case and outer blanks."""
    return F.upper(F.trim(F.col(column))).isin(*[w.strip().upper() for w in wanted])


def science_sample(p_star: float = 0.51, p_pair: float = 0.5) -> Column:
    """Stars with secure identifications that are not known to be subdwarfs."""
    return (F.col("pstellar") > p_star) & (F.col("pij") > p_pair) & ~F.coalesce(F.col("subdwarf"), F.lit(False))


def nearby(z_max: float | None = None, distance_max: float | None = None, z: str = "z", distance: str = "DistMpc") -> Column:
    """Redshift within [0, z_max] and distance within [0, distance_max]."""
    out = F.lit(True)
    if z_max is not None:
        out = out & F.coalesce(finite(z).between(0.0, z_max), F.lit(False))
    if distance_max is not None:
        out = out & F.coalesce(finite(distance).between(0.0, distance_max), F.lit(False))
    return out
