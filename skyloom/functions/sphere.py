"""Column expressions on the celestial sphere. Angles are degrees, missing values null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Geodetic latitude of the observatory.
LATITUDE = 37.239777

# The rotation from ICRS to galactic coordinates (rows x, y, z).
GALACTIC = (
    (-0.0548755604162154, -0.8734370902348850, -0.4838350155487132),
    (0.4941094278755837, -0.4448296299600112, 0.7469822444972189),
    (-0.8676661490190047, -0.1980763734312015, 0.4559837761750669),
)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def finite(x) -> Column:
    """The value as a double, null where it is NaN or infinite."""
    d = _c(x).cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def positive(x) -> Column:
    d = finite(x)
    return F.when(d > 0, d)


def wrap_ra(x) -> Column:
    """Right ascension in [0, 360)."""
    return F.pmod(_c(x).cast("double"), F.lit(360.0))


def wrap_ra_columns(df: DataFrame) -> DataFrame:
    """Wraps RA and every RA_* column."""
    return df.withColumns({c: wrap_ra(F.col(f"`{c}`")) for c in df.columns if c == "RA" or c.startswith("RA_")})


def separation(ra1, dec1, ra2, dec2) -> Column:
    """Great-circle distance (haversine)."""
    d1, d2 = F.radians(_c(dec1)), F.radians(_c(dec2))
    a = F.pow(F.sin((d2 - d1) / 2), 2) + F.cos(d1) * F.cos(d2) * F.pow(F.sin(F.radians(_c(ra2) - _c(ra1)) / 2), 2)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def unit_vector(ra, dec) -> tuple[Column, Column, Column]:
    a, d = F.radians(_c(ra)), F.radians(_c(dec))
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def lst_hours(label) -> Column:
    """Hours of a label such as ``07h`` or a bare number; null if it is neither."""
    return F.rtrim(F.lower(F.trim(_c(label).cast("string"))), F.lit("h")).try_cast("double")


def elevation(ra, dec, lst, latitude: float = LATITUDE) -> Column:
    """Elevation of a source when the zenith lies at right ascension ``lst`` (a label)."""
    return 90.0 - separation(lst_hours(lst) * 15.0, latitude, ra, dec)


def hour_separation(a, b) -> Column:
    """Distance of two times on the 24 hour circle."""
    return F.abs(F.pmod(_c(a) - _c(b) + 12.0, F.lit(24.0)) - 12.0)


def near_transit(ra, lst, window_hours: float) -> Column:
    """Whether a detection was made within so many hours of its transit."""
    if window_hours < 0:
        raise ValueError("the window must not be negative")
    return F.coalesce(hour_separation(lst_hours(lst), finite(ra) / 15.0) <= window_hours, F.lit(False))


def galactic(ra, dec) -> tuple[Column, Column]:
    """Galactic longitude in [0, 360) and latitude."""
    v = unit_vector(ra, dec)
    x, y, z = (sum((k * c for k, c in zip(row[1:], v[1:])), row[0] * v[0]) for row in GALACTIC)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z))))


def equatorial(lon, lat) -> tuple[Column, Column]:
    """Right ascension and declination of galactic coordinates."""
    v = unit_vector(lon, lat)
    x, y, z = (sum((GALACTIC[k][j] * v[k] for k in (1, 2)), GALACTIC[0][j] * v[0]) for j in range(3))
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z))))


def offsets(ra1, dec1, ra2, dec2, wrapped: bool = False) -> tuple[Column, Column, Column]:
    """Tangent-plane offsets of position 2 from 1: along RA, along Dec, and their length.

    The plain form does not wrap RA at 360 degrees.
    """
    dra = _c(ra2) - _c(ra1)
    if wrapped:
        dra = F.pmod(dra + 180.0, F.lit(360.0)) - 180.0
    x, y = dra * F.cos(F.radians(_c(dec1))), _c(dec2) - _c(dec1)
    return x, y, F.hypot(x, y)


def widest_pair(positions: Column) -> Column:
    """Largest separation among an array of structs (ra, dec); null for fewer than two."""
    pairs = F.flatten(F.transform(positions, lambda a: F.transform(positions, lambda b: separation(a["ra"], a["dec"], b["ra"], b["dec"]))))
    return F.when(F.size(positions) >= 2, F.array_max(pairs))


def parse_position(text: str) -> tuple[float, float]:
    """(RA, Dec) in degrees of a pair of degrees or of sexagesimal hours and degrees."""
    import re

    parts = [p for p in re.split(r"[\s,]+", text.strip()) if p]
    if len(parts) == 2 and not any(re.search(r"[:hdms]", p) for p in parts):
        ra, dec = float(parts[0]), float(parts[1])
    else:
        if len(parts) == 6:
            parts = [" ".join(parts[:3]), " ".join(parts[3:])]
        if len(parts) != 2:
            raise ValueError(f"not a position: {text!r}")

        def sexagesimal(t: str) -> float:
            sign = -1.0 if t.lstrip().startswith("-") else 1.0
            n = [float(x) for x in re.findall(r"\d+(?:\.\d+)?", t)]
            return sign * sum(v / 60**k for k, v in enumerate(n))

        ra, dec = 15.0 * sexagesimal(parts[0]), sexagesimal(parts[1])
    if not -90 <= dec <= 90:
        raise ValueError(f"not a declination: {dec}")
    return ra % 360.0, dec


def _six_places(x) -> Column:
    """Six decimals of a value below 1e9, as C's printf writes them: its exact binary value rounded, ties to even.

    ``format_string`` would round the shortest decimal instead, and halves up.
    """
    d = _c(x).cast("double")
    return F.when(finite(d).isNotNull(), F.call_function("format_number", d, F.lit("0.000000"))).when(F.isnan(d), "nan").when(d > 0, "inf").when(d < 0, "-inf")


def position_label(ra, dec) -> Column:
    return F.concat(_six_places(ra), F.lit(" "), _six_places(dec))


def position_key(ra, dec) -> Column:
    return F.concat(_six_places(ra), F.lit(","), _six_places(dec))
