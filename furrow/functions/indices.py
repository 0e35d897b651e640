"""Spectral indices as column functions over reflectance from 0 to 1; missing is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Denominators nearer to zero than this give NULL.
TINY = 1e-6


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is within TINY of zero."""
    return F.when(F.abs(b) >= TINY, F.try_divide(a, b))


def normalised(a: Column, b: Column) -> Column:
    """(a - b) / (a + b)."""
    return safe_ratio(a - b, a + b)


def _bands(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def ndvi() -> Column:
    return normalised(*_bands("nir", "red"))


def ndyi() -> Column:
    return normalised(*_bands("green", "blue"))


def cfi() -> Column:
    """Canola flower index; not scale-free, so an index of medians differs from a median of indices."""
    red, green, blue = _bands("red", "green", "blue")
    return ndvi() * ((red + green) + (green - blue))


def ndre() -> Column:
    return normalised(*_bands("nir", "re1"))


def ndre2() -> Column:
    return normalised(*_bands("nir", "re2"))


def ndwi() -> Column:
    return normalised(*_bands("green", "nir"))


def nbr() -> Column:
    return normalised(*_bands("nir", "sw3"))


def gndvi() -> Column:
    return normalised(*_bands("nir", "green"))


def psri() -> Column:
    red, blue, re3 = _bands("red", "blue", "re3")
    return safe_ratio(red - blue, re3)


def swir_ratio() -> Column:
    return safe_ratio(*_bands("sw2", "sw3"))


def evi() -> Column:
    nir, red, blue = _bands("nir", "red", "blue")
    return safe_ratio(2.5 * (nir - red), nir + 6 * red - 7.5 * blue + 1)


def evi2() -> Column:
    nir, red = _bands("nir", "red")
    return safe_ratio(2.5 * (nir - red), nir + 2.4 * red + 1)


def savi() -> Column:
    nir, red = _bands("nir", "red")
    return safe_ratio(1.5 * (nir - red), nir + red + 0.5)


def ci_red_edge() -> Column:
    return safe_ratio(*_bands("nir", "re1")) - 1


def vi2() -> Column:
    red, blue, re1, re2 = _bands("red", "blue", "re1", "re2")
    return (re2 + red) - (re1 - blue)


def vi3() -> Column:
    red, green, blue, re1 = _bands("red", "green", "blue", "re1")
    return (re1 + green) - (blue + red)


def vdvi() -> Column:
    red, green, blue = _bands("red", "green", "blue")
    return safe_ratio(2 * green - red - blue, 2 * green + red + blue)


def vci() -> Column:
    """Squared contrast of a red-green mix with red against that with blue."""
    nir, red, green, blue = _bands("nir", "red", "green", "blue")
    mix = 0.38 * (nir - green) + green
    return safe_ratio((mix - red) * (mix - red), (mix - blue) * (mix - blue))


def evi2_ramped() -> Column:
    """The two-band EVI with unit weights below the line."""
    nir, red = _bands("nir", "red")
    return safe_ratio(2.4 * (nir - red), nir + red + 1)


def decibel(power: Column) -> Column:
    """10 log10 of a positive power, else NULL."""
    return F.when(power > 0, 10 * F.log10(power))


def presto_normalised(x: Column, add: float, div: float) -> Column:
    """A channel shifted and scaled for the embedding model."""
    return (x + add) / div


def half_up_percent(basis_points: Column, top: int = 100) -> Column:
    """Basis points to whole percent, halves up, at most ``top``."""
    return F.least(F.floor((basis_points + 50) / 100), F.lit(top))


INDICES = {
    "ndvi": ndvi, "ndyi": ndyi, "cfi": cfi, "ndre": ndre, "ndwi": ndwi, "nbr": nbr, "psri": psri, "swir_ratio": swir_ratio,
    "evi": evi, "evi2": evi2, "savi": savi, "gndvi": gndvi, "ci_red_edge": ci_red_edge, "ndre2": ndre2, "vi2": vi2, "vi3": vi3,
    "vdvi": vdvi, "vci": vci, "evi2_ramped": evi2_ramped,
}
