"""Scalar helpers: rounding, distances, binning, names, dates and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def r6(c: Column | str) -> Column:
    """Six decimals, the form in which results are compared."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def nan_to_null(c: Column) -> Column:
    """NaN as NULL: the rule at every source."""
    return F.when(~F.isnan(c), c)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def stub_parts(stub: Column) -> dict[str, Column]:
    """region, year and cell of a tile name region_yyyy_rXcY."""
    pattern = r"^(.+)_(\d{4})_(r\d+c\d+)$"
    return {name: F.regexp_extract(stub, pattern, i + 1) for i, name in enumerate(("region", "year", "cell"))}


def stub_region(stub: Column) -> Column:
    """A name without its last two parts."""
    return F.regexp_replace(stub, r"_[^_]*_[^_]*$", "")


def stub_with_year(stub: Column, year: int) -> Column:
    """A tile name moved to another year; only the year part before the cell changes."""
    return F.regexp_replace(stub, r"_\d{4}(_r\d+c\d+)$", f"_{year}$1")


def signed_stub(prefix: str, x: Column, digits: int = 4) -> Column:
    """A number as zero-padded text after p (plus) or m (minus)."""
    return F.concat(F.lit(prefix), F.when(x < 0, "m").otherwise("p"), F.lpad(F.abs(x).cast("string"), digits, "0"))


def left_closed_bin(x: Column, start: int, stop: int, step: int) -> Column:
    """The lower edge of a left-closed bin of [start, stop), else NULL."""
    return F.when((x >= start) & (x < stop), (F.floor((x - start) / step) * step + start).cast("int"))


def right_closed_bin(x: Column, edges: list[float]) -> Column:
    """The label (a,b] of a right-closed bin, else NULL."""
    out = None
    for a, b in zip(edges, edges[1:], strict=False):
        label = f"({a:g},{b:g}]"
        cond = (x > a) & (x <= b)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def crop_year(financial_year: Column) -> Column:
    """The calendar year of a season named 2021-22 or 2021–22; other forms give NULL."""
    return F.try_to_number(F.nullif(F.regexp_extract(financial_year, r"^(\d{4})\s*[-–]\s*\d{2}", 1), F.lit("")), F.lit("9999")).cast("int")


def clock_seconds(hms: Column) -> Column:
    """Seconds of HH:MM:SS."""
    part = F.split(hms, ":")
    return part[0].cast("long") * 3600 + part[1].cast("long") * 60 + part[2].cast("long")


def days_after(day: Column, start: Column) -> Column:
    """Whole days from a start date."""
    return F.datediff(day, start)


def log_area_ratio(a: Column, b: Column) -> Column:
    """|ln(a / b)|."""
    return F.abs(F.ln(F.try_divide(a, b)))


def quadkey(tile_x: Column, tile_y: Column, zoom: int) -> Column:
    """The base-4 address of a slippy tile."""
    digit = lambda i: (F.call_function("shiftright", tile_x, i) % 2 + F.call_function("shiftright", tile_y, i) % 2 * 2).cast("string")
    return F.array_join(F.transform(F.sequence(F.lit(zoom - 1), F.lit(0), F.lit(-1)), digit), "")


def slippy_tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the slippy tile that holds a point."""
    n = float(1 << zoom)
    rad = F.radians(lat)
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.ln(F.tan(rad) + 1 / F.cos(rad)) / F.lit(3.141592653589793)) / 2 * n)
    return x, y


def box_degrees(lon: Column, lat: Column, half_m: float) -> dict[str, Column]:
    """A square of 2 * half_m metres around a point, in degrees."""
    dy = F.lit(half_m / 111_320)
    dx = half_m / (111_320 * F.cos(F.radians(lat)))
    return {"west": lon - dx, "south": lat - dy, "east": lon + dx, "north": lat + dy}


def short_md5(c: Column, n: int = 12) -> Column:
    """The first characters of a value's md5."""
    return F.substring(F.md5(c), 1, n)


def albers_constants(lat0: float = 0.0, lat1: float = -18.0, lat2: float = -36.0) -> dict[str, float]:
    """The cone constant n, c, the radius of the origin and the ellipsoid's a, e2 and e, for GRS80."""
    import math

    a, e2 = 6378137.0, 0.00669438002290
    e = math.sqrt(e2)

    def m_of(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)

    def q_of(phi: float) -> float:
        s = math.sin(phi)
        return (1 - e2) * (s / (1 - e2 * s * s) - 1 / (2 * e) * math.log((1 - e * s) / (1 + e * s)))

    p1, p2 = math.radians(lat1), math.radians(lat2)
    n = (m_of(p1) ** 2 - m_of(p2) ** 2) / (q_of(p2) - q_of(p1))
    c = m_of(p1) ** 2 + n * q_of(p1)
    return {"a": a, "e2": e2, "e": e, "n": n, "c": c, "rho0": a * math.sqrt(c - n * q_of(math.radians(lat0))) / n}


def albers(lon: Column, lat: Column, lon0: float = 132.0, **parallels: float) -> tuple[Column, Column]:
    """Equal-area conic metres on GRS80 for a pair of standard parallels."""
    k = albers_constants(**parallels)
    s = F.sin(F.radians(lat))
    q = (1 - k["e2"]) * (s / (1 - k["e2"] * s * s) - 1 / (2 * k["e"]) * F.ln((1 - k["e"] * s) / (1 + k["e"] * s)))
    rho, theta = k["a"] * F.sqrt(k["c"] - k["n"] * q) / k["n"], k["n"] * F.radians(lon - lon0)
    return rho * F.sin(theta), F.lit(k["rho0"]) - rho * F.cos(theta)


def ellipsoid_cell_area(lat_top: Column, res: float) -> Column:
    """Square metres of a res by res degree cell of GRS80 whose upper edge is at a latitude."""
    import math

    a, e2 = 6378137.0, 0.00669438002290
    e = math.sqrt(e2)

    def zone(lat: Column) -> Column:
        s = F.sin(F.radians(lat))
        return s / (2 * (1 - e2 * s * s)) + F.ln((1 + e * s) / (1 - e * s)) / (4 * e)

    b2 = a * a * (1 - e2)
    return b2 * math.radians(res) * (zone(lat_top) - zone(lat_top - res))
