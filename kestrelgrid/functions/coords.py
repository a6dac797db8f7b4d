"""Coordinates, pixels and regions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 and the transverse Mercator zone 46N; fixed values of EPSG:32646.
_A, _F, _K0, _FALSE_EASTING, _LON0 = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0, 93.0


def pixel_index(value: Column, origin: float, step: float) -> Column:
    """Pixel of a coordinate: truncation toward zero, so offsets in (-1, 0) land on pixel 0; null if not finite."""
    off = (value - F.lit(origin)) / F.lit(step)
    return F.when(F.abs(off) < 2_147_483_647.0, off.cast("int"))


def pixel_centre(y: Column, x: Column, geo: list[float]) -> tuple[Column, Column]:
    """(x coordinate, y coordinate) of a pixel's centre by the full affine transform of six numbers."""
    px, py = x + 0.5, y + 0.5
    return geo[0] + px * geo[1] + py * geo[2], geo[3] + px * geo[4] + py * geo[5]


def utm46(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in metres, by Kruger's series to the third order (well below a millimetre within the zone)."""
    n = _F / (2 - _F)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - _LON0)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _FALSE_EASTING + _K0 * radius * east, _K0 * radius * north


def fold_by_latitude(lat: Column, cuts: tuple[float, float, float] = (13.0, 11.5, 10.0)) -> Column:
    """Four latitude bands, from north to south."""
    return F.when(lat >= cuts[0], "North_Andaman").when(lat >= cuts[1], "Middle_Andaman").when(lat >= cuts[2], "South_Andaman").otherwise("Nicobar")


def region(lat: Column, split: float = 10.5, north: str = "Andaman", south: str = "Nicobar") -> Column:
    return F.when(lat >= split, north).when(lat < split, south)


def decimal_places(value: Column) -> Column:
    """Digits after the point of a number's plain decimal text; exponent forms are written out first."""
    text = value.cast("string")
    exponent = F.regexp_extract(text, r"[eE](-?\d+)$", 1).try_cast("int")
    places = F.regexp_extract(text, r"^-?\d+\.(\d+)", 1)
    written_out = F.length(F.regexp_replace(places, "0+$", "")) - exponent  # 1.0E-4 has four places, not five
    return F.when(text.isNull(), F.lit(None)).otherwise(F.greatest(F.lit(0), F.coalesce(written_out, F.length(places))))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float] = (6.0, 14.0, 92.0, 94.5)) -> Column:
    """Inclusive box (lat_min, lat_max, lon_min, lon_max); plain comparisons, so that it reaches the scan."""
    return (lat >= box[0]) & (lat <= box[1]) & (lon >= box[2]) & (lon <= box[3])


def valid_position(lat: Column, lon: Column) -> Column:
    return lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0))
