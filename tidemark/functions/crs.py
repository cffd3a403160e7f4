"""Reference systems: identifiers, and projections of a closed set as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.geometry import let

#: Spherical radius of web mercator, and ellipsoids (fixed values).
MERCATOR_RADIUS = 6378137.0
WGS84 = (6378137.0, 1 / 298.257223563)
GRS80 = (6378137.0, 1 / 298.257222101)

#: Geographic systems that agree with EPSG:4326 to within the accuracy of a box (fixed values).
GEOGRAPHIC = {"EPSG:4326", "EPSG:4167", "OGC:CRS84", "CRS84"}


def transverse_parameters(crs: str) -> tuple | None:
    """``ellipsoid, central meridian, scale, false easting, false northing`` of a transverse Mercator system."""
    if crs == "EPSG:2193":
        return GRS80, 173.0, 0.9996, 1600000.0, 10000000.0
    if crs.startswith(("EPSG:326", "EPSG:327")) and len(crs) == 10:
        zone = int(crs[-2:])
        if 1 <= zone <= 60:
            return WGS84, zone * 6.0 - 183.0, 0.9996, 500000.0, 10000000.0 if crs[7] == "7" else 0.0
    return None


def identifier(wkt: Column) -> Column:
    """``AUTHORITY:code`` of a definition, else its code, else its name, else ``CUSTOM:n``.

    Only the authority of the outermost node counts: the last one in the text.
    """
    tail = F.regexp_extract(wkt, r'(?s)AUTHORITY\["([^"]+)",\s*"?([^"\]]+)"?\]\s*\]\s*$', 1)
    code = F.regexp_extract(wkt, r'(?s)AUTHORITY\["([^"]*)",\s*"?([^"\]]+)"?\]\s*\]\s*$', 2)
    name = F.regexp_extract(wkt, r'^\s*[A-Z_]+\["([^"]+)"', 1)
    return (
        F.when((tail != "") & (code != ""), F.concat_ws(":", tail, code))
        .when(code != "", code)
        .when(name != "", name)
        .otherwise(F.concat(F.lit("CUSTOM:"), custom_number(wkt).cast("string")))
    )


def custom_number(wkt: Column) -> Column:
    """A number in 200000..209199 made from the definition's text."""
    from tidemark.functions.hashing import uint32_hash

    return uint32_hash(wkt) % 9200 + 200000


def identifier_number(wkt: Column) -> Column:
    """The numeric code if there is one, else the number made from the text."""
    code = F.regexp_extract(wkt, r'(?s)AUTHORITY\["[^"]*",\s*"?(\d+)"?\]\s*\]\s*$', 1)
    return F.when(code != "", code.cast("bigint")).otherwise(custom_number(wkt))


def same_crs(a: Column, b: Column) -> Column:
    """Equal text once spacing is ignored, or the same identifier."""
    def squeezed(c: Column) -> Column:
        return F.regexp_replace(c, r"\s+", "")

    return (squeezed(a) == squeezed(b)) | (identifier(a) == identifier(b))


def _series(n: float) -> tuple[list[float], list[float], float]:
    """Forward and inverse coefficients of the transverse Mercator series, and the radius factor."""
    alpha = [
        n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4,
        13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4,
        61 / 240 * n**3 - 103 / 140 * n**4,
        49561 / 161280 * n**4,
    ]
    beta = [
        n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - 1 / 360 * n**4,
        1 / 48 * n**2 + 1 / 15 * n**3 - 437 / 1440 * n**4,
        17 / 480 * n**3 - 37 / 840 * n**4,
        4397 / 161280 * n**4,
    ]
    return alpha, beta, (1 + n**2 / 4 + n**4 / 64) / (1 + n)


def from_lonlat(crs: str, lon: Column, lat: Column) -> tuple[Column, Column]:
    if crs in GEOGRAPHIC:
        return lon, lat
    if crs == "EPSG:3857":
        x = F.radians(lon) * MERCATOR_RADIUS
        y = F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR_RADIUS
        return x, y
    params = transverse_parameters(crs)
    if params is None:
        raise ValueError(f"reference system {crs} is not supported")
    (a, f), lon0, k0, fe, fn = params
    n = f / (2 - f)
    alpha, _, factor = _series(n)
    radius = a * factor
    e = math.sqrt(f * (2 - f))
    phi, lam = F.radians(lat), F.radians(lon - lon0)
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(phi)))
    xi0 = F.atan2(t, F.cos(lam))
    eta0 = F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    xi, eta = xi0, eta0
    for j, c in enumerate(alpha, 1):
        xi = xi + F.lit(c) * F.sin(xi0 * (2 * j)) * F.cosh(eta0 * (2 * j))
        eta = eta + F.lit(c) * F.cos(xi0 * (2 * j)) * F.sinh(eta0 * (2 * j))
    return F.lit(fe) + eta * (k0 * radius), F.lit(fn) + xi * (k0 * radius)


def _unprojected(params: tuple, x: Column, y: Column, hold: Callable[[Column, Callable[[Column], Column]], Column]) -> Column:
    """Struct ``x, y`` in degrees of a transverse Mercator point; ``hold(value, body)`` binds what later steps name often."""
    (a, f), lon0, k0, fe, fn = params
    n = f / (2 - f)
    _, beta, factor = _series(n)
    radius = a * factor
    e2 = f * (2 - f)

    def conformal(g: Column) -> Column:
        xi, eta = g["xi"], g["eta"]
        xi0, eta0 = xi, eta
        for j, c in enumerate(beta, 1):
            xi0 = xi0 - F.lit(c) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
            eta0 = eta0 - F.lit(c) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        return hold(F.struct(xi0.alias("xi"), eta0.alias("eta")), angles)

    def angles(g: Column) -> Column:
        chi = F.asin(F.sin(g["xi"]) / F.cosh(g["eta"]))
        lam = F.atan2(F.sinh(g["eta"]), F.cos(g["xi"]))
        return hold(F.struct(chi.alias("chi"), (F.degrees(lam) + lon0).alias("lon")), degrees)

    def degrees(g: Column) -> Column:
        # Latitude from conformal latitude by its series in the eccentricity.
        e4, e6, e8 = e2**2, e2**3, e2**4
        chi, lon = g["chi"], g["lon"]
        phi = (
            chi
            + F.sin(chi * 2) * (e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360)
            + F.sin(chi * 4) * (7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520)
            + F.sin(chi * 6) * (7 * e6 / 120 + 81 * e8 / 1120)
            + F.sin(chi * 8) * (4279 * e8 / 161280)
        )
        wrapped = F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon)
        return F.struct(wrapped.alias("x"), F.degrees(phi).alias("y"))

    return hold(F.struct(((y - fn) / (k0 * radius)).alias("xi"), ((x - fe) / (k0 * radius)).alias("eta")), conformal)


def to_lonlat(crs: str, x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees of a projected point; longitudes fall into -180..180 as projections leave them."""
    if crs in GEOGRAPHIC:
        return x, y
    if crs == "EPSG:3857":
        lon = F.degrees(x / MERCATOR_RADIUS)
        lat = F.degrees(F.atan(F.sinh(y / MERCATOR_RADIUS)))
        return lon, lat
    params = transverse_parameters(crs)
    if params is None:
        raise ValueError(f"reference system {crs} is not supported")
    place = _unprojected(params, x, y, lambda value, body: body(value))
    return place["x"], place["y"]


def lonlat_point(crs: str, x: Column, y: Column) -> Column:
    """:func:`to_lonlat` as a struct ``x, y`` that works out each step once.

    For lambdas, where Spark does not share what an expression names twice.
    """
    params = transverse_parameters(crs)
    if params is None:
        lon, lat = to_lonlat(crs, x, y)
        return F.struct(lon.alias("x"), lat.alias("y"))
    return _unprojected(params, x, y, let)


def reproject_xy(source: str, target: str, x: Column, y: Column) -> tuple[Column, Column]:
    if source == target:
        return x, y
    return from_lonlat(target, *to_lonlat(source, x, y))
