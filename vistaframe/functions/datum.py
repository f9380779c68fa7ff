"""Transverse Mercator grids on any ellipsoid, and the change of datum between two of them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semi-major axis and flattening.
BESSEL = (6_377_397.155, 1 / 299.1528128)
GRS80 = (6_378_137.0, 1 / 298.257222101)
#: Fixed values of EPSG:5174 and EPSG:5186: ellipsoid, longitude and latitude of origin,
#: false easting and northing (scale 1).
KATECH_MODIFIED = (BESSEL, 127.0028902777778, 38.0, 200_000.0, 500_000.0)
KOREA_2000 = (GRS80, 127.0, 38.0, 200_000.0, 600_000.0)
#: Shifts (m), rotations (seconds of arc, position vector) and scale (ppm)
#: from the first datum to the second.
HELMERT = (-115.8, 474.99, 674.11, 1.16, -2.31, -1.63, 6.43)


def _series(f: float) -> tuple[float, tuple, tuple]:
    n = f / (2 - f)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    return (1 + n**2 / 4 + n**4 / 64) / (1 + n), alpha, beta


def _origin(grid: tuple) -> float:
    (a, f), _, lat0, _, _ = grid
    size, alpha, _ = _series(f)
    e = math.sqrt(f * (2 - f))
    s = math.sin(math.radians(lat0))
    xi = math.atan(math.sinh(math.atanh(s) - e * math.atanh(e * s)))
    return a * size * (xi + sum(c * math.sin(2 * (j + 1) * xi) for j, c in enumerate(alpha)))


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _named(**fields: Column) -> Column:
    return F.struct(*[c.alias(name) for name, c in fields.items()])


def forward(point: Column, grid: tuple) -> Column:
    """struct(x, y), easting and northing, of a point struct(lon, lat) in degrees."""
    (a, f), lon0, _, east, north = grid
    size, alpha, _ = _series(f)
    e = math.sqrt(f * (2 - f))

    def planar(w: Column) -> Column:
        x, y = w["eta"], w["xi"]
        for j, c in enumerate(alpha):
            k = 2 * (j + 1)
            x, y = x + c * F.cos(k * w["xi"]) * F.sinh(k * w["eta"]), y + c * F.sin(k * w["xi"]) * F.cosh(k * w["eta"])
        return _named(x=east + a * size * x, y=north + a * size * y - _origin(grid))

    start = _named(s=F.sin(F.radians(point["lat"])), lam=F.radians(point["lon"] - lon0))
    sphere = lambda q: _named(t=F.sinh(F.atanh(q["s"]) - e * F.atanh(e * q["s"])), lam=q["lam"])
    turned = lambda q: _named(xi=F.atan2(q["t"], F.cos(q["lam"])), eta=F.atanh(F.sin(q["lam"]) / F.sqrt(1 + q["t"] * q["t"])))
    return _let(start, lambda q: _let(sphere(q), lambda r: _let(turned(r), planar)))


def inverse(point: Column, grid: tuple) -> Column:
    """struct(lon, lat) in degrees of a point struct(x, y), easting and northing."""
    (a, f), lon0, _, east, north = grid
    size, _, beta = _series(f)
    e = math.sqrt(f * (2 - f))

    def conformal(q: Column) -> Column:
        u, v = q["xi"], q["eta"]
        for j, c in enumerate(beta):
            k = 2 * (j + 1)
            u, v = u - c * F.sin(k * q["xi"]) * F.cosh(k * q["eta"]), v - c * F.cos(k * q["xi"]) * F.sinh(k * q["eta"])
        return _named(u=u, v=v)

    def geographic(q: Column) -> Column:
        phi = F.asin(q["chi"])
        for _ in range(5):  # the conformal latitude back to the geographic one
            phi = F.asin(F.tanh(F.atanh(q["chi"]) + e * F.atanh(e * F.sin(phi))))
        return _named(lon=lon0 + F.degrees(q["lam"]), lat=F.degrees(phi))

    sphere = lambda q: _named(lam=F.atan2(F.sinh(q["v"]), F.cos(q["u"])), chi=F.sin(q["u"]) / F.cosh(q["v"]))
    start = _named(eta=(point["x"] - east) / (a * size), xi=(point["y"] - north + _origin(grid)) / (a * size))
    return _let(start, lambda q: _let(conformal(q), lambda r: _let(sphere(r), geographic)))


def moved(point: Column, source: tuple, target: tuple, helmert: tuple = HELMERT) -> Column:
    """struct(lon, lat) of a point on the target ellipsoid, by seven parameters."""
    dx, dy, dz, rx, ry, rz, ppm = helmert
    rx, ry, rz = (math.radians(r / 3600) for r in (rx, ry, rz))
    m, e2 = 1 + ppm * 1e-6, source[1] * (2 - source[1])
    a, b, f2 = target[0], target[0] * (1 - target[1]), target[1] * (2 - target[1])

    def geocentric(q: Column) -> Column:
        n = source[0] / F.sqrt(1 - e2 * F.pow(F.sin(q["phi"]), 2))
        return _named(x=n * F.cos(q["phi"]) * F.cos(q["lam"]), y=n * F.cos(q["phi"]) * F.sin(q["lam"]), z=n * (1 - e2) * F.sin(q["phi"]))

    shifted = lambda q: _named(x=dx + m * (q["x"] - rz * q["y"] + ry * q["z"]), y=dy + m * (rz * q["x"] + q["y"] - rx * q["z"]), z=dz + m * (-ry * q["x"] + rx * q["y"] + q["z"]))
    angle = lambda q: _named(p=F.sqrt(q["x"] * q["x"] + q["y"] * q["y"]), z=q["z"], lon=F.atan2(q["y"], q["x"]))

    def geographic(q: Column) -> Column:
        # Bowring's formula: exact to well below a millimetre near the ground
        bow = lambda t: F.atan2(q["z"] + f2 / (1 - f2) * b * F.pow(F.sin(t), 3), q["p"] - f2 * a * F.pow(F.cos(t), 3))
        return _named(lon=F.degrees(q["lon"]), lat=F.degrees(_let(F.atan2(q["z"] * a, q["p"] * b), bow)))

    start = _named(phi=F.radians(point["lat"]), lam=F.radians(point["lon"]))
    return _let(start, lambda q: _let(geocentric(q), lambda r: _let(shifted(r), lambda w: _let(angle(w), geographic))))


def regridded(x: Column, y: Column, source: tuple = KATECH_MODIFIED, target: tuple = KOREA_2000, helmert: tuple = HELMERT) -> Column:
    """struct(x, y): easting and northing of one grid as those of another."""
    start = _named(x=x.cast("double"), y=y.cast("double"))
    return _let(start, lambda p: _let(inverse(p, source), lambda q: _let(moved(q, source[0], target[0], helmert), lambda r: forward(r, target))))
