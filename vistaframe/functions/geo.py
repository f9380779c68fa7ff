"""Angles, distances, projections and the sun, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SPHERE_M = 6_371_008.8
EARTH_DIAMETER_M = 12_756_274.0
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres; the square root is clamped so that antipodes stay finite."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2 * SPHERE_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def initial_bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def planar_bearing(dx: Column, dy: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def angle_gap(a: Column, b: Column) -> Column:
    """Unsigned difference of two bearings, 0 to 180."""
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def compass(bearing: Column) -> Column:
    at = (F.floor((bearing + 22.5) / 45) % 8 + 1).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in COMPASS]), at)


def elevation_angle(dz: Column, d: Column) -> Column:
    return F.degrees(F.atan2(dz, F.greatest(F.lit(0.001), d)))


def finite(c: Column) -> Column:
    """The number in a string or numeric column, null unless finite."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


# GRS80 and the transverse Mercator of EPSG:5186 (fixed values)
_A, _F = 6_378_137.0, 1 / 298.257222101
_LON0, _LAT0, _E0, _N0 = 127.0, 38.0, 200_000.0, 600_000.0
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_ECC = math.sqrt(_F * (2 - _F))


def _meridian() -> float:
    s = math.sin(math.radians(_LAT0))
    xi = math.atan(math.sinh(math.atanh(s) - _ECC * math.atanh(_ECC * s)))
    return _RADIUS * (xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(_ALPHA)))


_M0 = _meridian()



def to_plane(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing of the Krueger series."""
    s = F.sin(F.radians(lat))
    t = F.sinh(_atanh(s) - _ECC * _atanh(_ECC * s))
    lam = F.radians(lon - _LON0)
    xi, eta = F.atan2(t, F.cos(lam)), _atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA):
        k = 2 * (j + 1)
        x = x + a * F.cos(k * xi) * F.sinh(k * eta)
        y = y + a * F.sin(k * xi) * F.cosh(k * eta)
    return _E0 + _RADIUS * x, _N0 + _RADIUS * y - _M0


def _atanh(c: Column) -> Column:
    return F.lit(0.5) * F.log((1 + c) / (1 - c))


def to_plane_sql(lon: str, lat: str) -> tuple[str, str]:
    """The same series as SQL text (for oracles)."""
    atanh = lambda c: f"0.5 * ln((1 + ({c})) / (1 - ({c})))"
    sinh = lambda c: f"((exp({c}) - exp(-({c}))) / 2)"
    cosh = lambda c: f"((exp({c}) + exp(-({c}))) / 2)"
    s = f"sin(radians({lat}))"
    t = sinh(f"({atanh(s)}) - {_ECC!r} * ({atanh(f'{_ECC!r} * {s}')})")
    lam = f"radians({lon} - {_LON0})"
    xi, eta = f"atan2({t}, cos({lam}))", atanh(f"sin({lam}) / sqrt(1 + {t} * {t})")
    x, y = f"({eta})", xi
    for j, a in enumerate(_ALPHA):
        k = 2 * (j + 1)
        x += f" + {a!r} * cos({k} * {xi}) * {sinh(f'{k} * ({eta})')}"
        y += f" + {a!r} * sin({k} * {xi}) * {cosh(f'{k} * ({eta})')}"
    return f"{_E0} + {_RADIUS!r} * ({x})", f"{_N0} + {_RADIUS!r} * ({y}) - {_M0!r}"


def sun(lon: Column, lat: Column, at: Column) -> tuple[Column, Column, Column]:
    """Altitude, azimuth (degrees) and phase of the sun by the fractional-year series."""
    year = F.year(at)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    hour = F.hour(at) + F.minute(at) / 60 + F.second(at) / 3600
    g = F.lit(2 * math.pi) / F.when(leap, 366).otherwise(365) * (F.dayofyear(at) - 1 + (hour - 12) / 24)
    eq = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    dec = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    ha = F.radians(F.pmod(hour * 60 + eq + 4 * lon, F.lit(1440.0)) / 4 - 180)
    phi = F.radians(lat)
    rise = F.sin(phi) * F.sin(dec) + F.cos(phi) * F.cos(dec) * F.cos(ha)
    altitude = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rise))))
    azimuth = F.pmod(F.degrees(F.atan2(F.sin(ha), F.cos(ha) * F.sin(phi) - F.tan(dec) * F.cos(phi))) + 180, F.lit(360.0))
    phase = F.when(altitude > 0, "daylight").when(altitude > -6, "twilight").otherwise("night")
    return altitude, azimuth, phase
