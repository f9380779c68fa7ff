"""Ellipsoidal distances (GRS80) as an Arrow kernel: the iteration has no built-in form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf

_A, _F = 6_378_137.0, 1 / 298.257222101
_B = _A * (1 - _F)


def inverse(lon1, lat1, lon2, lat2, rounds: int = 50) -> np.ndarray:
    """Metres between points in degrees (vectorised inverse problem)."""
    u1, u2 = np.arctan((1 - _F) * np.tan(np.radians(lat1))), np.arctan((1 - _F) * np.tan(np.radians(lat2)))
    dl = np.radians(lon2 - lon1)
    lam = dl.copy() if isinstance(dl, np.ndarray) else np.array(dl, float)
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    for _ in range(rounds):
        sin_s = np.hypot(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))
        cos_s = s1 * s2 + c1 * c2 * np.cos(lam)
        sigma = np.arctan2(sin_s, cos_s)
        safe = np.where(sin_s == 0, 1, sin_s)
        sin_a = np.where(sin_s == 0, 0, c1 * c2 * np.sin(lam) / safe)
        cos2 = 1 - sin_a**2
        mid = np.where(cos2 > 0, cos_s - 2 * s1 * s2 / np.where(cos2 > 0, cos2, 1), 0)
        c = _F / 16 * cos2 * (4 + _F * (4 - 3 * cos2))
        new = dl + (1 - c) * _F * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
        if np.all(np.abs(new - lam) < 1e-13):
            lam = new
            break
        lam = new
    k = cos2 * (_A**2 - _B**2) / _B**2
    big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    turn = small * sin_s * (mid + small / 4 * (cos_s * (2 * mid**2 - 1) - small / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
    return _B * big * (sigma - turn)


def metres():
    """A column function (lon1, lat1, lon2, lat2) -> metres."""

    @pandas_udf("double")
    def run(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
        return pd.Series(inverse(lon1.to_numpy(float), lat1.to_numpy(float), lon2.to_numpy(float), lat2.to_numpy(float)))

    return run
