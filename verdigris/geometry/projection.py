"""UTM on the WGS 84 ellipsoid, by Krüger's series to the sixth order, and choosing a zone."""

from __future__ import annotations

import math

import numpy as np

_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_R = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
_K0, _E0 = 0.9996, 500000.0
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180 - 127 * _N**5 / 288 + 7891 * _N**6 / 37800,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440 + 281 * _N**5 / 630 - 1983433 * _N**6 / 1935360,
    61 * _N**3 / 240 - 103 * _N**4 / 140 + 15061 * _N**5 / 26880 + 167603 * _N**6 / 181440,
    49561 * _N**4 / 161280 - 179 * _N**5 / 168 + 6601661 * _N**6 / 7257600,
    34729 * _N**5 / 80640 - 3418889 * _N**6 / 1995840,
    212378941 * _N**6 / 319334400,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360 - 81 * _N**5 / 512 + 96199 * _N**6 / 604800,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440 + 46 * _N**5 / 105 - 1118711 * _N**6 / 3870720,
    17 * _N**3 / 480 - 37 * _N**4 / 840 - 209 * _N**5 / 4480 + 5569 * _N**6 / 90720,
    4397 * _N**4 / 161280 - 11 * _N**5 / 504 - 830251 * _N**6 / 7257600,
    4583 * _N**5 / 161280 - 108847 * _N**6 / 3991680,
    20648693 * _N**6 / 638668800,
)


def utm_srid(lon: float, lat: float) -> int:
    """EPSG code of the zone of a place: 326zz in the north, 327zz in the south."""
    return (32600 if lat >= 0 else 32700) + min(60, int(math.floor((lon + 180) / 6)) + 1)


def _zone(srid: int) -> tuple[float, float]:
    if not (32601 <= srid <= 32660 or 32701 <= srid <= 32760):
        raise ValueError(f"not a UTM zone: {srid}")
    return math.radians((srid % 100) * 6 - 183), 0.0 if srid < 32700 else 1e7


def to_utm(lonlat: np.ndarray, srid: int) -> np.ndarray:
    mid, north = _zone(srid)
    lon, lat = np.radians(lonlat[:, 0]) - mid, np.radians(lonlat[:, 1])
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = np.sinh(np.arctanh(np.sin(lat)) - e * np.arctanh(e * np.sin(lat)))
    xi, eta = np.arctan2(t, np.cos(lon)), np.arctanh(np.sin(lon) / np.sqrt(1 + t * t))
    x, y = eta.copy(), xi.copy()
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        y = y + a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return np.stack([_E0 + _K0 * _R * x, north + _K0 * _R * y], 1)


def from_utm(xy: np.ndarray, srid: int) -> np.ndarray:
    mid, north = _zone(srid)
    xi, eta = (xy[:, 1] - north) / (_K0 * _R), (xy[:, 0] - _E0) / (_K0 * _R)
    x, y = xi.copy(), eta.copy()
    for j, b in enumerate(_BETA, 1):
        x = x - b * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        y = y - b * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    t = np.sin(x) / np.sqrt(np.sinh(y) ** 2 + np.cos(x) ** 2)
    lon = np.arctan2(np.sinh(y), np.cos(x))
    e = 2 * math.sqrt(_N) / (1 + _N)
    tau = t.copy()
    for _ in range(6):  # Newton's steps for the latitude
        sigma = np.sinh(e * np.arctanh(e * tau / np.sqrt(1 + tau * tau)))
        own = tau * np.sqrt(1 + sigma * sigma) - sigma * np.sqrt(1 + tau * tau)
        tau = tau + (t - own) / np.sqrt(1 + own * own) * (1 + (1 - e * e) * tau * tau) / ((1 - e * e) * np.sqrt(1 + tau * tau))
    return np.stack([np.degrees(lon + mid), np.degrees(np.arctan(tau))], 1)


def reproject(xy: np.ndarray, source: int, target: int) -> np.ndarray:
    """Between EPSG:4326 (longitude, latitude) and UTM zones."""
    if source == target:
        return xy
    lonlat = xy if source == 4326 else from_utm(xy, source)
    return lonlat if target == 4326 else to_utm(lonlat, target)
