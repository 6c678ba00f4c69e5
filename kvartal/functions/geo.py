"""Distances and boxes on the sphere, as Columns and as numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius (IUGG).
EARTH_RADIUS_KM = 6371.0088
EARTH_RADIUS_M = 6371008.8


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km between two pairs of degree columns."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), half)))


def haversine_m_np(lat1, lon1, lat2, lon2):
    """Great-circle distance in metres of numpy degree arrays."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    half = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(1.0, half)))


def circle_boxes(lat, lon, radius_m):
    """Degree boxes around circles: (lat_lo, lat_hi, lon_lo, lon_hi), slightly generous; all longitudes near a pole."""
    angle = np.minimum(radius_m / EARTH_RADIUS_M, np.pi)
    pad = 1e-9 + np.degrees(angle) * (1 + 1e-9)
    lo, hi = lat - pad, lat + pad
    with np.errstate(invalid="ignore", divide="ignore"):
        reach = np.degrees(np.arcsin(np.clip(np.sin(angle) / np.cos(np.radians(lat)), -1, 1))) * (1 + 1e-9) + 1e-9
    whole = (hi >= 90) | (lo <= -90) | (angle >= np.pi / 2)
    return np.maximum(lo, -90), np.minimum(hi, 90), np.where(whole, -180.0, lon - reach), np.where(whole, 180.0, lon + reach)


def wrap_boxes(lat_lo, lat_hi, lon_lo, lon_hi):
    """Split boxes that cross the antimeridian; returns (source index, lat_lo, lat_hi, lon_lo, lon_hi)."""
    parts = []
    for shift in (-360.0, 0.0, 360.0):
        a, b = lon_lo + shift, lon_hi + shift
        keep = np.flatnonzero((b >= -180) & (a <= 180))
        parts.append((keep, lat_lo[keep], lat_hi[keep], np.maximum(a[keep], -180), np.minimum(b[keep], 180)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def inside_rings(lat, lon, rings) -> np.ndarray:
    """Even-odd test of points against rings [(lats, lons), ...]; edges straight in (lon, lat)."""
    odd = np.zeros(len(lat), dtype=bool)
    for ys, xs in rings:
        y2, x2 = np.roll(ys, -1), np.roll(xs, -1)
        for a in range(0, len(ys), 64):
            y1, x1, yb, xb = ys[a : a + 64], xs[a : a + 64], y2[a : a + 64], x2[a : a + 64]
            spans = (y1[None, :] > lat[:, None]) != (yb[None, :] > lat[:, None])
            with np.errstate(invalid="ignore", divide="ignore"):
                at = (xb - x1)[None, :] * (lat[:, None] - y1[None, :]) / (yb - y1)[None, :] + x1[None, :]
            odd ^= ((spans & (lon[:, None] < at)).sum(axis=1) % 2).astype(bool)
    return odd
