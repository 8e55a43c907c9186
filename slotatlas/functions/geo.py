"""Distances as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotatlas.functions.timefn import col

KM_PER_DEGREE = 111
EARTH_KM = 6371.0088


def planar_km(lat, lng, lat0, lng0) -> Column:
    """Plain degree distance times 111, without the cosine of the latitude."""
    dx, dy = col(lat) - col(lat0), col(lng) - col(lng0)
    return F.sqrt(dx * dx + dy * dy) * KM_PER_DEGREE


def haversine_km(lat, lng, lat0, lng0) -> Column:
    p1, p2 = F.radians(col(lat)), F.radians(col(lat0))
    dp, dl = (p2 - p1) / 2, F.radians(col(lng0) - col(lng)) / 2
    a = F.sin(dp) * F.sin(dp) + F.cos(p1) * F.cos(p2) * F.sin(dl) * F.sin(dl)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))
