"""Distances and point-in-area tests as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0


def has_gps(lat: Column, lon: Column) -> Column:
    return lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlon / 2), F.lit(2.0)
    )
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def equirect(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Planar approximation used only to rank candidates."""
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(dlat * dlat + dlon * dlon)


def in_polygon(lat: Column, lon: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd rule over the polygon's edges; one boolean term per edge."""
    inside = F.lit(False)
    n = len(polygon)
    for i in range(n):
        yi, xi = polygon[i]
        yj, xj = polygon[i - 1]
        if yi == yj:
            continue
        crosses = (F.lit(yi) > lat) != (F.lit(yj) > lat)
        inside = inside != (crosses & (lon < (xj - xi) * (lat - yi) / (yj - yi) + xi))
    return inside


def km_to_segment(lat: Column, lon: Column, p: tuple[float, float], q: tuple[float, float]) -> Column:
    """Flat-plane distance to a segment; longitudes are scaled at the segment's middle latitude."""
    kx = KM_PER_DEGREE * math.cos(math.radians((p[0] + q[0]) / 2))
    seg = ((q[1] - p[1]) * kx, (q[0] - p[0]) * KM_PER_DEGREE)
    length2 = seg[0] ** 2 + seg[1] ** 2
    east, north = (lon - p[1]) * kx, (lat - p[0]) * KM_PER_DEGREE
    if length2 == 0:
        return F.sqrt(east * east + north * north)
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (east * seg[0] + north * seg[1]) / length2))
    off_e, off_n = east - along * seg[0], north - along * seg[1]
    return F.sqrt(off_e * off_e + off_n * off_n)


def in_area(lat: Column, lon: Column, polygon: list[tuple[float, float]] | None = None, buffer_km: float = 0.0,
            box: tuple[float, float, float, float] | None = None) -> Column:
    """Inside a polygon (or near its edge), else inside a (lat0, lat1, lon0, lon1) box.

    Rows without a position, and (0,0), always pass.
    """
    nowhere = lat.isNull() | lon.isNull() | ((lat == 0) & (lon == 0))
    if polygon and len(polygon) >= 3:
        ok = in_polygon(lat, lon, polygon)
        if buffer_km > 0:
            near = [km_to_segment(lat, lon, polygon[i], polygon[(i + 1) % len(polygon)]) <= buffer_km
                    for i in range(len(polygon))]
            for c in near:
                ok = ok | c
    elif box is not None:
        ok = (lat >= box[0]) & (lat <= box[1]) & (lon >= box[2]) & (lon <= box[3])
    else:
        ok = F.lit(True)
    return F.coalesce(nowhere | ok, F.lit(True))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    la, lo = F.radians(lat), F.radians(lon)
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)


def chord_to_km(chord: Column) -> Column:
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), chord / 2))

