"""Distances and point-in-polygon tests as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Miles of the earth's radius, and of a degree of latitude; origin of the flat projection; miles of the orbit.
RADIUS, MILES_PER_DEGREE, LAT0, LNG0, ORBIT = 3958.8, 69.0, 42.35, -83.4, 75.0


def haversine(lat1, lng1, lat2, lng2) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def in_ring(lng: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Half-open ray casting: each edge that crosses the point's latitude east of it flips the answer."""
    inside = F.lit(False)
    for (xj, yj), (xi, yi) in zip([ring[-1], *ring[:-1]], ring, strict=True):
        if yi == yj:
            continue
        crosses = (F.lit(yi) > lat) != (F.lit(yj) > lat)
        inside = inside != (crosses & (lng < F.lit(xj - xi) * (lat - yi) / F.lit(yj - yi) + xi))
    return inside


def in_polygon(lng: Column, lat: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Inside the first ring, behind its bounding box, and in none of the holes."""
    xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
    out = lng.between(min(xs), max(xs)) & lat.between(min(ys), max(ys)) & in_ring(lng, lat, rings[0])
    for hole in rings[1:]:
        out = out & ~in_ring(lng, lat, hole)
    return out


def border_miles(lng: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Miles to the nearest edge, in a flat projection."""
    import math

    per_lng = MILES_PER_DEGREE * math.cos(math.radians(LAT0))
    x, y = (lng - LNG0) * per_lng, (lat - LAT0) * MILES_PER_DEGREE
    out = []
    for (ax, ay), (bx, by) in zip(ring[:-1], ring[1:], strict=True):
        ax, bx, ay, by = (ax - LNG0) * per_lng, (bx - LNG0) * per_lng, (ay - LAT0) * MILES_PER_DEGREE, (by - LAT0) * MILES_PER_DEGREE
        dx, dy = bx - ax, by - ay
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else F.lit(0.0)
        out.append(F.hypot(x - (ax + t * dx), y - (ay + t * dy)))
    return F.least(*out) if len(out) > 1 else out[0]
