"""Planar geometry as Column expressions.

A point is two double columns or struct<x,y>, a line array<struct<x,y>>, a polygon array of rings. All sums run on
coordinates shifted to the first vertex, so that large metric coordinates do not eat the digits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
LINE = f"array<{POINT}>"
POLYGON = f"array<{LINE}>"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))


def _shifted(line: Column) -> Column:
    """Vertices relative to the first."""
    o = F.get(line, F.lit(0))
    return F.transform(line, lambda p: F.struct((p["x"] - o["x"]).alias("x"), (p["y"] - o["y"]).alias("y")))


def _next(ring: Column) -> Column:
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def ring_area(ring: Column) -> Column:
    """Signed area; closed and open rings alike; NULL for fewer than three vertices."""
    s = _shifted(ring)
    return F.when(F.size(ring) >= 3, _sum(F.zip_with(s, _next(s), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) / 2)


def polygon_area(rings: Column) -> Column:
    """Area of the first ring less its holes."""
    holes = F.transform(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: F.abs(ring_area(r)))
    return F.abs(ring_area(F.get(rings, F.lit(0)))) - _sum(holes)


def line_length(line: Column) -> Column:
    """Sum of the segment lengths; 0 for one vertex, NULL for none."""
    a = F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0)))
    b = F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0)))
    return F.when(F.size(line) >= 1, _sum(F.zip_with(a, b, lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))))


def ring_perimeter(ring: Column) -> Column:
    return F.when(F.size(ring) >= 2, _sum(F.zip_with(ring, _next(ring), lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))))


def ring_centroid(ring: Column) -> Column:
    """struct<x,y>: the centre of area of a ring; NULL if it has none."""
    s = _shifted(ring)
    o = F.get(ring, F.lit(0))
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    area = ring_area(ring)
    cx = _sum(F.zip_with(s, _next(s), lambda a, b: (a["x"] + b["x"]) * cross(a, b))) / (6 * area)
    cy = _sum(F.zip_with(s, _next(s), lambda a, b: (a["y"] + b["y"]) * cross(a, b))) / (6 * area)
    return F.when(F.abs(area) > 1e-9, F.struct((o["x"] + cx).alias("x"), (o["y"] + cy).alias("y")))


def bounds(ring: Column) -> dict[str, Column]:
    """x0, y0, x1, y1 of a line or ring."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd ray cast with half-open edges."""
    crossed = F.zip_with(
        ring, _next(ring),
        lambda a, b: F.when((a["y"] > y) != (b["y"] > y), (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]).cast("int")).otherwise(0),
    )
    return (F.size(ring) >= 3) & (F.aggregate(crossed, F.lit(0), lambda s, v: s + v) % 2 == 1)


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """In the first ring and in no further one."""
    return in_ring(x, y, F.get(rings, F.lit(0))) & ~F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda h: in_ring(x, y, h))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment; the foot is clamped to its ends."""
    t = segment_foot(px, py, ax, ay, bx, by)
    return F.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def segment_foot(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where along a segment, 0 to 1, the point's nearest place lies."""
    d = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / F.nullif(d, F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), F.lit(0.0))


def ring_distance(x: Column, y: Column, ring: Column) -> Column:
    """Distance to the outline of a ring."""
    return F.array_min(F.zip_with(ring, _next(ring), lambda a, b: segment_distance(x, y, a["x"], a["y"], b["x"], b["y"])))


def bearing(line: Column) -> Column:
    """Degrees from the first to the last vertex, mod 180."""
    a, b = F.get(line, F.lit(0)), F.element_at(line, -1)
    return F.pmod(F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"])), F.lit(180.0))


def turn(b1: Column, b2: Column) -> Column:
    """Angle between two bearings mod 180, at most 90."""
    d = F.abs(b1 - b2) % 180
    return F.least(d, 180 - d)


def interpolate(line: Column, share: float) -> Column:
    """The point at a share of a line's length."""
    a = F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0)))
    b = F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0)))
    parts = F.zip_with(a, b, lambda p, q: F.struct(p.alias("p"), q.alias("q"), F.hypot(q["x"] - p["x"], q["y"] - p["y"]).alias("l")))
    want = line_length(line) * share
    start = F.struct(F.lit(0.0).alias("done"), F.lit(None).cast(POINT).alias("at"))

    def step(s, v):
        t = F.coalesce((want - s["done"]) / F.nullif(v["l"], F.lit(0.0)), F.lit(0.0))
        here = F.struct((v["p"]["x"] + t * (v["q"]["x"] - v["p"]["x"])).alias("x"), (v["p"]["y"] + t * (v["q"]["y"] - v["p"]["y"])).alias("y"))
        found = s["at"].isNull() & (s["done"] + v["l"] >= want)
        return F.struct((s["done"] + v["l"]).alias("done"), F.when(found, here).otherwise(s["at"]).alias("at"))

    got = F.aggregate(parts, start, step)["at"]
    return F.coalesce(got, F.when(F.size(line) >= 1, F.element_at(line, -1)))


def crossing(a: tuple, b: tuple) -> tuple[Column, Column]:
    """Where two segments (ax, ay, bx, by) cross: shares along the first and the second; NULL if parallel."""
    ax, ay, bx, by = a
    cx, cy, dx, dy = b
    den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    den = F.nullif(den, F.lit(0.0))
    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den
    u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den
    return t, u


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere of 6,371,009 m."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6_371_009 * F.asin(F.sqrt(h))


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone of a place."""
    return F.when(lat >= 0, 32600).otherwise(32700) + (F.floor((lon + 180) / 6) + 1).cast("int")


# WGS 84 and the series of transverse Mercator to the third order in n.
_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)


def to_utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in the place's own UTM zone."""
    zone = F.floor((lon + 180) / 6) + 1
    dl = F.radians(lon - (zone * 6 - 183))
    phi = F.radians(lat)
    e = 2 * math.sqrt(_N) / (1 + _N)
    atanh = lambda v: 0.5 * F.log((1 + v) / (1 - v))
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi = F.atan2(t, F.cos(dl))
    eta = atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + 0.9996 * _RECT * east, F.when(lat < 0, 10_000_000.0).otherwise(0.0) + 0.9996 * _RECT * north
