"""Shapes round reached junctions: convex and concave hulls, and the division of land between points."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolathe.operators.buildings import hull
from geolathe.session import ship

RING = "array<struct<x:double,y:double>>"


def delaunay(p: np.ndarray) -> np.ndarray:
    """Triangles of a point set, by adding one point after the other and refilling the hole of all circles it lies in."""
    n = len(p)
    if n < 3:
        return np.zeros((0, 3), int)
    mid, span = p.mean(0), max(float(np.ptp(p, axis=0).max()), 1.0)
    far = 50.0 * span
    q = np.vstack([p, mid + [0.0, 2 * far], mid + [-1.8 * far, -far], mid + [1.8 * far, -far]]) - mid

    def circle(t):
        a, b, c = q[t[0]], q[t[1]], q[t[2]]
        d = 2 * ((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
        if abs(d) < 1e-12:
            return (0.0, 0.0, math.inf)
        e, f = (b - a) @ (b - a), (c - a) @ (c - a)
        x, y = ((c[1] - a[1]) * e - (b[1] - a[1]) * f) / d, ((b[0] - a[0]) * f - (c[0] - a[0]) * e) / d
        return (a[0] + x, a[1] + y, x * x + y * y)

    tris = [(n, n + 1, n + 2)]
    circles = np.array([circle(tris[0])])
    for i in np.lexsort((p[:, 1], p[:, 0])):
        bad = (q[i, 0] - circles[:, 0]) ** 2 + (q[i, 1] - circles[:, 1]) ** 2 < circles[:, 2] * (1 - 1e-12)
        border: dict[tuple[int, int], int] = {}
        for k in np.flatnonzero(bad):
            a, b, c = tris[k]
            for e in ((a, b), (b, c), (c, a)):
                key = (min(e), max(e))
                border[key] = border.get(key, 0) + 1
        fresh = [(a, b, int(i)) for (a, b), m in border.items() if m == 1]
        keep = np.flatnonzero(~bad)
        tris = [tris[k] for k in keep] + fresh
        circles = np.vstack([circles[keep], np.array([circle(t) for t in fresh]).reshape(-1, 3)])
    t = np.array([t for t in tris if max(t) < n], int).reshape(-1, 3)
    return t


def outline(tris: np.ndarray) -> list[int] | None:
    """The closed border of triangles that form one region without holes or pinches; None otherwise."""
    count: dict[tuple[int, int], int] = {}
    for a, b, c in tris.tolist():
        for e in ((a, b), (b, c), (c, a)):
            k = (min(e), max(e))
            count[k] = count.get(k, 0) + 1
    step: dict[int, list[int]] = {}
    for (a, b), m in count.items():
        if m == 1:
            step.setdefault(a, []).append(b)
            step.setdefault(b, []).append(a)
    if not step or any(len(v) != 2 for v in step.values()):
        return None
    start = min(step)
    ring, before, at = [start], None, start
    while True:
        nxt = next(v for v in step[at] if v != before) if before is not None else step[at][0]
        if nxt == start:
            break
        ring.append(nxt)
        before, at = at, nxt
    return ring if len(ring) == len(step) else None


class _Region:
    """Triangles added one by one, with what tells whether they form one region without holes or pinches over all points."""

    def __init__(self, n: int):
        self.of: dict[tuple[int, int], int] = {}  # edge -> the first triangle on it
        self.parent: list[int] = []
        self.sides = [0] * n  # border edges at each point
        self.odd = self.parts = self.edges = 0
        self.bare = n

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _turn(self, v: int, by: int) -> None:
        self.odd -= self.sides[v] not in (0, 2)
        self.sides[v] += by
        self.odd += self.sides[v] not in (0, 2)

    def add(self, tri, met: set[int]) -> None:
        me = len(self.parent)
        self.parent.append(me)
        self.parts += 1
        self.bare -= len(set(tri) - met)
        met.update(tri)
        for k in range(3):
            e = tuple(sorted((tri[k], tri[k - 1])))
            other = self.of.setdefault(e, me)
            for v in e:
                self._turn(v, 1 if other == me else -1)
            if other == me:
                self.edges += 1
            elif (r := self.root(other)) != self.root(me):
                self.parent[r] = self.root(me)
                self.parts -= 1

    def simple(self, points: int) -> bool:
        """One part over all points, every border point on two border edges, and no hole by Euler's count."""
        return not self.bare and self.parts == 1 and not self.odd and points - self.edges + len(self.parent) == 1


def concave(xy: np.ndarray, start_percentile: int = 85) -> np.ndarray | None:
    """Ring of the triangles whose circumradius is at most a percentile of all, raised until they form one region that touches every point.

    The triangles are sorted once; each step only adds those that the next percentile lets in.
    """
    p = np.unique(xy, axis=0)
    t = delaunay(p) if len(p) > 2 else []
    if not len(t):
        return None
    side = [((p[t[:, i]] - p[t[:, j]]) ** 2).sum(1) for i, j in ((0, 1), (1, 2), (2, 0))]
    u, v = p[t[:, 1]] - p[t[:, 0]], p[t[:, 2]] - p[t[:, 0]]
    cross = (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]) ** 2
    thin = cross <= 4e-18
    size = np.sqrt(side[0] * side[1] * side[2] / np.where(thin, 1.0, 4 * cross))
    size[thin] = np.inf
    order = np.argsort(size, kind="stable")
    ranked = size[order]
    region, met, done = _Region(len(p)), set(), 0
    for q in range(start_percentile, 101):
        at = (len(t) - 1) * q / 100
        low = int(at)
        bound = ranked[low] if at == low else ranked[low] + (at - low) * (ranked[min(low + 1, len(t) - 1)] - ranked[low])
        upto = len(t) if q == 100 else int(np.searchsorted(ranked, bound, "right"))
        for k in order[done:upto]:
            region.add(t[k].tolist(), met)
        done = max(done, upto)
        if region.simple(len(p)) and (ring := outline(t[order[:done]])) is not None:
            return p[ring]
    h = hull(p)
    return h if len(h) >= 3 else None


def reach_polygons(reached: DataFrame, keys: list[str], shape: str = "concave") -> DataFrame:
    """keys, ring, area_ha: the hull of the points (x, y) of each group; groups under three points or on one line have none.

    A group is what one facility reaches in one band, so its size is bounded by the band's length and not by the data.
    """
    ship(reached.sparkSession)

    def none(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[keys].iloc[:0].assign(ring=pd.Series([], dtype=object), area_ha=pd.Series([], dtype=float))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = pdf[["x", "y"]].to_numpy(float)
        r = concave(xy) if shape == "concave" else hull(xy)
        if r is None or len(r) < 3:
            return none(pdf)
        s = r - r[0]
        area = abs(np.dot(s[:, 0], np.roll(s[:, 1], -1)) - np.dot(s[:, 1], np.roll(s[:, 0], -1))) / 2
        if area <= 0:
            return none(pdf)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "ring": [[{"x": float(x), "y": float(y)} for x, y in r]], "area_ha": [round(area / 10_000, 4)]})

    kinds = dict(reached.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", ring {RING}, area_ha double"
    return reached.select(*keys, "x", "y").groupBy(*keys).applyInPandas(run, schema)


def partly_walked(reach: DataFrame, edges: DataFrame, limit: float) -> DataFrame:
    """source, x, y: where the walk ends on streets that are entered and not finished within the limit. edges: u, v, w, ux, uy, vx, vy."""
    r = reach.where(F.col("dist") < limit).join(edges.select(F.col("u").alias("node"), "w", "ux", "uy", "vx", "vy"), "node").where((F.col("w") > 0) & (F.col("dist") + F.col("w") > limit))
    t = (F.lit(limit) - F.col("dist")) / F.col("w")
    return r.select("source", (F.col("ux") + t * (F.col("vx") - F.col("ux"))).alias("x"), (F.col("uy") + t * (F.col("vy") - F.col("uy"))).alias("y"))


def nearest_cells(points: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """cells (cell, cx, cy) with the nearest point's `owner`: a division of land between points on a fine grid of cells."""
    from geolathe.operators.spatial import nearest

    b = points.select(F.col("owner"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return nearest(cells.select("cell", F.col("cx").alias("x"), F.col("cy").alias("y")), b, "cell", "owner", size=size).select("cell", "owner", "dist")
