"""Building footprints: shape measures, land use, type by ordered rules, rule-based heights, blocks and massing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolathe.functions import geom
from geolathe.session import ship


def hull(xy: np.ndarray) -> np.ndarray:
    """Convex hull by the monotone chain, anticlockwise, open."""
    p = np.unique(xy, axis=0)
    if len(p) < 3:
        return p
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    half = []
    for pts in (p, p[::-1]):
        h = []
        for q in pts:
            while len(h) > 1 and cross(h[-2], h[-1], q) <= 0:
                h.pop()
            h.append(q)
        half += h[:-1]
    return np.array(half)


def _area(xy: np.ndarray) -> float:
    x, y = xy[:, 0] - xy[0, 0], xy[:, 1] - xy[0, 1]
    return abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def _perimeter(xy: np.ndarray) -> float:
    return float(np.linalg.norm(np.roll(xy, -1, 0) - xy, axis=1).sum())


def smallest_rectangle(h: np.ndarray) -> tuple[float, float]:
    """Sides (short, long) of the hull's smallest enclosing rectangle; one of its sides lies on a hull side."""
    d = np.roll(h, -1, 0) - h
    a = np.unique(np.round(np.arctan2(d[:, 1], d[:, 0]) % (np.pi / 2), 12))
    c, s = np.cos(a), np.sin(a)
    u, v = h @ np.stack([c, s]), h @ np.stack([-s, c])
    w, t = np.ptp(u, axis=0), np.ptp(v, axis=0)
    k = int(np.argmin(w * t))
    return tuple(sorted((float(w[k]), float(t[k]))))


def enclosing_circle(h: np.ndarray) -> float:
    """Diameter of the smallest circle round the hull: the circle of two or three hull points that holds all."""
    if len(h) < 2:
        return 0.0
    rng, pts = np.random.default_rng(0), h.copy()
    rng.shuffle(pts)

    def two(a, b):
        return (a + b) / 2, np.linalg.norm(a - b) / 2

    def three(a, b, c):
        m = 2 * np.array([b - a, c - a])
        if abs(np.linalg.det(m)) < 1e-12:
            return max((two(a, b), two(a, c), two(b, c)), key=lambda v: v[1])
        o = np.linalg.solve(m, [b @ b - a @ a, c @ c - a @ a])
        return o, np.linalg.norm(o - a)

    out = lambda k, p: np.linalg.norm(p - k[0]) > k[1] * (1 + 1e-9) + 1e-12
    k = two(pts[0], pts[1])
    for i in range(2, len(pts)):
        if out(k, pts[i]):
            k = two(pts[0], pts[i])
            for j in range(1, i):
                if out(k, pts[j]):
                    k = two(pts[j], pts[i])
                    for l in range(j):
                        if out(k, pts[l]):
                            k = three(pts[l], pts[j], pts[i])
    return 2 * float(k[1])


def corner_angles(xy: np.ndarray) -> np.ndarray:
    """Inner angle at each vertex in degrees."""
    a, b = np.roll(xy, 1, 0) - xy, np.roll(xy, -1, 0) - xy
    cos = (a * b).sum(1) / np.maximum(np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1), 1e-300)
    return np.degrees(np.arccos(np.clip(cos, -1, 1)))


SHAPES = "longest_axis double, convexity double, elongation double, rectangularity double, eri double, corners bigint, squareness double"


def shape_measures(df: DataFrame, key: str) -> DataFrame:
    """key, area, perimeter (expressions) and the measures that need a hull (an Arrow function over the first ring).

    longest_axis: diameter of the enclosing circle; convexity: area over hull area; elongation: short over long side of the
    smallest rectangle; rectangularity: area over its area; eri: sqrt(area / its area) * its perimeter / perimeter; corners:
    vertices that turn by more than 10 degrees; squareness: mean distance of the corners from 90 degrees. NULL for rings under three vertices.
    """
    ship(df.sparkSession)
    ring = F.get("geom", F.lit(0))
    base = df.select(key, "geom", geom.polygon_area(F.col("geom")).alias("area"), geom.ring_perimeter(ring).alias("perimeter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for rings, area, per in zip(b.column("geom").to_pylist(), b.column("area").to_pylist(), b.column("perimeter").to_pylist()):
                xy = np.array([(v["x"], v["y"]) for v in (rings[0] if rings else [])], float).reshape(-1, 2)
                if len(xy) > 1 and (xy[0] == xy[-1]).all():
                    xy = xy[:-1]
                xy = xy[(np.abs(xy - np.roll(xy, 1, 0)) > 0).any(1)] if len(xy) else xy
                if len(xy) < 3 or not area:
                    rows.append((None,) * 7)
                    continue
                xy = xy - xy[0]
                h = hull(xy)
                s, l = smallest_rectangle(h)
                ang = corner_angles(xy)
                cor = np.abs(180 - ang) > 10
                rows.append((enclosing_circle(h), area / _area(h), s / l if l else None, area / (s * l) if s * l else None, (area / (s * l)) ** 0.5 * 2 * (s + l) / per if s * l else None, int(cor.sum()), float(np.abs(90 - ang[cor]).mean()) if cor.any() else None))
            cols = list(zip(*rows)) if rows else [[]] * 7
            extra = [pa.array(c, pa.int64() if i == 5 else pa.float64()) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("area"), b.column("perimeter"), *extra], names=[key, "area", "perimeter", "longest_axis", "convexity", "elongation", "rectangularity", "eri", "corners", "squareness"])

    kind = dict(df.dtypes)[key]
    return base.mapInArrow(run, f"{key} {kind}, area double, perimeter double, {SHAPES}")


def building_type(use: Column, area: Column, eri: Column, crossings: Column, sets: dict[str, Sequence[str]], default: str, rules: Sequence[tuple[Column, str]] = ()) -> Column:
    """Type by land use first (sets: type -> uses), then by the rules in order, else the default."""
    out = None
    low = F.lower(use)
    for t, uses in sets.items():
        out = F.when(low.isin(*uses), t) if out is None else out.when(low.isin(*uses), t)
    for cond, t in rules:
        out = F.when(cond, t) if out is None else out.when(cond, t)
    return out.otherwise(default)


def drawn(key: Column, seed: int, salt: str) -> Column:
    """A number in [0, 1) for a key, the same in any partitioning."""
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)


def massing(df: DataFrame, key: str, ladder: Sequence[tuple[Column, tuple[int, int], tuple[float, float]]], seed: int = 42) -> DataFrame:
    """floors_est, height_est, volume_est: known pairs are kept; where either is missing both are drawn from the first rung that holds.

    ladder: (condition, range of floors, range of heights); the last condition should be always true.
    """
    f = h = None
    for cond, (f0, f1), (h0, h1) in ladder:
        fv = F.lit(f0) + F.floor(drawn(F.col(key), seed, "floors") * (f1 - f0 + 1)).cast("int")
        hv = F.round(F.lit(h0) + drawn(F.col(key), seed, "height") * (h1 - h0), 1)
        f = F.when(cond, fv) if f is None else f.when(cond, fv)
        h = F.when(cond, hv) if h is None else h.when(cond, hv)
    both = F.col("height").isNotNull() & F.col("num_floors").isNotNull()
    out = df.withColumns({"floors_est": F.when(both, F.col("num_floors")).otherwise(f.cast("double")), "height_est": F.when(both, F.col("height")).otherwise(h)})
    return out.withColumn("volume_est", F.col("area") * F.col("height_est"))


def walls(df: DataFrame, key: str) -> DataFrame:
    """Vertices (key, seq, x, y, z) of a footprint's first ring at its base and top, the start of any mesh. df: geom, base_z, height."""
    ring = F.get("geom", F.lit(0))
    open_ = F.when(F.get(ring, F.lit(0)) == F.element_at(ring, -1), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)
    v = df.where(F.col("height").isNotNull() & (F.col("height") > 0)).withColumn("_r", open_).where("size(_r) >= 3")
    v = v.select(key, "base_z", "height", F.size("_r").alias("n"), F.posexplode("_r").alias("i", "p"))
    level = F.explode(F.array(F.lit(0), F.lit(1))).alias("top")
    v = v.select("*", level)
    return v.select(key, (F.col("i") + F.col("top") * F.col("n")).alias("seq"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), (F.col("base_z") + F.col("top") * F.col("height")).alias("z"))


def triangulate(xy: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles of a simple ring by cutting ears; anticlockwise."""
    n = len(xy)
    idx = list(range(n)) if np.dot(xy[:, 0], np.roll(xy[:, 1], -1)) - np.dot(xy[:, 1], np.roll(xy[:, 0], -1)) > 0 else list(range(n))[::-1]
    turn = lambda a, b, c: (xy[b][0] - xy[a][0]) * (xy[c][1] - xy[a][1]) - (xy[b][1] - xy[a][1]) * (xy[c][0] - xy[a][0])
    out = []
    while len(idx) > 3:
        for k in range(len(idx)):
            a, b, c = idx[k - 1], idx[k], idx[(k + 1) % len(idx)]
            if turn(a, b, c) <= 0:
                continue
            if any(p not in (a, b, c) and turn(a, b, p) >= 0 and turn(b, c, p) >= 0 and turn(c, a, p) >= 0 for p in idx):
                continue
            out.append((a, b, c))
            idx.pop(k)
            break
        else:
            idx.pop(0)  # no ear is left in a ring that meets itself
    return [*out, tuple(idx)]


def faces(df: DataFrame, key: str) -> DataFrame:
    """Triangles (key, face, a, b, c) over the vertices of `walls`: cut floor, cut roof and two for each wall."""
    ship(df.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for k, rings in zip(p[key], p["geom"]):
                xy = np.array([(v["x"], v["y"]) for v in rings[0]], float)
                if len(xy) > 1 and (xy[0] == xy[-1]).all():
                    xy = xy[:-1]
                n = len(xy)
                if n < 3:
                    continue
                cap = triangulate(xy - xy[0])
                fs = [(a, c, b) for a, b, c in cap] + [(n + a, n + b, n + c) for a, b, c in cap]
                for i in range(n):
                    j = (i + 1) % n
                    fs += [(i, j, n + j), (i, n + j, n + i)]
                rows += [(k, f, *t) for f, t in enumerate(fs)]
            yield pd.DataFrame(rows, columns=[key, "face", "a", "b", "c"])

    ok = df.where(F.col("height").isNotNull() & (F.col("height") > 0) & F.col("geom").isNotNull() & (F.size("geom") > 0)).select(key, "geom")
    return ok.mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, face bigint, a bigint, b bigint, c bigint")
