"""A planar grid of pointy-topped hexagons: cells as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SQRT3 = math.sqrt(3.0)


def area(edge: float) -> float:
    return 1.5 * SQRT3 * edge * edge


def axial(x: Column, y: Column, edge: float) -> tuple[Column, Column]:
    """Axial coordinates (q, r) of the cell that holds a point, by cube rounding."""
    q = (SQRT3 / 3 * x - y / 3) / edge
    r = (2.0 / 3 * y) / edge
    s = -q - r
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(s + 0.5)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    q_ = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    r_ = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return q_.cast("long"), r_.cast("long")


def cell(x: Column, y: Column, edge: float) -> Column:
    """The cell's name, "q:r"; NULL for a point without coordinates."""
    q, r = axial(x, y, edge)
    return F.when(x.isNotNull() & y.isNotNull(), F.concat(q.cast("string"), F.lit(":"), r.cast("string")))


def centre(q: Column, r: Column, edge: float) -> tuple[Column, Column]:
    return edge * SQRT3 * (q + r / 2.0), edge * 1.5 * r


def corners(cx: Column, cy: Column, edge: float) -> Column:
    """The ring of six corners, anticlockwise."""
    return F.array(*[F.struct((cx + edge * math.cos(math.radians(60 * k - 30))).alias("x"), (cy + edge * math.sin(math.radians(60 * k - 30))).alias("y")) for k in range(6)])


def grid(bounds: DataFrame, edge: float) -> DataFrame:
    """q, r, cell, cx, cy, area_m2 of all cells whose centre lies in a box; bounds: x0, y0, x1, y1, one row for each box."""
    b = bounds.select("x0", "y0", "x1", "y1", F.explode(F.sequence(F.floor(F.col("y0") / (1.5 * edge)), F.ceil(F.col("y1") / (1.5 * edge)))).alias("r"))
    lo, hi = F.col("x0") / (SQRT3 * edge) - F.col("r") / 2.0, F.col("x1") / (SQRT3 * edge) - F.col("r") / 2.0
    c = b.withColumn("q", F.explode(F.sequence(F.floor(lo), F.ceil(hi))))
    cx, cy = centre(F.col("q"), F.col("r"), edge)
    c = c.withColumns({"cx": cx, "cy": cy}).where((F.col("cx") >= F.col("x0")) & (F.col("cx") <= F.col("x1")) & (F.col("cy") >= F.col("y0")) & (F.col("cy") <= F.col("y1")))
    name = F.concat(F.col("q").cast("string"), F.lit(":"), F.col("r").cast("string"))
    return c.select("q", "r", name.alias("cell"), "cx", "cy", F.lit(area(edge)).alias("area_m2")).distinct()
