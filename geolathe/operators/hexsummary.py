"""Results moved onto the hexagon grid: one row per cell of the grid, with 0 for absent counts and sums and NULL for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolathe.functions import geom, hexes

# Summaries by name. "mode" takes the smallest of the most frequent values.
HOW = {
    "count": F.count,
    "sum": F.sum,
    "mean": F.avg,
    "median": F.median,
    "min": F.min,
    "max": F.max,
    "mode": lambda c: F.mode(c, deterministic=True),
}


def agg_columns(aggs: dict[str, tuple[str, str]]) -> list[Column]:
    """Aggregates from {output: (column, how)}; `how` may also be a function of the column's name that gives a Column."""
    return [(HOW[how] if isinstance(how, str) else how)(col).alias(out) for out, (col, how) in aggs.items()]


def on_grid(result: DataFrame, grid: DataFrame, aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """Left join from the grid, with zeros for counts and sums."""
    zero = {out: (F.coalesce(F.col(out), F.lit(0)) if how in ("count", "sum") else F.col(out)) for out, (_, how) in aggs.items()}
    return grid.select("cell").join(result, "cell", "left").select("cell", *[c.alias(o) for o, c in zero.items()])


def points_to_hex(points: DataFrame, grid: DataFrame, edge: float, **aggs: tuple[str, str]) -> DataFrame:
    """points: x, y and the summarised columns. Points off the grid count nowhere; NULLs are skipped, as by any aggregate."""
    by_cell = points.withColumn("cell", hexes.cell(F.col("x"), F.col("y"), edge)).where(F.col("cell").isNotNull())
    return on_grid(by_cell.groupBy("cell").agg(*agg_columns(aggs)), grid, aggs)


def polygons_to_hex(polygons: DataFrame, grid: DataFrame, edge: float, **aggs: tuple[str, str]) -> DataFrame:
    """polygons: geom and the summarised columns; each goes whole to the cell of its centroid."""
    c = geom.ring_centroid(F.get("geom", F.lit(0)))
    # The one-row explode keeps the optimizer from copying the centroid into every use of x and y.
    at = polygons.withColumn("_c", F.explode(F.array(c)))
    return points_to_hex(at.withColumns({"x": F.col("_c.x"), "y": F.col("_c.y")}).drop("_c"), grid, edge, **aggs)


def clip_to_hex(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, edge: float) -> Column:
    """Length of a segment inside a hexagon, by cutting its parameter range at the six half planes."""
    import math

    lo, hi, out = F.lit(0.0), F.lit(1.0), F.lit(False)
    apothem = edge * math.sqrt(3) / 2
    for k in range(6):
        nx, ny = math.cos(math.radians(60 * k)), math.sin(math.radians(60 * k))
        d = (bx - ax) * nx + (by - ay) * ny
        n = apothem - ((ax - cx) * nx + (ay - cy) * ny)  # inside while t * d <= n
        t = n / F.nullif(d, F.lit(0.0))
        hi = F.when(d > 0, F.least(hi, t)).otherwise(hi)
        lo = F.when(d < 0, F.greatest(lo, t)).otherwise(lo)
        out = out | ((d == 0) & (n < 0))
    return F.when(out, 0.0).otherwise(F.greatest(F.lit(0.0), hi - lo) * F.hypot(bx - ax, by - ay))


def lines_to_hex(lines: DataFrame, grid: DataFrame, edge: float, **means: str) -> DataFrame:
    """cell, street_length_m and length-weighted means. lines: geom and the metric columns; long lines are cut at the cells' edges.

    A segment is sent only to the cells its box can meet; each piece counts with its length, a missing metric not at all.
    """
    cols = list(dict.fromkeys(means.values()))
    at = F.posexplode(F.slice("geom", 1, F.greatest(F.size("geom") - 1, F.lit(0)))).alias("i", "a")
    s = lines.select("geom", *cols, at).select(*cols, F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.get("geom", F.col("i") + 1).alias("b"))
    s = s.select(*cols, "ax", "ay", F.col("b.x").alias("bx"), F.col("b.y").alias("by"))
    pad = 1.01 * edge
    box = s.select("*", (F.least("ax", "bx") - pad).alias("x0"), (F.greatest("ax", "bx") + pad).alias("x1"), (F.least("ay", "by") - pad).alias("y0"), (F.greatest("ay", "by") + pad).alias("y1"))
    rows = box.withColumn("r", F.explode(F.sequence(F.floor(F.col("y0") / (1.5 * edge)), F.ceil(F.col("y1") / (1.5 * edge)))))
    qx = lambda c: F.col(c) / (hexes.SQRT3 * edge) - F.col("r") / 2.0
    rows = rows.withColumn("q", F.explode(F.sequence(F.floor(qx("x0")), F.ceil(qx("x1")))))
    cx, cy = hexes.centre(F.col("q"), F.col("r"), edge)
    piece = rows.withColumn("len", clip_to_hex(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), cx, cy, edge)).where("len > 0")
    piece = piece.withColumn("cell", F.concat(F.col("q").cast("string"), F.lit(":"), F.col("r").cast("string")))
    w = [(F.sum(F.col(c) * F.col("len")) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), F.col("len"))), F.lit(0.0))).alias(o) for o, c in means.items()]
    got = piece.groupBy("cell").agg(F.sum("len").alias("street_length_m"), *w)
    return grid.select("cell").join(got, "cell", "left").withColumn("street_length_m", F.coalesce("street_length_m", F.lit(0.0)))


def rasters_to_hex(pixels: DataFrame, grid: DataFrame, edge: float, bands: list[str], size: float, *, min_valid: float = 0.5, supersample: int = 4) -> DataFrame:
    """Area-weighted mean of pixel bands per cell. pixels: x, y (centre) and the bands, NULL for no data; size: metres of a pixel's side.

    A pixel is cut into supersample x supersample parts, each of which goes to the cell of its centre. Only pixels with a
    value in every band count. Below `min_valid` of the cell's area the means are NULL.
    """
    ok = pixels.where(" AND ".join(f"{b} IS NOT NULL" for b in bands)) if bands else pixels
    k = supersample
    offs = F.array(*[F.lit((2 * i + 1 - k) / (2 * k) * size) for i in range(k)])
    parts = ok.withColumn("dx", F.explode(offs)).withColumn("dy", F.explode(offs))
    parts = parts.withColumn("cell", hexes.cell(F.col("x") + F.col("dx"), F.col("y") + F.col("dy"), edge))
    got = parts.groupBy("cell").agg((F.count("*") / (k * k)).alias("n_valid_px"), *[F.avg(b).alias(b) for b in bands])
    frac = F.least(F.col("n_valid_px") * size * size / hexes.area(edge), F.lit(1.0))
    j = grid.select("cell").join(got, "cell", "left").withColumn("n_valid_px", F.coalesce("n_valid_px", F.lit(0.0))).withColumn("valid_frac", frac)
    return j.select("cell", *[F.when(F.col("valid_frac") >= min_valid, F.col(b)).alias(b) for b in bands], "n_valid_px", "valid_frac")
