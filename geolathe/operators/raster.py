"""Raster map algebra on pixel tables: row, col and one column per band, NULL for no data."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Rescaling of surface reflectance and temperature products, and of emissivity by vegetation cover.
SR_MULT, SR_ADD = 2.75e-05, -0.2
ST_MULT, ST_ADD = 0.00341802, 149.0
SOIL_MAX, VEG_MIN = 0.2, 0.5
EM_SOIL, EM_VEG, RED_A, RED_B, GEOM = 0.9668, 0.9863, 0.973, 0.047, 0.55


def clip(v: Column, lo: float, hi: float) -> Column:
    """NULL stays NULL; greatest and least alone would turn it into a bound."""
    return F.when(v.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), v)))


def difference_index(a: Column, b: Column, clipped: bool = True) -> Column:
    """(a - b) / (a + b); NULL where the sum is 0."""
    v = (a - b) / F.nullif(a + b, F.lit(0.0))
    return clip(v, -1.0, 1.0) if clipped else v


def scaled(dn: Column) -> Column:
    """Digital numbers to 0..1; 0 is no data."""
    return F.when(dn != 0, clip(dn / 10000.0, 0.0, 1.0))


def reflectance(dn: Column) -> Column:
    return SR_MULT * dn + SR_ADD


def surface_temperature(dn: Column) -> Column:
    """Degrees Celsius; 0 is no data."""
    return F.when(dn != 0, ST_MULT * dn + ST_ADD - 273.15)


def emissivity(ndvi: Column, red: Column) -> Column:
    fvc = clip(F.pow((ndvi - SOIL_MAX) / (VEG_MIN - SOIL_MAX), 2), 0.0, 1.0)
    cavity = (1 - EM_SOIL) * EM_VEG * GEOM * (1 - fvc)
    return (
        F.when((ndvi >= -1) & (ndvi < SOIL_MAX), RED_A - RED_B * red)
        .when((ndvi >= SOIL_MAX) & (ndvi <= VEG_MIN), EM_VEG * fvc + EM_SOIL * (1 - fvc) + cavity)
        .when((ndvi > VEG_MIN) & (ndvi <= 1), EM_VEG + cavity)
    )


def change_class(delta: Column, low: float, high: float) -> Column:
    """-1 below low, 1 above high, else 0; no data is 0."""
    return F.when(delta < low, -1).when(delta > high, 1).otherwise(0)


def water(ndwi: Column) -> Column:
    return F.when(ndwi > 0, 1).otherwise(0)


def flood_class(dry: Column, flood: Column) -> Column:
    """0 dry in both, 1 water in both, 2 new water, 3 water gone."""
    return F.when((dry == 1) & (flood == 1), 1).when((dry == 0) & (flood == 1), 2).when((dry == 1) & (flood == 0), 3).otherwise(0)


def refine_flood(cls: Column, permanent: Column) -> Column:
    return F.when(permanent & cls.isin(0, 3), 1).otherwise(cls)


def flood_depth(z: Column, level: Column | float) -> Column:
    return F.when(z <= level, F.lit(level) - z if not isinstance(level, Column) else level - z)


def normalize01(df: DataFrame, *cols: str) -> DataFrame:
    """Adds <col>_n in 0..1 over the whole raster; one row of extremes is joined on."""
    ext = df.agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    j = df.crossJoin(F.broadcast(ext))
    return j.withColumns({f"{c}_n": (F.col(c) - F.col(f"_lo_{c}")) / F.nullif(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(0.0)) for c in cols}).drop(*ext.columns)


def heat_exposure(df: DataFrame, weights: dict[str, tuple[float, float]]) -> DataFrame:
    """hei_<label> of each weighting of temperature against missing vegetation, and hei_range between the weightings. df: lst, ndvi."""
    n = normalize01(df, "lst", "ndvi")
    n = n.withColumns({f"hei_{k}": a * F.col("lst_n") + b * (1 - F.col("ndvi_n")) for k, (a, b) in weights.items()})
    all_ = F.array_compact(F.array(*[F.col(f"hei_{k}") for k in weights]))
    return n.withColumn("hei_range", F.array_max(all_) - F.array_min(all_))


def heat_island(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row: vegetation_pct over all pixels, mean temperatures of vegetated and of other valid pixels, and their gap."""
    veg = F.col("ndvi") > threshold
    r = df.agg((100.0 * F.sum(F.when(veg, 1).otherwise(0)) / F.count("*")).alias("vegetation_pct"), F.avg(F.when(veg, F.col("lst"))).alias("mean_lst_vegetation"), F.avg(F.when(~veg, F.col("lst"))).alias("mean_lst_built_up"))
    return r.withColumn("uhi_intensity", F.col("mean_lst_built_up") - F.col("mean_lst_vegetation"))


def density(df: DataFrame, a: str, b: str, bins: int) -> DataFrame:
    """bin_a, bin_b, n: a two-dimensional histogram over the data's range with every bin present; the last bin is closed."""
    v = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ext = v.agg(F.min(a).alias("a0"), F.max(a).alias("a1"), F.min(b).alias("b0"), F.max(b).alias("b1"))
    pos = lambda c, lo, hi: F.least(F.floor((F.col(c) - F.col(lo)) * bins / F.nullif(F.col(hi) - F.col(lo), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    h = v.crossJoin(F.broadcast(ext)).groupBy(pos(a, "a0", "a1").alias("bin_a"), pos(b, "b0", "b1").alias("bin_b")).agg(F.count("*").alias("n"))
    axis = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin_a"))
    full = axis.crossJoin(axis.withColumnRenamed("bin_a", "bin_b"))
    return full.join(h, ["bin_a", "bin_b"], "left").fillna(0, ["n"])


def overlap_pct(df: DataFrame, cls: str, value: int, flag: str) -> Column:
    """Percentage of the pixels of a class at which a flag holds; NULL without such pixels."""
    return 100.0 * F.sum(F.when((F.col(cls) == value) & F.col(flag), 1).otherwise(0)) / F.nullif(F.sum(F.when(F.col(cls) == value, 1).otherwise(0)), F.lit(0))


def block_mean(df: DataFrame, bands: list[str], k: int) -> DataFrame:
    """Down-sampling by block means."""
    return df.groupBy(F.floor(F.col("row") / k).cast("int").alias("row"), F.floor(F.col("col") / k).cast("int").alias("col")).agg(*[F.avg(b).alias(b) for b in bands])


def stride(df: DataFrame, k: int) -> DataFrame:
    """Down-sampling of classes: every k-th pixel."""
    return df.where((F.col("row") % k == 0) & (F.col("col") % k == 0)).select((F.col("row") / k).cast("int").alias("row"), (F.col("col") / k).cast("int").alias("col"), *[c for c in df.columns if c not in ("row", "col")])


def mosaic(tiles: DataFrame, priority: str, *bands: str) -> DataFrame:
    """One value per pixel: the first valid one in order of priority."""
    return tiles.groupBy("row", "col").agg(*[F.min_by(F.col(b), F.when(F.col(b).isNotNull(), F.col(priority))).alias(b) for b in bands])


def temporal_median(scenes: DataFrame, *bands: str) -> DataFrame:
    return scenes.groupBy("row", "col").agg(*[F.median(b).alias(b) for b in bands])


def align(fine: DataFrame, coarse: DataFrame, ratio: float, value: str, fill: int = 0) -> DataFrame:
    """The value of the coarse pixel that holds each fine pixel's centre, `fill` outside."""
    k = fine.select("row", "col", F.floor((F.col("row") + 0.5) / ratio).cast("int").alias("r_"), F.floor((F.col("col") + 0.5) / ratio).cast("int").alias("c_"))
    c = coarse.select(F.col("row").alias("r_"), F.col("col").alias("c_"), value)
    return k.join(c, ["r_", "c_"], "left").select("row", "col", F.coalesce(value, F.lit(fill)).alias(value))


def sample(points: DataFrame, pixels: DataFrame, value: str, x0: float, y0: float, size: float) -> DataFrame:
    """points (x, y, ...) with the pixel value below them; outside or without data the median of the valid samples."""
    p = points.withColumns({"row": F.floor((F.lit(y0) - F.col("y")) / size).cast("int"), "col": F.floor((F.col("x") - x0) / size).cast("int")})
    j = p.join(pixels.select("row", "col", value), ["row", "col"], "left")
    return j.crossJoin(F.broadcast(j.agg(F.median(value).alias("_m")))).withColumn(value, F.coalesce(value, "_m")).drop("_m", "row", "col")


def hillshade_gradient(df: DataFrame, z: str) -> DataFrame:
    """row, col, shade: the east-facing and south-facing slope in 0..1. Central differences inside, one-sided at the borders."""
    wc, wr = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    diff = lambda w: F.when(F.lag(z).over(w).isNull(), F.lead(z).over(w) - F.col(z)).when(F.lead(z).over(w).isNull(), F.col(z) - F.lag(z).over(w)).otherwise((F.lead(z).over(w) - F.lag(z).over(w)) / 2)
    s = df.select("row", "col", (-diff(wc) + diff(wr)).alias("shade"))
    return normalize01(s, "shade").select("row", "col", F.col("shade_n").alias("shade"))


def smooth(df: DataFrame, z: str, sigma: float) -> DataFrame:
    """Gaussian smoothing that skips missing pixels: weighted sum over weight, in two separable passes; no data stays no data."""
    if sigma <= 0:
        return df.select("row", "col", z)
    reach = int(4 * sigma + 0.5)
    k = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-reach, reach + 1)]
    tot = sum(k)
    kernel = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(v / tot).alias("w")) for i, v in zip(range(-reach, reach + 1), k)])
    ext = df.agg(F.max("row").alias("mr"), F.max("col").alias("mc"))

    def reflect(v: Column, top: Column) -> Column:
        """Mirrored at the border, edge pixel repeated."""
        m = F.pmod(v, 2 * (top + 1))
        return F.when(m <= top, m).otherwise(2 * top + 1 - m)

    cur = df.select("row", "col", F.coalesce(F.col(z), F.lit(0.0)).alias("num"), F.when(F.col(z).isNotNull(), 1.0).otherwise(0.0).alias("den"))
    for axis, top in (("row", "mr"), ("col", "mc")):
        # Each pixel gathers from its mirrored neighbours: the wanted index is made on the gathering side.
        want = cur.select("row", "col").crossJoin(F.broadcast(ext)).withColumn("k", F.explode(kernel))
        want = want.withColumn("src", reflect(F.col(axis) + F.col("k.o"), F.col(top)).cast("int"))
        other = "col" if axis == "row" else "row"
        src = cur.select(F.col(axis).alias("src"), F.col(other).alias("o_"), "num", "den")
        j = want.join(src, (want.src == src.src) & (want[other] == src.o_))
        cur = j.groupBy("row", "col").agg(F.sum(F.col("k.w") * F.col("num")).alias("num"), F.sum(F.col("k.w") * F.col("den")).alias("den"))
    return df.select("row", "col", F.col(z).alias("_z")).join(cur, ["row", "col"]).select("row", "col", F.when(F.col("_z").isNotNull(), F.col("num") / F.nullif(F.col("den"), F.lit(0.0))).alias(z))


def contours(df: DataFrame, z: str, interval: float) -> DataFrame:
    """Contour segments (level, ax, ay, bx, by) by marching over windows of 2 x 2 pixels; x is col, y is row."""
    at = lambda dr, dc, n: df.select((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.col(z).cast("double").alias(n))
    w = at(0, 0, "a").join(at(0, 1, "b"), ["row", "col"]).join(at(1, 1, "c"), ["row", "col"]).join(at(1, 0, "d"), ["row", "col"]).where("a is not null and b is not null and c is not null and d is not null")
    lo, hi = F.least("a", "b", "c", "d"), F.greatest("a", "b", "c", "d")
    span = F.when(F.ceil(lo / interval) <= F.floor(hi / interval), F.sequence(F.ceil(lo / interval), F.floor(hi / interval)))
    lv = w.withColumn("level", F.explode(span)).withColumn("level", F.col("level") * F.lit(float(interval)))
    L = F.col("level")

    def cut(v0: str, v1: str, x0, y0, x1, y1):
        """Where the level cuts an edge of the window, half open so that a corner at the level counts once."""
        t = (L - F.col(v0)) / F.nullif(F.col(v1) - F.col(v0), F.lit(0.0))
        return F.when((F.col(v0) < L) != (F.col(v1) < L), F.struct((F.col("col") + x0 + t * (x1 - x0)).alias("x"), (F.col("row") + y0 + t * (y1 - y0)).alias("y")))

    cuts = F.array_compact(F.array(cut("a", "b", 0, 0, 1, 0), cut("b", "c", 1, 0, 1, 1), cut("c", "d", 1, 1, 0, 1), cut("d", "a", 0, 1, 0, 0)))
    s = lv.withColumn("p", cuts).where(F.size("p") >= 2)
    # Four cuts are a saddle: two segments, in the order round the window.
    pairs = F.when(F.size("p") == 4, F.array(F.slice("p", 1, 2), F.slice("p", 3, 2))).otherwise(F.array("p"))
    s = s.select("level", F.explode(pairs).alias("p"))
    return s.select("level", F.col("p")[0]["x"].alias("ax"), F.col("p")[0]["y"].alias("ay"), F.col("p")[1]["x"].alias("bx"), F.col("p")[1]["y"].alias("by"))


def neighbours(df: DataFrame, same: str | None = None) -> DataFrame:
    """Edges (a, b) between the ids of 4-connected pixels, both directions; `same`: only between equal values. df: id, row, col."""
    keep = ["id", "row", "col", *([same] if same else [])]
    l = df.select(*keep)
    out = None
    for dr, dc in ((0, 1), (1, 0)):
        r = df.select(F.col("id").alias("id2"), (F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), *([F.col(same).alias("same2")] if same else []))
        e = l.join(r, ["row", "col"])
        e = (e.where(F.col(same) == F.col("same2")) if same else e).select(F.col("id").alias("a"), F.col("id2").alias("b"))
        e = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        out = e if out is None else out.unionAll(e)
    return out


def lowest(df: DataFrame, z: str) -> DataFrame:
    """One row: row, col and floored value of the lowest pixel, the first in row-major order among equals."""
    r = df.where(F.col(z).isNotNull()).agg(F.min(F.struct(F.col(z).alias("z"), "row", "col")).alias("m"))
    return r.select(F.col("m.row").alias("row"), F.col("m.col").alias("col"), F.floor("m.z").cast("long").alias("elevation"))


def kde(points: DataFrame, cells: DataFrame, bandwidth: tuple[float, float] | None = None) -> DataFrame:
    """cells (cx, cy, ...) with a Gaussian density of the points (x, y).

    Scott's rule by axis. Points are first summed on a grid of a tenth of the bandwidth, so a cell meets sums and not
    points; beyond six bandwidths a point adds nothing that a double can hold beside the rest and is not met.
    """
    s = points.agg(F.count("*").alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy")).first()
    n = s["n"]
    if n < 2:
        return cells.withColumn("density", F.lit(0.0))
    hx, hy = bandwidth or (max(s["sx"] * n ** (-1 / 6), 1e-6), max(s["sy"] * n ** (-1 / 6), 1e-6))
    fx, fy = hx / 10, hy / 10
    sums = points.where("x is not null and y is not null").groupBy(F.floor(F.col("x") / fx).alias("gx"), F.floor(F.col("y") / fy).alias("gy")).agg(F.count("*").alias("m"), F.avg("x").alias("px"), F.avg("y").alias("py"))
    bx, by = 6 * hx, 6 * hy
    spread = lambda c, d: F.explode(F.sequence(F.floor(F.col(c) / d).cast("long") - 1, F.floor(F.col(c) / d).cast("long") + 1))
    src = sums.withColumn("ux", spread("px", bx)).withColumn("uy", spread("py", by))
    dst = cells.withColumns({"ux": F.floor(F.col("cx") / bx).cast("long"), "uy": F.floor(F.col("cy") / by).cast("long")})
    z2 = F.pow((F.col("cx") - F.col("px")) / hx, 2) + F.pow((F.col("cy") - F.col("py")) / hy, 2)
    j = dst.join(src, ["ux", "uy"], "left")
    d = F.coalesce(F.sum(F.col("m") * F.exp(-0.5 * z2)), F.lit(0.0)) / (n * 2 * math.pi * hx * hy)
    return j.groupBy(*cells.columns).agg(d.alias("density"))


def kmeans_ranked(df: DataFrame, col: str, k: int, by_size: bool = True, seed: int = 42) -> DataFrame:
    """df with `cluster`: one-dimensional k-means, clusters numbered by the size (else the value) of their centre; NULL for no data."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    ok = df.where(F.col(col).isNotNull())
    vec = VectorAssembler(inputCols=[col], outputCol="_v").transform(ok)
    model = KMeans(featuresCol="_v", predictionCol="_c", k=k, seed=seed).fit(vec)
    centres = [float(c[0]) for c in model.clusterCenters()]
    order = sorted(range(len(centres)), key=lambda i: abs(centres[i]) if by_size else centres[i])
    rank = F.create_map(*[x for r, i in enumerate(order) for x in (F.lit(i), F.lit(r))])
    got = model.transform(vec).withColumn("cluster", rank[F.col("_c")]).drop("_v", "_c")
    return got.unionByName(df.where(F.col(col).isNull()).withColumn("cluster", F.lit(None).cast("int")))


def warp(pixels: DataFrame, value: str, origin: tuple[float, float], size: float, to: DataFrame, inverse) -> DataFrame:
    """Nearest-neighbour resampling onto another grid: row, col of `to` with the value of the source pixel below its centre, NULL outside or without data.

    pixels: row, col, value, counted from the upper left `origin`; to: row, col, x, y, its own centres; inverse takes the Columns x
    and y to source coordinates. Declared as one equi-join, so either grid may be of any size.
    """
    sx, sy = inverse(F.col("x"), F.col("y"))
    at = to.select("row", "col", F.floor((F.lit(origin[1]) - sy) / size).cast("int").alias("_r"), F.floor((sx - origin[0]) / size).cast("int").alias("_c"))
    src = pixels.select(F.col("row").alias("_r"), F.col("col").alias("_c"), value)
    return at.join(src, ["_r", "_c"], "left").select("row", "col", value)


def grid(spark, rows: int, cols: int, origin: tuple[float, float], size: float) -> DataFrame:
    """row, col and the centre x, y of every pixel of a grid."""
    g = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    return g.withColumns({"x": F.lit(origin[0]) + (F.col("col") + 0.5) * size, "y": F.lit(origin[1]) - (F.col("row") + 0.5) * size})


def clipped(pixels: DataFrame, ring: list[tuple[float, float]], origin: tuple[float, float], size: float) -> DataFrame:
    """Pixels whose centre lies in a ring, rows and columns counted from the ring's own corner of the grid."""
    from geolathe.functions import geom

    xs, ys = zip(*ring)
    r0, c0 = int((origin[1] - max(ys)) // size), int((min(xs) - origin[0]) // size)
    line = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring])
    x, y = F.lit(origin[0]) + (F.col("col") + 0.5) * size, F.lit(origin[1]) - (F.col("row") + 0.5) * size
    box = F.col("row").between(r0, int((origin[1] - min(ys)) // size)) & F.col("col").between(c0, int((max(xs) - origin[0]) // size))
    return pixels.where(box & geom.in_ring(x, y, line)).withColumns({"row": F.col("row") - r0, "col": F.col("col") - c0})


def patches(pixels: DataFrame, classes: list[int], tree: int, pixel_area: float, min_area: float) -> DataFrame:
    """patch, n, area_ha, tree_share of each 4-connected region of pixels of the classes that has at least min_area hectares. pixels: id, row, col, cls; a patch is named by its least id."""
    from geolathe.operators import graph

    green = pixels.where(F.col("cls").isin(*classes)).select("id", "row", "col", "cls")
    of = graph.components(green.select(F.col("id").alias("node")), neighbours(green))
    p = green.join(of, F.col("id") == F.col("node")).groupBy(F.col("component").alias("patch")).agg(F.count("*").alias("n"), F.avg((F.col("cls") == tree).cast("double")).alias("tree_share"))
    return p.withColumn("area_ha", F.col("n") * pixel_area / 10_000).where(F.col("area_ha") >= min_area)
