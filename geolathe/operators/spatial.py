"""Spatial joins as equi-joins on a square bucket, refined by exact expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolathe.functions import geom


def bucket(x: Column, y: Column, size: float) -> list[Column]:
    return [F.floor(x / size).cast("long").alias("bx"), F.floor(y / size).cast("long").alias("by")]


def _over(x0: Column, y0: Column, x1: Column, y1: Column, size: float, df: DataFrame) -> DataFrame:
    """df repeated for every bucket a box meets."""
    span = lambda a, b: F.explode(F.sequence(F.floor(a / size).cast("long"), F.floor(b / size).cast("long")))
    return df.withColumn("bx", span(x0, x1)).withColumn("by", span(y0, y1))


def within(points: DataFrame, polygons: DataFrame, *, size: float = 100.0, how: str = "inner") -> DataFrame:
    """points (x, y, ...) joined to the polygons (geom, ...) that hold them: in the first ring, in no further one.

    how: "inner" or "left"; overlapping polygons repeat a point. Polygon columns must not share a name with point columns.
    """
    box = geom.bounds(F.get("geom", F.lit(0)))
    cells = _over(box["x0"], box["y0"], box["x1"], box["y1"], size, polygons.where("geom is not null and size(geom) > 0"))
    p = points.select("*", *bucket(F.col("x"), F.col("y"), size))
    hit = p.join(cells, ["bx", "by"], how)
    inside = geom.in_polygon(F.col("x"), F.col("y"), F.col("geom"))
    if how == "inner":
        return hit.where(inside).drop("bx", "by", "geom")
    # A point that nothing holds keeps one row with NULLs.
    found = hit.where(inside).drop("bx", "by", "geom")
    held = found.select(*[F.col(c).alias(f"_k_{c}") for c in points.columns]).distinct()
    same = F.lit(True)
    for c in points.columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return found.unionByName(points.join(held, same, "left_anti"), allowMissingColumns=True)


def first_within(points: DataFrame, polygons: DataFrame, key: str, order: str, *, size: float = 100.0) -> DataFrame:
    """Like `within`, with the polygon of the least `order` for each point `key`."""
    hit = within(points, polygons, size=size)
    return hit.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def count_within(polygons: DataFrame, points: DataFrame, key: str, col: str = "n", *, size: float = 100.0, sums: tuple[str, ...] = ()) -> DataFrame:
    """key, the number of points in each polygon (0 if none) and sums of point columns."""
    hit = within(points, polygons.select(key, "geom"), size=size)
    got = hit.groupBy(key).agg(F.count("*").alias(col), *[F.sum(s).alias(f"sum_{s}") for s in sums])
    return polygons.select(key).distinct().join(got, key, "left").fillna(0, [col, *[f"sum_{s}" for s in sums]])


def within_distance(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Pairs of points at most `radius` apart, with `dist`. a: x, y, ...; b: x2, y2, ...; b is copied to the nine buckets around it."""
    p = a.select("*", *bucket(F.col("x"), F.col("y"), radius))
    r = _over(F.col("x2") - radius, F.col("y2") - radius, F.col("x2") + radius, F.col("y2") + radius, radius, b)
    d = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
    return p.join(r, ["bx", "by"]).withColumn("dist", d).where(F.col("dist") <= radius).drop("bx", "by")


def nearest(a: DataFrame, b: DataFrame, key: str, id_b: str, *, size: float = 100.0, max_rounds: int = 24) -> DataFrame:
    """a with the nearest b: `id_b` and `dist`; ties go to the least id_b. a: key, x, y, ...; b: id_b, x2, y2.

    Rings grow by doubling: a round looks at the buckets within its reach and settles the points whose find is nearer
    than that reach; only the others go on. So dense points never look far and no pair is made twice the distance needed.
    """
    from geolathe.session import materialize

    b = materialize(b.select(id_b, "x2", "y2").where("x2 is not null and y2 is not null"), "targets")
    open_ = a.where("x is not null and y is not null")
    done, reach = None, size
    for _ in range(max_rounds):
        wide = _over(F.col("x2") - reach, F.col("y2") - reach, F.col("x2") + reach, F.col("y2") + reach, reach, b)
        p = open_.select("*", *bucket(F.col("x"), F.col("y"), reach))
        d = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
        # Spark takes the copies for no larger than b and would gather them on the driver to broadcast them.
        best = p.join(wide.hint("merge"), ["bx", "by"], "left").groupBy(*[c for c in a.columns]).agg(F.min(F.struct(d.alias("dist"), F.col(id_b).alias("id"))).alias("m"))
        best = materialize(best, "nearest")
        near = F.coalesce(F.col("m.dist") <= reach, F.lit(False))
        got = best.where(near).select(*a.columns, F.col("m.id").alias(id_b), F.col("m.dist").alias("dist"))
        done = got if done is None else done.unionByName(got)
        open_ = best.where(~near).select(*a.columns)
        if not open_.take(1) or not b.take(1):
            break
        reach *= 2
    lost = open_.select(*a.columns, F.lit(None).cast(dict(b.dtypes)[id_b]).alias(id_b), F.lit(None).cast("double").alias("dist"))
    return done.unionByName(lost)


def touching_lines(lines: DataFrame, key: str, tolerance: float = 0.01, size: float = 100.0) -> DataFrame:
    """Pairs a < b of straight lines (ax, ay, bx, by) that touch or cross, and `metric`: the way from midpoint to midpoint over their meeting point."""
    x0, x1 = F.least("ax", "bx") - tolerance, F.greatest("ax", "bx") + tolerance
    y0, y1 = F.least("ay", "by") - tolerance, F.greatest("ay", "by") + tolerance
    base = lines.select(F.col(key).alias("k"), "ax", "ay", F.col("bx").alias("ex"), F.col("by").alias("ey"), x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))
    c = _over(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size, base).drop("x0", "y0", "x1", "y1")
    l, r = c.select(*[F.col(v).alias(f"{v}_1") if v not in ("bx", "by") else F.col(v) for v in c.columns]), c.select(*[F.col(v).alias(f"{v}_2") if v not in ("bx", "by") else F.col(v) for v in c.columns])
    p = l.join(r, ["bx", "by"]).where("k_1 < k_2").drop("bx", "by").distinct()
    s1 = tuple(F.col(f"{v}_1") for v in ("ax", "ay", "ex", "ey"))
    s2 = tuple(F.col(f"{v}_2") for v in ("ax", "ay", "ex", "ey"))
    t, u = geom.crossing(s1, s2)
    crosses = t.between(0, 1) & u.between(0, 1)
    # Ends that touch: the nearest of the four end-to-segment distances, with its place on both lines.
    ends = []
    for px, py, seg, first in ((s1[0], s1[1], s2, 0.0), (s1[2], s1[3], s2, 1.0)):
        ends.append(F.struct(geom.segment_distance(px, py, *seg).alias("d"), F.lit(first).alias("t"), geom.segment_foot(px, py, *seg).alias("u")))
    for px, py, seg, second in ((s2[0], s2[1], s1, 0.0), (s2[2], s2[3], s1, 1.0)):
        ends.append(F.struct(geom.segment_distance(px, py, *seg).alias("d"), geom.segment_foot(px, py, *seg).alias("t"), F.lit(second).alias("u")))
    meet = F.when(crosses, F.struct(F.lit(0.0).alias("d"), t.alias("t"), u.alias("u"))).otherwise(F.array_min(F.array(*ends)))
    len1, len2 = F.hypot(s1[2] - s1[0], s1[3] - s1[1]), F.hypot(s2[2] - s2[0], s2[3] - s2[1])
    got = p.withColumn("m", meet).where(F.col("m.d") <= tolerance)
    return got.select(F.col("k_1").alias("a"), F.col("k_2").alias("b"), (F.abs(F.col("m.t") - 0.5) * len1 + F.abs(F.col("m.u") - 0.5) * len2).alias("metric"))


def within_or_near(points: DataFrame, regions: DataFrame, key: str, region: str, gap: float, *, size: float = 100.0) -> DataFrame:
    """key, region, gap: the least region that holds a point, else the nearest whose border is at most `gap` away, else NULL; the distance to it, 0 inside.

    points: key, x, y; regions: region, geom. One row per point row.
    """
    ring = F.get("geom", F.lit(0))
    box = geom.bounds(ring)
    cells = _over(box["x0"] - gap, box["y0"] - gap, box["x1"] + gap, box["y1"] + gap, size, regions.where("geom is not null and size(geom) > 0").select(region, "geom"))
    hit = points.select(key, "x", "y", *bucket(F.col("x"), F.col("y"), size)).join(cells, ["bx", "by"])
    far = F.when(geom.in_polygon(F.col("x"), F.col("y"), F.col("geom")), 0.0).otherwise(F.round(geom.ring_distance(F.col("x"), F.col("y"), ring), 6))
    best = hit.select(key, region, far.alias("gap")).where(F.col("gap") <= gap).groupBy(key).agg(F.min(F.struct("gap", region)).alias("m"))
    return points.select(key).join(best, key, "left").select(key, F.col(f"m.{region}").alias(region), F.col("m.gap").alias("gap"))
