"""Queries of map algebra on the raster of orders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from geolathe.operators import graph as G
from geolathe.operators import raster as R
from geolathe.plans.base import PIXELS, SPOTS, pixels, spots
from geolathe.session import shared_dir, table
from geolathe.sources import writers

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_clip = lambda e, a, b: f"CASE WHEN ({e}) IS NOT NULL THEN greatest({a}, least({b}, {e})) END"
_idx = lambda a, b: f"CAST({a} - {b} AS DOUBLE) / nullif({a} + {b}, 0)"
NDVI_LST = """nl AS (SELECT id, "row", col, CASE WHEN b04 <> 0 THEN ((2.75e-05 * b08 - 0.2) - (2.75e-05 * b04 - 0.2)) / nullif((2.75e-05 * b08 - 0.2) + (2.75e-05 * b04 - 0.2), 0) END AS ndvi0,
  CASE WHEN b10 <> 0 THEN 0.00341802::DOUBLE * b10 + 149 - 273.15 END AS lst, 2.75e-05 * b04 - 0.2 AS red FROM pixels),
v AS (SELECT id, "row", col, round(CASE WHEN ndvi0 BETWEEN -1 AND 1 THEN ndvi0 END, 9) AS ndvi, round(lst, 9) AS lst, red FROM nl)"""


def _ndvi_lst(spark, d):
    p = pixels(spark, d)
    n = R.difference_index(R.reflectance(F.col("b08")), R.reflectance(F.col("b04")), clipped=False)
    p = p.select("id", "row", "col", F.when(F.col("b04") != 0, n).alias("n0"), F.round(R.surface_temperature(F.col("b10")), 9).alias("lst"), R.reflectance(F.col("b04")).alias("red"))
    return p.select("id", "row", "col", F.round(F.when(F.col("n0").between(-1, 1), F.col("n0")), 9).alias("ndvi"), "lst", "red")


@query(f"""WITH {PIXELS} SELECT id, round({_clip(_idx('b08', 'b04'), -1, 1)}, 9) AS ndvi, round({_clip(_idx('b11', 'b08'), -1, 1)}, 9) AS ndbi, round({_clip(_idx('b04', 'b11'), -1, 1)}, 9) AS ndwi FROM pixels""")
def m1_indices(spark, d):
    i = lambda a, b: F.round(R.difference_index(F.col(a).cast("double"), F.col(b).cast("double")), 9)
    return pixels(spark, d).select("id", i("b08", "b04").alias("ndvi"), i("b11", "b08").alias("ndbi"), i("b04", "b11").alias("ndwi"))


@query(f"WITH {PIXELS} SELECT id, round(CASE WHEN b04 <> 0 THEN greatest(0, least(1, b04 / 10000.0)) END, 9) AS scaled, round(2.75e-05 * b08 - 0.2, 9) AS refl, round(CASE WHEN b10 <> 0 THEN 0.00341802::DOUBLE * b10 + 149 - 273.15 END, 6) AS lst FROM pixels")
def m2_scaling(spark, d):
    return pixels(spark, d).select("id", F.round(R.scaled(F.col("b04")), 9).alias("scaled"), F.round(R.reflectance(F.col("b08")), 9).alias("refl"), F.round(R.surface_temperature(F.col("b10")), 6).alias("lst"))


_FVC = "greatest(0, least(1, pow((ndvi - 0.2) / 0.3, 2)))"
_CAV = f"((1 - 0.9668) * 0.9863 * 0.55 * (1 - {_FVC}))"


@query(f"""WITH {PIXELS}, {NDVI_LST} SELECT id, round(CASE WHEN ndvi >= -1 AND ndvi < 0.2 THEN 0.973 - 0.047 * red WHEN ndvi >= 0.2 AND ndvi <= 0.5 THEN 0.9863 * {_FVC} + 0.9668 * (1 - {_FVC}) + {_CAV}
    WHEN ndvi > 0.5 AND ndvi <= 1 THEN 0.9863 + {_CAV} END, 5) AS emissivity FROM v""")
def m3_emissivity(spark, d):
    return _ndvi_lst(spark, d).select("id", F.round(R.emissivity(F.col("ndvi"), F.col("red")), 5).alias("emissivity"))


@query(f"""WITH {PIXELS}, a AS (SELECT id, cls, {_idx('b08', 'b04')} - {_idx('b11', 'b04')} AS delta, CASE WHEN {_idx('b04', 'b11')} > 0 THEN 1 ELSE 0 END AS dry, CASE WHEN {_idx('b08', 'b11')} > 0 THEN 1 ELSE 0 END AS flood FROM pixels),
    f AS (SELECT *, CASE WHEN dry = 1 AND flood = 1 THEN 1 WHEN dry = 0 AND flood = 1 THEN 2 WHEN dry = 1 AND flood = 0 THEN 3 ELSE 0 END AS fc FROM a)
    SELECT id, CASE WHEN delta < -0.15 THEN -1 WHEN delta > 0.15 THEN 1 ELSE 0 END AS change, fc AS flood, CASE WHEN cls = 4 AND fc IN (0, 3) THEN 1 ELSE fc END AS refined FROM f""")
def m4_classes(spark, d):
    i = lambda a, b: R.difference_index(F.col(a).cast("double"), F.col(b).cast("double"), clipped=False)
    p = pixels(spark, d).select("id", "cls", (i("b08", "b04") - i("b11", "b04")).alias("delta"), R.water(i("b04", "b11")).alias("dry"), R.water(i("b08", "b11")).alias("wet"))
    p = p.withColumn("fc", R.flood_class(F.col("dry"), F.col("wet")))
    return p.select("id", R.change_class(F.col("delta"), -0.15, 0.15).alias("change"), F.col("fc").alias("flood"), R.refine_flood(F.col("fc"), F.col("cls") == 4).alias("refined"))


@query(f"""WITH {PIXELS}, {NDVI_LST} SELECT round(100.0 * sum(CASE WHEN ndvi > 0.3 THEN 1 ELSE 0 END) / count(*), 6) AS vegetation_pct, round(avg(CASE WHEN ndvi > 0.3 THEN lst END), 6) AS mean_lst_vegetation,
    round(avg(CASE WHEN NOT ndvi > 0.3 THEN lst END), 6) AS mean_lst_built_up, round(avg(CASE WHEN NOT ndvi > 0.3 THEN lst END) - avg(CASE WHEN ndvi > 0.3 THEN lst END), 6) AS uhi_intensity FROM v""")
def a8_heat_island(spark, d):
    r = R.heat_island(_ndvi_lst(spark, d))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query(f"""WITH {PIXELS}, {NDVI_LST}, e AS (SELECT min(lst) AS l0, max(lst) AS l1, min(ndvi) AS n0, max(ndvi) AS n1 FROM v), n AS (SELECT id, (lst - l0) / (l1 - l0) AS l, 1 - (ndvi - n0) / (n1 - n0) AS g FROM v, e)
    SELECT id, round(0.5 * l + 0.5 * g, 7) AS hei_even, round(0.7 * l + 0.3 * g, 7) AS hei_hot, round(abs(0.2 * l - 0.2 * g), 7) AS hei_range FROM n""")
def a10_heat_exposure(spark, d):
    h = R.heat_exposure(_ndvi_lst(spark, d), {"even": (0.5, 0.5), "hot": (0.7, 0.3)})
    both = F.col("hei_even").isNotNull() & F.col("hei_hot").isNotNull()
    return h.select("id", F.round("hei_even", 7).alias("hei_even"), F.round("hei_hot", 7).alias("hei_hot"), F.round(F.when(both, F.col("hei_range")), 7).alias("hei_range"))


@query(f"""WITH {PIXELS}, {NDVI_LST}, w AS (SELECT * FROM v WHERE ndvi IS NOT NULL AND lst IS NOT NULL), e AS (SELECT min(ndvi) AS a0, max(ndvi) AS a1, min(lst) AS b0, max(lst) AS b1 FROM w),
    h AS (SELECT CAST(least(floor((ndvi - a0) * 20 / (a1 - a0)), 19) AS INTEGER) AS bin_a, CAST(least(floor((lst - b0) * 20 / (b1 - b0)), 19) AS INTEGER) AS bin_b, count(*) AS n FROM w, e GROUP BY 1, 2),
    g AS (SELECT CAST(x AS INTEGER) AS bin_a, CAST(y AS INTEGER) AS bin_b FROM range(20) a(x), range(20) b(y)) SELECT bin_a, bin_b, coalesce(n, 0) AS n FROM g LEFT JOIN h USING (bin_a, bin_b)""")
def a11_histogram(spark, d):
    return R.density(_ndvi_lst(spark, d), "ndvi", "lst", 20)


@query(f"WITH {PIXELS} SELECT round(quantile_cont(z, 0.02), 6) AS lo, round(quantile_cont(z, 0.98), 6) AS hi FROM pixels")
def a12_percentiles(spark, d):
    q = pixels(spark, d).agg(F.percentile("z", F.array(F.lit(0.02), F.lit(0.98))).alias("q"))
    return q.select(F.round(F.col("q")[0], 6).alias("lo"), F.round(F.col("q")[1], 6).alias("hi"))


@query(f"WITH {PIXELS} SELECT round(100.0 * sum(CASE WHEN cls = 1 AND b04 > 5000 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN cls = 1 THEN 1 ELSE 0 END), 0), 6) AS pct_1, round(100.0 * sum(CASE WHEN cls = 3 AND b04 > 5000 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN cls = 3 THEN 1 ELSE 0 END), 0), 6) AS pct_3 FROM pixels")
def a9_overlap(spark, d):
    p = pixels(spark, d).withColumn("wet", F.col("b04") > 5000)
    return p.agg(F.round(R.overlap_pct(p, "cls", 1, "wet"), 6).alias("pct_1"), F.round(R.overlap_pct(p, "cls", 3, "wet"), 6).alias("pct_3"))


@query(f"WITH {PIXELS} SELECT CAST(\"row\" // 4 AS INTEGER) AS \"row\", CAST(col // 4 AS INTEGER) AS col, round(avg(z), 6) AS z FROM pixels GROUP BY 1, 2")
def src7_block_mean(spark, d):
    return R.block_mean(pixels(spark, d), ["z"], 4).withColumn("z", F.round("z", 6))


@query(f"""WITH {PIXELS}, t AS (SELECT "row", col, 1 AS p, CASE WHEN b04 % 3 = 0 THEN z END AS v FROM pixels UNION ALL SELECT "row", col, 2, CASE WHEN b08 % 2 = 0 THEN z + 1 END FROM pixels)
    SELECT "row", col, arg_min(v, p) FILTER (WHERE v IS NOT NULL) AS v FROM t GROUP BY 1, 2""")
def src9_mosaic(spark, d):
    """First valid value by priority of tile."""
    p = pixels(spark, d)
    a = p.select("row", "col", F.lit(1).alias("p"), F.when(F.col("b04") % 3 == 0, F.col("z")).alias("v"))
    b = p.select("row", "col", F.lit(2).alias("p"), F.when(F.col("b08") % 2 == 0, F.col("z") + 1).alias("v"))
    return R.mosaic(a.unionByName(b), "p", "v")


@query(f"""WITH {PIXELS}, t AS (SELECT "row", col, b04 AS v FROM pixels UNION ALL SELECT "row", col, b08 FROM pixels UNION ALL SELECT "row", col, b11 FROM pixels) SELECT "row", col, CAST(median(v) AS DOUBLE) AS v FROM t GROUP BY 1, 2""")
def src10_temporal_median(spark, d):
    p = pixels(spark, d)
    t = p.select("row", "col", F.col("b04").alias("v")).unionAll(p.select("row", "col", "b08")).unionAll(p.select("row", "col", "b11"))
    return R.temporal_median(t, "v")


@query(f"""WITH {PIXELS}, c AS (SELECT "row", col, cls FROM pixels) SELECT f."row", f.col, coalesce(c.cls, 0) AS cls FROM pixels f LEFT JOIN c ON c."row" = floor((f."row" + 0.5) / 2.0) AND c.col = floor((f.col + 0.5) / 2.0)""")
def j14_aligned(spark, d):
    p = pixels(spark, d)
    return R.align(p, p, 2.0, "cls")


@query(f"""WITH {PIXELS}, p AS (SELECT c_custkey AS id, c_custkey * 7919 % 1200 + 0.5 AS x, 1000.0 - c_custkey * 104729 % 1100 AS y FROM customer),
    s AS (SELECT p.id, q.z FROM p LEFT JOIN pixels q ON q.col = CAST(floor(p.x / 10) AS INTEGER) AND q."row" = CAST(floor((1000 - p.y) / 10) AS INTEGER))
    SELECT id, coalesce(z, (SELECT median(z) FROM s)) AS z FROM s""")
def j15_sampled(spark, d):
    """Raster values below points; the median where there is none."""
    k = F.col("c_custkey")
    pts = table(spark, d, "customer").select(k.alias("id"), (k * 7919 % 1200 + 0.5).alias("x"), (1000.0 - k * 104729 % 1100).alias("y"))
    return R.sample(pts, pixels(spark, d), "z", 0.0, 1000.0, 10.0).select("id", "z")


@query(f"WITH {PIXELS} SELECT \"row\", col, CAST(floor(z) AS BIGINT) AS elevation FROM pixels WHERE z IS NOT NULL ORDER BY z, \"row\", col LIMIT 1")
def t2_lowest(spark, d):
    return R.lowest(pixels(spark, d), "z")


@query(f"""WITH {PIXELS}, g AS (SELECT *, lag(z) OVER (PARTITION BY "row" ORDER BY col) AS l, lead(z) OVER (PARTITION BY "row" ORDER BY col) AS r, lag(z) OVER (PARTITION BY col ORDER BY "row") AS u, lead(z) OVER (PARTITION BY col ORDER BY "row") AS w FROM pixels),
    s AS (SELECT "row", col, -(CASE WHEN l IS NULL THEN r - z WHEN r IS NULL THEN z - l ELSE (r - l) / 2 END) + (CASE WHEN u IS NULL THEN w - z WHEN w IS NULL THEN z - u ELSE (w - u) / 2 END) AS v FROM g)
    SELECT "row", col, round((v - (SELECT min(v) FROM s)) / (SELECT max(v) - min(v) FROM s), 7) AS shade FROM s""")
def m5_hillshade(spark, d):
    return R.hillshade_gradient(pixels(spark, d), "z").withColumn("shade", F.round("shade", 7))


_mirror = lambda v, top: f"CASE WHEN mod({v} + 20 * ({top} + 1), 2 * ({top} + 1)) <= {top} THEN mod({v} + 20 * ({top} + 1), 2 * ({top} + 1)) ELSE 2 * {top} + 1 - mod({v} + 20 * ({top} + 1), 2 * ({top} + 1)) END"


@query(f"""WITH {PIXELS}, ext AS (SELECT max("row") AS mr, max(col) AS mc FROM pixels), k AS (SELECT CAST(o AS INTEGER) AS o, exp(-0.5 * o * o) / sum(exp(-0.5 * o * o)) OVER () AS w FROM range(-4, 5) t(o)),
    a AS (SELECT "row", col, coalesce(CAST(z AS DOUBLE), 0.0) AS num, CASE WHEN z IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0 END AS den FROM pixels),
    wr AS (SELECT "row", col, w, {_mirror('"row" + o', "mr")} AS src FROM a, k, ext), b AS (SELECT t."row", t.col, sum(t.w * s.num) AS num, sum(t.w * s.den) AS den FROM wr t JOIN a s ON s."row" = t.src AND s.col = t.col GROUP BY ALL),
    wc AS (SELECT "row", col, w, {_mirror("col + o", "mc")} AS src FROM b, k, ext), c AS (SELECT t."row", t.col, sum(t.w * s.num) AS num, sum(t.w * s.den) AS den FROM wc t JOIN b s ON s.col = t.src AND s."row" = t."row" GROUP BY ALL)
    SELECT p."row", p.col, round(CASE WHEN p.z IS NOT NULL THEN c.num / nullif(c.den, 0) END, 6) AS z FROM pixels p JOIN c ON c."row" = p."row" AND c.col = p.col""")
def m5_smoothed(spark, d):
    return R.smooth(pixels(spark, d), "z", 1.0).withColumn("z", F.round("z", 6))


@query()
def m6_contours(spark, d):
    return R.contours(pixels(spark, d), "z", 5.0)


@query(f"""WITH RECURSIVE {PIXELS}, p AS (SELECT id, "row", col, cls FROM pixels WHERE cls <> 0),
    e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.cls = b.cls AND ((a."row" = b."row" AND b.col IN (a.col - 1, a.col + 1)) OR (a.col = b.col AND b."row" IN (a."row" - 1, a."row" + 1)))),
    c(n, lab) USING KEY (n) AS (SELECT id, id FROM p UNION SELECT e.b, min(c.lab) FROM c JOIN e ON e.a = c.n JOIN recurring.c AS old ON old.n = e.b WHERE c.lab < old.lab GROUP BY e.b),
    r AS (SELECT c.lab, max(p.cls) AS cls, count(*) AS n, min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1 FROM c JOIN p ON p.id = c.n GROUP BY c.lab)
    SELECT lab AS region, cls, n, r0, r1, c0, c1 FROM r""")
def snk3_regions(spark, d):
    """4-connected regions of equal class, as the rows a vectoriser writes."""
    p = pixels(spark, d).where("cls <> 0")
    lab = G.components(p.select(F.col("id").alias("node")), R.neighbours(p, "cls"))
    j = lab.join(p.select(F.col("id").alias("node"), "cls", "row", "col"), "node")
    return j.groupBy(F.col("component").alias("region")).agg(F.max("cls").alias("cls"), F.count("*").alias("n"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))


@query(f"""WITH RECURSIVE {PIXELS}, p AS (SELECT id, "row", col FROM pixels WHERE z <= 720), s AS (SELECT id FROM pixels WHERE z IS NOT NULL ORDER BY z, "row", col LIMIT 1),
    f(id) AS (SELECT id FROM s UNION SELECT b.id FROM f JOIN p a ON a.id = f.id JOIN p b ON (a."row" = b."row" AND b.col IN (a.col - 1, a.col + 1)) OR (a.col = b.col AND b."row" IN (a."row" - 1, a."row" + 1))) SELECT id FROM f""")
def gr2_flood_fill(spark, d):
    """The wet pixels 4-connected to the lowest one."""
    p = pixels(spark, d)
    wet = p.where("z <= 720")
    seed = R.lowest(p, "z").join(p, ["row", "col"]).select("id")
    lab = G.components(wet.select(F.col("id").alias("node")), R.neighbours(wet))
    of = lab.join(seed, lab.node == seed.id).select("component")
    return lab.join(of, "component").select(F.col("node").alias("id"))


@query(f"""WITH {PIXELS}, p AS (SELECT cls IN (1, 2) AS green, cls, z FROM pixels) SELECT count(*) AS n, round(100.0 * sum(CASE WHEN green THEN 1 ELSE 0 END) / count(*), 6) AS green_pct, round(sum(CASE WHEN green THEN 100.0 ELSE 0 END) / 10000, 4) AS green_ha FROM p""")
def a13_green_share(spark, d):
    p = pixels(spark, d).withColumn("green", F.col("cls").isin(1, 2))
    return p.agg(F.count("*").alias("n"), F.round(100.0 * F.avg(F.col("green").cast("double")), 6).alias("green_pct"), F.round(F.sum(F.when(F.col("green"), 100.0).otherwise(0.0)) / 10000, 4).alias("green_ha"))


def _land(spark, d):
    """The raster with land classes in blotches, two of them green."""
    r, c = F.col("row"), F.col("col")
    return pixels(spark, d).select("id", "row", "col", F.when((r % 6 < 4) & (c % 9 < 6) & ~((r % 6 == 2) & (c % 9 == 3)), F.when((r + c) % 3 == 0, 10).otherwise(20)).otherwise(50).alias("cls"))


@query(f"""WITH RECURSIVE {PIXELS}, land AS (SELECT id, "row", col, CASE WHEN "row" % 6 < 4 AND col % 9 < 6 AND NOT ("row" % 6 = 2 AND col % 9 = 3) THEN CASE WHEN ("row" + col) % 3 = 0 THEN 10 ELSE 20 END ELSE 50 END AS cls FROM pixels),
    g AS (SELECT * FROM land WHERE cls IN (10, 20)), adj AS (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a."row" = b."row" AND b.col = a.col + 1 UNION ALL SELECT b.id, a.id FROM g a JOIN g b ON a."row" = b."row" AND b.col = a.col + 1
      UNION ALL SELECT a.id, b.id FROM g a JOIN g b ON a.col = b.col AND b."row" = a."row" + 1 UNION ALL SELECT b.id, a.id FROM g a JOIN g b ON a.col = b.col AND b."row" = a."row" + 1),
    r(id, root) AS (SELECT id, id FROM g UNION SELECT adj.b, r.root FROM r JOIN adj ON adj.a = r.id WHERE adj.b > r.root), lab AS (SELECT id, min(root) AS patch FROM r GROUP BY 1)
    SELECT patch, count(*) AS n, round(avg(CASE WHEN cls = 10 THEN 1.0 ELSE 0.0 END), 9) AS tree_share, round(count(*) * 100.0 / 10000, 6) AS area_ha FROM lab JOIN g USING (id) GROUP BY 1 HAVING count(*) * 100.0 / 10000 >= 0.05""")
def a13_patches(spark, d):
    """Green patches of at least a twentieth of a hectare."""
    p = R.patches(_land(spark, d), [10, 20], 10, 100.0, 0.05)
    return p.select("patch", "n", F.round("tree_share", 9).alias("tree_share"), F.round("area_ha", 6).alias("area_ha"))


@query(f"""WITH {PIXELS}, t AS (SELECT CAST(i // 80 AS INTEGER) AS "row", CAST(i % 80 AS INTEGER) AS col FROM range(4800) r(i)), c AS (SELECT "row", col, 3.0 + (col + 0.5) * 12.5 AS x, 990.0 - ("row" + 0.5) * 12.5 AS y FROM t),
    k AS (SELECT "row", col, CAST(floor((1000.0 - (0.8 * y + 0.6 * x - 180.0)) / 10) AS INTEGER) AS r_, CAST(floor((0.8 * x - 0.6 * y + 400.0) / 10) AS INTEGER) AS c_ FROM c)
    SELECT k."row", k.col, p.z FROM k LEFT JOIN pixels p ON p."row" = k.r_ AND p.col = k.c_""")
def m13_warped(spark, d):
    """The heights on a coarser grid that is turned against the first."""
    to = R.grid(spark, 60, 80, (3.0, 990.0), 12.5)
    return R.warp(pixels(spark, d), "z", (0.0, 1000.0), 10.0, to, lambda x, y: (0.8 * x - 0.6 * y + 400.0, 0.8 * y + 0.6 * x - 180.0))


@query(f"""WITH {PIXELS} SELECT "row", col, CAST(z AS FLOAT) AS z FROM pixels""")
def snk2_raster(spark, d):
    """The heights written as 32-bit floats and read again."""
    return writers.write_raster(pixels(spark, d), "z", f"{shared_dir(spark)}/raster-{uuid.uuid4().hex}", origin=(0.0, 1000.0), size=10.0, epsg=32649)


@query(f"""WITH {PIXELS}, m AS (SELECT max("row") AS top FROM pixels) SELECT "row", string_agg(coalesce(CAST(p.cls AS VARCHAR), '-9999'), ' ' ORDER BY c.col) AS line FROM (SELECT DISTINCT "row" FROM pixels) r CROSS JOIN (SELECT CAST(i AS INTEGER) AS col FROM range(100) t(i)) c LEFT JOIN pixels p USING ("row", col) GROUP BY 1""")
def snk2_grid_lines(spark, d):
    """Each row of the classes as a line of a text grid."""
    return writers.grid_lines(pixels(spark, d), "cls", 100)


@query()
def a15_kmeans(spark, d):
    p = pixels(spark, d).select("id", R.difference_index(F.col("b08").cast("double"), F.col("b04").cast("double")).alias("delta"))
    return R.kmeans_ranked(p, "delta", 3).select("id", "cluster")


@query()
def a14_kde(spark, d):
    """Density of the places of each hexagon's site, one surface over all."""
    from geolathe.functions import hexes

    s = spots(spark, d)
    b = s.groupBy("site").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    cells = hexes.grid(b, 200.0).select("cell", "cx", "cy").distinct()
    return R.kde(s.select("x", "y"), cells, (250.0, 250.0)).select("cell", F.round("density", 14).alias("density"))


@query(f"""WITH {PIXELS}, q AS (SELECT quantile_cont(ln(1 + b04), 0.05) AS lo, quantile_cont(ln(1 + b04), 0.95) AS hi FROM pixels)
    SELECT id, CAST(round(255 * greatest(0, least(1, (ln(1 + b04) - lo) / (hi - lo)))) AS INTEGER) AS shade FROM pixels, q""")
def pr1_stretched(spark, d):
    """Percentile-clipped logarithmic stretch to 0..255."""
    p = pixels(spark, d).withColumn("v", F.log1p("b04"))
    q = p.agg(F.percentile("v", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    j = p.crossJoin(F.broadcast(q))
    return j.select("id", F.round(255 * R.clip((F.col("v") - F.col("q")[0]) / (F.col("q")[1] - F.col("q")[0]), 0.0, 1.0)).cast("int").alias("shade"))


@query()
def a3_zonal(spark, d):
    """Area-weighted mean of a band per hexagon of 45 m over pixels of 10 m."""
    from geolathe.functions import hexes
    from geolathe.operators import hexsummary as H

    p = pixels(spark, d).select((F.col("col") * 10.0 + 5).alias("x"), (F.col("row") * 10.0 + 5).alias("y"), "z")
    b = p.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    g = hexes.grid(b, 45.0).select("cell")
    r = H.rasters_to_hex(p, g, 45.0, ["z"], 10.0)
    return r.select("cell", F.round("z", 6).alias("z"), F.round("n_valid_px", 4).alias("n_valid_px"), F.round("valid_frac", 6).alias("valid_frac"))
