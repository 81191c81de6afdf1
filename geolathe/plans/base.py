"""The relations that the site queries share, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolathe.operators.nearby import real_location
from geolathe.session import table


def spots(spark, d: str) -> DataFrame:
    """One row per place with a real location."""
    p = table(spark, d, "places").where(F.col("id").isNotNull() & real_location(F.col("geometry.x"), F.col("geometry.y")))
    return p.groupBy("id").agg(*[F.max(c).alias(c) for c in ("site", "name", "category", "hierarchy", "confidence")], F.max("geometry.x").alias("x"), F.max("geometry.y").alias("y"))


SPOTS = """spots AS (
  SELECT id, max(site) AS site, max(name) AS name, max(category) AS category, max(hierarchy) AS hierarchy, max(confidence) AS confidence,
         max(geometry.x) AS x, max(geometry.y) AS y
  FROM places WHERE id IS NOT NULL AND isfinite(geometry.x) AND isfinite(geometry.y) AND NOT (geometry.x = 0 AND geometry.y = 0) GROUP BY id)"""


def houses(spark, d: str) -> DataFrame:
    """One row per building and release, its first ring and a dense uid in order of id and release."""
    from pyspark.sql import Window

    b = table(spark, d, "buildings").where("geom is not null and size(geom) > 0 and size(geom[0]) >= 4")
    b = b.groupBy("id", "release").agg(F.max("site").alias("site"), F.max("class").alias("class"), F.max("geom").alias("geom"))
    # A dense number over the whole table: counts per site first, then a rank inside each, so no task sees all rows.
    n = b.groupBy("site").agg(F.count("*").alias("n"))
    off = n.select("site", (F.sum("n").over(Window.orderBy("site").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    rank = F.row_number().over(Window.partitionBy("site").orderBy("id", "release"))
    return b.withColumn("k", rank).join(off, "site").select((F.coalesce("before", F.lit(0)) + F.col("k") - 1).alias("uid"), "id", "release", "site", "class", "geom")


HOUSES = """houses AS (
  SELECT row_number() OVER (ORDER BY site, id, "release") - 1 AS uid, * FROM (
    SELECT id, "release", max(site) AS site, max(class) AS class, max(geom) AS geom FROM buildings
    WHERE geom IS NOT NULL AND len(geom) > 0 AND len(geom[1]) >= 4 GROUP BY id, "release"))"""

# Sides of each house's first ring, shifted to its first vertex.
SIDES = """sides AS (
  SELECT uid, i, geom[1][1].x AS ox, geom[1][1].y AS oy, geom[1][i].x - geom[1][1].x AS ax, geom[1][i].y - geom[1][1].y AS ay,
         geom[1][i % len(geom[1]) + 1].x - geom[1][1].x AS ex, geom[1][i % len(geom[1]) + 1].y - geom[1][1].y AS ey
  FROM (SELECT uid, geom, unnest(generate_series(1, len(geom[1]))) AS i FROM houses))"""
MEASURES = """measures AS (
  SELECT uid, abs(sum(ax * ey - ex * ay)) / 2 AS area, sum(sqrt((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay))) AS perimeter,
         max(ox) + sum((ax + ex) * (ax * ey - ex * ay)) / nullif(3 * sum(ax * ey - ex * ay), 0) AS cx,
         max(oy) + sum((ay + ey) * (ax * ey - ex * ay)) / nullif(3 * sum(ax * ey - ex * ay), 0) AS cy
  FROM sides GROUP BY uid)"""


def areas(spark, d: str) -> DataFrame:
    """Distinct zones with an area: zone_id, site, lu_class, geom."""
    z = table(spark, d, "zones").where("geom is not null and size(geom) > 0 and size(geom[0]) >= 3")
    return z.groupBy("zone_id").agg(F.max("site").alias("zone_site"), F.max("lu_class").alias("lu_class"), F.max("geom").alias("geom"))


AREAS = """areas AS (
  SELECT zone_id, max(site) AS zone_site, max(lu_class) AS lu_class, max(geom) AS geom FROM zones
  WHERE geom IS NOT NULL AND len(geom) > 0 AND len(geom[1]) >= 3 GROUP BY zone_id)"""
# Which spots lie in which areas: crossings of each ring, odd in the first and even in the others.
HELD = """edges_ AS (
  SELECT zone_id, ring, geom[ring][i].x AS ax, geom[ring][i].y AS ay, geom[ring][i % len(geom[ring]) + 1].x AS bx, geom[ring][i % len(geom[ring]) + 1].y AS by
  FROM (SELECT zone_id, geom, ring, unnest(generate_series(1, len(geom[ring]))) AS i FROM (SELECT zone_id, geom, unnest(generate_series(1, len(geom))) AS ring FROM areas))),
boxes AS (SELECT zone_id, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM edges_ WHERE ring = 1 GROUP BY 1),
odd AS (
  SELECT p.id, e.zone_id, e.ring, count(*) % 2 AS o FROM pts p JOIN boxes b ON p.x BETWEEN b.x0 AND b.x1 AND p.y BETWEEN b.y0 AND b.y1
  JOIN edges_ e ON e.zone_id = b.zone_id WHERE (e.ay > p.y) <> (e.by > p.y) AND p.x < (e.bx - e.ax) * (p.y - e.ay) / (e.by - e.ay) + e.ax GROUP BY ALL),
held AS (
  SELECT id, zone_id FROM odd GROUP BY ALL HAVING max(CASE WHEN ring = 1 THEN o ELSE 0 END) = 1 AND max(CASE WHEN ring > 1 THEN o ELSE 0 END) = 0)"""


def pixels(spark, d: str) -> DataFrame:
    """A raster of 100 columns made of orders: digital numbers of three bands (0 is no data), a class and a height."""
    k = F.col("o_orderkey")
    dn = lambda a, m, b: F.when(k % 97 == 0, 0).otherwise(k * a % m + b).cast("long")
    return table(spark, d, "orders").select(
        k.alias("id"), F.floor(k / 100).cast("int").alias("row"), (k % 100).cast("int").alias("col"),
        dn(7919, 9000, 500).alias("b04"), dn(104729, 9000, 700).alias("b08"), dn(31, 20000, 30000).alias("b10"), dn(1299709, 8000, 900).alias("b11"),
        (k * 13 % 5).cast("int").alias("cls"), F.when(k % 89 != 0, 700 + (k * 37 % 400) / 10.0).alias("z"),
    )


PIXELS = """pixels AS (
  SELECT o_orderkey AS id, CAST(o_orderkey // 100 AS INTEGER) AS "row", CAST(o_orderkey % 100 AS INTEGER) AS col,
         CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE o_orderkey * 7919 % 9000 + 500 END AS b04,
         CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE o_orderkey * 104729 % 9000 + 700 END AS b08,
         CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE o_orderkey * 31 % 20000 + 30000 END AS b10,
         CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE o_orderkey * 1299709 % 8000 + 900 END AS b11,
         CAST(o_orderkey * 13 % 5 AS INTEGER) AS cls, CASE WHEN o_orderkey % 89 <> 0 THEN 700 + (o_orderkey * 37 % 400) / 10.0 END AS z
  FROM orders)"""


def streets(spark, d: str) -> DataFrame:
    """A street lattice of 50 columns made of parts: id, u, v, w (metres), ends and geometry; some streets are missing."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k")).where("k % 11 <> 0")
    n = table(spark, d, "part").agg(F.max("p_partkey").alias("top"))
    steps = F.explode(F.array(F.struct(F.lit(1).alias("s"), F.lit(0).alias("z")), F.struct(F.lit(50).alias("s"), F.lit(1).alias("z"))))
    e = p.crossJoin(F.broadcast(n)).select("k", "top", steps.alias("st")).select("k", "top", "st.s", "st.z").where("k + s <= top and not (s = 1 and k % 50 = 49)")
    at = lambda c: F.struct((F.pmod(c, F.lit(50)) * 100.0).alias("x"), (F.floor(c / 50) * 100.0).alias("y"))
    e = e.select((F.col("k") * 2 + F.col("z")).alias("id"), F.col("k").alias("u"), (F.col("k") + F.col("s")).alias("v"), (90 + F.col("k") * 37 % 21).cast("double").alias("w"))
    return e.withColumns({"ux": at(F.col("u"))["x"], "uy": at(F.col("u"))["y"], "vx": at(F.col("v"))["x"], "vy": at(F.col("v"))["y"]}).withColumn("geom", F.array(F.struct(F.col("ux").alias("x"), F.col("uy").alias("y")), F.struct(F.col("vx").alias("x"), F.col("vy").alias("y"))))


STREETS = """streets AS (
  SELECT k * 2 + z AS id, k AS u, k + s AS v, CAST(90 + k * 37 % 21 AS DOUBLE) AS w, k % 50 * 100.0 AS ux, k // 50 * 100.0 AS uy, (k + s) % 50 * 100.0 AS vx, (k + s) // 50 * 100.0 AS vy
  FROM (SELECT p_partkey AS k, max(p_partkey) OVER () AS top FROM part), (VALUES (1, 0), (50, 1)) AS t(s, z)
  WHERE k % 11 <> 0 AND k + s <= top AND NOT (s = 1 AND k % 50 = 49)),
arcs AS (SELECT id, u, v, w FROM streets UNION ALL SELECT id, v, u, w FROM streets)"""

EDGE = 80.0  # metres of a hexagon's side in the queries


def hexed(rel: str, name: str = "hexed") -> str:
    """A CTE that adds the cell to a relation with x and y."""
    return f"""{name} AS (
  WITH a_ AS (SELECT *, (0.5773502691896257 * x - y / 3) / {EDGE} AS q0, (2.0 / 3 * y) / {EDGE} AS r0 FROM {rel} WHERE x IS NOT NULL AND y IS NOT NULL),
  b_ AS (SELECT *, floor(q0 + 0.5) AS rq, floor(r0 + 0.5) AS rr, floor(-q0 - r0 + 0.5) AS rs FROM a_),
  c_ AS (SELECT *, abs(rq - q0) AS dq, abs(rr - r0) AS dr, abs(rs + q0 + r0) AS ds FROM b_)
  SELECT * EXCLUDE (q0, r0, rq, rr, rs, dq, dr, ds),
    CAST(CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS VARCHAR) || ':' ||
    CAST(CAST(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS VARCHAR) AS cell FROM c_)"""


# All cells whose centre lies in the box of a site's spots.
GRID = f"""grid AS (
  WITH bx_ AS (SELECT site, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM spots GROUP BY site),
  r_ AS (SELECT *, unnest(generate_series(CAST(floor(y0 / {1.5 * EDGE}::DOUBLE) AS BIGINT), CAST(ceil(y1 / {1.5 * EDGE}::DOUBLE) AS BIGINT))) AS r FROM bx_),
  q_ AS (SELECT *, unnest(generate_series(CAST(floor(x0 / {1.7320508075688772 * EDGE}::DOUBLE - r / 2.0) AS BIGINT), CAST(ceil(x1 / {1.7320508075688772 * EDGE}::DOUBLE - r / 2.0) AS BIGINT))) AS q FROM r_)
  SELECT DISTINCT CAST(q AS VARCHAR) || ':' || CAST(r AS VARCHAR) AS cell FROM q_
  WHERE {EDGE * 1.7320508075688772}::DOUBLE * (q + r / 2.0) BETWEEN x0 AND x1 AND {EDGE * 1.5} * r BETWEEN y0 AND y1)"""


def site_grid(spark, d: str) -> DataFrame:
    from geolathe.functions import hexes

    b = spots(spark, d).groupBy("site").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return hexes.grid(b, EDGE).select("cell").distinct()
