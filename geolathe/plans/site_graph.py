"""Queries of networks on the street lattice of parts: searches of limited reach, so that their work grows with the network."""

from __future__ import annotations

from pyspark.sql import functions as F

from geolathe.functions import geom
from geolathe.operators import access as A
from geolathe.operators import graph as G
from geolathe.operators import hexsummary as H
from geolathe.operators import reach_shapes as M
from geolathe.operators import spatial as S
from geolathe.operators import street_edits as E
from geolathe.plans.base import STREETS, streets
from geolathe.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _net(spark, d):
    return streets(spark, d).drop("geom")


def _facilities(spark, d):
    """Every supplier at a node of the lattice."""
    n = table(spark, d, "part").agg(F.max("p_partkey").alias("top"))
    return table(spark, d, "supplier").crossJoin(F.broadcast(n)).select(F.col("s_suppkey").alias("source"), F.pmod(F.col("s_suppkey") * 7919 + 137, F.col("top")).alias("node"))


FAC = "fac AS (SELECT s_suppkey AS source, (s_suppkey * 7919 + 137) % (SELECT max(p_partkey) FROM part) AS node FROM supplier)"


@query(f"WITH {STREETS} SELECT DISTINCT u, v, w, round(w / (4.8 * 1000 / 3600), 6) AS travel_time FROM arcs")
def src12_two_way(spark, d):
    """The network in both directions with walking times."""
    e = G.with_speed(G.two_way(_net(spark, d).select("u", "v", "w")), 4.8, "w")
    return e.select("u", "v", "w", F.round("travel_time", 6).alias("travel_time"))


@query(f"WITH {STREETS}, p AS (SELECT least(u, v % 40) AS a, greatest(u, v % 40) AS b, id, w FROM streets WHERE u <> v % 40) SELECT a AS u, b AS v, arg_max(w, id) AS w, max(id) AS id FROM p GROUP BY 1, 2")
def gr1_simple_graph(spark, d):
    """Parallel edges collapse, the last wins."""
    e = _net(spark, d).select(F.col("u"), (F.col("v") % 40).alias("v"), "id", "w").where("u <> v")
    return G.simple_graph(e.withColumn("o", F.col("id")), "o").select("u", "v", "w", "id")


@query(f"WITH {STREETS}, p AS (SELECT least(u, v) AS a, greatest(u, v) AS b, id FROM (SELECT u, v % 40 AS v, id FROM streets)) SELECT min(id) AS id FROM p GROUP BY a, b")
def a17_first_of_pair(spark, d):
    return G.undirected_once(_net(spark, d).select("u", (F.col("v") % 40).alias("v"), "id"), "id").select("id")


@query(f"""WITH RECURSIVE {STREETS}, n AS (SELECT u AS k FROM arcs UNION SELECT v FROM arcs), keep AS (SELECT u, v FROM arcs WHERE (u + v) % 7 <> 0),
    c(k, lab) USING KEY (k) AS (SELECT k, k FROM n UNION SELECT e.v, min(c.lab) FROM c JOIN keep e ON e.u = c.k JOIN recurring.c AS old ON old.k = e.v WHERE c.lab < old.lab GROUP BY e.v)
    SELECT k AS node, lab AS component FROM c""")
def gr2_components(spark, d):
    e = _net(spark, d)
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    return G.components(nodes, e.where("(u + v) % 7 <> 0").select(F.col("u").alias("a"), F.col("v").alias("b")))


@query(f"""WITH RECURSIVE {STREETS}, {FAC}, r(source, node, dist) USING KEY (source, node) AS (SELECT source, node, 0.0::DOUBLE FROM fac WHERE node IN (SELECT u FROM arcs) UNION
    SELECT r.source, a.v, min(r.dist + a.w) FROM r JOIN arcs a ON a.u = r.node LEFT JOIN recurring.r AS old ON old.source = r.source AND old.node = a.v WHERE r.dist + a.w <= 400 AND r.dist + a.w < coalesce(old.dist, 1e18) GROUP BY ALL)
    SELECT source, node, dist FROM r""")
def gr4_reach(spark, d):
    """All nodes within 400 m on foot of each facility."""
    e = _net(spark, d)
    both = e.select("u", "v", "w", "ux", "uy", "vx", "vy").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w", F.col("vx").alias("ux"), F.col("vy").alias("uy"), F.col("ux").alias("vx"), F.col("uy").alias("vy")))
    f = _facilities(spark, d)
    src = f.select(F.col("node").alias("source"), (F.pmod("node", F.lit(50)) * 100.0).alias("x"), (F.floor(F.col("node") / 50) * 100.0).alias("y")).distinct()
    r = G.reachable(both, src, 400.0).withColumnRenamed("source", "at")
    return f.join(r, f.node == r["at"]).select("source", r["node"], "dist")


@query(f"""WITH RECURSIVE {STREETS}, {FAC}, f0 AS (SELECT node, min(source) AS source FROM fac GROUP BY 1),
    r(node, dist, source) USING KEY (node) AS (SELECT node, 0.0::DOUBLE, source FROM f0 UNION
    SELECT v, (m).d, (m).s FROM (SELECT a.v, min(struct_pack(d := r.dist + a.w, s := r.source)) AS m, min(struct_pack(d := old.dist, s := old.source)) AS o FROM r JOIN arcs a ON a.u = r.node LEFT JOIN recurring.r AS old ON old.node = a.v WHERE r.dist + a.w <= 1200 GROUP BY a.v) WHERE o IS NULL OR m < o)
    SELECT node, dist, source FROM r""")
def gr5_nearest_facility(spark, d):
    """Owner and distance of every junction within 1200 m."""
    return G.nearest_source(G.two_way(_net(spark, d).select("u", "v", "w")), _facilities(spark, d), 1200.0)


@query(f"""WITH {STREETS}, b AS (SELECT id, u, v, ((atan2(vy - uy, vx - ux) * 180 / pi()) % 180 + 180) % 180 AS br FROM streets), i AS (SELECT id, u AS n, br FROM b UNION ALL SELECT id, v, br FROM b),
    p AS (SELECT x.id AS a, y.id AS b, abs(x.br - y.br) % 180 AS t FROM i x JOIN i y ON x.n = y.n AND x.id < y.id) SELECT a, b, round(min(least(t, 180 - t)) / 90, 6) AS cost FROM p GROUP BY 1, 2""")
def gr10_dual(spark, d):
    """The line graph weighted by turns."""
    s = streets(spark, d).withColumn("bearing", geom.bearing(F.col("geom")))
    return G.angular_graph(s.select("id", "u", "v", "bearing")).withColumn("cost", F.round("cost", 6))


@query(f"""WITH RECURSIVE {STREETS}, b AS (SELECT id, u, v, ((atan2(vy - uy, vx - ux) * 180 / pi()) % 180 + 180) % 180 AS br FROM streets), i AS (SELECT id, u AS n, br FROM b UNION ALL SELECT id, v, br FROM b),
    p AS (SELECT x.id AS a, y.id AS b FROM i x JOIN i y ON x.n = y.n AND x.id <> y.id WHERE least(abs(x.br - y.br) % 180, 180 - abs(x.br - y.br) % 180) <= 20),
    c(id, lab) USING KEY (id) AS (SELECT id, id FROM streets UNION SELECT p.b, min(c.lab) FROM c JOIN p ON p.a = c.id JOIN recurring.c AS old ON old.id = p.b WHERE c.lab < old.lab GROUP BY p.b)
    SELECT id, lab AS axial FROM c""")
def gr3_axial(spark, d):
    """Segments that run on in nearly one direction, as one line."""
    s = streets(spark, d).withColumn("bearing", geom.bearing(F.col("geom")))
    return G.axial_lines(s.select("id", "u", "v", "bearing"))


def _axial(spark, d):
    """Axial lines as straight chords."""
    s = streets(spark, d)
    a = gr3_axial(spark, d)
    p = s.join(a, "id").select("axial", F.explode("geom").alias("p"))
    g = p.groupBy("axial").agg(F.min(F.struct("p.x", "p.y")).alias("a"), F.max(F.struct("p.x", "p.y")).alias("b"))
    return g.select(F.col("axial").alias("id"), F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))


@query()
def j5_touching(spark, d):
    """Pairs of axial lines that touch or cross, with the way between their midpoints."""
    return S.touching_lines(_axial(spark, d), "id").withColumn("metric", F.round("metric", 4))


@query()
def gr6_integration(spark, d):
    """Integration of axial lines within three steps."""
    lines = _axial(spark, d)
    return G.axial_integration(S.touching_lines(lines, "id"), lines.select("id"), 3).withColumn("integration", F.round("integration", 6))


@query()
def gr7_axial_choice(spark, d):
    lines = _axial(spark, d).withColumn("len", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    t = S.touching_lines(lines, "id")
    e = t.select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(1.0).alias("w"), "metric")
    return G.betweenness(e, 800.0, of="node", by_hops=True, metric="metric").withColumn("choice", F.round("choice", 6))


@query()
def gr8_choice(spark, d):
    """Edge betweenness by length within 400 m."""
    return G.betweenness(_net(spark, d), 400.0).withColumn("choice", F.round("choice", 6))


@query()
def gr9_segment_integration(spark, d):
    return G.segment_integration(_net(spark, d), 6).withColumn("integration", F.round("integration", 6))


@query()
def gr11_angular(spark, d):
    """Angular choice, integration and its normalised form within 600 m."""
    s = streets(spark, d).withColumn("bearing", geom.bearing(F.col("geom")))
    dual = G.angular_graph(s.select("id", "u", "v", "bearing"))
    w = s.select("id", "w")
    dual = dual.join(w.withColumnRenamed("id", "a").withColumnRenamed("w", "wa"), "a").join(w.withColumnRenamed("id", "b").withColumnRenamed("w", "wb"), "b").select("a", "b", "cost", ((F.col("wa") + F.col("wb")) / 2).alias("m"))
    mid = s.select("id", ((F.col("ux") + F.col("vx")) / 2).alias("x"), ((F.col("uy") + F.col("vy")) / 2).alias("y"))
    r = G.angular_measures(dual, mid, 600.0, metric=True)
    return r.select("id", "choice", "reached", F.round("total", 6).alias("total"), F.round("nach", 6).alias("nach"))


@query(f"""WITH RECURSIVE {STREETS}, r(source, node, dist) USING KEY (source, node) AS (SELECT DISTINCT u, u, 0.0::DOUBLE FROM arcs UNION
    SELECT r.source, a.v, min(r.dist + a.w) FROM r JOIN arcs a ON a.u = r.node LEFT JOIN recurring.r AS old ON old.source = r.source AND old.node = a.v WHERE r.dist + a.w <= 500 AND r.dist + a.w < coalesce(old.dist, 1e18) GROUP BY ALL),
    ends AS (SELECT id, u AS source FROM streets UNION SELECT id, v FROM streets), held AS (SELECT id, node, min(dist) AS dist FROM ends JOIN r USING (source) GROUP BY ALL),
    both_ AS (SELECT a.id, s.w, greatest(a.dist, b.dist) AS far FROM held a JOIN streets s ON s.u = a.node JOIN held b ON b.id = a.id AND b.node = s.v)
    SELECT s.id, coalesce(sum(CASE WHEN far <= 300 THEN b.w END), 0) AS r300, coalesce(sum(b.w), 0) AS r500 FROM streets s LEFT JOIN both_ b USING (id) GROUP BY s.id""")
def gr12_reach_length(spark, d):
    """Street length within 300 and 500 m of a street's ends."""
    return G.metric_reach(_net(spark, d), {"r300": 300.0, "r500": 500.0})


@query()
def gr12_weighted_choice(spark, d):
    return G.length_weighted_choice(_net(spark, d), 400.0).withColumn("choice", F.round("choice", 3))


@query(f"WITH {STREETS}, a AS (SELECT id, w AS m FROM streets WHERE id % 3 = 0), b AS (SELECT id, w * 2 AS m FROM streets WHERE id % 2 = 0) SELECT s.id, coalesce(a.m, 0) AS one, coalesce(b.m, 0) AS two FROM streets s LEFT JOIN a USING (id) LEFT JOIN b USING (id)")
def gr13_pivot(spark, d):
    e = _net(spark, d)
    return G.pivot_metrics(e.select("id"), {"one": e.where("id % 3 = 0").select("id", "w"), "two": e.where("id % 2 = 0").select("id", (F.col("w") * 2).alias("w2"))})


@query(f"WITH {STREETS}, n AS (SELECT u AS node FROM arcs), c AS (SELECT node, count(*) AS degree FROM n GROUP BY 1) SELECT node, degree FROM c WHERE degree >= 3")
def a16_street_count(spark, d):
    """Street ends at each junction."""
    e = _net(spark, d)
    return e.select(F.col("u").alias("node")).unionAll(e.select("v")).groupBy("node").agg(F.count("*").alias("degree")).where("degree >= 3")


@query(f"""WITH {STREETS}, {FAC}, blk AS (SELECT DISTINCT CAST(floor(ux / 500) AS BIGINT) AS bx, CAST(floor(uy / 500) AS BIGINT) AS by_ FROM streets), n AS (SELECT k, count(*) AS deg, max(x) AS x, max(y) AS y FROM (SELECT u AS k, ux AS x, uy AS y FROM streets UNION ALL SELECT v, vx, vy FROM streets) GROUP BY 1)
    SELECT bx, by_ AS "by", count(n.k) AS crossings, round(count(n.k) / 0.25, 4) AS density FROM blk LEFT JOIN n ON n.deg >= 3 AND floor(n.x / 500) = bx AND floor(n.y / 500) = by_ GROUP BY 1, 2""")
def a4_crossings(spark, d):
    """Junctions of three or more streets per block of 500 m and square kilometre."""
    e = _net(spark, d)
    blk = e.select(F.floor(F.col("ux") / 500).alias("bx"), F.floor(F.col("uy") / 500).alias("by")).distinct()
    ends = e.select(F.col("u").alias("k"), F.col("ux").alias("x"), F.col("uy").alias("y")).unionAll(e.select("v", "vx", "vy"))
    n = ends.groupBy("k").agg(F.count("*").alias("deg"), F.max("x").alias("x"), F.max("y").alias("y")).where("deg >= 3")
    c = n.groupBy(F.floor(F.col("x") / 500).alias("bx"), F.floor(F.col("y") / 500).alias("by")).agg(F.count("*").alias("crossings"))
    return blk.join(c, ["bx", "by"], "left").fillna(0, ["crossings"]).withColumn("density", F.round(F.col("crossings") / 0.25, 4))


@query(f"""WITH {STREETS} SELECT 'A' AS part, id, round(sqrt((vx - ux) * (vx - ux) + (vy - uy) * (vy - uy)), 4) AS length, round(((atan2(vy - uy, vx - ux) * 180 / pi()) % 180 + 180) % 180, 4) AS bearing, round((ux + vx) / 2, 4) AS mx, round((uy + vy) / 2, 4) AS my FROM streets""")
def m9_lines(spark, d):
    """Length, bearing and midpoint of streets."""
    m = geom.interpolate(F.col("geom"), 0.5)
    s = streets(spark, d).select(F.lit("A").alias("part"), "id", F.round(geom.line_length(F.col("geom")), 4).alias("length"), F.round(geom.bearing(F.col("geom")), 4).alias("bearing"), m.alias("m"))
    return s.select("part", "id", "length", "bearing", F.round("m.x", 4).alias("mx"), F.round("m.y", 4).alias("my"))


@query()
def a2_hex_streets(spark, d):
    """Length and length-weighted mean per hexagon of 130 m."""
    from geolathe.functions import hexes

    s = streets(spark, d)
    b = s.agg(F.min("ux").alias("x0"), F.min("uy").alias("y0"), F.max("vx").alias("x1"), F.max("vy").alias("y1"))
    r = H.lines_to_hex(s.select("geom", "w"), hexes.grid(b, 130.0).select("cell"), 130.0, mean_w="w")
    return r.select("cell", F.round("street_length_m", 3).alias("street_length_m"), F.round("mean_w", 4).alias("mean_w"))


@query()
def gr1_noded(spark, d):
    """Diagonal sketches laid over the lattice and cut at every crossing."""
    s = streets(spark, d).select("id", "geom")
    sketch = s.where("id % 40 = 1").select((F.col("id") + 10_000_000).alias("id"), F.array(F.struct((F.col("geom")[0]["x"] - 50).alias("x"), (F.col("geom")[0]["y"] - 30).alias("y")), F.struct((F.col("geom")[0]["x"] + 60).alias("x"), (F.col("geom")[0]["y"] + 40).alias("y"))).alias("geom"))
    return G.node_lines(s.unionByName(sketch)).select("line", "seq", "ax", "ay", "bx", "by", F.round("length", 4).alias("length"))


def _banded(spark, d):
    r = gr4_reach(spark, d).withColumn("grp", F.col("source") % 4)
    return A.bands(r, [150.0, 300.0, 400.0])


_BANDED = f"""{STREETS}, {FAC}, r(source, node, dist) USING KEY (source, node) AS (SELECT source, node, 0.0::DOUBLE FROM fac WHERE node IN (SELECT u FROM arcs) UNION
    SELECT r.source, a.v, min(r.dist + a.w) FROM r JOIN arcs a ON a.u = r.node LEFT JOIN recurring.r AS old ON old.source = r.source AND old.node = a.v WHERE r.dist + a.w <= 400 AND r.dist + a.w < coalesce(old.dist, 1e18) GROUP BY ALL),
    bd AS (SELECT source % 4 AS grp, node, band FROM r, (VALUES (150.0), (300.0), (400.0)) AS t(band) WHERE dist <= band)"""


@query(f"WITH RECURSIVE {_BANDED}, f AS (SELECT grp, node, min(band) AS f FROM bd GROUP BY 1, 2) SELECT b.grp, CAST(b.band AS DOUBLE) AS band, count(*) AS nodes FROM f JOIN (SELECT DISTINCT grp, band FROM bd) b ON b.grp = f.grp AND b.band >= f.f GROUP BY 1, 2")
def w1_nested_bands(spark, d):
    """Junctions within each band of any facility of a group, bands nested."""
    return A.dissolved(_banded(spark, d), "grp")


@query(f"WITH RECURSIVE {_BANDED}, f AS (SELECT grp, node, min(band) AS band FROM bd GROUP BY 1, 2), g AS (SELECT grp, CAST(band AS DOUBLE) AS band, count(*) AS nodes FROM f GROUP BY 1, 2) SELECT grp, band, nodes, CAST(CAST(coalesce(lag(band) OVER (PARTITION BY grp ORDER BY band), 0) AS INTEGER) AS VARCHAR) || '-' || CAST(CAST(band AS INTEGER) AS VARCHAR) || ' min' AS label FROM g")
def w2_rings(spark, d):
    """What each band adds to the one before."""
    return A.rings(_banded(spark, d), "grp").select("grp", "band", "nodes", "label")


@query("SELECT c_mktsegment AS seg, round((sum(2.0 * rk * v) - n * max(t) - max(t)) / (n * max(t)), 8) AS gini FROM (SELECT c_mktsegment, v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY v) AS rk, count(*) OVER (PARTITION BY c_mktsegment) AS n, sum(v) OVER (PARTITION BY c_mktsegment) AS t FROM (SELECT c_mktsegment, CAST(c_custkey * 37 % 900 + 1 AS DOUBLE) AS v FROM customer)) GROUP BY c_mktsegment, n")
def a7_gini(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("seg"), (F.col("c_custkey") * 37 % 900 + 1).cast("double").alias("v"))
    return A.gini(c, "v", "seg").withColumn("gini", F.round("gini", 8))


@query("SELECT round(100.0 * avg(CASE WHEN t <= 15 THEN 1.0 ELSE 0 END), 6) AS pct_within, median(CASE WHEN t < 999 THEN t END) AS median_min FROM (SELECT CASE WHEN c_custkey % 13 <> 0 THEN CAST(c_custkey * 7919 % 40 AS DOUBLE) END AS t FROM customer)")
def a6_summary(spark, d):
    c = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 13 != 0, (F.col("c_custkey") * 7919 % 40).cast("double")).alias("t"))
    r = A.access_summary(c.withColumn("t", F.coalesce("t", F.lit(float("inf")))), "t", 15.0)
    return r.select(F.round("pct_within", 6).alias("pct_within"), "median_min")


@query("SELECT c_custkey AS id, CASE WHEN a <= 10 AND b <= 10 THEN 'both' WHEN b <= 10 THEN 'second_only' WHEN a <= 10 THEN 'first_only' ELSE 'none' END AS gap FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey * 31 % 25 END AS a, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 17 % 25 END AS b FROM customer)")
def pf5_gap(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), A.gap_class(F.when(k % 7 != 0, k * 31 % 25), F.when(k % 5 != 0, k * 17 % 25), 10).alias("gap"))


@query(f"""WITH {STREETS} SELECT id, id % 9 = 0 AS is_new, w + id % 4 AS w_after, CASE WHEN id % 9 <> 0 THEN CAST(id % 4 AS DOUBLE) END AS w_delta FROM streets""")
def j12_scenario(spark, d):
    """Before and after matched by midpoint; new lines have no difference."""
    s = streets(spark, d).select("id", "geom", "w")
    after = s.withColumn("w", F.col("w") + F.col("id") % 4)
    return G.scenario_delta(s.where("id % 9 <> 0"), after, "id", ["w"], "id")


@query(f"""WITH RECURSIVE {STREETS}, f1(node, dist) USING KEY (node) AS (SELECT k, 0.0::DOUBLE FROM (VALUES (101), (777)) AS t(k) UNION SELECT a.v, min(f1.dist + a.w) FROM f1 JOIN arcs a ON a.u = f1.node LEFT JOIN recurring.f1 AS old ON old.node = a.v WHERE f1.dist + a.w <= 900 AND f1.dist + a.w < coalesce(old.dist, 1e18) GROUP BY a.v),
    f2(node, dist) USING KEY (node) AS (SELECT 410, 0.0::DOUBLE UNION SELECT a.v, min(f2.dist + a.w) FROM f2 JOIN arcs a ON a.u = f2.node LEFT JOIN recurring.f2 AS old ON old.node = a.v WHERE f2.dist + a.w <= 900 AND f2.dist + a.w < coalesce(old.dist, 1e18) GROUP BY a.v)
    SELECT coalesce(f1.node, f2.node) AS node, f1.dist AS before, least(f1.dist, f2.dist) AS after FROM f1 FULL JOIN f2 ON f1.node = f2.node""")
def gr5_what_if(spark, d):
    """One more facility: nearest distance before and after."""
    e = G.two_way(_net(spark, d).select("u", "v", "w"))
    old = G.nearest_source(e, spark.createDataFrame([(1, 101), (2, 777)], "source bigint, node bigint"), 900.0)
    new = G.nearest_source(e, spark.createDataFrame([(3, 410)], "source bigint, node bigint"), 900.0)
    return A.what_if(old, new).select("node", "before", "after")


_XY = lambda c: ((F.pmod(c, F.lit(50)) * 100.0).alias("x"), (F.floor(F.col(c) / 50) * 100.0).alias("y"))


def _reach_xy(spark, d):
    """Junctions reached within 400 m, the facility's own, and the ends of streets walked in part."""
    r = gr4_reach(spark, d)
    e = _net(spark, d)
    both = e.select("u", "v", "w", "ux", "uy", "vx", "vy").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w", F.col("vx").alias("ux"), F.col("vy").alias("uy"), F.col("ux").alias("vx"), F.col("uy").alias("vy")))
    return r.select("source", *_XY("node")).unionByName(M.partly_walked(r, both, 400.0))


@query()
def m11_concave_hulls(spark, d):
    """Walking area of each facility as a concave hull."""
    return M.reach_polygons(_reach_xy(spark, d), ["source"]).select("source", F.size("ring").alias("corners"), "area_ha")


@query()
def m11_convex_hulls(spark, d):
    return M.reach_polygons(_reach_xy(spark, d), ["source"], "convex").select("source", F.size("ring").alias("corners"), "area_ha")


@query()
def gr14_service_areas(spark, d):
    """Places (customers) inside each facility's widest area."""
    a = M.reach_polygons(_reach_xy(spark, d), ["source"], "convex").select("source", F.array("ring").alias("geom"))
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("id"), (k * 7919 % 5000 + 0.25).alias("x"), (k * 104729 % 4000 + 0.25).alias("y"))
    return S.count_within(a, p, "source", "captured")


@query(f"""WITH {STREETS}, n AS (SELECT DISTINCT u AS node, ux AS x, uy AS y FROM streets UNION SELECT v, vx, vy FROM streets), c AS (SELECT c_custkey AS cell, c_custkey * 7919 % 5000 + 0.25 AS x, c_custkey * 104729 % 4000 + 0.25 AS y FROM customer)
    SELECT c.cell, round(min(sqrt((c.x - n.x) * (c.x - n.x) + (c.y - n.y) * (c.y - n.y))), 4) AS dist FROM c, n GROUP BY 1""")
def m12_nearest_cells(spark, d):
    """Land divided between junctions: each cell's nearest one (the distance, as owners tie)."""
    e = _net(spark, d)
    n = e.select(F.col("u").alias("owner"), F.col("ux").alias("x"), F.col("uy").alias("y")).union(e.select("v", "vx", "vy")).distinct()
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k.alias("cell"), (k * 7919 % 5000 + 0.25).alias("cx"), (k * 104729 % 4000 + 0.25).alias("cy"))
    return M.nearest_cells(n, c, 100.0).select("cell", F.round("dist", 4).alias("dist"))


def _sketch(spark, d):
    """New streets: a diagonal from near every 40th junction."""
    s = streets(spark, d).where("id % 80 = 1").select("id", "ux", "uy")
    p = lambda a, b: F.struct((F.col("ux") + a).alias("x"), (F.col("uy") + b).alias("y"))
    return s.select("id", F.array(p(3.0, 2.0), p(152.0, 97.0)).alias("geom"))


def _net_tables(spark, d):
    e = _net(spark, d)
    n = e.select(F.col("u").alias("node"), F.col("ux").alias("x"), F.col("uy").alias("y")).union(e.select("v", "vx", "vy")).distinct()
    return n, e.select("id", "u", "v", "w", F.col("ux").alias("ax"), F.col("uy").alias("ay"), F.col("vx").alias("bx"), F.col("vy").alias("by"))


@query()
def j8_snapped_ends(spark, d):
    """Where the ends of sketched streets go: junction, street, other sketch or nowhere."""
    n, e = _net_tables(spark, d)
    return E.snapped_ends(_sketch(spark, d), n, e, 5.0)


@query()
def j8_joined(spark, d):
    """The network with the sketches joined in."""
    n, e = _net_tables(spark, d)
    return E.joined(n, e, _sketch(spark, d))[1].select("id", "seq", "u", "v", F.round("w", 3).alias("w"), "source", "key")


@query(f"WITH {STREETS}, {FAC}, n AS (SELECT DISTINCT u AS node FROM arcs), g AS (SELECT c_custkey AS cell, c_custkey * 31 % (SELECT max(p_partkey) FROM part) AS node FROM customer), f AS (SELECT node, min(source) AS source FROM fac GROUP BY 1) SELECT g.cell, f.source, CASE WHEN f.source IS NULL THEN 'inf'::DOUBLE ELSE 0.0 END AS minutes FROM g LEFT JOIN f USING (node)")
def j10_lookup(spark, d):
    """Times at each cell's junction; not reached is infinite; of facilities at one junction the first wins."""
    top = table(spark, d, "part").agg(F.max("p_partkey").alias("top"))
    g = table(spark, d, "customer").crossJoin(F.broadcast(top)).select(F.col("c_custkey").alias("cell"), (F.col("c_custkey") * 31 % F.col("top")).alias("node"))
    f = _facilities(spark, d).groupBy("node").agg(F.min("source").alias("source")).withColumn("sec", F.lit(0.0))
    return g.join(f, "node", "left").select("cell", "source", A.minutes(g, "sec").alias("minutes"))
