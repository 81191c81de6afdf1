"""Networks against hand-calculated values and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolathe.functions import geom
from geolathe.operators import access as A
from geolathe.operators import graph as G
from geolathe.operators import spatial as S

LINE = "id bigint, geom array<struct<x:double,y:double>>"


def lines(spark, *coords):
    return spark.createDataFrame([(i, [(float(x), float(y)) for x, y in c]) for i, c in enumerate(coords)], LINE)


def edges(spark, df, digits=6):
    """id, u, v, w, bearing with numbered nodes."""
    e = G.ends(df, digits).withColumns({"w": geom.line_length(F.col("geom")), "bearing": geom.bearing(F.col("geom"))})
    return e.select("id", "u", "v", "w", "bearing")


def chords(df):
    a, b = F.col("geom")[0], F.element_at("geom", -1)
    return df.select("id", a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))


def values(df, key="id", col=None):
    col = col or [c for c in df.columns if c != key][0]
    return {r[key]: r[col] for r in df.collect()}


CROSS = [[(0, 0), (100, 0)], [(0, 0), (-100, 0)], [(0, 0), (0, 100)], [(0, 0), (0, -100)]]
GRID = [[(-100, -100), (100, -100)], [(100, -100), (100, 100)], [(100, 100), (-100, 100)], [(-100, 100), (-100, -100)], [(-100, 0), (100, 0)], [(0, -100), (0, 100)]]
COMB = [[(0, 0), (400, 0)], [(150, 0), (150, 100)], [(200, 0), (200, 100)], [(250, 0), (250, 100)]]
TURN = [[(0, 0), (100, 0)], [(100, 0), (200, 0)], [(200, 0), (200, 100)]]


def test_axial_map_of_a_cross(spark):
    m = values(G.axial_lines(edges(spark, lines(spark, *CROSS)).select("id", "u", "v", "bearing")), col="axial")
    assert m[0] == m[1] == 0 and m[2] == m[3] == 2


def test_grid_connectivity_and_integration(spark):
    c = chords(lines(spark, *GRID))
    t = S.touching_lines(c, "id")
    deg = {i: 0 for i in range(6)}
    for r in t.collect():
        deg[r["a"]] += 1
        deg[r["b"]] += 1
    assert set(deg.values()) == {3}
    # Each of six lines sees three at depth 1 and two at depth 2: total 7, so integration is D_6 / 0.2.
    d6 = 2 * (6 * (math.log2(8 / 3) - 1) + 1) / (5 * 4)
    got = values(G.axial_integration(t, c.select("id")))
    assert all(v == pytest.approx(d6 / 0.2) for v in got.values())


def test_comb_choice(spark):
    c = chords(lines(spark, *COMB))
    t = S.touching_lines(c, "id")
    e = t.select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(1.0).alias("w"), "metric")
    assert values(G.betweenness(e, of="node", by_hops=True)) == {0: 3.0, 1: 0.0, 2: 0.0, 3: 0.0}
    assert values(G.betweenness(e, 150.0, of="node", by_hops=True, metric="metric"))[0] == 2.0
    ln = c.select("id", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("l"))
    w = e.join(ln.withColumnsRenamed({"id": "u", "l": "lu"}), "u").join(ln.withColumnsRenamed({"id": "v", "l": "lv"}), "v")
    assert values(G.betweenness(w, of="node", by_hops=True, weighted=True))[0] == pytest.approx(30_000)


def test_angular_measures_of_a_turn(spark):
    e = edges(spark, lines(spark, *TURN))
    dual = G.angular_graph(e)
    r = {x["id"]: x for x in G.angular_measures(dual, e.select("id")).collect()}
    assert [r[i]["integration"] for i in range(3)] == pytest.approx([4, 4, 2])
    assert [r[i]["nach"] for i in range(3)] == pytest.approx([math.log(5) / math.log(4), math.log(7) / math.log(4), 1.0])
    # Within 150 m by mean lengths only neighbours are met.
    d = dual.withColumn("m", F.lit(100.0))
    n = {x["id"]: x["nach"] for x in G.angular_measures(d, e.select("id"), 150.0, metric=True).collect()}
    assert [n[i] for i in range(3)] == pytest.approx([1.0, math.log(5) / math.log(4), math.log(3) / math.log(4)])


def test_angular_measures_do_not_depend_on_orientation(spark):
    c, s = math.cos(0.3), math.sin(0.3)
    turned = [[(x * c - y * s, x * s + y * c) for x, y in l] for l in TURN]
    e = edges(spark, lines(spark, *turned), 3)
    r = values(G.angular_measures(G.angular_graph(e), e.select("id")), col="integration")
    assert [r[i] for i in range(3)] == pytest.approx([4, 4, 2])


def lattice(n=7, seed=3):
    rng = np.random.default_rng(seed)
    at = {(i, j): (i * 100 + rng.uniform(-25, 25), j * 100 + rng.uniform(-25, 25)) for i in range(n) for j in range(n)}
    out = []
    for i in range(n):
        for j in range(n):
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < n and b < n and rng.random() < 0.9:
                    out.append((len(out), i * n + j, a * n + b, math.dist(at[i, j], at[a, b]), *at[i, j], *at[a, b]))
    return out


SCHEMA = "id bigint, u bigint, v bigint, w double, ux double, uy double, vx double, vy double"


def brute_distances(rows, n):
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for _, u, v, w, *_ in rows:
        d[u, v] = d[v, u] = min(d[u, v], w)
    for k in range(n):
        d = np.minimum(d, d[:, k, None] + d[None, k])
    return d


def test_searches_equal_brute_force_whole_and_in_tiles(spark, monkeypatch):
    data = lattice()
    d = brute_distances(data, 49)
    e = spark.createDataFrame(data, SCHEMA)
    xy = {}
    for _, u, v, _, ux, uy, vx, vy in data:
        xy[u], xy[v] = (ux, uy), (vx, vy)
    src = spark.createDataFrame([(k, *p) for k, p in xy.items()], "source bigint, x double, y double")
    want = {(a, b): d[a, b] for a in xy for b in xy if d[a, b] <= 250}
    for limit in (G.LIMIT, 0):
        monkeypatch.setattr(G, "LIMIT", limit)
        got = {(r["source"], r["node"]): r["dist"] for r in G.reachable(e, src, 250.0, directed=False).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    with pytest.raises(ValueError):
        G.betweenness(e)


def test_choice_counts_each_shortest_way(spark):
    data = lattice(5)
    d = brute_distances(data, 25)
    got = values(G.betweenness(spark.createDataFrame(data, SCHEMA)))
    for i, u, v, w, *_ in data:
        on = sum(1 for a in range(25) for b in range(25) if a != b and np.isfinite(d[a, b]) and (abs(d[a, u] + w + d[v, b] - d[a, b]) < 1e-7 or abs(d[a, v] + w + d[u, b] - d[a, b]) < 1e-7))
        assert got[i] == pytest.approx(on)


def test_nearest_source_equals_brute_force(spark):
    data = lattice()
    d = brute_distances(data, 49)
    e = G.two_way(spark.createDataFrame(data, SCHEMA).select("u", "v", "w"))
    got = {r["node"]: (r["dist"], r["source"]) for r in G.nearest_source(e, spark.createDataFrame([(1, 5), (2, 30), (3, 30)], "source bigint, node bigint"), 400.0).collect()}
    for k in range(49):
        best = min((d[5, k], 1), (d[30, k], 2))
        assert (k in got) == (best[0] <= 400) and (k not in got or (got[k][0] == pytest.approx(best[0]) and got[k][1] == best[1]))


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(40)], "node bigint")
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (33, 32), (39, 39)], "a bigint, b bigint")
    got = values(G.components(nodes, e), "node")
    assert [got[i] for i in (0, 20, 21, 31, 33, 39)] == [0, 0, 21, 30, 32, 39]
    assert G.largest_component(G.components(nodes, e)).count() == 21
    assert G.components(nodes.limit(0), e.limit(0)).collect() == []


def test_noding(spark):
    df = lines(spark, [(0, 0), (200, 0)], [(100, -100), (100, 100)], [(50, 50), (150, 50)], [(200, 0), (300, 0)])
    p = G.node_lines(df).collect()
    assert sorted((r["line"], r["seq"], r["length"]) for r in p) == [(0, 0, 100.0), (0, 1, 100.0), (1, 0, 100.0), (1, 1, 50.0), (1, 2, 50.0), (2, 0, 50.0), (2, 1, 50.0), (3, 0, 100.0)]


def test_metric_reach(spark):
    rows = [(0, 0, 1, 100.0), (1, 1, 2, 100.0), (2, 10, 11, 100.0), (3, 11, 12, 50.0)]
    df = spark.createDataFrame(rows, "id bigint, u bigint, v bigint, w double")
    r = {x["id"]: x["all"] for x in G.metric_reach(df, {"all": 10_000.0}).collect()}
    assert set(r.values()) == {150.0, 200.0}


def test_scenario_delta(spark):
    s = lines(spark, [(0, 0), (100, 0)], [(0, 0), (0, 100)]).withColumn("m", F.col("id") * 1.0)
    after = lines(spark, [(0, 0), (0, 100)], [(0, 0), (100, 0)], [(0, 0), (50, 50)]).withColumn("m", F.lit(5.0))
    got = {r["id"]: (r["is_new"], r["m_delta"]) for r in G.scenario_delta(s, after, "id", ["m"], "id").collect()}
    assert got == {0: (False, 4.0), 1: (False, 5.0), 2: (True, None)}


def test_access(spark):
    g = lambda vs: A.gini(spark.createDataFrame([(float(v),) for v in vs], "v double"), "v").first()
    assert g([3])["gini"] is None and g([2, 2, 2])["gini"] == 0 and 0 < g([1, 1, 1, 100])["gini"] <= 1
    t = spark.createDataFrame([(2.0,), (4.0,), (6.0,), (math.inf,)], "t double")
    r = A.access_summary(t, "t", 15.0).first()
    assert (r["pct_within"], r["median_min"]) == (75.0, 4.0)
    gaps = spark.createDataFrame([(5.0, 5.0), (20.0, 5.0), (5.0, math.inf), (None, None)], "a double, b double").select(A.gap_class(F.col("a"), F.col("b"), 10).alias("g"))
    assert [r["g"] for r in gaps.collect()] == ["both", "second_only", "first_only", "none"]


def test_concave_hull(spark):
    from geolathe.operators.reach_shapes import concave, delaunay, reach_polygons

    rng = np.random.default_rng(4)
    p = rng.uniform(0, 100, (60, 2))
    t = delaunay(p)
    area = np.abs((p[t[:, 1], 0] - p[t[:, 0], 0]) * (p[t[:, 2], 1] - p[t[:, 0], 1]) - (p[t[:, 1], 1] - p[t[:, 0], 1]) * (p[t[:, 2], 0] - p[t[:, 0], 0])).sum() / 2
    from geolathe.operators.buildings import _area, hull

    assert area == pytest.approx(_area(hull(p)), rel=1e-3)
    # An L of points: the concave hull leaves most of the empty corner out.
    ell = np.array([(x, y) for x in range(0, 101, 10) for y in range(0, 101, 10) if x <= 30 or y <= 30], float) + rng.uniform(-1, 1, (77 - 0, 2))[: sum(1 for x in range(0, 101, 10) for y in range(0, 101, 10) if x <= 30 or y <= 30)]
    assert _area(concave(ell)) < 0.85 * _area(hull(ell))
    df = spark.createDataFrame([(1, 0.0, 0.0), (1, 100.0, 0.0), (1, 0.0, 100.0), (2, 0.0, 0.0), (2, 1.0, 1.0)], "g bigint, x double, y double")
    assert [(r["g"], r["area_ha"]) for r in reach_polygons(df, ["g"], "convex").collect()] == [(1, 0.5)]


def test_concave_hull_touches_every_point_as_a_simple_ring():
    from geolathe.operators.buildings import _area, hull
    from geolathe.operators.reach_shapes import concave

    rng = np.random.default_rng(9)
    for n in (3, 5, 20, 80):
        p = rng.uniform(0, 100, (n, 2))
        r = concave(p)
        assert len({tuple(v) for v in r}) == len(r) and 0 < _area(r) <= _area(hull(p)) * (1 + 1e-9)
        # A point is on the ring or inside it: no point is left out.
        ring = {tuple(v) for v in r}
        for x, y in p:
            if (x, y) not in ring:
                inside = sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(r, np.roll(r, -1, axis=0)))
                assert inside % 2 == 1
    assert concave(np.array([[0.0, 0.0], [1.0, 1.0]])) is None


def test_sketches_join_the_network(spark):
    from geolathe.operators.street_edits import joined, snapped_ends, street_count

    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 200.0, 0.0), (3, 0.0, 200.0), (4, 200.0, 200.0)], "node bigint, x double, y double")
    e = spark.createDataFrame([(0, 1, 2, 200.0, 0.0, 0.0, 200.0, 0.0), (1, 3, 4, 200.0, 0.0, 200.0, 200.0, 200.0), (2, 1, 3, 200.0, 0.0, 0.0, 0.0, 200.0)], "id bigint, u bigint, v bigint, w double, ax double, ay double, bx double, by double")
    sketch = spark.createDataFrame([(0, [(100.0, 2.0), (100.0, 198.0)])], LINE)
    ends = {r["which"]: r for r in snapped_ends(sketch, nodes, e, 5.0).collect()}
    assert ends["start"]["target"] == "street" and (ends["start"]["x"], ends["start"]["y"], ends["start"]["moved_m"]) == (100.0, 0.0, 2.0)
    n, out = joined(nodes, e, sketch)
    assert n.count() == 6 and sorted(r["node"] for r in n.collect())[:2] == [-2, -1]
    rows = out.collect()
    assert len(rows) == 6 and sorted(r["w"] for r in rows if r["source"] == "osm") == [100.0] * 4 + [200.0] and [r["w"] for r in rows if r["source"] == "added"] == [200.0]
    deg = {r["node"]: r["street_count"] for r in street_count(out).collect()}
    assert deg[-1] == deg[-2] == 3
    # Near a junction: no new node, one more edge.
    n, out = joined(nodes, e, spark.createDataFrame([(0, [(198.0, 1.0), (199.0, 199.0)])], LINE))
    assert n.count() == 4 and out.count() == 4


def test_noded_holds_the_whole_lattice(spark, tmp_path):
    from geolathe.plans.base import streets
    from geolathe.plans.site_graph import gr1_noded

    spark.createDataFrame([(k,) for k in range(1, 121)], "p_partkey bigint").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["line"] for r in gr1_noded(spark, str(tmp_path)).select("line").distinct().collect()}
    assert {r["id"] for r in streets(spark, str(tmp_path)).select("id").collect()} <= got


def test_gini_over_all_rows_runs_through_ranges(spark):
    from geolathe.operators.access import gini

    v = [float(i * 7 % 23 + 1) for i in range(200)]
    x = sorted(v)
    want = 2 * sum((i + 1) * y for i, y in enumerate(x)) / (len(x) * sum(x)) - (len(x) + 1) / len(x)
    df = spark.createDataFrame([(y,) for y in v] + [(None,)], "v double").repartition(5)
    assert gini(df, "v").first()["gini"] == pytest.approx(want)
    assert gini(df.where("v > 99"), "v").first()["gini"] is None


def in_tiles(monkeypatch):
    """Graphs of any size are cut into small tiles."""
    monkeypatch.setattr(G, "LIMIT", 0)
    monkeypatch.setattr(G, "TILE_SOURCES", 20, raising=False)


def same_in_tiles(monkeypatch, measure):
    """measure() gives the same rows, by id, over the whole graph and in tiles."""
    of = lambda: {r["id"]: tuple(r) for r in measure().collect()}
    want = of()
    in_tiles(monkeypatch)
    got = of()
    assert want and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def short_cuts(n=12):
    """A lattice with some streets shorter than the straight way between their ends."""
    return [(i, u, v, w * (0.6 if i % 5 == 0 else 1.0), *at) for i, u, v, w, *at in lattice(n)]


def test_angular_measures_in_tiles_equal_the_whole(spark, monkeypatch):
    e = spark.createDataFrame(short_cuts(), SCHEMA).withColumn("bearing", F.pmod(F.degrees(F.atan2(F.col("vy") - F.col("uy"), F.col("vx") - F.col("ux"))), F.lit(180.0)))
    m = e.select("id", "w")
    dual = G.angular_graph(e).join(m.toDF("a", "wa"), "a").join(m.toDF("b", "wb"), "b").select("a", "b", "cost", ((F.col("wa") + F.col("wb")) / 2).alias("m"))
    mid = e.select("id", ((F.col("ux") + F.col("vx")) / 2).alias("x"), ((F.col("uy") + F.col("vy")) / 2).alias("y"))
    same_in_tiles(monkeypatch, lambda: G.angular_measures(dual, mid, 150.0, metric=True))


def test_tiles_keep_isolated_sources_and_streets_without_length(spark, monkeypatch):
    rows = [(0, 0, 1, 0.0, 0.0, 0.0, 5000.0, 0.0), (1, 1, 2, 50.0, 5000.0, 0.0, 5050.0, 0.0), (2, 3, 4, 50.0, 0.0, 100.0, 50.0, 100.0)]
    src = spark.createDataFrame([(0, 0.0, 0.0), (9, 9000.0, 9000.0)], "source bigint, x double, y double")
    in_tiles(monkeypatch)
    got = {r["source"]: (r["reached"], r["total"]) for r in G.depth(spark.createDataFrame(rows, SCHEMA), src, 60.0, by_hops=False).collect()}
    assert got == {0: (2, 50.0), 9: (0, 0.0)}


def test_length_weighted_choice_in_tiles_equals_the_whole(spark, monkeypatch):
    e = spark.createDataFrame(short_cuts(), SCHEMA)
    same_in_tiles(monkeypatch, lambda: G.length_weighted_choice(e, 150.0))


def test_segment_integration_in_tiles_equals_the_whole(spark, monkeypatch):
    e = spark.createDataFrame(short_cuts(), SCHEMA)
    same_in_tiles(monkeypatch, lambda: G.segment_integration(e, 2))


def test_metric_reach_in_tiles_equals_the_whole(spark, monkeypatch):
    e = spark.createDataFrame(short_cuts(), SCHEMA)
    same_in_tiles(monkeypatch, lambda: G.metric_reach(e, {"near": 120.0, "far": 150.0}))


def test_choice_in_tiles_equals_the_whole(spark, monkeypatch):
    e = spark.createDataFrame(short_cuts(), SCHEMA)
    same_in_tiles(monkeypatch, lambda: G.betweenness(e, 150.0))
