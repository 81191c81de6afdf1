"""Rasters, hexagons, buildings, places, sources and sinks against hand-calculated values."""

import math

import pytest
from pyspark.sql import functions as F

from geolathe.functions import geom, hexes
from geolathe.operators import buildings as B
from geolathe.operators import hexsummary as H
from geolathe.operators import places as P
from geolathe.operators import raster as R
from geolathe.operators import spatial as S
from geolathe.sources import readers
from geolathe.sources import writers

POLY = "uid bigint, geom array<array<struct<x:double,y:double>>>"


def square(x, y, s):
    return [[(float(x), float(y)), (float(x + s), float(y)), (float(x + s), float(y + s)), (float(x), float(y + s)), (float(x), float(y))]]


def one(spark, schema, *row):
    return spark.createDataFrame([row], schema)


def test_indices_and_scaling(spark):
    df = spark.createDataFrame([(0,), (5000,), (10000,), (15000,), (None,)], "dn bigint")
    assert [r[0] for r in df.select(R.scaled(F.col("dn"))).collect()] == [None, 0.5, 1.0, 1.0, None]
    ab = spark.createDataFrame([(0.5, 0.1), (0.0, 0.0), (None, 1.0)], "a double, b double")
    got = [r[0] for r in ab.select(R.difference_index(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.6667, abs=1e-4) and got[1:] == [None, None]
    c = spark.createDataFrame([(-0.2,), (0.0,), (0.2,), (None,)], "d double")
    assert [r[0] for r in c.select(R.change_class(F.col("d"), -0.05, 0.05)).collect()] == [-1, 0, 1, 0]
    t = spark.createDataFrame([(0,), (44000,)], "d bigint").select(R.surface_temperature(F.col("d"))).collect()
    assert t[0][0] is None and t[1][0] == pytest.approx(0.00341802 * 44000 + 149 - 273.15)


def test_floods(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (0, 1), (1, 0)], "dry int, wet int").withColumn("c", R.flood_class(F.col("dry"), F.col("wet")))
    assert [r["c"] for r in df.collect()] == [0, 1, 2, 3]
    perm = spark.createDataFrame([(0, True), (1, False), (2, True), (3, True)], "c int, p boolean").select(R.refine_flood(F.col("c"), F.col("p")))
    assert [r[0] for r in perm.collect()] == [1, 1, 2, 1]
    pct = spark.createDataFrame([(1, True), (1, False), (3, True), (3, True)], "c int, p boolean")
    assert pct.agg(R.overlap_pct(pct, "c", 1, "p"), R.overlap_pct(pct, "c", 3, "p"), R.overlap_pct(pct, "c", 2, "p")).first()[:] == (50.0, 100.0, None)


def test_heat(spark):
    df = spark.createDataFrame([(0.5, 30.0), (0.5, 32.0), (0.1, 40.0), (0.1, 42.0)], "ndvi double, lst double")
    r = R.heat_island(df).first()
    assert (r["mean_lst_vegetation"], r["mean_lst_built_up"], r["uhi_intensity"], r["vegetation_pct"]) == (31.0, 41.0, 10.0, 50.0)
    r = R.heat_island(spark.createDataFrame([(0.5, 30.0), (None, 99.0), (0.1, 40.0)], "ndvi double, lst double")).first()
    assert r["mean_lst_built_up"] == 40.0
    h = R.heat_exposure(spark.createDataFrame([(0.0, 0.0), (1.0, 10.0)], "ndvi double, lst double"), {"even": (0.5, 0.5)}).collect()
    assert [x["hei_even"] for x in h] == [0.5, 0.5]
    n = [x["v_n"] for x in R.normalize01(spark.createDataFrame([(10.0,), (20.0,), (30.0,)], "v double"), "v").collect()]
    assert n == [0.0, 0.5, 1.0]


def test_emissivity(spark):
    df = spark.createDataFrame([(-0.5, 0.1), (0.35, 0.1), (0.8, 0.1), (None, 0.1), (2.0, 0.1)], "n double, r double")
    e = [r[0] for r in df.select(R.emissivity(F.col("n"), F.col("r"))).collect()]
    assert e[0] == pytest.approx(0.973 - 0.047 * 0.1) and e[1] is not None and e[2] > e[0] and e[3:] == [None, None]


def test_stencils(spark):
    px = [(r, c, 100.0 if c != 7 else None) for r in range(20) for c in range(20)]
    s = {(r["row"], r["col"]): r["z"] for r in R.smooth(spark.createDataFrame(px, "row int, col int, z double"), "z", 2.0).collect()}
    assert s[10, 7] is None and all(abs(v - 100) < 1e-9 for k, v in s.items() if k[1] != 7)
    cone = spark.createDataFrame([(r, c, 700 - 0.5 * math.hypot(r - 15, c - 15)) for r in range(30) for c in range(30)], "row int, col int, z double")
    levels = R.contours(cone, "z", 2.0).collect()
    assert levels and all(r["level"] % 2 == 0 for r in levels)
    assert all(abs(700 - 0.5 * math.hypot(r["ax"] - 15, r["ay"] - 15) - r["level"]) < 0.15 for r in levels if r["level"] < 698)
    low = R.lowest(spark.createDataFrame([(0, 1, 5.5), (0, 0, 5.5), (1, 1, None)], "row int, col int, z double"), "z").first()
    assert low[:] == (0, 0, 5)


def test_kmeans_ranks_by_size(spark):
    df = spark.createDataFrame([(i, v + 0.001 * i) for i, v in enumerate([0.0] * 20 + [0.3] * 20 + [-0.6] * 20)] + [(99, None)], "id bigint, d double")
    got = {r["id"]: r["cluster"] for r in R.kmeans_ranked(df, "d", 3).collect()}
    assert got[0] == 0 and got[25] == 1 and got[45] == 2 and got[99] is None


def test_hexagons(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0, "a", 2.0), (2, 1.0, 1.0, "a", 4.0), (3, 500.0, 500.0, "b", None), (4, None, None, "c", 1.0)], "id bigint, x double, y double, k string, v double")
    grid = hexes.grid(spark.createDataFrame([(-200.0, -200.0, 200.0, 200.0)], "x0 double, y0 double, x1 double, y1 double"), 50.0)
    out = {r["cell"]: r for r in H.points_to_hex(pts, grid, 50.0, n=("id", "count"), s=("v", "sum"), m=("v", "mean"), top=("k", "mode")).collect()}
    assert out["0:0"]["n"] == 2 and out["0:0"]["m"] == 3.0 and out["0:0"]["top"] == "a"
    assert out["1:0"]["n"] == 0 and out["1:0"]["s"] == 0 and out["1:0"]["m"] is None
    # Every centre lies in its own cell.
    same = grid.withColumn("c2", hexes.cell(F.col("cx"), F.col("cy"), 50.0)).where("cell <> c2").count()
    assert same == 0


def test_lines_are_cut_at_hexagons(spark):
    line = spark.createDataFrame([([(-140.0, 3.0), (140.0, 3.0)], 7.0), ([(0.0, -10.0), (0.0, 10.0)], None)], "geom array<struct<x:double,y:double>>, v double")
    grid = hexes.grid(spark.createDataFrame([(-400.0, -400.0, 400.0, 400.0)], "x0 double, y0 double, x1 double, y1 double"), 50.0)
    out = H.lines_to_hex(line, grid, 50.0, mean_v="v").collect()
    assert sum(r["street_length_m"] for r in out) == pytest.approx(300.0)
    mid = next(r for r in out if r["cell"] == "0:0")
    assert mid["street_length_m"] == pytest.approx(50 * math.sqrt(3) + 20) and mid["mean_v"] == pytest.approx(7.0)


def test_shapes(spark):
    df = spark.createDataFrame([(0, square(0, 0, 6)), (1, square(50, 0, 15)), (2, square(100, 0, 40)), (3, [[(0.0, 0.0), (1.0, 1.0)]])], POLY)
    r = {x["uid"]: x for x in B.shape_measures(df, "uid").collect()}
    assert r[0]["area"] == 36 and r[0]["convexity"] == pytest.approx(1) and r[0]["corners"] == 4 and r[0]["squareness"] == pytest.approx(0, abs=1e-9)
    assert r[0]["elongation"] == pytest.approx(1) and r[0]["rectangularity"] == pytest.approx(1) and r[0]["eri"] == pytest.approx(1)
    assert r[1]["longest_axis"] == pytest.approx(15 * math.sqrt(2)) and r[3]["convexity"] is None


def test_geometry_expressions(spark):
    hole = [square(0, 0, 10)[0], square(2, 2, 2)[0]]
    df = one(spark, POLY, 1, hole)
    c = geom.ring_centroid(F.col("geom")[0])
    r = df.select(geom.polygon_area(F.col("geom")).alias("a"), geom.ring_perimeter(F.col("geom")[0]).alias("p"), c["x"].alias("cx"), geom.in_polygon(F.lit(3.0), F.lit(3.0), F.col("geom")).alias("h"), geom.in_polygon(F.lit(5.0), F.lit(5.0), F.col("geom")).alias("i"), geom.ring_distance(F.lit(15.0), F.lit(5.0), F.col("geom")[0]).alias("d")).first()
    assert r[:] == (96.0, 40.0, 5.0, False, True, 5.0)
    line = one(spark, "g array<struct<x:double,y:double>>", [(0.0, 0.0), (3.0, 4.0), (3.0, 10.0)])
    m = geom.interpolate(F.col("g"), 0.5)
    q = line.select(geom.line_length(F.col("g")).alias("l"), geom.bearing(F.col("g")).alias("b"), m["x"].alias("x"), m["y"].alias("y")).first()
    assert q["l"] == 11.0 and q["b"] == pytest.approx(math.degrees(math.atan2(10, 3))) and (q["x"], q["y"]) == (3.0, 4.5)
    e, n = geom.to_utm(F.lit(108.0), F.lit(13.98))
    u = spark.range(1).select(e.alias("e"), n.alias("n"), geom.utm_epsg(F.lit(108.0), F.lit(13.98)).alias("z")).first()
    assert u["e"] == pytest.approx(175_867.95, abs=0.05) and u["n"] == pytest.approx(1_547_565.80, abs=0.05) and u["z"] == 32649


def test_massing_and_mesh(spark):
    df = spark.createDataFrame([(0, 30.0, None, None), (1, 200.0, 12.5, 4.0), (2, 200.0, 12.5, None)], "uid bigint, area double, height double, num_floors double")
    ladder = [(F.col("area") < 40, (1, 1), (3.0, 3.0)), (F.lit(True), (2, 4), (6.0, 12.0))]
    a = {r["uid"]: r for r in B.massing(df, "uid", ladder).collect()}
    b = {r["uid"]: r for r in B.massing(df.repartition(3), "uid", ladder).collect()}
    assert a == b and a[0]["height_est"] == 3.0 and (a[1]["height_est"], a[1]["floors_est"]) == (12.5, 4.0)
    assert 6 <= a[2]["height_est"] <= 12 and a[2]["volume_est"] == pytest.approx(200 * a[2]["height_est"])
    m = spark.createDataFrame([(1, square(0, 0, 10), 100.0, 5.0)], "uid bigint, geom array<array<struct<x:double,y:double>>>, base_z double, height double")
    v, f = B.walls(m, "uid").collect(), B.faces(m, "uid").collect()
    assert len(v) == 8 and {r["z"] for r in v} == {100.0, 105.0} and len(f) == 2 * 2 + 4 * 2


def test_spatial_joins(spark):
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 50.0, 50.0), (3, 305.0, 5.0)], "id bigint, x double, y double")
    zones = spark.createDataFrame([(0, square(0, 0, 20)), (1, square(0, 0, 400)), (2, None)], POLY.replace("uid", "z"))
    assert sorted((r["id"], r["z"]) for r in S.within(pts, zones).collect()) == [(1, 0), (1, 1), (2, 1), (3, 1)]
    assert {r["id"]: r["z"] for r in S.first_within(pts, zones, "id", "z").collect()} == {1: 0, 2: 1, 3: 1}
    assert {r["z"]: r["n"] for r in S.count_within(zones.where("geom is not null"), pts, "z").collect()} == {0: 1, 1: 3}
    left = S.within(pts, zones.where("z = 0"), how="left").collect()
    assert sorted((r["id"], r["z"]) for r in left) == [(1, 0), (2, None), (3, None)]
    far = spark.createDataFrame([(7, 1000.0, 1000.0), (8, 6.0, 5.0), (9, 4.0, 5.0)], "b bigint, x2 double, y2 double")
    got = {r["id"]: (r["b"], r["dist"]) for r in S.nearest(pts, far, "id", "b", size=10.0).collect()}
    assert got[1] == (8, 1.0) and got[3][0] == 8 and got[2][0] == 8
    assert S.nearest(pts, far.limit(0), "id", "b").where("b is null").count() == 3


def test_places(spark):
    lookup = spark.createDataFrame([("cafe", "Food", ["Optional", "Social"], 1.0)], "category string, group string, activities array<string>, score double")
    p = spark.createDataFrame([(1, "cafe", None), (2, "noodle", "eating > noodles > stall"), (3, "truck", None), (4, None, "x")], "id bigint, category string, hierarchy string")
    got, missing = P.classify(p, lookup, P.group_of(F.col("hierarchy"), {"noodles": "Food"}, {}))
    r = {x["id"]: x for x in P.flags(got, ["Optional", "Social", "Necessary"]).collect()}
    assert r.keys() == {1, 2, 3} and r[1]["activities"] == "Optional|Social" and r[1]["is_full"] and not r[1]["is_necessary"]
    assert (r[2]["group"], r[3]["group"], r[2]["activities"]) == ("Food", "Other", "Unclassified") and missing.count() == 2
    rules = [("Market", "Shop", ["chợ"], []), ("School", "Edu", ["truong", "school"], ["driving"])]
    n = spark.createDataFrame([("Chợ Lớn",), ("Cho thue xe",), ("Trường Tiểu học",), ("Driving school",), ("ợchợ",), (None,), ("Union of school",)], "name string")
    t = {r["name"]: (r["type"], r["note"], r["keep"]) for r in P.type_by_name(n, rules, leave_out=["union"]).collect()}
    assert t["Chợ Lớn"] == ("Market", "", True) and t["Cho thue xe"][1] == "no rule" and t["Trường Tiểu học"][0] == "School"
    assert t["Driving school"][0] is None and t["ợchợ"][0] is None and t[None][1] == "no name" and t["Union of school"][1] == "organisation"


def test_sources_and_sinks(spark, tmp_path):
    box = one(spark, "x0 double, y0 double, x1 double, y1 double", 4.5, -6.0, 10.0, 5.0)
    assert sorted(r["tile"] for r in readers.tiles(box, 5, "%s%02d_%s%03d").collect()) == sorted(f"{'N' if la >= 0 else 'S'}{abs(la):02d}_E{lo:03d}" for lo in (0, 5) for la in (-10, -5, 0))
    ids = spark.createDataFrame([("https://www.openstreetmap.org/way/12#map",), ("r7",), ("99",), ("town",)], "s string").select(readers.osm_id(F.col("s"))).collect()
    assert [r[0] for r in ids] == ["W12", "R7", "R99", None]
    csv = tmp_path / "l.csv"
    csv.write_bytes("﻿key,v\na,x|y\n".encode())
    assert readers.csv_lookup(spark, str(csv), "key").first()[:] == ("a", "x|y")
    with pytest.raises(ValueError):
        readers.csv_lookup(spark, str(csv), "nokey")
    j = one(spark, "j string", '{"a": {"g": "x", "n": 1}, "b": {"g": "y"}}')
    assert sorted(tuple(r) for r in readers.json_lookup(j, "j", "struct<g:string,n:int>").collect()) == [("a", "x", 1), ("b", "y", None)]
    df = one(spark, "a int, b boolean", 1, True)
    assert writers.write_layers({"one": df, "none": df.limit(0)}, str(tmp_path / "o")) == ["one"]
    assert spark.read.parquet(str(tmp_path / "o/one")).first()[:] == (1, 1)
    assert not readers.has_rows(df.limit(0)) and readers.has_rows(df)


def test_the_core_stands_without_the_text_operators():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "geolathe"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "geolathe.llm" not in p.read_text(), p


def test_crs_must_agree(spark):
    from geolathe.sources.readers import crs_of, same_crs, with_crs

    df = with_crs(spark.createDataFrame([(1, 2.0)], "id int, x double"), "x", 32649)
    assert crs_of(df, "x") == 32649 and crs_of(df, "id") is None and same_crs({"a": 32649, "b": 32649}) == 32649
    for bad in ({"a": 32649, "b": None}, {"a": 4326}, {"a": 32649, "b": 32648}):
        with pytest.raises(ValueError):
            same_crs(bad)


def test_row_structs_read_lists_scores_and_third_places(spark):
    from geolathe.sources.readers import row_structs

    df = spark.createDataFrame([("a", "x| y ||", "0.5", "", "Work"), ("b", None, '{"value": 2}', "0.25", "Work"), ("c", "", "n/a", None, "Home"), (None, "z", None, "x", None)], "k string, tags string, score string, third string, grp string")
    got = {r["k"]: (list(r["info"]["tags"]), r["info"]["score"], r["info"]["third_place"]) for r in row_structs(df, "k", ["tags"], "score", "third", ["Work"], "grp").collect()}
    assert got == {"a": (["x", "y"], 0.5, 0.0), "b": ([], 2.0, 0.25), "c": ([], None, 1.0), None: (["z"], None, 1.0)}
    with pytest.raises(ValueError):
        row_structs(df, "none", [], "score", "third", [], "grp")


def test_sources_that_are_not_there_are_empty_and_other_errors_are_raised(spark, tmp_path):
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    from geolathe.sources.readers import has_rows

    spark.range(3).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert has_rows(df) and not has_rows(df.where("id > 5"))
    with pytest.raises(PySparkException):
        has_rows(df.select(F.raise_error(F.lit("broken"))))


def test_numbers_run_through_all_ranges(spark, rows):
    from geolathe.session import numbered

    df = spark.createDataFrame([(i * 7 % 50, "clash") for i in range(50)], "k int, n string").repartition(5)
    assert rows(numbered(df, "line", "k"), "k", "line") == sorted([(k, k + 1) for k in range(50)], key=repr)
    assert numbered(df.limit(0), "line", "k").count() == 0


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace as N

    from geolathe.session import shared_dir

    conf = N(get=lambda k, d: d)
    with pytest.raises(ValueError):
        shared_dir(N(sparkContext=N(getConf=lambda: conf, master="spark://host:7077")))


def test_regions_within_a_gap(spark, rows):
    from geolathe.operators.spatial import within_or_near

    box = lambda x: [[(x, 0.0), (x + 10.0, 0.0), (x + 10.0, 10.0), (x, 10.0), (x, 0.0)]]
    regions = spark.createDataFrame([(1, box(0.0)), (2, box(5.0)), (3, None), (4, box(40.0))], "r bigint, geom array<array<struct<x:double,y:double>>>")
    p = spark.createDataFrame([("in", 2.0, 5.0), ("both", 7.0, 5.0), ("near", 18.0, 5.0), ("far", 27.0, 5.0)], "id string, x double, y double")
    assert rows(within_or_near(p, regions, "id", "r", 4.0)) == [("both", 1, 0.0), ("far", None, None), ("in", 1, 0.0), ("near", 2, 3.0)]


def test_rasters_are_warped_clipped_and_grouped(spark, rows):
    from geolathe.operators import raster as R
    from geolathe.sources.writers import color_bytes, grid_lines
    from pyspark.sql import functions as F

    px = spark.createDataFrame([(r * 4 + c, r, c, 10 if (r, c) in ((0, 0), (0, 1), (3, 3)) else 20 if (r, c) == (1, 1) else 50, float(r * 4 + c)) for r in range(4) for c in range(4)], "id bigint, row int, col int, cls int, z double")
    assert rows(R.patches(px, [10, 20], 10, 100.0, 0.02)) == [(0, 3, pytest.approx(2 / 3), 0.03)]
    half = R.warp(px, "z", (0.0, 4.0), 1.0, R.grid(spark, 2, 3, (0.0, 4.0), 2.0), lambda x, y: (x, y))
    assert rows(half) == [(0, 0, 5.0), (0, 1, 7.0), (0, 2, None), (1, 0, 13.0), (1, 1, 15.0), (1, 2, None)]
    part = R.clipped(px, [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)], (0.0, 4.0), 1.0)
    assert rows(part, "row", "col", "z") == [(0, 0, 5.0), (0, 1, 6.0), (1, 0, 9.0), (1, 1, 10.0)]
    assert rows(grid_lines(px.where("id <> 1"), "cls", 4))[0] == (0, "10 -9999 50 50")
    c = spark.createDataFrame([(0.5,), (2.0,), (None,)], "v double").select(color_bytes(F.col("v"), 0.0, 1.0, [(0, 0, 0), (100, 50, 0), (200, 0, 10)]).alias("c")).collect()
    assert [tuple(r["c"]) for r in c] == [(100, 50, 0, 255), (200, 0, 10, 255), (0, 0, 0, 0)]


def test_names_of_any_script_are_folded_and_typed(spark, rows):
    from geolathe.operators.places import fold_ascii, type_by_name
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Ｐｈａｒｍａｃｙ Éa",), ("Аптека Pharmacy",), ("Straße",), ("Nhà thuốc Đa",), ("",), (None,)], "name string")
    assert [r[0] for r in df.select(fold_ascii(F.col("name"))).collect()] == ["pharmacy ea", "pharmacy", "strae", "nha thuoc da", "", None]
    out = {r["name"]: r["type"] for r in type_by_name(df, [("Pharmacy", "Health", ["pharmacy", "nhà thuốc"], [])]).collect()}
    assert out["Ｐｈａｒｍａｃｙ Éa"] == out["Аптека Pharmacy"] == out["Nhà thuốc Đa"] == "Pharmacy" and out["Straße"] is None and out[""] is None


def test_nearest_broadcasts_no_copies(spark, monkeypatch):
    from geolathe import session

    plans, write = [], session.materialize
    monkeypatch.setattr(session, "materialize", lambda df, name="t": (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    a = spark.createDataFrame([(1, 0.0, 0.0)], "id bigint, x double, y double")
    b = spark.createDataFrame([(7, 3.0, 4.0), (8, 30.0, 40.0)], "b bigint, x2 double, y2 double")
    assert [(r["b"], r["dist"]) for r in S.nearest(a, b, "id", "b", size=10.0).collect()] == [(7, 5.0)]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
