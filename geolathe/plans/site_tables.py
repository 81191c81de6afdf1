"""Queries of sources, projections, joins and aggregations on places, zones and buildings. Names start with the operator's number."""

from __future__ import annotations

from pyspark.sql import functions as F

from geolathe.functions import geom, hexes
from geolathe.operators import buildings as B
from geolathe.operators import hexsummary as H
from geolathe.operators import places as P
from geolathe.operators import spatial as S
from geolathe.plans.base import AREAS, EDGE, GRID, HELD, HOUSES, MEASURES, SIDES, SPOTS, areas, hexed, houses, site_grid, spots
from geolathe.session import table
from geolathe.sources import readers as R
from geolathe.sources import writers as W

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


BOX = (104.5, 13.57, 105.2, 13.58)


@query(f"SELECT DISTINCT id, name, category, hierarchy FROM places WHERE lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]}")
def src1_box_scan(spark, d):
    """Box predicate and projection that reach the scan."""
    return R.read_layer(spark, [f"{d}/places.parquet"], {"id": "id", "name": "name", "category": "category", "hierarchy": "hierarchy"}, R.in_box(F.col("lon"), F.col("lat"), BOX)).distinct()


@query("SELECT kind, count(*) AS n, min(x) AS lo, max(x) AS hi FROM (SELECT 'node' AS kind, x FROM nodes WHERE isfinite(x) UNION ALL SELECT 'place', geometry.x FROM places WHERE isfinite(geometry.x)) GROUP BY 1")
def src2_tile_union(spark, d):
    """Several tables as one scan, with the sanity figures of the coordinates."""
    a = table(spark, d, "nodes").select(F.lit("node").alias("kind"), "x")
    b = table(spark, d, "places").select(F.lit("place").alias("kind"), F.col("geometry.x").alias("x"))
    u = a.unionByName(b).where("x is not null and not isnan(x) and abs(x) < double('infinity')")
    return u.groupBy("kind").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))


@query("SELECT max(regexp_extract(file_name, 'places-(.*)\\.jsonl', 1)) AS \"release\" FROM places_raw WHERE regexp_extract(file_name, 'places-(.*)\\.jsonl', 1) <> ''")
def src3_latest_release(spark, d):
    return R.latest_release(table(spark, d, "places_raw"), "file_name", r"places-(.*)\.jsonl")


@query("SELECT 'places' AS source, count(*) > 0 AS reachable FROM (SELECT 1 FROM places LIMIT 1)")
def src4_probe(spark, d):
    ok = R.has_rows(table(spark, d, "places").select("id"))
    return spark.createDataFrame([("places", ok)], "source string, reachable boolean")


@query(f"WITH {HOUSES} SELECT uid, id, \"release\", class FROM houses")
def src6_buildings(spark, d):
    """Polygons with a dense number in order."""
    return houses(spark, d).select("uid", "id", "release", "class")


@query("""
    WITH b AS (SELECT site, min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1 FROM places WHERE isfinite(lon) AND isfinite(lat) AND lon <> 0 GROUP BY site),
    t AS (SELECT DISTINCT unnest(generate_series(CAST(floor(x0) AS BIGINT), greatest(CAST(floor(x0) AS BIGINT), CAST(ceil(x1) AS BIGINT) - 1))) AS lon0, y0, y1 FROM b),
    u AS (SELECT DISTINCT lon0, unnest(generate_series(CAST(floor(y0) AS BIGINT), greatest(CAST(floor(y0) AS BIGINT), CAST(ceil(y1) AS BIGINT) - 1))) AS lat0 FROM t)
    SELECT lon0, lat0, CASE WHEN lat0 >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(abs(lat0) AS VARCHAR), 2, '0') || CASE WHEN lon0 >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(abs(lon0) AS VARCHAR), 3, '0') AS tile FROM u""")
def src8_tiles(spark, d):
    b = table(spark, d, "places").where("not isnan(lon) and not isnan(lat) and abs(lon) < double('infinity') and abs(lat) < double('infinity') and lon <> 0")
    return R.tiles(b.groupBy("site").agg(F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1")), 1, "%s%02d%s%03d")


@query("SELECT p_partkey AS id, p_brand AS highway FROM part WHERE NOT (p_type IN ('STEEL', 'COPPER') OR p_brand = 'Brand#11') AND p_brand IS NOT NULL")
def src11_ways(spark, d):
    """Ways filtered by tags: any excluded value of any tag drops a way."""
    w = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("surface"), F.col("p_type"), F.lit("highway"), F.col("p_brand")).alias("tags"))
    return R.allowed_ways(w, "tags", {"surface": ["STEEL", "COPPER"], "highway": ["Brand#11"]}, "highway").select("id", F.col("tags")["highway"].alias("highway"))


@query("SELECT feed, arg_max(file_name, struct_pack(a := delivered, b := file_name)) AS file_name FROM (SELECT feed, file_name, max(ingested_at) AS delivered FROM places_raw GROUP BY ALL) GROUP BY feed")
def src13_newest_file(spark, d):
    f = table(spark, d, "places_raw").groupBy("feed", "file_name").agg(F.max("ingested_at").alias("at"))
    return R.newest(f, "feed", "file_name", "at")


@query("SELECT DISTINCT osmid, 'N' || CAST(osmid AS VARCHAR) AS from_url, 'R' || CAST(osmid AS VARCHAR) AS from_digits, 'W' || CAST(osmid AS VARCHAR) AS from_short FROM nodes WHERE osmid IS NOT NULL")
def src14_osm_ids(spark, d):
    n = table(spark, d, "nodes").where("osmid is not null").select("osmid").distinct()
    s = F.col("osmid").cast("string")
    return n.select("osmid", R.osm_id(F.concat(F.lit("https://www.openstreetmap.org/node/"), s)).alias("from_url"), R.osm_id(s).alias("from_digits"), R.osm_id(F.concat(F.lit("w"), s)).alias("from_short"))


@query(f"WITH {HOUSES} SELECT class, count(*) AS n FROM houses WHERE class IS NOT NULL GROUP BY 1")
def snk1_layers(spark, d):
    """Written as layers and read again: replaced, not added to."""
    from geolathe.session import shared_dir

    folder = f"{shared_dir(spark)}/geolathe-layers-{abs(hash(d)) % 10**8}"
    h = houses(spark, d).select("uid", "class")
    for _ in range(2):
        W.write_layers({"houses": h, "none": h.where("uid < 0")}, folder)
    return spark.read.parquet(f"{folder}/houses").where("class is not null").groupBy("class").agg(F.count("*").alias("n"))


@query(f"""WITH {HOUSES}, rr AS (SELECT uid, class, ring - 1 AS ring, geom[ring] AS l FROM (SELECT uid, class, geom, unnest(generate_series(1, len(geom))) AS ring FROM houses)),
    v AS (SELECT 'BLDG_' || upper(coalesce(class, 'none')) AS layer, uid AS part, ring, i - 1 AS seq, l[i].x AS x, l[i].y AS y FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM rr))
    SELECT layer, part, ring, seq, x, y FROM v""")
def snk5_vertices(spark, d):
    v = W.vertices(houses(spark, d), "class")
    return v.withColumns({"ring": F.col("ring").cast("long"), "seq": F.col("seq").cast("long"), "part": F.col("part").cast("long")})


@query("SELECT DISTINCT id, keep = 1 AND functional_group IN ('Food', 'Education') AS chosen FROM pois_review WHERE id IS NOT NULL AND keep IS NOT NULL AND functional_group IS NOT NULL")
def pf2_in_lists(spark, d):
    r = table(spark, d, "pois_review").where("id is not null and keep is not null and functional_group is not null")
    return r.select("id", ((F.col("keep") == 1) & F.col("functional_group").isin("Food", "Education")).alias("chosen")).distinct()


USES = {"civic": ("school", "hospital", "civic"), "industrial": ("industrial", "storage"), "mixed": ("commercial", "retail"), "residential": ("residential", "farmland")}
_HOUSE_PTS = "pts AS (SELECT uid AS id, cx AS x, cy AS y FROM measures WHERE cx IS NOT NULL)"


def _house_centres(spark, d):
    c = geom.ring_centroid(F.get("geom", F.lit(0)))
    return houses(spark, d).select("uid", "class", geom.ring_area(F.get("geom", F.lit(0))).alias("sa"), geom.ring_perimeter(F.get("geom", F.lit(0))).alias("perimeter"), c.alias("c")).where("c is not null").select("uid", "class", F.abs("sa").alias("area"), "perimeter", F.col("c.x").alias("x"), F.col("c.y").alias("y"))


@query(f"""WITH {HOUSES}, {SIDES}, {MEASURES}, {AREAS}, {_HOUSE_PTS}, {HELD}, lu AS (SELECT h.id, arg_min(a.lu_class, h.zone_id) AS lu_class, min(h.zone_id) AS zone_id FROM held h JOIN areas a USING (zone_id) WHERE a.lu_class IS NOT NULL GROUP BY 1)
    SELECT m.uid, CASE WHEN lower(lu_class) IN ('school','hospital','civic') THEN 'civic' WHEN lower(lu_class) IN ('industrial','storage') THEN 'industrial' WHEN lower(lu_class) IN ('commercial','retail') THEN 'mixed'
      WHEN lower(lu_class) IN ('residential','farmland') THEN 'residential' WHEN area > 500 THEN 'industrial' WHEN area > 80 AND area < 400 AND perimeter > 60 THEN 'mixed' ELSE 'residential' END AS building_type
    FROM measures m LEFT JOIN lu ON lu.id = m.uid WHERE m.cx IS NOT NULL""")
def pf3_building_type(spark, d):
    """Land use first, then footprint rules in order."""
    h = _house_centres(spark, d)
    z = areas(spark, d).where("lu_class is not null").select("zone_id", "lu_class", "geom")
    lu = S.first_within(h.select("uid", "x", "y"), z, "uid", "zone_id").select("uid", "lu_class")
    j = h.join(lu, "uid", "left")
    rules = [(F.col("area") > 500, "industrial"), ((F.col("area") > 80) & (F.col("area") < 400) & (F.col("perimeter") > 60), "mixed")]
    return j.select("uid", B.building_type(F.col("lu_class"), F.col("area"), F.lit(None), F.lit(None), USES, "residential", rules).alias("building_type"))


@query()
def pf4_massing(spark, d):
    """Rule-based floors and heights where either is missing; the same draw for a building in any partitioning."""
    h = _house_centres(spark, d).select("uid", "area").join(houses(spark, d).select("uid", "id", "release"), "uid")
    v = table(spark, d, "buildings").groupBy("id", "release").agg(F.max(F.when(F.col("height").between(1, 300), F.col("height"))).alias("height"), F.max(F.when(F.col("num_floors").between(1, 60), F.col("num_floors"))).alias("num_floors"))
    ladder = [(F.col("area") < 40, (1, 1), (3.0, 3.0)), (F.col("area") < 120, (1, 3), (3.0, 9.0)), (F.col("area") < 300, (2, 4), (6.0, 12.0)), (F.col("area") < 800, (2, 2), (8.0, 8.0)), (F.lit(True), (1, 1), (6.0, 6.0))]
    return B.massing(h.join(v, ["id", "release"]), "uid", ladder).select("uid", "floors_est", "height_est", "volume_est")


@query("SELECT DISTINCT id, CASE WHEN note IS NOT NULL AND note <> '' THEN 'note:' || note WHEN amenity_type IS NOT NULL AND amenity_type <> '' THEN 'type:' || amenity_type ELSE 'unknown' END AS label FROM pois_review WHERE id IS NOT NULL")
def pf6_first_tag(spark, d):
    r = table(spark, d, "pois_review").where("id is not null")
    tags = F.map_filter(F.create_map(F.lit("note"), F.col("note"), F.lit("type"), F.col("amenity_type")), lambda k, v: F.length(v) > 0)
    return r.select("id", P.first_tag(tags, ["note", "type"]).alias("label")).distinct()


ACTS = {"brew_bar": (["Optional", "Social"], 1.0), "broth_counter": (["Optional"], 1.0), "lower_school": (["Necessary"], 0.0), "pill_counter": (["Necessary"], 0.0), "prayer_hall": (["Social"], 1.0), "stay_house": (["Optional"], None)}
LOOKUP_ROWS = [(k, {"brew_bar": "Food", "broth_counter": "Food", "lower_school": "Education", "pill_counter": "Health", "prayer_hall": "Community", "stay_house": "Lodging"}[k], a, s) for k, (a, s) in ACTS.items()]
SECOND = {"vehicle_retail": "Transport", "materials": "Trade", "practice": "Health"}
FIRST = {"learning": "Education", "civic": "Government", "care": "Health"}


def _lookup(spark):
    return spark.createDataFrame(LOOKUP_ROWS, "category string, group string, activities array<string>, score double")


_LOOKUP_SQL = "lookup(category, grp, activities, score) AS (VALUES " + ", ".join(f"('{c}', '{g}', {a}, {'NULL' if s is None else s})" for c, g, a, s in LOOKUP_ROWS) + ")"
_case = lambda m, e: "CASE " + " ".join(f"WHEN {e} = '{k}' THEN '{v}'" for k, v in m.items()) + " END"
_STEP = "trim(string_split(hierarchy, '>')[{}])"
_GROUP_SQL = f"coalesce({_case(SECOND, _STEP.format(2))}, {_case(FIRST, _STEP.format(1))})"


@query(f"WITH {SPOTS}, {_LOOKUP_SQL} SELECT s.id, s.category, coalesce(l.grp, {_GROUP_SQL}, 'Other') AS grp, coalesce(array_to_string(l.activities, '|'), 'Unclassified') AS activities FROM spots s LEFT JOIN lookup l USING (category) WHERE s.category IS NOT NULL")
def j1_classified(spark, d):
    """Lookup by category, group by hierarchy where it lacks one."""
    j, _ = P.classify(spots(spark, d), _lookup(spark), P.group_of(F.col("hierarchy"), SECOND, FIRST))
    return j.select("id", "category", F.col("group").alias("grp"), F.array_join("activities", "|").alias("activities"))


@query(f"WITH {SPOTS}, {_LOOKUP_SQL} SELECT category, count(*) AS n FROM spots WHERE category IS NOT NULL AND category NOT IN (SELECT category FROM lookup) GROUP BY 1")
def j1_missing(spark, d):
    return P.classify(spots(spark, d), _lookup(spark), F.lit(None).cast("string"))[1]


@query(f"""WITH {SPOTS}, {_LOOKUP_SQL} SELECT s.id, coalesce(list_contains(l.activities, 'Necessary'), false) AS is_necessary, coalesce(list_contains(l.activities, 'Optional'), false) AS is_optional,
    coalesce(list_contains(l.activities, 'Social'), false) AS is_social, coalesce(l.score = 1.0, false) AS is_full, coalesce(array_to_string(l.activities, '|'), 'Unclassified') AS activities
    FROM spots s LEFT JOIN lookup l USING (category) WHERE s.category IS NOT NULL""")
def pf7_flags(spark, d):
    j, _ = P.classify(spots(spark, d), _lookup(spark), F.lit(None).cast("string"))
    return P.flags(j, ["Necessary", "Optional", "Social"]).select("id", "is_necessary", "is_optional", "is_social", "is_full", "activities")


@query(f"WITH {SPOTS} SELECT id, {_GROUP_SQL} AS grp FROM spots WHERE length(trim(hierarchy)) > 0")
def f4_hierarchy(spark, d):
    return spots(spark, d).where("length(trim(hierarchy)) > 0").select("id", P.group_of(F.col("hierarchy"), SECOND, FIRST).alias("grp"))


@query("""WITH o AS (SELECT review_seq, count(*) AS rep, max(keep) AS keep, max(functional_group) AS g, max(name) AS name FROM pois_review GROUP BY 1),
    n AS (SELECT *, row_number() OVER (ORDER BY review_seq) + 1 AS line FROM o)
    SELECT review_seq, line, 'unknown group' AS problem FROM n WHERE g IS NULL OR g NOT IN ('Food', 'Education', 'Health') UNION ALL
    SELECT review_seq, line, 'keep is not 0 or 1' FROM n WHERE keep IS NULL OR keep NOT IN (0, 1) UNION ALL SELECT review_seq, line, 'no name' FROM n WHERE name IS NULL OR trim(name) = ''""")
def pf10_problems(spark, d):
    r = table(spark, d, "pois_review").groupBy("review_seq").agg(F.max("keep").alias("keep"), F.max("functional_group").alias("g"), F.max("name").alias("name"))
    checks = {"unknown group": ~F.coalesce(F.col("g").isin("Food", "Education", "Health"), F.lit(False)), "keep is not 0 or 1": ~F.coalesce(F.col("keep").isin(0, 1), F.lit(False)), "no name": F.coalesce(F.trim("name") == "", F.lit(True))}
    return P.problems(r, "review_seq", "review_seq", checks).withColumn("line", F.col("line").cast("long"))


@query(f"WITH {SPOTS}, {AREAS}, pts AS (SELECT id, x, y FROM spots), {HELD} SELECT id, zone_id FROM held")
def j3_within(spark, d):
    return S.within(spots(spark, d).select("id", "x", "y"), areas(spark, d).select("zone_id", "geom")).select("id", "zone_id")


@query(f"WITH {SPOTS}, {AREAS}, pts AS (SELECT id, x, y FROM spots), {HELD} SELECT id, min(zone_id) AS zone_id FROM held GROUP BY id")
def w3_first_within(spark, d):
    """Of several areas the first, by a window."""
    return S.first_within(spots(spark, d).select("id", "x", "y"), areas(spark, d).select("zone_id", "geom"), "id", "zone_id").select("id", "zone_id")


@query(f"WITH {SPOTS}, {AREAS}, pts AS (SELECT id, x, y FROM spots), {HELD} SELECT a.zone_id, count(h.id) AS n FROM areas a LEFT JOIN held h USING (zone_id) GROUP BY 1")
def j4_count(spark, d):
    return S.count_within(areas(spark, d), spots(spark, d).select("id", "x", "y"), "zone_id")


@query(f"""WITH {SPOTS}, n AS (SELECT osmid, min(x) AS x, min(y) AS y FROM nodes WHERE isfinite(x) AND isfinite(y) GROUP BY 1), c AS (
    SELECT s.id, n.osmid, sqrt((s.x - n.x) * (s.x - n.x) + (s.y - n.y) * (s.y - n.y)) AS dist FROM spots s, n),
    b AS (SELECT id, min(dist) AS dist FROM c GROUP BY 1) SELECT id, round(dist, 4) AS dist FROM b""")
def j7_nearest(spark, d):
    """Nearest street node of every place; the distance, as equal ones tie."""
    n = table(spark, d, "nodes").where("x is not null and y is not null and not isnan(x) and not isnan(y)").groupBy("osmid").agg(F.min("x").alias("x2"), F.min("y").alias("y2"))
    return S.nearest(spots(spark, d).select("id", "x", "y"), n, "id", "osmid").select("id", F.round("dist", 4).alias("dist"))


@query(f"""WITH {SPOTS}, n AS (SELECT DISTINCT osmid, x, y FROM nodes WHERE isfinite(x) AND isfinite(y))
    SELECT s.id, n.osmid FROM spots s JOIN n ON n.x BETWEEN s.x - 60 AND s.x + 60 AND n.y BETWEEN s.y - 60 AND s.y + 60 WHERE sqrt((s.x - n.x) * (s.x - n.x) + (s.y - n.y) * (s.y - n.y)) <= 60""")
def j6_within_distance(spark, d):
    n = table(spark, d, "nodes").where("x is not null and y is not null and not isnan(x) and not isnan(y)").select("osmid", F.col("x").alias("x2"), F.col("y").alias("y2")).distinct()
    return S.within_distance(spots(spark, d).select("id", "x", "y"), n, 60.0).select("id", "osmid")


@query("""WITH r AS (SELECT id, arg_min(struct_pack(k := keep, ak := auto_keep, t := amenity_type, at_ := auto_type), review_seq) AS v FROM pois_review WHERE id IS NOT NULL GROUP BY 1),
    p AS (SELECT id, max(category) AS category FROM places WHERE id IS NOT NULL GROUP BY 1)
    SELECT p.id, CASE WHEN e THEN nullif(v.t, '') ELSE category END AS amenity_type, coalesce(e, false) AS edited FROM p LEFT JOIN
    (SELECT *, (v.k IS DISTINCT FROM v.ak) OR (nullif(v.t, '') IS DISTINCT FROM nullif(v.at_, '')) AS e FROM r) r ON p.id = r.id AND e""")
def j13_corrected(spark, d):
    p = table(spark, d, "places").where("id is not null").groupBy("id").agg(F.max("category").alias("amenity_type")).withColumn("keep", F.lit(None).cast("int"))
    return P.corrected(p, table(spark, d, "pois_review").where("id is not null"), "id", {"keep": "auto_keep", "amenity_type": "auto_type"}, "review_seq").select("id", "amenity_type", "edited")


@query("SELECT DISTINCT id FROM pois_review WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM places WHERE id IS NOT NULL)")
def j11_anti(spark, d):
    return table(spark, d, "pois_review").where("id is not null").select("id").join(table(spark, d, "places").select("id"), "id", "left_anti").distinct()


_HEX_AGG = "count(*) AS n, avg(confidence) AS mean_conf, median(confidence) AS med_conf, max(confidence) AS max_conf"


@query(f"""WITH {SPOTS}, {GRID}, {hexed('spots')}, m AS (SELECT cell, category, row_number() OVER (PARTITION BY cell ORDER BY count(*) DESC, category) AS k FROM hexed WHERE category IS NOT NULL GROUP BY 1, 2),
    a AS (SELECT cell, count(id) AS n, round(avg(confidence), 11) AS mean_conf, round(median(confidence), 11) AS med_conf, round(sum(confidence), 6) AS sum_conf FROM hexed GROUP BY 1)
    SELECT g.cell, coalesce(n, 0) AS n, mean_conf, med_conf, coalesce(sum_conf, 0) AS sum_conf, m.category AS top_category FROM grid g LEFT JOIN a USING (cell) LEFT JOIN m ON m.cell = g.cell AND m.k = 1""")
def a1_hex_places(spark, d):
    """Count, mean, median, sum and most frequent category per hexagon of the grid."""
    s = spots(spark, d).withColumn("confidence", F.when(~F.isnan("confidence"), F.col("confidence")))
    r = H.points_to_hex(s, site_grid(spark, d), EDGE, n=("id", "count"), mean_conf=("confidence", "mean"), med_conf=("confidence", "median"), sum_conf=("confidence", "sum"), top_category=("category", "mode"))
    return r.withColumns({"mean_conf": F.round("mean_conf", 11), "med_conf": F.round("med_conf", 11), "sum_conf": F.round("sum_conf", 6)})


@query(f"""WITH {SPOTS}, {GRID}, {HOUSES}, {SIDES}, {MEASURES}, pm AS (SELECT uid, area, cx AS x, cy AS y FROM measures WHERE cx IS NOT NULL), {hexed('pm')}
    SELECT g.cell, count(h.uid) AS n, round(coalesce(sum(h.area), 0), 2) AS built FROM grid g LEFT JOIN hexed h USING (cell) GROUP BY 1""")
def a1_hex_buildings(spark, d):
    h = houses(spark, d).withColumn("area", geom.polygon_area(F.slice("geom", 1, 1)))
    r = H.polygons_to_hex(h, site_grid(spark, d), EDGE, n=("uid", "count"), built=("area", "sum"))
    return r.withColumn("built", F.round("built", 2))


@query(f"WITH {SPOTS}, {GRID} SELECT cell FROM grid")
def m10_hex_grid(spark, d):
    return site_grid(spark, d)


@query("SELECT functional_group AS type_group, amenity_type AS type, CAST(sum(CASE WHEN keep = 1 THEN 1 ELSE 0 END) AS BIGINT) AS kept, count(*) AS total FROM (SELECT DISTINCT review_seq, functional_group, amenity_type, keep FROM pois_review) WHERE amenity_type IS NOT NULL AND functional_group IS NOT NULL GROUP BY 1, 2")
def a5_summary(spark, d):
    r = table(spark, d, "pois_review").select("review_seq", F.col("functional_group").alias("type_group"), F.col("amenity_type").alias("type"), (F.col("keep") == 1).alias("keep")).distinct()
    return P.summary(r.where("type_group is not null"))


@query("""WITH r AS (SELECT DISTINCT review_seq, id, functional_group AS g, amenity_type AS t, keep FROM pois_review), e(entry) AS (VALUES ('Food'), ('Café'), ('Nothing'))
    SELECT entry, count(r.review_seq) AS n FROM e LEFT JOIN r ON r.keep = 1 AND (r.g = entry OR r.t = entry) GROUP BY 1""")
def s1_chosen(spark, d):
    """A row for each entry it is chosen under; entries that nothing matches."""
    r = table(spark, d, "pois_review").select("review_seq", "id", F.col("functional_group").alias("type_group"), F.col("amenity_type").alias("type"), (F.col("keep") == 1).alias("keep")).distinct()
    hit, unknown = P.chosen(r, ["Food", "Café", "Nothing"])
    return hit.groupBy("entry").agg(F.count("*").alias("n")).unionByName(unknown.withColumn("n", F.lit(0).cast("long")))


@query("SELECT category, count(*) AS n FROM (SELECT DISTINCT id, category FROM places) WHERE category IS NOT NULL GROUP BY 1 ORDER BY n DESC, category LIMIT 2")
def t3_top_two(spark, d):
    return table(spark, d, "places").select("id", "category").distinct().where("category is not null").groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(2)


@query("SELECT DISTINCT osmid AS id FROM nodes WHERE osmid % 3 = 0 UNION SELECT DISTINCT osmid FROM nodes WHERE street_count >= 3")
def s2_union(spark, d):
    n = table(spark, d, "nodes")
    return n.where("osmid % 3 = 0").select(F.col("osmid").alias("id")).union(n.where("street_count >= 3").select("osmid")).distinct()


@query(f"""WITH {HOUSES}, {SIDES}, {MEASURES} SELECT uid, round(area, 3) AS area, round(perimeter, 3) AS perimeter, round(cx, 3) AS cx, round(cy, 3) AS cy FROM measures WHERE cx IS NOT NULL""")
def m8_measures(spark, d):
    return _house_centres(spark, d).select("uid", F.round("area", 3).alias("area"), F.round("perimeter", 3).alias("perimeter"), F.round("x", 3).alias("cx"), F.round("y", 3).alias("cy"))


@query()
def m8_shapes(spark, d):
    """Hull-based shape measures of every footprint."""
    return B.shape_measures(houses(spark, d), "uid")


@query(f"SELECT DISTINCT id, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS epsg FROM places WHERE id IS NOT NULL AND isfinite(lon) AND isfinite(lat)")
def m7_epsg(spark, d):
    p = table(spark, d, "places").where("id is not null and not isnan(lon) and not isnan(lat) and abs(lon) < double('infinity') and abs(lat) < double('infinity')")
    return p.select("id", geom.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg")).distinct()


def _utm_sql() -> str:
    """The projection's series with its numbers written out."""
    a1, a2, a3, e, scale = (f"{v:.17e}" for v in (*geom._ALPHA, 2 * geom._N**0.5 / (1 + geom._N), 0.9996 * geom._RECT))
    series = lambda f, g, base: f"{base} + {a1} * {f}(2 * xi) * {g}(2 * eta) + {a2} * {f}(4 * xi) * {g}(4 * eta) + {a3} * {f}(6 * xi) * {g}(6 * eta)"
    return f"""WITH p AS (SELECT DISTINCT id, lon, lat FROM places WHERE id IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat) AND abs(lat) < 84 AND lon BETWEEN -180 AND 180),
    q AS (SELECT id, lat, radians(lon - ((floor((lon + 180) / 6) + 1) * 6 - 183)) AS dl, sinh(atanh(sin(radians(lat))) - {e} * atanh({e} * sin(radians(lat)))) AS t FROM p),
    x AS (SELECT id, lat, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM q)
    SELECT id, round(500000 + {scale} * ({series("cos", "sinh", "eta")}), 2) AS easting, round(CASE WHEN lat < 0 THEN 10000000.0 ELSE 0.0 END + {scale} * ({series("sin", "cosh", "xi")}), 2) AS northing FROM x"""


@query(_utm_sql())
def m7_utm(spark, d):
    """Easting and northing of every place in its zone."""
    p = table(spark, d, "places").where("id is not null and not isnan(lon) and not isnan(lat) and abs(lat) < 84 and lon between -180 and 180").select("id", "lon", "lat").distinct()
    e, n = geom.to_utm(F.col("lon"), F.col("lat"))
    return p.select("id", F.round(e, 2).alias("easting"), F.round(n, 2).alias("northing"))


@query()
def f2_folded(spark, d):
    """Names folded to ASCII words."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.split("text", "\n")[0].alias("title"))
    return t.select("doc_id", P.fold_ascii(F.col("title")).alias("folded"))


@query("SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def f1_slug(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), P.slug(F.col("p_name")).alias("slug"))


RULES = [("Pharmacy", "Health", ["pharmacy", "apotheke", "nhà thuốc", "farmacia"], []), ("School", "Education", ["school", "grundschule", "trường tiểu học"], ["nursery"]), ("Cafe", "Food", ["coffee", "cà phê", "kaffeehaus"], [])]


@query()
def f3_rules(spark, d):
    """Type by the first rule whose whole words stand in the name."""
    n = table(spark, d, "places").where("name is not null").select("name").distinct()
    return P.type_by_name(n, RULES).select("name", "type")


@query("""WITH r AS (SELECT DISTINCT file_name, feed, "release" FROM places_raw) SELECT file_name, coalesce(nullif(regexp_extract(file_name, 'places-(\\d{4}-\\d{2})', 1), ''), '[unknown]') AS month, coalesce(feed, '') AS feed, coalesce("release", '') AS "release" FROM r""")
def f6_provenance(spark, d):
    """What each file is, from its name."""
    r = table(spark, d, "places_raw").select("file_name", "feed", "release").distinct()
    m = F.nullif(F.regexp_extract("file_name", r"places-(\d{4}-\d{2})", 1), F.lit(""))
    return r.select("file_name", F.coalesce(m, F.lit("[unknown]")).alias("month"), F.coalesce("feed", F.lit("")).alias("feed"), F.coalesce("release", F.lit("")).alias("release"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x1_windowed(spark, d):
    """An event stream read file by file and counted by hour, to its end."""
    import uuid

    from geolathe.session import shared_dir
    from geolathe.streaming import events as E

    src = table(spark, d, "events")
    base = f"{shared_dir(spark)}/geolathe-stream-{uuid.uuid4().hex}"
    feed = src.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    feed.write.parquet(f"{base}/in")
    stream = E.windowed(E.read_events(spark, f"{base}/in", feed.schema), late="40 days")
    q = stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(lambda b, i: b.withColumn("_batch", F.lit(i)).write.mode("append").parquet(f"{base}/out")).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    last = out.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total"), "_batch").alias("v"))
    return last.select(F.col("window_start").cast(src.schema["ts"].dataType).alias("window_start"), "event_type", "v.n", F.round("v.total", 4).alias("total"))


@query(f"""WITH {SPOTS}, {AREAS}, pts AS (SELECT id, x, y FROM spots), {HELD},
    inside AS (SELECT id, min(zone_id) AS zone_id, 0.0 AS gap FROM held GROUP BY 1),
    segs AS (SELECT p.id, e.zone_id, p.x, p.y, e.ax, e.ay, e.bx - e.ax AS dx, e.by - e.ay AS dy FROM pts p JOIN boxes b ON p.x BETWEEN b.x0 - 20 AND b.x1 + 20 AND p.y BETWEEN b.y0 - 20 AND b.y1 + 20
      JOIN edges_ e ON e.zone_id = b.zone_id AND e.ring = 1 WHERE p.id NOT IN (SELECT id FROM inside)),
    feet AS (SELECT id, zone_id, x, y, ax, ay, dx, dy, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0, least(1, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) ELSE 0 END AS t FROM segs),
    near AS (SELECT id, zone_id, min(sqrt((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2)) AS gap FROM feet GROUP BY ALL HAVING gap <= 20),
    one AS (SELECT id, arg_min(zone_id, (round(gap, 6), zone_id)) AS zone_id, round(min(gap), 6) AS gap FROM near GROUP BY 1)
    SELECT p.id, coalesce(i.zone_id, o.zone_id) AS zone_id, coalesce(i.gap, o.gap) AS gap FROM pts p LEFT JOIN inside i USING (id) LEFT JOIN one o USING (id)""")
def j16_within_or_near(spark, d):
    """The zone that holds each place, else the nearest within 20 m, else none."""
    return S.within_or_near(spots(spark, d).select("id", "x", "y"), areas(spark, d).select("zone_id", "geom"), "id", "zone_id", 20.0)


@query("SELECT layer, epsg FROM (VALUES ('nodes', 32649), ('places', 32649), ('zones', 32649)) t(layer, epsg)")
def pf9_crs(spark, d):
    """The one system of three layers, from their schemas."""
    layers = {n: R.with_crs(table(spark, d, n), c, 32649) for n, c in (("places", "geometry"), ("nodes", "x"), ("zones", "geom"))}
    cols = {"places": "geometry", "nodes": "x", "zones": "geom"}
    epsg = R.same_crs({n: R.crs_of(df, cols[n]) for n, df in layers.items()})
    return spark.createDataFrame([(n, epsg) for n in sorted(layers)], "layer string, epsg int")


@query("""WITH r AS (SELECT review_seq, max(amenity_type) AS types, max(note) AS score, max(CAST(auto_keep AS VARCHAR)) AS third, max(functional_group) AS g FROM pois_review GROUP BY 1)
    SELECT review_seq, [trim(x, ' ') for x in string_split(coalesce(types, ''), '|') if trim(x, ' ') <> ''] AS types, TRY_CAST(score AS DOUBLE) AS score,
    coalesce(TRY_CAST(third AS DOUBLE), CASE WHEN g IN ('Food', 'Education', 'Health') THEN 0.0 ELSE 1.0 END) AS third_place FROM r""")
def f5_row_structs(spark, d):
    """Review rows as structs: lists, a score or its JSON, and the third-place rule."""
    r = table(spark, d, "pois_review").groupBy("review_seq").agg(F.max("amenity_type").alias("types"), F.max("note").alias("score"), F.max(F.col("auto_keep").cast("string")).alias("third"), F.max("functional_group").alias("g"))
    out = R.row_structs(r, "review_seq", ["types"], "score", "third", ["Food", "Education", "Health"], "g")
    return out.select("review_seq", "info.types", "info.score", "info.third_place")
