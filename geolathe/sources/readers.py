"""Scans: columnar files with pushed-down boxes, tile names, listings, lookups, tagged ways and street networks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def in_box(x: Column, y: Column, box: Sequence[float]) -> Column:
    """Closed box (west, south, east, north) against points."""
    w, s, e, n = box
    return (x >= w) & (x <= e) & (y >= s) & (y <= n)


def box_overlap(x0: Column, y0: Column, x1: Column, y1: Column, box: Sequence[float]) -> Column:
    """Closed overlap of boxes; on columns of a Parquet file it is pushed into the scan."""
    w, s, e, n = box
    return (x0 <= e) & (x1 >= w) & (y0 <= n) & (y1 >= s)


def read_layer(spark: SparkSession, paths: Sequence[str], fields: dict[str, str], where: Column | None = None) -> DataFrame:
    """A projection {output: expression} of one or more Parquet paths under a filter; only the columns named are read."""
    df = spark.read.parquet(*paths)
    return (df.where(where) if where is not None else df).selectExpr(*[f"{e} AS {o}" for o, e in fields.items()])


def joined_path(parts: Column, sep: str = " > ") -> Column:
    return F.array_join(parts, sep)


MISSING = ("PATH_NOT_FOUND", "FAILED_READ_FILE.FILE_NOT_EXIST")


def has_rows(df: DataFrame) -> bool:
    """Whether a source answers with a row; reads no more than that. A source that is not there counts as empty, any other error is raised."""
    try:
        return bool(df.take(1))
    except PySparkException as e:
        if (e.getCondition() or "") in MISSING:
            return False
        raise


def same_crs(epsg: dict[str, int | None]) -> int:
    """The one metric system of several layers, by their EPSG numbers; an error names the layers without one, in degrees or that differ."""
    bad = [n for n, e in epsg.items() if e is None]
    if bad:
        raise ValueError(f"no coordinate system: {', '.join(sorted(bad))}")
    degrees = [n for n, e in epsg.items() if 4000 <= e < 5000]
    if degrees:
        raise ValueError(f"in degrees, not metres: {', '.join(sorted(degrees))}")
    if len(set(epsg.values())) > 1:
        raise ValueError("systems differ: " + ", ".join(f"{n} {e}" for n, e in sorted(epsg.items())))
    return next(iter(epsg.values()))


def with_crs(df: DataFrame, column: str, epsg: int) -> DataFrame:
    """df whose geometry column carries its EPSG number in the schema."""
    return df.withMetadata(column, df.schema[column].metadata | {"epsg": epsg})


def crs_of(df: DataFrame, column: str) -> int | None:
    return df.schema[column].metadata.get("epsg")


def row_structs(df: DataFrame, key: str, lists: Sequence[str], score: str, third: str, groups: Sequence[str], group: str) -> DataFrame:
    """key, info: a lookup row as a struct. Text lists are split at "|"; the score is a number, or the number `value` of a JSON object;
    an empty third-place cell is 0.0 for the given groups and 1.0 for others. Raises if the key column is missing."""
    if key not in df.columns:
        raise ValueError(f"no column {key!r}; columns: {df.columns}")
    number = lambda c: F.expr(f"try_cast({c} as double)")
    parts = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    value = F.coalesce(number(score), F.get_json_object(score, "$.value").cast("double"))
    place = F.coalesce(number(third), F.when(F.col(group).isin(*groups), 0.0).otherwise(1.0))
    return df.select(key, F.struct(*[parts(c).alias(c) for c in lists], value.alias("score"), place.alias("third_place")).alias("info"))


def latest_release(listing: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row `release`: the greatest release in a listing of paths; group 1 of the pattern, blanks ignored."""
    r = F.regexp_extract(F.col(path), pattern, 1)
    return listing.select(r.alias("release")).where(F.length("release") > 0).agg(F.max("release").alias("release"))


def newest(files: DataFrame, key: str, path: str, at: str) -> DataFrame:
    """The newest path of each key."""
    return files.groupBy(key).agg(F.max_by(path, F.struct(at, path)).alias(path))


def tiles(box: DataFrame, step: int, name: str, half_open: bool = True) -> DataFrame:
    """Tiles (lon0, lat0, tile) of `step` degrees that boxes x0, y0, x1, y1 meet. name: a format of (NS, lat, EW, lon)."""
    last = lambda c: F.ceil(F.col(c) / step) * step - step if half_open else F.floor(F.col(c) / step) * step
    first = lambda c: F.floor(F.col(c) / step) * step
    t = box.select(F.explode(F.sequence(first("x0"), F.greatest(first("x0"), last("x1")), F.lit(step).cast("long"))).alias("lon0"), "y0", "y1")
    t = t.select("lon0", F.explode(F.sequence(first("y0"), F.greatest(first("y0"), last("y1")), F.lit(step).cast("long"))).alias("lat0")).distinct()
    ns, ew = F.when(F.col("lat0") >= 0, "N").otherwise("S"), F.when(F.col("lon0") >= 0, "E").otherwise("W")
    return t.withColumn("tile", F.format_string(name, ns, F.abs("lat0"), ew, F.abs("lon0")))


def tiles_of_manifest(manifest: DataFrame, boxes: DataFrame) -> DataFrame:
    """Rows of a manifest (x0, y0, x1, y1, ...) that overlap a box openly: boxes that only touch do not count."""
    m = manifest.select("*").withColumnsRenamed({c: f"m_{c}" for c in ("x0", "y0", "x1", "y1")})
    return m.join(boxes, (F.col("m_x0") < F.col("x1")) & (F.col("m_x1") > F.col("x0")) & (F.col("m_y0") < F.col("y1")) & (F.col("m_y1") > F.col("y0")))


def valid_polygons(df: DataFrame) -> DataFrame:
    """Rows whose geom has a first ring of at least three distinct places and an area."""
    from geolathe.functions import geom

    ring = F.get("geom", F.lit(0))
    return df.where(F.col("geom").isNotNull() & (F.size("geom") > 0) & (F.size(F.array_distinct(ring)) >= 3) & (F.abs(geom.ring_area(ring)) > 0))


def json_lookup(df: DataFrame, col: str, value: str) -> DataFrame:
    """key and the fields of a JSON object of objects. value: the struct's DDL."""
    m = F.from_json(col, f"map<string,{value}>")
    return df.select(F.explode(m).alias("key", "v")).select("key", "v.*")


def csv_lookup(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A CSV with a header, with or without a byte order mark, all columns as text. Raises if the key column is missing."""
    df = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True)
    if key not in df.columns:
        raise ValueError(f"no column {key!r}; columns: {df.columns}")
    return df


def allowed_ways(ways: DataFrame, tags: str, excluded: dict[str, Sequence[str]], must: str) -> DataFrame:
    """Ways that carry the tag `must` and no excluded value (whole value) of any tag."""
    bad = F.lit(False)
    for k, vs in excluded.items():
        bad = bad | F.coalesce(F.try_element_at(F.col(tags), F.lit(k)).isin(*vs), F.lit(False))
    return ways.where(~bad & F.map_contains_key(tags, must))




def osm_id(c: Column) -> Column:
    """N, W or R and the number, from an address, a short form or bare digits (then R); NULL if it is none."""
    s = F.trim(c)
    url = F.regexp_extract(s, r"(?i)(node|way|relation)/(\d+)", 1)
    num = F.regexp_extract(s, r"(?i)(node|way|relation)/(\d+)", 2)
    return F.when(num != "", F.concat(F.upper(F.substring(url, 1, 1)), num)).when(s.rlike(r"^[NWRnwr]\d+$"), F.upper(s)).when(s.rlike(r"^\d+$"), F.concat(F.lit("R"), s))


def box_round(lat: Column, lon: Column, metres: float) -> dict[str, Column]:
    """A box of 2 * metres round a place by a plain degree length."""
    dy = metres / 111_320
    dx = F.lit(metres) / (111_320 * F.cos(F.radians(lat)))
    return {"x0": lon - dx, "y0": lat - dy, "x1": lon + dx, "y1": lat + dy}


def cad_origin(e: float, n: float, step: float) -> tuple[float, float]:
    return math.floor(e / step) * step, math.floor(n / step) * step
