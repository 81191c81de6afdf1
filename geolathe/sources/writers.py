"""Sinks. A layer is replaced, never added to; an empty layer is not written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_layers(layers: dict[str, DataFrame], folder: str) -> list[str]:
    """One Parquet folder per layer, booleans as 0 and 1. Gives the names of the layers written."""
    done = []
    for name, df in layers.items():
        out = df.withColumns({c: F.col(c).cast("int") for c, t in df.dtypes if t == "boolean"})
        if not out.take(1):
            continue
        out.write.mode("overwrite").parquet(f"{folder}/{name}")
        done.append(name)
    return done


def geojson(df: DataFrame, key: str) -> DataFrame:
    """`feature`: one GeoJSON text per row of a polygon table; x and y as they are."""
    coords = F.transform("geom", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    props = F.struct(*[c for c in df.columns if c != "geom"])
    return df.select(key, F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")).alias("geometry"), props.alias("properties"))).alias("feature"))


def write_raster(pixels: DataFrame, value: str, folder: str, *, kind: str = "float", origin: tuple[float, float] = (0.0, 0.0), size: float = 1.0, epsg: int | None = None) -> DataFrame:
    """A raster as row, col, value in Parquet, compressed, sorted by row within files, its grid in the schema; gives it as read again. NULL stays NULL."""
    v = pixels.select("row", "col", F.col(value).cast(kind).alias(value)).withMetadata(value, {"x0": origin[0], "y0": origin[1], "size": size, "epsg": epsg})
    v.repartitionByRange("row").sortWithinPartitions("row", "col").write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return pixels.sparkSession.read.parquet(folder)


def grid_lines(pixels: DataFrame, value: str, cols: int, nodata: str = "-9999") -> DataFrame:
    """row, line: the text of each grid row, its values in order of columns, gaps as `nodata`; what text grids are written from. A row of a raster is one group."""
    m = pixels.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.coalesce(F.col(value).cast("string"), F.lit(nodata)).alias("v")))).alias("m"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(nodata)))
    return m.select("row", F.array_join(cells, " ").alias("line"))


def color_bytes(v, low: float, high: float, ramp: list[tuple[int, int, int]]):
    """Column struct r, g, b, a: a value stretched from low to high over a ramp of colours; no data is transparent."""
    ok = v.isNotNull() & ~F.isnan(v)
    t = F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low))) * (len(ramp) - 1))
    i = F.when(ok, F.least(F.floor(t).cast("int"), F.lit(len(ramp) - 2)))
    of = lambda k, at: F.element_at(F.array(*[F.lit(c[k]) for c in ramp]), at + 1)
    mix = lambda k: F.coalesce(F.round(of(k, i) + (of(k, i + 1) - of(k, i)) * (t - i)).cast("int"), F.lit(0))
    return F.struct(*[mix(k).alias(c) for k, c in enumerate("rgb")], F.when(ok, 255).otherwise(0).alias("a"))


def vertices(df: DataFrame, layer: str) -> DataFrame:
    """layer, part, ring, seq, x, y of polygon outlines, shell first: what any drawing format is written from. df: uid, geom and the layer's column."""
    r = df.select(F.concat(F.lit("BLDG_"), F.upper(F.coalesce(F.col(layer), F.lit("none")))).alias("layer"), F.col("uid").alias("part"), F.posexplode("geom").alias("ring", "line"))
    return r.select("layer", "part", "ring", F.posexplode("line").alias("seq", "p")).select("layer", "part", "ring", "seq", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def scene_document(df: DataFrame, *cols: str) -> DataFrame:
    """`doc`: one JSON text per row; absent values leave their key out."""
    return df.select(F.to_json(F.struct(*cols)).alias("doc"))
