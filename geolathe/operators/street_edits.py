"""Sketched streets joined onto a network: ends snapped, streets split where they meet, numbers and keys given out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolathe.functions import geom
from geolathe.operators.spatial import _over, bucket
from geolathe.session import numbered


def snapped_ends(sketch: DataFrame, nodes: DataFrame, edges: DataFrame, tolerance: float) -> DataFrame:
    """id, which, x, y, target, moved_m: where each end of a sketched street goes.

    An existing junction within the tolerance comes first, then the nearest existing street, then another sketch's end, else
    the end stays. sketch: id, geom; nodes: node, x, y; edges: id, ax, ay, bx, by. Candidates come from buckets of the tolerance.
    """
    ends = sketch.select("id", F.explode(F.array(F.struct(F.lit("start").alias("which"), F.get("geom", F.lit(0)).alias("p")), F.struct(F.lit("end").alias("which"), F.element_at("geom", -1).alias("p")))).alias("e"))
    ends = ends.select("id", F.col("e.which").alias("which"), F.col("e.p.x").alias("px"), F.col("e.p.y").alias("py"))
    near = ends.select("*", *bucket(F.col("px"), F.col("py"), tolerance))
    around = lambda x, y, df: _over(x - tolerance, y - tolerance, x + tolerance, y + tolerance, tolerance, df)
    n = around(F.col("nx"), F.col("ny"), nodes.select(F.col("node").cast("string").alias("name"), F.col("x").alias("nx"), F.col("y").alias("ny")))
    c1 = near.join(n, ["bx", "by"]).select("id", "which", "px", "py", F.lit(1).alias("rank"), F.hypot(F.col("px") - F.col("nx"), F.col("py") - F.col("ny")).alias("d"), F.col("nx").alias("x"), F.col("ny").alias("y"), "name")
    e = edges.select(F.col("id").cast("string").alias("name"), F.col("ax").alias("sx"), F.col("ay").alias("sy"), F.col("bx").alias("ex"), F.col("by").alias("ey"))
    e = _over(F.least("sx", "ex") - tolerance, F.least("sy", "ey") - tolerance, F.greatest("sx", "ex") + tolerance, F.greatest("sy", "ey") + tolerance, tolerance, e)
    s = (F.col("sx"), F.col("sy"), F.col("ex"), F.col("ey"))
    t = geom.segment_foot(F.col("px"), F.col("py"), *s)
    c2 = near.join(e, ["bx", "by"]).select("id", "which", "px", "py", F.lit(2).alias("rank"), geom.segment_distance(F.col("px"), F.col("py"), *s).alias("d"), (s[0] + t * (s[2] - s[0])).alias("x"), (s[1] + t * (s[3] - s[1])).alias("y"), "name")
    o = around(F.col("ox"), F.col("oy"), ends.select(F.col("id").alias("oid"), F.concat_ws(":", F.col("id").cast("string"), "which").alias("name"), F.col("px").alias("ox"), F.col("py").alias("oy")))
    # Of two loose ends the one of the lesser street stays and the other moves to it.
    c3 = near.join(o, ["bx", "by"]).where("oid < id").select("id", "which", "px", "py", F.lit(3).alias("rank"), F.hypot(F.col("px") - F.col("ox"), F.col("py") - F.col("oy")).alias("d"), F.col("ox").alias("x"), F.col("oy").alias("y"), "name")
    stay = ends.select("id", "which", "px", "py", F.lit(4).alias("rank"), F.lit(0.0).alias("d"), F.col("px").alias("x"), F.col("py").alias("y"), F.lit("").alias("name"))
    all_ = c1.unionByName(c2).unionByName(c3).where(F.col("d") <= tolerance).unionByName(stay)
    best = all_.groupBy("id", "which", "px", "py").agg(F.min(F.struct("rank", "d", "name", "x", "y")).alias("m"))
    names = F.create_map(*[F.lit(v) for kv in ((1, "junction"), (2, "street"), (3, "sketch"), (4, "dead end")) for v in kv])
    return best.select("id", "which", F.col("m.x").alias("x"), F.col("m.y").alias("y"), names[F.col("m.rank")].alias("target"), F.round(F.hypot(F.col("m.x") - F.col("px"), F.col("m.y") - F.col("py")), 2).alias("moved_m"))


def moved(sketch: DataFrame, ends: DataFrame) -> DataFrame:
    """The sketch with its ends put where `snapped_ends` says; streets that shrink to nothing are left out."""
    at = lambda w, n: ends.where(F.col("which") == w).select("id", F.struct("x", "y").alias(n))
    j = sketch.join(at("start", "_s"), "id").join(at("end", "_e"), "id")
    inner = F.slice("geom", 2, F.greatest(F.size("geom") - 2, F.lit(0)))
    out = j.withColumn("geom", F.concat(F.array("_s"), inner, F.array("_e"))).drop("_s", "_e")
    return out.where(geom.line_length(F.col("geom")) > 0.01)


def joined(nodes: DataFrame, edges: DataFrame, sketch: DataFrame, *, tolerance: float = 5.0, crossings: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after the join. nodes: node, x, y; edges: id, u, v, w and ends ax, ay, bx, by; sketch: id, geom of straight pieces.

    Streets are split at the new ends and, with crossings=True, wherever a sketch crosses them; pieces share their street's w
    by length. New nodes have numbers below all others, new streets numbers above; both have source "added".
    """
    from geolathe.operators.graph import node_lines

    ends = snapped_ends(sketch, nodes, edges, tolerance)
    m = moved(sketch, ends)
    top = edges.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    line = lambda: F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))
    old = edges.select("id", line().alias("geom"))
    new = numbered(m.select("id", "geom"), "n", "id").crossJoin(F.broadcast(top)).select((F.col("top") + F.col("n")).alias("id"), "geom")
    if crossings:
        pieces = node_lines(old.unionByName(new), snap=0.01)
    else:
        # Only ends meet: a sketch cuts a street where it ends on it, and is itself not cut.
        pieces = node_lines(old.unionByName(ends.crossJoin(F.broadcast(top)).where("target = 'street'").select((F.col("top") + 1_000_000 + F.col("id")).alias("id"), F.array(F.struct("x", "y"), F.struct((F.col("x") + 0.02).alias("x"), "y")).alias("geom"))), snap=0.01)
        pieces = pieces.join(F.broadcast(top), F.col("line") <= F.col("top")).drop("top")
        straight = new.select(F.col("id").alias("line"), F.lit(0).alias("seq"), F.col("geom")[0]["x"].alias("ax"), F.col("geom")[0]["y"].alias("ay"), F.element_at("geom", -1)["x"].alias("bx"), F.element_at("geom", -1)["y"].alias("by"), geom.line_length(F.col("geom")).alias("length"))
        pieces = pieces.unionByName(straight)
    key = lambda x, y: F.concat_ws("|", F.round(x, 2).cast("string"), F.round(y, 2).cast("string"))
    known = nodes.groupBy(key(F.col("x"), F.col("y")).alias("k")).agg(F.min("node").alias("node"))
    p = pieces.withColumns({"ka": key(F.col("ax"), F.col("ay")), "kb": key(F.col("bx"), F.col("by"))})
    loose = p.select(F.col("ka").alias("k"), F.col("ax").alias("x"), F.col("ay").alias("y")).union(p.select("kb", "bx", "by")).groupBy("k").agg(F.min("x").alias("x"), F.min("y").alias("y")).join(known, "k", "left_anti")
    least = nodes.agg(F.least(F.coalesce(F.min("node"), F.lit(0)), F.lit(0)).alias("least"))
    fresh = numbered(loose, "n", "k").crossJoin(F.broadcast(least)).select("k", (F.col("least") - F.col("n")).alias("node"), "x", "y")
    names = known.unionByName(fresh.select("k", "node"))
    total = pieces.groupBy("line").agg(F.sum("length").alias("total"))
    q = p.join(names.select(F.col("k").alias("ka"), F.col("node").alias("u")), "ka").join(names.select(F.col("k").alias("kb"), F.col("node").alias("v")), "kb").join(total, "line")
    q = q.join(edges.select(F.col("id").alias("line"), F.col("w").alias("w0")), "line", "left")
    out = q.select(F.col("line").alias("id"), "seq", "u", "v", F.when(F.col("w0").isNotNull(), F.col("w0") * F.col("length") / F.col("total")).otherwise(F.col("length")).alias("w"), F.when(F.col("w0").isNotNull(), "osm").otherwise("added").alias("source"), "ax", "ay", "bx", "by")
    w = Window.partitionBy(F.least("u", "v"), F.greatest("u", "v")).orderBy("id", "seq")
    all_nodes = nodes.select("node", "x", "y", F.lit("osm").alias("source")).unionByName(fresh.select("node", "x", "y", F.lit("added").alias("source")))
    return all_nodes, out.withColumn("key", F.row_number().over(w) - 1)


def street_count(edges: DataFrame) -> DataFrame:
    """node, street_count: ends of streets at each node."""
    return edges.select(F.col("u").alias("node")).unionAll(edges.select("v")).groupBy("node").agg(F.count("*").alias("street_count"))


def added_line(lines: DataFrame, points: tuple[float, float, float, float], tolerance: float) -> DataFrame:
    """lines (id, geom) and one more line, numbered after the greatest, its ends snapped to line ends first, then onto lines."""
    ax, ay, bx, by = points
    one = lines.sparkSession.createDataFrame([(0, [(ax, ay), (bx, by)])], "id bigint, geom array<struct<x:double,y:double>>")
    e = F.explode(F.array(F.get("geom", F.lit(0)), F.element_at("geom", -1))).alias("p")
    nodes = numbered(lines.select(e).distinct().select("p.x", "p.y"), "node", "x", "y")
    segs = lines.select("id", F.get("geom", F.lit(0)).alias("a"), F.element_at("geom", -1).alias("b")).select("id", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))
    m = moved(one, snapped_ends(one, nodes, segs, tolerance))
    top = lines.agg(F.max("id").alias("top"))
    return lines.select("id", "geom").unionByName(m.crossJoin(top).select((F.col("top") + 1).alias("id"), "geom"))
