"""Graphs as edge tables: building, components, nearest facility, and measures that run one search per source.

Searches with a finite reach are exact on a piece of the graph: a way of length r stays within r of its start, times the
most metres that an edge spans per unit of length. So large graphs are cut into tiles of sources, each with the edges of
a halo around it, and every tile is searched in one task. A graph of up to TILED edges is shipped whole instead, and up
to LIMIT one that can't be cut, for unlimited reach or want of coordinates.
"""

from __future__ import annotations

import heapq
import math
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from geolathe.functions import geom
from geolathe.functions.quadtree import QuadTree
from geolathe.session import discard, materialize, ship

LIMIT = 2_000_000  # edges of a graph that is shipped whole, about 100 MB
TILED = 200_000  # edges above which a graph is cut into tiles where it can be
TILE_SOURCES = 10_000  # sources of a tile


# -- tables --------------------------------------------------------------------------------------------------------


def two_way(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, repeated rows once. edges: u, v, ..."""
    return edges.unionByName(edges.withColumns({"u": F.col("v"), "v": F.col("u")})).distinct()


def with_speed(edges: DataFrame, kmh: float, length: str = "length") -> DataFrame:
    return edges.withColumn("travel_time", F.col(length) / (kmh * 1000 / 3600))


def undirected_once(edges: DataFrame, order: str, *extra: str) -> DataFrame:
    """The first edge, by `order`, of each pair of ends (and `extra` key)."""
    w = Window.partitionBy(F.least("u", "v"), F.greatest("u", "v"), *extra).orderBy(order)
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def simple_graph(edges: DataFrame, order: str) -> DataFrame:
    """Of parallel edges the last, by `order`, wins. edges: u, v, ..."""
    a, b = F.least("u", "v"), F.greatest("u", "v")
    rest = [c for c in edges.columns if c not in ("u", "v")]
    g = edges.groupBy(a.alias("u"), b.alias("v")).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return g.select("u", "v", *[F.col(f"r.{c}").alias(c) for c in rest])


def ends(lines: DataFrame, digits: int) -> DataFrame:
    """lines with u and v: their ends as rounded coordinates "x|y". lines: geom."""
    at = lambda p: F.concat_ws("|", F.round(p["x"], digits).cast("string"), F.round(p["y"], digits).cast("string"))
    return lines.withColumns({"u": at(F.get("geom", F.lit(0))), "v": at(F.element_at("geom", -1))})


def line_graph(edges: DataFrame, cost: Callable[[Column, Column], Column], attr: str) -> DataFrame:
    """a < b, cost: the edges (id, u, v, attr) that share a node; of several shared nodes the least cost."""
    inc = edges.select("id", F.col("u").alias("node"), attr).unionAll(edges.select("id", F.col("v").alias("node"), attr))
    l, r = inc.select(F.col("id").alias("a"), "node", F.col(attr).alias("fa")), inc.select(F.col("id").alias("b"), "node", F.col(attr).alias("fb"))
    return l.join(r, "node").where("a < b").groupBy("a", "b").agg(F.min(cost(F.col("fa"), F.col("fb"))).alias("cost"))


def angular_graph(edges: DataFrame) -> DataFrame:
    """The line graph by turns: 0 straight on, 1 at a right angle. edges: id, u, v, bearing."""
    return line_graph(edges, lambda x, y: geom.turn(x, y) / 90.0, "bearing")


def node_lines(lines: DataFrame, snap: float = 1.0, size: float = 100.0) -> DataFrame:
    """Straight pieces (line, seq, ax, ay, bx, by, length) of lines (id, geom), snapped to a grid and cut at every crossing."""
    s = lines.select("id", F.posexplode(F.slice("geom", 1, F.greatest(F.size("geom") - 1, F.lit(0)))).alias("i", "p"), "geom").select("id", "i", "p", F.get("geom", F.col("i") + 1).alias("q"))
    g = lambda c: F.round(F.col(c) / snap) * snap
    s = s.select("id", "i", g("p.x").alias("ax"), g("p.y").alias("ay"), g("q.x").alias("ex"), g("q.y").alias("ey")).where("ax <> ex or ay <> ey")
    s = materialize(s.withColumn("k", F.struct("id", "i")), "segments")
    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / size - 0.01).cast("long"), F.floor(F.greatest(a, b) / size + 0.01).cast("long")))
    c = s.withColumn("gx", span("ax", "ex")).withColumn("gy", span("ay", "ey"))
    o = c.select("gx", "gy", F.col("k").alias("k2"), F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("ex").alias("dx"), F.col("ey").alias("dy"))
    j = c.join(o, ["gx", "gy"]).where("k <> k2")
    t, u = geom.crossing((F.col("ax"), F.col("ay"), F.col("ex"), F.col("ey")), (F.col("cx"), F.col("cy"), F.col("dx"), F.col("dy")))
    eps = 1e-9
    cuts = j.select("k", F.when(t.between(-eps, 1 + eps) & u.between(-eps, 1 + eps), t).alias("t")).where("t is not null")
    # Ends of other segments that lie on this one cut it too, parallel ones among them.
    on = None
    for x, y in (("cx", "cy"), ("dx", "dy")):
        d = geom.segment_distance(F.col(x), F.col(y), F.col("ax"), F.col("ay"), F.col("ex"), F.col("ey"))
        e = j.where(d <= snap / 2).select("k", geom.segment_foot(F.col(x), F.col(y), F.col("ax"), F.col("ay"), F.col("ex"), F.col("ey")).alias("t"))
        on = e if on is None else on.unionAll(e)
    at = cuts.unionAll(on).groupBy("k").agg(F.collect_set(F.round("t", 9)).alias("ts"))
    stops = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.transform(F.coalesce("ts", F.array().cast("array<double>")), lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))))))
    p = s.join(at, "k", "left").withColumn("stops", stops).select("*", F.posexplode(F.slice("stops", 1, F.size("stops") - 1)).alias("seq", "t0")).withColumn("t1", F.get("stops", F.col("seq") + 1))
    place = lambda a, b, tt: F.round((F.col(a) + F.col(tt) * (F.col(b) - F.col(a))) / snap) * snap
    q = p.select(F.col("id").alias("line"), "i", "seq", place("ax", "ex", "t0").alias("ax"), place("ay", "ey", "t0").alias("ay"), place("ax", "ex", "t1").alias("bx"), place("ay", "ey", "t1").alias("by"))
    q = q.where("ax <> bx or ay <> by").withColumn("length", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    w = Window.partitionBy("line").orderBy("i", "seq")
    return q.withColumn("seq", F.row_number().over(w) - 1).drop("i")


# -- components ----------------------------------------------------------------------------------------------------


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component: the least node of its component. nodes: node; edges: a, b in any direction.

    Least labels spread over edges and jump to the label's own label, so the rounds grow with the logarithm of a
    component's width; each round is written to the shared folder.
    """
    e = materialize(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    kept = lab = materialize(nodes.select("node").distinct().withColumn("component", F.col("node")), "labels")
    while True:
        near = e.join(lab.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = lab.join(near, "node", "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("to"))
        jump = lab.select(F.col("node").alias("to"), F.col("component").alias("far"))
        new = step.join(jump, "to", "left").select("node", F.least("to", F.coalesce("far", "to")).alias("component"), (F.least("to", F.coalesce("far", "to")) < F.col("component")).alias("moved"))
        new = materialize(new, "labels")
        discard(kept)
        kept, lab = new, new.drop("moved")
        if not new.where("moved").limit(1).count():
            return lab


def largest_component(labels: DataFrame) -> DataFrame:
    """The nodes of the component with most nodes, the least label among equals."""
    top = labels.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    return labels.join(F.broadcast(top), "component").select("node")


# -- distances by relaxation ---------------------------------------------------------------------------------------


def nearest_source(edges: DataFrame, sources: DataFrame, cutoff: float = math.inf, weight: str = "w") -> DataFrame:
    """node, dist, source: the nearest source of each reached node, the least source among equals, up to cutoff.

    Relaxation of whole tables: only nodes that improved in a round are joined to the edges in the next. edges: u, v, w,
    walked from u to v; sources: source, node. A graph of any size; rounds grow with the hops of the longest way.
    """
    e = materialize(edges.select("u", "v", F.col(weight).alias("w")).groupBy("u", "v").agg(F.min("w").alias("w")), "edges")
    best = sources.groupBy("node").agg(F.min(F.struct(F.lit(0.0).alias("dist"), F.col("source").alias("source"))).alias("m"))
    state = materialize(best.select("node", "m", F.lit(True).alias("fresh")), "reach")
    while True:
        front = state.where("fresh").select(F.col("node").alias("u"), "m")
        step = front.join(e, "u").select(F.col("v").alias("node"), F.struct((F.col("m.dist") + F.col("w")).alias("dist"), F.col("m.source").alias("source")).alias("m"))
        if math.isfinite(cutoff):
            step = step.where(F.col("m.dist") <= cutoff)
        best_step = step.groupBy("node").agg(F.min("m").alias("n"))
        j = state.join(best_step, "node", "full")
        better = F.col("m").isNull() | (F.col("n") < F.col("m"))
        new = materialize(j.select("node", F.when(F.col("n").isNotNull() & better, F.col("n")).otherwise(F.col("m")).alias("m"), (F.col("n").isNotNull() & better).alias("fresh")), "reach")
        discard(state)
        state = new
        if not state.where("fresh").limit(1).count():
            return state.select("node", "m.dist", "m.source")


# -- one search per source -----------------------------------------------------------------------------------------


class Net:
    """A graph in compressed rows. Nodes are numbered by their sorted names; edge `e` of a slot is its row in the edge table."""

    def __init__(self, edges: pd.DataFrame, directed: bool = False):
        self.names, inv = np.unique(np.concatenate([edges["u"].to_numpy(), edges["v"].to_numpy()]), return_inverse=True)
        n = len(edges)
        u, v, w, e = inv[:n], inv[n:], edges["w"].to_numpy(float), np.arange(n)
        if not directed:
            u, v, w, e = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([w, w]), np.concatenate([e, e])
        order = np.lexsort((v, u))
        self.start = np.searchsorted(u[order], np.arange(len(self.names) + 1)).tolist()
        self.to, self.w, self.e = v[order].tolist(), w[order].tolist(), e[order].tolist()
        self.index = {k: i for i, k in enumerate(self.names.tolist())}
        self.arcs: dict[int, list] = {}

    def out(self, i: int):
        a, b = self.start[i], self.start[i + 1]
        return zip(self.to[a:b], self.w[a:b], self.e[a:b])

    def distances(self, s: int, cutoff: float = math.inf, allowed: set[int] | None = None) -> dict[int, float]:
        dist, done, heap = {s: 0.0}, {}, [(0.0, s)]
        while heap:
            d, i = heapq.heappop(heap)
            if i in done:
                continue
            done[i] = d
            for j, w, _ in self.out(i):
                n = d + w
                if n <= cutoff and (allowed is None or j in allowed) and n < dist.get(j, math.inf):
                    dist[j] = n
                    heapq.heappush(heap, (n, j))
        return done

    def balls(self, sources: list[int], cutoff: float, room: int = 4_000_000) -> Iterator[list[int]]:
        """The nodes within cutoff of each source, itself among them. Many sources are searched at once, each round over the nodes that became nearer."""
        n, start, to, w = max(len(self.names), 1), np.array(self.start), np.array(self.to, np.int64), np.array(self.w)
        step = max(1, room // n)
        dist = np.full(min(step, max(len(sources), 1)) * n, np.inf)
        for lo in range(0, len(sources), step):
            part = np.array(sources[lo : lo + step], np.int64)
            front = np.arange(len(part)) * n + part
            dist[front] = 0.0
            seen = [front]
            while len(front):
                node = front % n
                deg = start[node + 1] - start[node]
                arc = np.repeat(start[node] - np.cumsum(deg) + deg, deg) + np.arange(deg.sum())
                key, d = np.repeat(front - node, deg) + to[arc], np.repeat(dist[front], deg) + w[arc]
                old = dist[key]
                ok = (d <= cutoff) & (d < old)
                key, d, old = key[ok], d[ok], old[ok]
                np.minimum.at(dist, key, d)
                front = np.unique(key[d == dist[key]])
                seen.append(np.unique(key[np.isinf(old)]))
            held = np.sort(np.concatenate(seen))
            dist[held] = np.inf
            cut = np.searchsorted(held, np.arange(len(part) + 1) * n).tolist()
            nodes = (held % n).tolist()
            yield from (nodes[cut[k] : cut[k + 1]] for k in range(len(part)))

    def first_ways(self, s: int, allowed: list[int], tie: float = 1e-9):
        """Order of settling among the allowed nodes, each one's least predecessor on a shortest way, and the sum of distances."""
        left, first, order, total, heap, arcs = dict.fromkeys(allowed, math.inf), {}, [], 0.0, [(0.0, s)], self.arcs
        left[s] = 0.0
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            d, i = pop(heap)
            if i not in left:
                continue
            del left[i]
            order.append(i)
            total += d
            out = arcs.get(i)
            if out is None:
                out = arcs[i] = [(j, w) for j, w, _ in self.out(i)]
            for j, w in out:
                old = left.get(j)
                if old is None:
                    continue
                n = d + w
                if n < old - tie:
                    left[j], first[j] = n, i
                    push(heap, (n, j))
                elif n <= old + tie and i < first[j]:
                    first[j] = i
        return order, first, total

    def hops(self, s: int, cutoff: float = math.inf) -> dict[int, int]:
        dist, queue = {s: 0}, deque([s])
        while queue:
            i = queue.popleft()
            if dist[i] >= cutoff:
                continue
            for j, _, _ in self.out(i):
                if j not in dist:
                    dist[j] = dist[i] + 1
                    queue.append(j)
        return dist

    def ways(self, s: int, cutoff: float = math.inf, by_hops: bool = False, allowed: set[int] | None = None, tie: float = 1e-9):
        """Order of settling, and for each node the predecessors (node, edge) and number of its shortest ways; equal up to `tie`."""
        dist, sigma, preds, order, done, heap = {s: 0.0}, {s: 1.0}, {s: []}, [], set(), [(0.0, s)]
        while heap:
            d, i = heapq.heappop(heap)
            if i in done:
                continue
            done.add(i)
            order.append(i)
            for j, w, e in self.out(i):
                n = d + (1.0 if by_hops else w)
                if n > cutoff + tie or j in done or (allowed is not None and j not in allowed):
                    continue
                old = dist.get(j, math.inf)
                if n < old - tie:
                    dist[j], sigma[j], preds[j] = n, sigma[i], [(i, e)]
                    heapq.heappush(heap, (n, j))
                elif n <= old + tie:
                    sigma[j] += sigma[i]
                    preds[j].append((i, e))
        return order, preds, sigma, dist


def _net(pdf: pd.DataFrame, directed: bool) -> Net:
    pdf = pdf.sort_values("id", kind="stable", ignore_index=True) if "id" in pdf else pdf  # equal parallel edges: the least id
    net = Net(pdf, directed)
    net.table = pdf
    return net


def _ends(edges: DataFrame) -> DataFrame:
    """source and, where edges have coordinates, x, y: every node once."""
    at = {"ux", "uy", "vx", "vy"} <= set(edges.columns)
    n = edges.select(F.col("u").alias("source"), *([F.col("ux").alias("x"), F.col("uy").alias("y")] if at else []))
    n = n.unionAll(edges.select("v", *(["vx", "vy"] if at else [])))
    return n.groupBy("source").agg(F.min("x").alias("x"), F.min("y").alias("y")) if at else n.distinct()


def _halo(edges: DataFrame, reach: float, length: str | None, beyond: bool) -> float:
    """Metres round a source that hold all edges within its reach; infinite if an edge without length spans any or a place is unknown."""
    span = F.hypot(F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy"))
    per = span if length is None else F.when(F.col(length) > 0, span / F.col(length)).otherwise(F.when(span > 0, math.inf).otherwise(0.0))
    r = edges.agg(F.max(F.coalesce(per, F.lit(math.inf))), F.max(span)).first()
    h = reach * (r[0] or 0.0) + ((r[1] or 0.0) if beyond else 0.0)
    return h * (1 + 1e-9) + 1e-6 if math.isfinite(h) else math.inf


def _in_tiles(edges: DataFrame, sources: DataFrame, halo: float) -> tuple[DataFrame, DataFrame, int]:
    """Both with the number of their tile, edges repeated for every tile whose halo they meet, and the number of tiles. Collects about 50,000 coordinates."""
    n, lost, *box = sources.agg(F.count("*"), F.count_if(F.col("x").isNull() | F.col("y").isNull() | F.isnan("x") | F.isnan("y")), F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if lost or not math.isfinite(halo):
        return edges.withColumn("tile", F.lit(0).cast("long")), sources.withColumn("tile", F.lit(0).cast("long")), 1
    f = min(1.0, 50_000 / max(n, 1))
    xy = (sources.sample(fraction=f, seed=7) if f < 1 else sources).select("x", "y").toPandas().to_numpy(float).reshape(-1, 2)
    tree = QuadTree(box if n else (0.0, 0.0, 0.0, 0.0), xy, np.full(len(xy), n / max(len(xy), 1)), TILE_SOURCES, 2 * halo)

    def of_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.leaf_of(b.column("x").to_numpy(), b.column("y").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int64())], names=[*b.schema.names, "tile"])

    def of_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ux, uy, vx, vy = (b.column(c).to_numpy() for c in ("ux", "uy", "vx", "vy"))
            at, leaf = tree.leaves_of(np.minimum(ux, vx) - halo, np.minimum(uy, vy) - halo, np.maximum(ux, vx) + halo, np.maximum(uy, vy) + halo)
            b = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int64())], names=[*b.schema.names, "tile"])

    tiled = lambda df, f: df.mapInArrow(f, StructType([*df.schema.fields, StructField("tile", LongType())]))
    return tiled(edges, of_edges), tiled(sources, of_sources), len(tree.first)


def per_source(edges: DataFrame, sources: DataFrame, kernel: Callable[[Net, list], pd.DataFrame], schema: str, *, reach: float = math.inf, directed: bool = False, length: str | None = "w", beyond: bool = False) -> DataFrame:
    """Runs kernel(net, sources) over the graph and gathers its rows.

    edges: u, v, w and, for tiles, ux, uy, vx, vy; other columns reach the kernel as net.table. sources: source and, for
    tiles, x, y; a node has one place. length: the column that reach is measured in, None for edges walked; beyond: the
    reach is from the far end of a source that is an edge, too.
    """
    spark = edges.sparkSession
    ship(spark)
    edges = materialize(edges, "net")
    n = edges.count()
    placed = {"ux", "uy", "vx", "vy"} <= set(edges.columns) and {"x", "y"} <= set(sources.columns)
    halo = _halo(edges, reach, length, beyond) if placed and math.isfinite(reach) and n > min(LIMIT, TILED) else math.inf
    if n <= LIMIT and not math.isfinite(halo):
        pdf = edges.toPandas()
        shared = spark.sparkContext.broadcast(_net(pdf, directed) if len(pdf) else None)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g = shared.value
            for p in parts:
                if g is not None:
                    yield kernel(g, p["source"].tolist())

        spread = max(8, spark.sparkContext.defaultParallelism)
        return sources.select("source").repartition(spread, "source").mapInPandas(run, schema)
    if not math.isfinite(reach):
        raise ValueError(f"{n} edges: a search of unlimited reach needs a graph of at most {LIMIT} edges; give a reach")
    if not placed:
        raise ValueError(f"{n} edges: a graph of more than {LIMIT} edges is searched in tiles, which need the coordinates of its nodes")
    e, s, tiles = _in_tiles(edges, sources.select("source", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), halo)
    spread = max(1, min(tiles, 8 * spark.sparkContext.defaultParallelism))

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return kernel(_net(left.drop(columns="tile"), directed), right["source"].tolist())

    return e.repartition(spread, "tile").groupBy("tile").cogroup(s.select("source", "tile").repartition(spread, "tile").groupBy("tile")).applyInPandas(both, schema)


def reachable(edges: DataFrame, sources: DataFrame, cutoff: float, directed: bool = True) -> DataFrame:
    """source, node, dist for every node within cutoff of a source."""

    def kernel(net: Net, src: list) -> pd.DataFrame:
        out = [(s, net.names[j], d) for s in src if s in net.index for j, d in net.distances(net.index[s], cutoff).items()]
        return pd.DataFrame(out, columns=["source", "node", "dist"])

    t = dict(edges.dtypes)["u"]
    return per_source(edges, sources, kernel, f"source {t}, node {t}, dist double", reach=cutoff, directed=directed)


def betweenness(edges: DataFrame, radius: float = math.inf, *, of: str = "edge", by_hops: bool = False, metric: str | None = None, weighted: bool = False) -> DataFrame:
    """id, choice: how many shortest ways between all pairs pass an edge (of="edge", both directions) or node (of="node", pairs once).

    Equal ways share the credit. radius: cutoff on the way; with `metric`, a second weight column of edges, the radius holds for
    that distance instead and routes are chosen among the nodes within it. weighted: a route counts the product of the
    lengths of its ends (of="node": column lu, lv of edges; of="edge": its first and last edge's w). Each task sends sums
    of partial credits, which are added up by key.
    """

    def kernel(net: Net, src: list) -> pd.DataFrame:
        tab = net.table
        ids = tab["id"].tolist() if "id" in tab else None
        other = None
        if metric and math.isfinite(radius):
            other = Net(tab.assign(w=tab[metric]))
        length = {}
        if weighted and of == "node":
            for u, v, lu, lv in zip(tab["u"], tab["v"], tab["lu"], tab["lv"]):
                length[net.index[u]], length[net.index[v]] = lu, lv
        got: dict = {}
        for s_ in src:
            if s_ not in net.index:
                continue
            s = net.index[s_]
            allowed = set(other.distances(s, radius)) if other is not None else None
            order, preds, sigma, dist = net.ways(s, math.inf if metric else radius, by_hops, allowed)
            if of == "node":
                ws = length.get(s, 1.0) if weighted else 1.0
                delta = dict.fromkeys(order, 0.0)
                for j in reversed(order):
                    c = (length.get(j, 1.0) if weighted else 1.0) + delta[j]
                    for i, _ in preds[j]:
                        delta[i] += sigma[i] / sigma[j] * c
                    if j != s:
                        got[net.names[j]] = got.get(net.names[j], 0.0) + ws * delta[j] / 2
            else:
                delta = dict.fromkeys(order, 0.0)
                for j in reversed(order):
                    for i, e in preds[j]:
                        c = sigma[i] / sigma[j] * (1.0 + delta[j])
                        delta[i] += c
                        got[ids[e]] = got.get(ids[e], 0.0) + c
        return pd.DataFrame({"id": list(got), "choice": list(got.values())}) if got else pd.DataFrame({"id": [], "choice": []}).astype({"choice": float})

    key = dict(edges.dtypes)["u" if of == "node" else "id"]
    nodes = _ends(edges)
    part = per_source(edges, nodes, kernel, f"id {key}, choice double", reach=radius, length=metric or (None if by_hops else "w"))
    all_ids = nodes.select(F.col("source").alias("id")) if of == "node" else edges.select("id").distinct()
    return all_ids.join(part.groupBy("id").agg(F.sum("choice").alias("choice")), "id", "left").fillna(0.0, ["choice"])


def depth(edges: DataFrame, sources: DataFrame, radius: float = math.inf, *, by_hops: bool = True, metric: str | None = None) -> DataFrame:
    """source, reached (nodes beside the source), total: the sum of hops or weights to them."""

    def kernel(net: Net, src: list) -> pd.DataFrame:
        other = Net(net.table.assign(w=net.table[metric])) if metric and math.isfinite(radius) else None
        out = []
        for s in src:
            if s not in net.index:
                out.append((s, 0, 0.0))
                continue
            i = net.index[s]
            if other is not None:
                d = net.distances(i, math.inf, set(other.distances(i, radius)))
            else:
                d = net.hops(i, radius) if by_hops else net.distances(i, radius)
            out.append((s, len(d) - 1, float(sum(d.values()))))
        return pd.DataFrame(out, columns=["source", "reached", "total"])

    t = dict(sources.dtypes)["source"]
    return per_source(edges, sources, kernel, f"source {t}, reached bigint, total double", reach=radius, length=metric or (None if by_hops else "w"))


def hh_integration(reached: Column, total: Column) -> Column:
    """1 / RRA with the D-value of k = reached + 1 lines; 0 below three lines, infinite when every line is one step away."""
    k = (reached + 1).cast("double")
    md = total / F.nullif(k - 1, F.lit(0.0))
    ra = 2 * (md - 1) / F.nullif(k - 2, F.lit(0.0))
    d_k = 2 * (k * (F.log2((k + 2) / 3) - 1) + 1) / F.nullif((k - 1) * (k - 2), F.lit(0.0))
    return F.when(k < 3, 0.0).when(ra / d_k > 0, d_k / F.nullif(ra, F.lit(0.0))).otherwise(F.lit(float("inf")))


def axial_integration(pairs: DataFrame, lines: DataFrame, radius: float = math.inf) -> DataFrame:
    """id, integration on the graph of touching lines; infinite values get the highest finite one. pairs: a, b; lines: id."""
    e = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(1.0).alias("w"))
    d = depth(e, lines.select(F.col("id").alias("source")), radius)
    v = materialize(d.select(F.col("source").alias("id"), hh_integration(F.col("reached"), F.col("total")).alias("i")), "integration")
    top = v.where(F.col("i") < float("inf")).agg(F.coalesce(F.max("i"), F.lit(0.0)).alias("top"))
    return v.crossJoin(F.broadcast(top)).select("id", F.least("i", "top").alias("integration"))


def segment_integration(edges: DataFrame, radius: float = math.inf) -> DataFrame:
    """id, integration: n * n / total hop depth from each edge's first end; 0 where nothing is reached."""
    d = depth(edges, _ends(edges).join(edges.select(F.col("u").alias("source")).distinct(), "source", "left_semi"), radius)
    return edges.join(d, edges.u == d.source).select("id", F.when((F.col("reached") > 0) & (F.col("total") > 0), F.col("reached") * F.col("reached") / F.col("total")).otherwise(0.0).alias("integration"))


def angular_measures(dual: DataFrame, segments: DataFrame, radius: float = math.inf, *, metric: bool = False) -> DataFrame:
    """id, choice, reached, total, integration, nach of every segment on the line graph.

    One way per pair, the one whose predecessor has the least id where turns are equal; its ends count too. radius: on the
    summed turn, or with metric=True on the distance by mean lengths (column m of dual). dual: a, b, cost[, m]; segments: id
    and, for tiles, a point x, y of each.
    """
    e = dual.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("cost").alias("w"), *(["m"] if metric else []))
    placed = {"x", "y"} <= set(segments.columns)
    if placed and math.isfinite(radius):
        for c in ("u", "v"):
            e = e.join(segments.select(F.col("id").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y")), c)

    def kernel(net: Net, src: list) -> pd.DataFrame:
        other = Net(net.table.assign(w=net.table["m"])) if metric else None
        near = other.balls([net.index[s] for s in src if s in net.index], radius) if metric else None
        got: dict = {}
        depth_: dict = {}
        names = net.names.tolist()
        for s_ in src:
            if s_ not in net.index:
                depth_[s_] = (0, 0.0)
                continue
            s = net.index[s_]
            if other is not None:
                order, first, total = net.first_ways(s, next(near))
            else:
                order, preds, _, dist = net.ways(s, radius)
                first, total = {j: min(p)[0] for j, p in preds.items() if p}, sum(dist[j] for j in order)
            depth_[s_] = (len(order) - 1, total)
            below = dict.fromkeys(order, 0)
            for j in reversed(order):
                if j != s:
                    n = below[j] = below[j] + 1
                    got[names[j]] = got.get(names[j], 0.0) + n
                    below[first[j]] += n
            if len(order) > 1:
                got[s_] = got.get(s_, 0.0) + len(order) - 1
        rows = [(k, v, 0, 0.0) for k, v in got.items()] + [(k, 0.0, n, t) for k, (n, t) in depth_.items()]
        return pd.DataFrame(rows, columns=["id", "choice", "reached", "total"])

    t = dict(segments.dtypes)["id"]
    src = segments.select(F.col("id").alias("source"), *(["x", "y"] if placed else []))
    part = per_source(e, src, kernel, f"id {t}, choice double, reached bigint, total double", reach=radius, length="m" if metric else "w")
    g = part.groupBy("id").agg(F.sum("choice").alias("choice"), F.sum("reached").alias("reached"), F.sum("total").alias("total"))
    g = segments.select("id").join(g, "id", "left").fillna(0, ["choice", "reached", "total"])
    return g.withColumns({"integration": F.when((F.col("reached") > 0) & (F.col("total") > 0), F.col("reached") * F.col("reached") / F.col("total")).otherwise(0.0), "nach": F.log(F.col("choice") + 1) / F.log(F.col("total") + 3)})


def metric_reach(edges: DataFrame, radii: dict[str, float]) -> DataFrame:
    """id and one column per radius: the length of edges with both ends within the radius of either end of an edge. edges: id, u, v, w."""
    top, limits = max(radii.values()), list(radii.values())

    def kernel(net: Net, src: list) -> pd.DataFrame:
        ends = {i: (net.index[u], net.index[v]) for i, u, v in zip(net.table["id"].tolist(), net.table["u"].tolist(), net.table["v"].tolist())}
        out, near = [], {}
        for s in sorted(src, key=lambda s: ends[s]):
            if len(near) > 20_000:
                near.clear()
            for i in ends[s]:
                if i not in near:
                    near[i] = net.distances(i, top)
            d = dict(near[ends[s][0]])
            for i, x in near[ends[s][1]].items():
                if x < d.get(i, math.inf):
                    d[i] = x
            sums = [0.0] * len(limits)
            for i, x in d.items():
                for j, w, _ in net.out(i):  # every edge comes from both its ends
                    y = d.get(j)
                    if y is not None:
                        y = max(x, y)
                        for k, limit in enumerate(limits):
                            if y <= limit:
                                sums[k] += w / 2
            out.append((s, *sums))
        return pd.DataFrame(out, columns=["id", *radii])

    src = edges.select(F.col("id").alias("source"), *([F.col("ux").alias("x"), F.col("uy").alias("y")] if {"ux", "uy"} <= set(edges.columns) else []))
    schema = ", ".join([f"id {dict(edges.dtypes)['id']}", *[f"`{name}` double" for name in radii]])
    return per_source(edges, src, kernel, schema, reach=top, beyond=True)


def length_weighted_choice(edges: DataFrame, radius: float = math.inf) -> DataFrame:
    """id, choice: one shortest way per ordered pair, counted by the product of the lengths of its first and last edge."""

    def kernel(net: Net, src: list) -> pd.DataFrame:
        ids, w = net.table["id"].tolist(), net.table["w"].tolist()
        got: dict = {}
        for s_ in src:
            if s_ not in net.index:
                continue
            s = net.index[s_]
            order, preds, _, _ = net.ways(s, radius)
            first, carry = {}, dict.fromkeys(order, 0.0)
            for j in order[1:]:
                p, e = min(preds[j])
                first[j] = e if p == s else first[p]
            for j in reversed(order[1:]):
                p, e = min(preds[j])
                mine = w[first[j]] * w[e] + carry[j]
                got[ids[e]] = got.get(ids[e], 0.0) + mine
                carry[p] += mine
        return pd.DataFrame({"id": list(got), "choice": list(got.values())}) if got else pd.DataFrame({"id": [], "choice": []}).astype({"choice": float})

    part = per_source(edges, _ends(edges), kernel, f"id {dict(edges.dtypes)['id']}, choice double", reach=radius)
    return edges.select("id").join(part.groupBy("id").agg(F.sum("choice").alias("choice")), "id", "left").fillna(0.0, ["choice"])


def axial_lines(segments: DataFrame, tolerance: float = 20.0) -> DataFrame:
    """id, axial: segments that meet and whose bearings agree within tolerance, tied transitively; the line is named by its least id."""
    d = line_graph(segments, geom.turn, "bearing").where(F.col("cost") <= tolerance).select("a", "b")
    return components(segments.select(F.col("id").alias("node")), d).select(F.col("node").alias("id"), F.col("component").alias("axial"))


def pivot_metrics(base: DataFrame, metrics: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """One column per metric table (key, value), 0 where it has no value."""
    out = base
    for name, m in metrics.items():
        out = out.join(m.select(key, m[[c for c in m.columns if c != key][0]].alias(name)), key, "left").fillna(0, [name])
    return out


def scenario_delta(before: DataFrame, after: DataFrame, key: str, metrics: list[str], order: str) -> DataFrame:
    """after with <metric>_after, <metric>_delta and is_new; rows match by their line's midpoint, the last `order` before wins."""
    mid = lambda df: df.withColumn("_m", geom.interpolate(F.col("geom"), 0.5)).withColumn("_k", F.struct(F.round("_m.x", 3).alias("x"), F.round("_m.y", 3).alias("y")))
    b = mid(before).groupBy("_k").agg(F.max_by(F.struct(*metrics), F.col(order)).alias("was"))
    j = mid(after).join(b, "_k", "left")
    return j.select(key, F.col("was").isNull().alias("is_new"), *[F.col(m).alias(f"{m}_after") for m in metrics], *[(F.col(m) - F.col(f"was.{m}")).alias(f"{m}_delta") for m in metrics])
