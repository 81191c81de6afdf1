"""Points near other points or inside regions.

Method: a bounded sample of both sides fits a quadtree on the driver; every point goes to the one leaf that owns it, the
other side is replicated over the leaf boundaries its box crosses; each leaf bulk-loads an R-tree, probes it and refines
the candidates exactly. A pair is reported only in the leaf that owns its reference point (the place itself), so no pair
comes twice. Leaves that stay heavy, as one location may hold a third of all rows, are split into a matrix of
(points x targets) slots by hash; each pair meets in exactly one slot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolathe.functions.quadtree import QuadTree
from geolathe.functions.rtree import PackedRTree, in_ring
from geolathe.session import ship

RING = "array<array<struct<x:double,y:double>>>"
ROUTED = f"cell bigint, side tinyint, pid string, oid bigint, x double, y double, rings {RING}"
FOUND = "place_id string, near_kind string, near_id bigint"


def real_location(x: Column, y: Column) -> Column:
    """Not null, not NaN, not infinite and not (0, 0)."""
    inf = F.lit(float("inf"))
    ok = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < inf) & (F.abs(y) < inf)
    return ok & ~((x == 0) & (y == 0))


def _hash(v) -> np.ndarray:
    return pd.util.hash_array(np.asarray(v, dtype=object) if not np.issubdtype(np.asarray(v).dtype, np.number) else np.asarray(v))


def _fit(points: DataFrame, targets: DataFrame, reach: float, rows_per_cell: int, sample_rows: int):
    """The tree and, for each leaf, its slots for points and targets. Collects at most about 2 * sample_rows coordinates."""
    both = points.select(F.lit(0).alias("s"), "x", "y").unionAll(targets.select(F.lit(1).alias("s"), "x", "y"))
    r = both.agg(F.sum((F.col("s") == 0).cast("long")).alias("p"), F.count("*").alias("n"), F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    n = r[1] or 0
    if not n:
        return None
    n_p, n_t = r[0], n - r[0]
    sides = []
    for df, m in ((points, n_p), (targets, n_t)):
        f = min(1.0, sample_rows / max(m, 1))
        xy = (df.sample(fraction=f, seed=7) if f < 1 else df).select("x", "y").toPandas().to_numpy()
        sides.append((xy, m / max(len(xy), 1)))
    xy = np.concatenate([sides[0][0], sides[1][0]])
    w = np.concatenate([np.full(len(s), k) for s, k in sides])
    is_p = np.concatenate([np.ones(len(sides[0][0]), bool), np.zeros(len(sides[1][0]), bool)])
    tree = QuadTree((r[2], r[3], r[4], r[5]), xy, w, rows_per_cell, 2 * reach)
    p_cum = np.concatenate([[0.0], np.cumsum(np.where(is_p, w, 0)[tree.order])])
    t_cum = np.concatenate([[0.0], np.cumsum(np.where(is_p, 0, w)[tree.order])])
    slots = lambda cum: np.array([max(1, math.ceil((cum[b] - cum[a]) / (2 * rows_per_cell))) for a, b in tree.sampled], np.int64)
    return tree, slots(p_cum), slots(t_cum)


def _cells(leaf, i, j):
    return (leaf.astype(np.int64) << 40) | (np.asarray(i, np.int64) << 20) | np.asarray(j, np.int64)


def _expand(idx, leaf, reps):
    """Repeats each (idx, leaf) once per slot and numbers the slots."""
    k = reps[leaf]
    at = np.repeat(np.arange(len(leaf)), k)
    return idx[at], leaf[at], np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)


def near_or_inside(places: DataFrame, nodes: DataFrame, zones: DataFrame, *, radius: float = 25.0, rows_per_cell: int = 8000, sample_rows: int = 50_000) -> DataFrame:
    """(place_id, near_kind, near_id): nodes at most `radius` from a place, and zones whose first ring holds it and no further ring does.

    places: id, geometry(x, y); nodes: osmid, x, y; zones: zone_id, geom (rings). Other columns are ignored, whatever they
    are called. Rows without an id or a real location, nodes without both coordinates and zones without geom or with a
    first ring of under three vertices give nothing. Repeated rows give a pair once. Empty tables give an empty result.
    """
    spark = places.sparkSession
    ship(spark)
    p = places.select(F.col("id").alias("pid"), F.col("geometry.x").alias("x"), F.col("geometry.y").alias("y")).where(F.col("pid").isNotNull() & real_location(F.col("x"), F.col("y")))
    t = nodes.select(F.col("osmid").cast("long").alias("oid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    there = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    t = t.where(F.col("oid").isNotNull() & there("x") & there("y"))
    z = zones.select(F.col("zone_id").cast("long").alias("oid"), F.col("geom").cast(RING).alias("rings")).where(F.col("oid").isNotNull() & F.col("rings").isNotNull() & (F.size("rings") > 0))
    # A zone weighs on the cells by its first corner.
    corner = F.get(F.get("rings", F.lit(0)), F.lit(0))
    targets = t.select("x", "y").unionAll(z.select(corner["x"].alias("x"), corner["y"].alias("y")).where(there("x") & there("y")))
    fitted = _fit(p, targets, radius, rows_per_cell, sample_rows)
    if fitted is None:
        return spark.createDataFrame([], FOUND)
    tree, p_slots, t_slots = fitted

    def route_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("x").to_numpy(), b.column("y").to_numpy()
            pid = b.column("pid")
            leaf = tree.leaf_of(x, y)
            slot = np.zeros(len(leaf), np.int64)
            if (many := p_slots[leaf] > 1).any():
                h = _hash(pid.to_numpy(zero_copy_only=False)[many])
                slot[many] = (h % p_slots[leaf[many]].astype(np.uint64)).astype(np.int64)
            idx, leaf2, j = _expand(np.arange(len(leaf)), leaf, t_slots)
            yield _routed(_cells(leaf2, slot[idx], j), 0, idx, pid=pid, x=x, y=y)

    def route_targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, oid = b.column("x").to_numpy(), b.column("y").to_numpy(), b.column("oid").to_numpy()
            bi, leaf = tree.leaves_of(x - radius, y - radius, x + radius, y + radius)
            slot = (_hash(oid[bi]) % t_slots[leaf].astype(np.uint64)).astype(np.int64)
            at, leaf2, i = _expand(np.arange(len(bi)), leaf, p_slots)
            yield _routed(_cells(leaf2, i, slot[at]), 1, bi[at], oid=b.column("oid"), x=x, y=y)

    def route_zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rings = b.column("rings")
            box = np.array([_box(v) for v in rings.to_pylist()])
            ok = np.flatnonzero(~np.isnan(box[:, 0])) if len(box) else np.zeros(0, np.int64)
            if not len(ok):
                continue
            bi, leaf = tree.leaves_of(*box[ok].T)
            slot = (_hash(b.column("oid").to_numpy()[ok[bi]]) % t_slots[leaf].astype(np.uint64)).astype(np.int64)
            at, leaf2, i = _expand(np.arange(len(bi)), leaf, p_slots)
            yield _routed(_cells(leaf2, i, slot[at]), 2, ok[bi[at]], oid=b.column("oid"), rings=rings)

    def probe(tbl: pa.Table) -> pa.Table:
        side = tbl.column("side").to_numpy()
        x, y = tbl.column("x").to_numpy(), tbl.column("y").to_numpy()
        pts = np.flatnonzero(side == 0)
        out = []
        if len(pts):
            key = pd.DataFrame({"i": tbl.column("pid").take(pa.array(pts)).to_pandas(), "x": x[pts], "y": y[pts]})
            pts = pts[~key.duplicated().to_numpy()]
            px, py = x[pts], y[pts]
            oid = tbl.column("oid").to_numpy()
            if len(tgt := np.flatnonzero(side == 1)):
                key = pd.DataFrame({"i": oid[tgt], "x": x[tgt], "y": y[tgt]})
                tgt = tgt[~key.duplicated().to_numpy()]
                tx, ty = x[tgt], y[tgt]
                tree_ = PackedRTree(tx, ty, tx, ty)
                r = radius * (1 + 1e-9)
                q, k = tree_.search(px - r, py - r, px + r, py + r)
                near = (px[q] - tx[k]) ** 2 + (py[q] - ty[k]) ** 2 <= radius * radius + 1e-7  # a distance of exactly the radius counts, whatever the last bit
                out.append(("node", pts[q[near]], oid[tgt[k[near]]]))
            if len(reg := np.flatnonzero(side == 2)):
                shapes = [_rings(v) for v in tbl.column("rings").take(pa.array(reg)).to_pylist()]
                box = np.array([[s[0][0].min(), s[0][1].min(), s[0][0].max(), s[0][1].max()] for s in shapes]).T
                q, k = PackedRTree(*box).search(px, py, px, py)
                by = np.argsort(k, kind="stable")
                q, k = q[by], k[by]
                cut = np.searchsorted(k, np.arange(len(reg) + 1))
                for z_ in range(len(reg)):
                    c = q[cut[z_] : cut[z_ + 1]]
                    if not len(c):
                        continue
                    held = in_ring(px[c], py[c], *shapes[z_][0])
                    for hole in shapes[z_][1:]:
                        held &= ~in_ring(px[c], py[c], *hole)
                    out.append(("zone", pts[c[held]], np.full(int(held.sum()), oid[reg[z_]])))
        if not out:
            return pa.table({"place_id": pa.array([], pa.string()), "near_kind": pa.array([], pa.string()), "near_id": pa.array([], pa.int64())})
        rows = np.concatenate([a for _, a, _ in out])
        kinds = pa.chunked_array([pa.array([k]).take(pa.array(np.zeros(len(a), np.int64))) for k, a, _ in out])
        return pa.table({"place_id": tbl.column("pid").take(pa.array(rows)), "near_kind": kinds, "near_id": pa.array(np.concatenate([v for _, _, v in out]).astype(np.int64))})

    routed = p.mapInArrow(route_points, ROUTED).unionAll(t.mapInArrow(route_targets, ROUTED)).unionAll(z.mapInArrow(route_zones, ROUTED))
    # An id may stand at several places in general, so the same pair can come from two leaves: rows are made distinct at the end.
    return routed.groupBy("cell").applyInArrow(probe, FOUND).distinct()


def _box(rings):
    x = [v["x"] for v in (rings[0] or []) if v and v["x"] is not None and v["y"] is not None and v["x"] == v["x"] and v["y"] == v["y"]]
    if len(x) < 3:
        return [np.nan] * 4
    y = [v["y"] for v in rings[0] if v and v["x"] is not None and v["y"] is not None and v["x"] == v["x"] and v["y"] == v["y"]]
    return [min(x), min(y), max(x), max(y)]


def _rings(rings):
    out = []
    for ring in rings:
        xy = np.array([(v["x"], v["y"]) for v in (ring or []) if v and v["x"] is not None and v["y"] is not None and v["x"] == v["x"] and v["y"] == v["y"]], float).reshape(-1, 2)
        out.append((xy[:, 0], xy[:, 1]))
    return out


_RINGS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


def _routed(cell, side, idx, pid=None, oid=None, x=None, y=None, rings=None) -> pa.RecordBatch:
    n, at = len(idx), pa.array(np.asarray(idx, np.int64))
    null = lambda t: pa.nulls(n, t)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(cell, pa.int64()),
            pa.array(np.full(n, side, np.int8)),
            pid.take(at).cast(pa.string()) if pid is not None else null(pa.string()),
            oid.take(at) if oid is not None else null(pa.int64()),
            pa.array(x[idx]) if x is not None else null(pa.float64()),
            pa.array(y[idx]) if y is not None else null(pa.float64()),
            rings.take(at).cast(_RINGS) if rings is not None else null(_RINGS),
        ],
        names=["cell", "side", "pid", "oid", "x", "y", "rings"],
    )
