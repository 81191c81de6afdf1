"""Near and inside: against brute force, hot spots, dirty rows and empty tables."""

import math

import numpy as np
import pytest

from geolathe.functions.quadtree import QuadTree
from geolathe.functions.rtree import PackedRTree, in_ring
from geolathe.operators.nearby import near_or_inside

P = "id string, geometry struct<x:double,y:double>, site string, osmid string"
N = "osmid bigint, x double, y double, cell string, side int"
Z = "zone_id bigint, geom array<array<struct<x:double,y:double>>>, x string"


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def frames(spark, p, n, z):
    return (
        spark.createDataFrame([(i, g, "s", "clash") for i, g in p], P),
        spark.createDataFrame([(i, x, y, "clash", 9) for i, x, y in n], N),
        spark.createDataFrame([(i, g, "clash") for i, g in z], Z),
    )


def brute(p, n, z, r=25.0):
    out = set()
    for i, g in p:
        if i is None or g is None or g[0] is None or g[1] is None or not all(map(math.isfinite, g)) or g == (0.0, 0.0):
            continue
        for o, x, y in n:
            if o is not None and x is not None and y is not None and math.hypot(g[0] - x, g[1] - y) <= r + 1e-9:
                out.add((i, "node", o))
        for zi, rings in z:
            if rings:
                hit = [in_ring(np.array([g[0]]), np.array([g[1]]), *np.array(q, float).reshape(-1, 2).T)[0] for q in rings]
                if hit[0] and not any(hit[1:]):
                    out.add((i, "zone", zi))
    return sorted(out, key=repr)


@pytest.mark.parametrize("per_cell", [30, 10_000])
def test_equals_brute_force(spark, rows, per_cell):
    rng = np.random.default_rng(1)
    p = [(f"p{i}", tuple(map(float, xy))) for i, xy in enumerate(rng.uniform(0, 900, (300, 2)))]
    n = [(i, *map(float, xy)) for i, xy in enumerate(rng.uniform(0, 900, (400, 2)))]
    z = [(i, [square(*map(float, xy), float(s))]) for i, (xy, s) in enumerate(zip(rng.uniform(0, 900, (40, 2)), rng.uniform(1, 500, 40)))]
    z.append((99, [[*square(100.0, 100.0, 400.0), (100.0, 100.0)], square(200.0, 200.0, 100.0)[::-1]]))
    got = rows(near_or_inside(*frames(spark, p, n, z), rows_per_cell=per_cell))
    assert got == brute(p, n, z)


def test_one_place_with_a_third_of_all_rows(spark, rows):
    p = [(f"p{i}", (500.0, 500.0)) for i in range(300)] + [(f"q{i}", (float(i), 10.0)) for i in range(300)]
    n = [(i, 501.0, 500.0) for i in range(60)] + [(1000 + i, float(i), 12.0) for i in range(50)]
    got = rows(near_or_inside(*frames(spark, p, n, []), rows_per_cell=20))
    assert got == brute(p, n, [])


def test_dirty_rows(spark, rows):
    nan, inf = float("nan"), float("inf")
    p = [("a", (10.0, 10.0)), ("a", (10.0, 10.0)), ("b", None), ("c", (nan, 1.0)), ("d", (0.0, 0.0)), ("e", (inf, 1.0)), (None, (10.0, 10.0)), ("f", (None, 3.0)), ("g", (35.0, 10.0))]
    n = [(1, 10.0, 10.0), (1, 10.0, 10.0), (2, None, None), (3, 25.0, 30.0), (None, 10.0, 10.0)]
    z = [(1, [square(0.0, 0.0, 20.0)]), (1, [square(0.0, 0.0, 20.0)]), (2, None), (3, []), (4, [[]]), (5, [[(0.0, 0.0), (1.0, 1.0)]])]
    # g and node 1 are exactly 25 m apart; a and node 3 too (15, 20).
    assert rows(near_or_inside(*frames(spark, p, n, z))) == [("a", "node", 1), ("a", "node", 3), ("a", "zone", 1), ("g", "node", 1), ("g", "node", 3)]


def test_empty_tables(spark, rows):
    assert rows(near_or_inside(*frames(spark, [], [], []))) == []
    assert rows(near_or_inside(*frames(spark, [("a", (1.0, 1.0))], [], []))) == []
    assert rows(near_or_inside(*frames(spark, [], [(1, 1.0, 1.0)], [(1, [square(0.0, 0.0, 5.0)])]))) == []


def test_rtree_finds_all_overlaps():
    rng = np.random.default_rng(2)
    for n in (0, 1, 16, 17, 500):
        a, w = rng.uniform(0, 100, (n, 2)), rng.uniform(0, 8, (n, 2))
        q = rng.uniform(0, 100, (40, 2))
        qi, bi = PackedRTree(a[:, 0], a[:, 1], a[:, 0] + w[:, 0], a[:, 1] + w[:, 1]).search(q[:, 0] - 3, q[:, 1] - 3, q[:, 0] + 3, q[:, 1] + 3, chunk=7)
        want = {(i, j) for i in range(40) for j in range(n) if (a[j] <= q[i] + 3).all() and (a[j] + w[j] >= q[i] - 3).all()}
        assert set(zip(qi.tolist(), bi.tolist())) == want and len(qi) == len(want)


def test_quadtree_leaves_cover_boxes():
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.uniform(0, 1000, (300, 2)), rng.normal(200, 3, (300, 2))])
    t = QuadTree((xy[:, 0].min(), xy[:, 1].min(), xy[:, 0].max(), xy[:, 1].max()), xy, np.ones(600), 20, 1.0)
    leaf = t.leaf_of(xy[:, 0], xy[:, 1])
    b, l = t.leaves_of(xy[:, 0] - 5, xy[:, 1] - 5, xy[:, 0] + 5, xy[:, 1] + 5)
    pairs = set(zip(b.tolist(), l.tolist()))
    assert len(pairs) == len(b)
    for i in range(0, 600, 7):
        near = np.flatnonzero((np.abs(xy - xy[i]) <= 5).all(1))
        assert all((i, leaf[j]) in pairs for j in near)


def test_many_zones_over_one_spot_are_split(spark, rows):
    """Zones that all cover one place weigh on its cell, so they are spread over slots; each pair still comes once."""
    p = [(f"p{i}", (50.0 + i % 3, 50.0)) for i in range(40)]
    z = [(i, [square(50.0 - 1 - i % 7, 45.0, 10.0)]) for i in range(90)]
    n = [(1, 51.0, 50.0), (2, float("inf"), 50.0)]
    got = rows(near_or_inside(*frames(spark, p, n, z), rows_per_cell=10))
    want = sorted([(a, "zone", i) for a, (x, y) in p for i in range(90) if 49.0 - i % 7 <= x < 59.0 - i % 7] + [(a, "node", 1) for a, _ in p], key=repr)
    assert got == want
