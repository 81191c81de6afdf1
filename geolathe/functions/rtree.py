"""A packed R-tree over axis-aligned boxes in numpy, bulk-loaded by sort-tile-recursive order and probed level by level."""

from __future__ import annotations

import numpy as np

FANOUT = 16


class PackedRTree:
    """Boxes as four arrays. `search` returns index pairs (query, box) of all closed overlaps."""

    def __init__(self, x0, y0, x1, y1):
        n = len(x0)
        order = np.arange(n)
        if n > FANOUT:
            slices = int(np.ceil(np.sqrt(np.ceil(n / FANOUT))))
            per = FANOUT * int(np.ceil(n / FANOUT / slices))
            by_x = np.argsort(x0 + x1, kind="stable")
            rank = np.empty(n, np.int64)
            rank[by_x] = np.arange(n)
            order = np.lexsort((y0 + y1, rank // per))
        self.items = order
        box = np.stack([x0, y0, x1, y1])[:, order] if n else np.zeros((4, 0))
        self.levels = [box]
        while box.shape[1] > FANOUT:
            at = np.arange(0, box.shape[1], FANOUT)
            box = np.stack([np.minimum.reduceat(box[0], at), np.minimum.reduceat(box[1], at), np.maximum.reduceat(box[2], at), np.maximum.reduceat(box[3], at)])
            self.levels.append(box)

    def search(self, x0, y0, x1, y1, chunk: int = 4096):
        out_q, out_b = [], []
        if not len(self.items):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        for lo in range(0, len(x0), chunk):
            q = np.arange(lo, min(lo + chunk, len(x0)))
            top = self.levels[-1].shape[1]
            qi, bi = np.repeat(q, top), np.tile(np.arange(top), len(q))
            for k in range(len(self.levels) - 1, -1, -1):
                b = self.levels[k]
                hit = (b[0, bi] <= x1[qi]) & (b[2, bi] >= x0[qi]) & (b[1, bi] <= y1[qi]) & (b[3, bi] >= y0[qi])
                qi, bi = qi[hit], bi[hit]
                if k:
                    n = self.levels[k - 1].shape[1]
                    bi = (bi[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    qi = np.repeat(qi, FANOUT)
                    ok = bi < n
                    qi, bi = qi[ok], bi[ok]
            out_q.append(qi)
            out_b.append(self.items[bi])
        return np.concatenate(out_q), np.concatenate(out_b)


def in_ring(px, py, rx, ry, limit: int = 2_000_000):
    """Even-odd test of points against one ring; an open ring counts as closed, a point on an edge goes with the half-open rule."""
    inside = np.zeros(len(px), bool)
    if len(rx) < 3:
        return inside
    ax, ay, bx, by = rx, ry, np.roll(rx, -1), np.roll(ry, -1)
    keep = ay != by
    ax, ay, bx, by = ax[keep], ay[keep], bx[keep], by[keep]
    step = max(1, limit // max(1, len(ax)))
    for lo in range(0, len(px), step):
        x, y = px[lo : lo + step, None], py[lo : lo + step, None]
        spans = (ay > y) != (by > y)
        left = x < (bx - ax) * (y - ay) / (by - ay) + ax
        inside[lo : lo + step] = (spans & left).sum(1) % 2 == 1
    return inside
