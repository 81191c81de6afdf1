"""A quadtree fitted on a sample; its leaves are the cells of a spatial shuffle."""

from __future__ import annotations

import numpy as np

DEPTH = 20  # levels of the Morton code


def _spread(v):
    v = v.astype(np.uint64)
    for s, m in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(s))) & np.uint64(m)
    return v


class QuadTree:
    """Leaves in Z-order. `cost` is the estimated number of rows per sampled row; a node splits while its cost is above
    `capacity`, it holds `least` sampled rows and its side stays above `min_side`."""

    def __init__(self, bounds, xy, weight, capacity, min_side, least=8, max_leaves=16384):
        x0, y0, x1, y1 = bounds
        self.x0, self.y0 = x0, y0
        self.side = max(x1 - x0, y1 - y0, 1e-9) * (1 + 1e-9)
        code = self.morton(xy[:, 0], xy[:, 1]) if len(xy) else np.zeros(0, np.uint64)
        order = np.argsort(code)
        code, cum = code[order], np.concatenate([[0.0], np.cumsum(np.asarray(weight)[order])])
        leaves = []
        stack = [(0, 0)]  # (first code, level)
        splits = 0
        while stack:
            first, level = stack.pop()
            span = 1 << (2 * (DEPTH - level))
            a, b = np.searchsorted(code, [first, first + span])
            room = len(leaves) + len(stack) + 4 <= max_leaves
            if level < DEPTH and room and b - a >= least and cum[b] - cum[a] > capacity and self.side / (1 << (level + 1)) >= min_side:
                q = span // 4
                stack += [(first + k * q, level + 1) for k in (3, 2, 1, 0)]
                splits += 1
            else:
                leaves.append((first, level, a, b))
        self.first = np.array([v[0] for v in leaves], np.uint64)
        self.level = np.array([v[1] for v in leaves], np.int64)
        self.sampled = [(v[2], v[3]) for v in leaves]
        self.order = order

    def grid(self, v, origin):
        n = 1 << DEPTH
        return np.clip(np.floor((v - origin) / self.side * n), 0, n - 1).astype(np.int64)

    def morton(self, x, y):
        return _spread(self.grid(x, self.x0)) | (_spread(self.grid(y, self.y0)) << np.uint64(1))

    def leaf_of(self, x, y):
        return np.searchsorted(self.first, self.morton(x, y), side="right") - 1

    def leaves_of(self, x0, y0, x1, y1):
        """Index pairs (box, leaf) of all leaves a box meets, by descent of the implicit tree."""
        gx0, gx1 = self.grid(x0, self.x0), self.grid(x1, self.x0)
        gy0, gy1 = self.grid(y0, self.y0), self.grid(y1, self.y0)
        box, fx, fy = np.arange(len(gx0)), np.zeros(len(gx0), np.int64), np.zeros(len(gx0), np.int64)
        out_b, out_l = [], []
        for level in range(DEPTH + 1):
            if not len(box):
                break
            code = _spread(fx) | (_spread(fy) << np.uint64(1))
            leaf = np.searchsorted(self.first, code, side="right") - 1
            done = self.level[leaf] == level
            out_b.append(box[done])
            out_l.append(leaf[done])
            box, fx, fy = box[~done], fx[~done], fy[~done]
            half = 1 << max(DEPTH - level - 1, 0)
            box = np.repeat(box, 4)
            fx = (fx[:, None] + np.array([0, half, 0, half])).ravel()
            fy = (fy[:, None] + np.array([0, 0, half, half])).ravel()
            ok = (fx <= gx1[box]) & (fx + half - 1 >= gx0[box]) & (fy <= gy1[box]) & (fy + half - 1 >= gy0[box])
            box, fx, fy = box[ok], fx[ok], fy[ok]
        return np.concatenate(out_b) if out_b else box, np.concatenate(out_l) if out_l else box
