"""Tries of words, many shards at once, and their join under Levenshtein automata.

A trie is held level by level as numpy arrays. Two tries are traversed together: a state is a pair of nodes of one depth with
a state of the Levenshtein automaton, the five distances between their prefixes that later ones are made of. So the work for a
prefix is done once for all words that begin with it, on either side. States without a distance within the bound are dropped.
"""

from __future__ import annotations

import numpy as np

EDITS = 2  # the largest bound
STATES = 1 << 20  # states that are advanced at once; more are cut into parts
_FAR = EDITS + 1


def allowed(w: str) -> int:
    """Edits between a word and a spelling of it."""
    return 0 if len(w) < 4 else 1 if len(w) < 5 else 2


class Forest:
    """The tries of all shards. items: (shard, word), sorted and distinct. Behind its end a word goes on with EDITS blank letters, so that words of other lengths still meet it."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = items
        n = len(items)
        self.length = np.array([len(w) for _, w in items], np.int32)
        self.own = bound = np.array([allowed(w) for _, w in items], np.int8)
        size = self.length + 1 + EDITS
        width = int(size.max()) if n else 1
        code = np.zeros((n, width), np.int32)
        letters = np.frombuffer("".join(w for _, w in items).encode("utf-32-le"), np.int32)
        ends = np.cumsum(self.length)
        code[:, 0] = [g for g, _ in items]
        code[np.repeat(np.arange(n), self.length), np.arange(len(letters)) - np.repeat(ends - self.length, self.length) + 1] = letters
        # A word opens nodes from the depth on to which it shares its letters with the word before.
        shared = np.zeros(n, int)
        if n > 1:
            shared[1:] = np.cumprod(code[1:] == code[:-1], axis=1).sum(1)
        self.child_from, self.child_to, self.char, self.word, self.first, self.last = [], [], [], [], [], []
        self.shortest, self.longest, self.bound, self.letters = [], [], [], []
        of, nodes = np.zeros(n, int), 1
        for t in range(width):
            opens = (size > t) & (shared <= t)
            if n:
                opens[0] = size[0] > t
            first = np.flatnonzero(opens)
            parent = of[first]
            self.child_from.append(np.searchsorted(parent, np.arange(nodes), "left"))
            self.child_to.append(np.searchsorted(parent, np.arange(nodes), "right"))
            self.char.append(code[first, t])
            self.word.append(np.where(self.length[first] <= t, first, -1))
            self.first.append(first)
            # Words between two openings that are too short for this depth stand before the next opening; they end the run.
            alive = size > t
            run = np.cumsum(opens) - 1
            self.last.append(first + np.bincount(run[alive], minlength=len(first)) if len(first) else first)
            big = np.where(alive, self.length, 1 << 20)
            small = np.where(alive, self.length, 0)
            at = lambda f, v: f.reduceat(v, first) if len(first) else v[:0]  # noqa: B023, E731
            self.shortest.append(at(np.minimum, big))
            self.longest.append(at(np.maximum, small))
            self.bound.append(at(np.maximum, np.where(alive, bound, 0)))
            back = lambda k: code[first, t - k] if t > k else np.full(len(first), -1 - k, np.int32)  # noqa: B023, E731
            self.letters.append((code[first, t], back(1), back(2)))
            of, nodes = run, len(first)
        self.depth = width


def _border(f, p, same, same1):
    """The border one letter on, of tuples: f: D[t][t-2], D[t][t-1], D[t][t], D[t-1][t], D[t-2][t]; p: D[t-1][t-2], D[t-1][t-1], D[t-2][t-1].

    same: whether the new letters a, b equal each other and those before: a = b2, a = b1, a = b, a1 = b, a2 = b; same1: a1 = b1.
    """
    g0 = min(f[1] + 1, f[0] + (not same[0]))
    g4 = min(f[3] + 1, f[4] + (not same[4]))
    g1 = min(f[2] + 1, g0 + 1, f[1] + (not same[1]), p[0] + 1 if same[0] and same1 else _FAR)  # a swap of neighbours is one edit
    g3 = min(f[2] + 1, g4 + 1, f[3] + (not same[3]), p[2] + 1 if same[4] and same1 else _FAR)
    g2 = min(g1 + 1, g3 + 1, f[2] + (not same[2]), p[1] + 1 if same[1] and same[3] else _FAR)
    return tuple(min(x, _FAR) for x in (g0, g1, g2, g3, g4))


class Automaton:
    """The Levenshtein automaton for all words: a state is a border with what the next one needs of the letters before; it goes on by which of the last letters are equal."""

    def __init__(self):
        start = ((_FAR, _FAR, 0, _FAR, _FAR), (_FAR,) * 3, False)
        at, todo, step = {start: 0}, [start], []
        for f, p, same1 in todo:
            row = []
            for bits in range(32):
                same = [bool(bits >> i & 1) for i in range(5)]
                to = (_border(f, p, same, same1), (f[1], f[2], f[3]), same[2])
                if min(to[0]) == _FAR:
                    to = ((_FAR,) * 5, (_FAR,) * 3, False)
                if to not in at:
                    at[to] = len(at)
                    todo.append(to)
                row.append(at[to])
            step.append(row)
        self.step = np.array(step, np.int16).ravel()
        self.border = np.array([f for f, _, _ in todo], np.int8)
        self.least = self.border.min(1)


AUTOMATON = Automaton()


def _spread(first, n):
    """Indices (row, value) of ranges that start at first and have n values."""
    at = np.repeat(np.arange(len(n), dtype=np.int32), n)
    ends = np.cumsum(n)
    return at, (np.arange(len(at)) + np.repeat(first - ends + n, n)).astype(np.int32)


def _walk(left: Forest, right: Forest, live, found, alone: bool) -> None:
    """Advances all pairs of nodes. live(t, u, v, least, bound) keeps states, found(t, u, v, state) takes results."""
    if not left.items or not right.items:
        return
    _, u, v = np.intersect1d(left.char[0], right.char[0], return_indices=True)
    stack = [(0, u, v, np.zeros(len(u), np.int16))]
    auto = AUTOMATON
    while stack:
        t, u, v, s = stack.pop()
        if not len(u) or t + 1 >= min(left.depth, right.depth):
            continue
        u0, v0 = left.child_from[t + 1][u], right.child_from[t + 1][v]
        nu, nv = left.child_to[t + 1][u] - u0, right.child_to[t + 1][v] - v0
        n = nu * nv
        if len(u) > 1 and n.sum() > STATES:
            h = max(1, min(len(u) - 1, int(np.searchsorted(np.cumsum(n), STATES))))
            stack += [(t, u[h:], v[h:], s[h:]), (t, u[:h], v[:h], s[:h])]
            continue
        at, cu = _spread(u0, nu)
        at2, cv = _spread(v0[at], nv[at])
        at, cu = at[at2], cu[at2]
        t += 1
        if alone:
            once = cu <= cv
            at, cu, cv = at[once], cu[once], cv[once]
        # Lengths are looked at before the letters.
        b = np.minimum(left.bound[t][cu], right.bound[t][cv])
        fit = live(t, cu, cv, None, b)
        at, cu, cv, b = at[fit], cu[fit], cv[fit], b[fit]
        (a, a1, a2), (c, c1, c2) = (x[cu] for x in left.letters[t]), (x[cv] for x in right.letters[t])
        bits = (a == c2) | (a == c1) << 1 | (a == c) << 2 | (a1 == c) << 3 | (a2 == c) << 4
        s = auto.step[s[at].astype(np.int32) * 32 + bits]
        keep = live(t, cu, cv, auto.least[s], b)
        cu, cv, s = cu[keep], cv[keep], s[keep]
        found(t, cu, cv, s)
        # Words that both have ended meet nothing more.
        on = (left.longest[t][cu] >= t) | (right.longest[t][cv] >= t)
        stack.append((t, cu[on], cv[on], s[on]))


def _half_near(left: Forest, right: Forest, backward: bool, alone: bool):
    out: list = []

    def live(t, u, v, least, b):
        if least is None:
            far = np.maximum(left.shortest[t][u] - right.longest[t][v], right.shortest[t][v] - left.longest[t][u])
            return far <= b
        short = np.minimum(left.shortest[t][u], right.shortest[t][v])
        early = t <= (short - short // 2 - 1 if backward else short // 2)
        return least <= np.where(early, 0 if backward else b // 2, b)

    def found(t, u, v, s):
        x, y = left.word[t][u], right.word[t][v]
        ok = np.flatnonzero((x >= 0) & (y >= 0))
        if not len(ok):
            return
        x, y = x[ok], y[ok]
        lx, ly = left.length[x], right.length[y]
        now = (np.maximum(lx, ly) == t) & (abs(lx - ly) <= EDITS)
        x, y, lx, ly, ok = x[now], y[now], lx[now], ly[now], ok[now]
        d = AUTOMATON.border[s[ok], 2 - (lx - ly)]
        most = np.array([0, 0, 0, 0, 1, EDITS], np.int8)[np.minimum(np.minimum(lx, ly), 5)]
        near = d <= most
        out.append((x[near], y[near], d[near]))

    _walk(left, right, live, found, alone)
    return [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3)]


def near_words(left: list[tuple[int, str]], right: list[tuple[int, str]] | None = None):
    """Pairs (shard, x, y, edits) of one shard whose words are within the edits `allowed` for the shorter; a swap is one edit.

    left, right: (shard, word). Without right left is joined with itself, each pair of different words once. Of at most b
    edits the first half of the shorter word takes b // 2 or fewer, or else the last half takes none; so the tries are traversed
    forwards with no more than these in the first half, and backwards with none in the last.
    """
    alone = right is None
    items = [sorted(set(s)) for s in ([left] if alone else [left, right])]
    seen: dict[tuple[int, str, str], int] = {}
    for backward in (False, True):
        f = [Forest(sorted((g, w[::-1]) for g, w in s) if backward else s) for s in items]
        one, two = f[0], f[-1]
        for i, j, d in zip(*(c.tolist() for c in _half_near(one, two, backward, alone))):
            (g, x), (_, y) = one.items[i], two.items[j]
            if backward:
                x, y = x[::-1], y[::-1]
            if x != y:
                seen[(g, min(x, y), max(x, y)) if alone else (g, x, y)] = d
    return [(*k, d) for k, d in seen.items()]


def run_together(parts: list[tuple[int, str]], wholes: list[tuple[int, str]], rest: int = 4):
    """(heads, tails), each (shard, whole, cut, part, edits): a part of at least `rest` letters is within its allowed edits of whole[:cut] (heads) or whole[cut:] (tails), and as many letters are left."""
    parts = sorted(set(p for p in parts if len(p[1]) >= rest))
    wholes = sorted(set(w for w in wholes if len(w[1]) >= 2 * rest))
    result = []
    for backward in (False, True):
        left = Forest(sorted((g, w[::-1]) for g, w in parts) if backward else parts)
        right = Forest(sorted((g, w[::-1]) for g, w in wholes) if backward else wholes)
        rows: list = []

        def live(t, u, v, least, b):
            if least is None:
                return (left.shortest[t][u] - EDITS <= right.longest[t][v] - rest) & (t <= left.longest[t][u] + EDITS)  # noqa: B023
            return least <= left.bound[t][u]  # noqa: B023

        def found(t, u, v, s):
            x = left.word[t][u]  # noqa: B023
            ok = np.flatnonzero(x >= 0)
            x, v, g = x[ok], v[ok], AUTOMATON.border[s[ok]].T
            n, most = left.length[x], left.own[x]  # noqa: B023
            # The part ends here and the whole's beginning up to two letters before, or the part ended before.
            for o, cut, when in ((0, t - 2, n == t), (1, t - 1, n == t), (2, t, n == t), (3, t, n == t - 1), (4, t, n == t - 2)):
                hit = np.flatnonzero(when & (g[o] <= most))
                if cut < rest or not len(hit):
                    continue
                a, b = right.first[t][v[hit]], right.last[t][v[hit]]  # noqa: B023
                rep = np.repeat(np.arange(len(hit)), b - a)
                w = a[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
                far = right.length[w] >= cut + rest  # noqa: B023
                rows.append((w[far], np.full(int(far.sum()), cut), x[hit][rep][far], g[o][hit][rep][far]))  # noqa: B023

        _walk(left, right, live, found, False)
        out = []
        for w, c, x, d in (z for r in rows for z in zip(*(k.tolist() for k in r))):
            (g, whole), part = right.items[w], left.items[x][1]
            out.append((g, whole[::-1], len(whole) - c, part[::-1], d) if backward else (g, whole, c, part, d))
        result.append(out)
    return tuple(result)
