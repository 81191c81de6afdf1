"""Edit scripts between nested schemas.

A schema is a tree: inner nodes are keys of objects, leaves are fields with a type. `edit_script` gives the cheapest
script of add, delete, rename, move and retype. Which fields carry on which is decided by the tree edit distance (Zhang and
Shasha's recurrence) with the evidence, the share of records whose value carries over, in its costs. Keys of an object have no
order; the new tree's are put in that of the fields they carry on, so that most renames hold in one mapping. What a mapping
that keeps order and ancestors cannot hold, fields that cross, is added by augmenting it along the cheapest paths.
"""

from __future__ import annotations

ADD = DELETE = 1.0
FORBIDDEN = 1e6


class _Node:
    __slots__ = ("label", "kids", "path", "kind", "at")

    def __init__(self, label, path, kind=None, at=""):
        self.label, self.path, self.kind, self.at, self.kids = label, path, kind, at, {}


def tree(fields: dict[str, str], place: dict[str, str] | None = None) -> _Node:
    """fields: path of keys joined by dots -> type. place: path -> what it is ordered by, else the path; an object by its first field."""
    root = _Node("", "")
    at_of = {p: (place or {}).get(p, p) for p in fields}
    for path in sorted(fields, key=lambda p: (at_of[p], p)):
        at = root
        keys = path.split(".")
        for i, k in enumerate(keys):
            leaf = i == len(keys) - 1
            name = (k, leaf)  # a key may be a field and an object at once in different records
            at = at.kids.setdefault(name, _Node(k, ".".join(keys[: i + 1]), fields[path] if leaf else None, at_of[path]))
    return root


def _postorder(root):
    nodes, leftmost = [], []

    def walk(n):
        first = None
        for kid in sorted(n.kids.values(), key=lambda k: (k.at, k.path)):
            i = walk(kid)
            first = i if first is None else first
        nodes.append(n)
        leftmost.append(len(nodes) - 1 if first is None else first)
        return leftmost[-1]

    walk(root)
    keyroots = sorted({lm: i for i, lm in enumerate(leftmost)}.values())
    return nodes, leftmost, keyroots


def carry_cost(a: str, b: str, share: float, retyped: bool) -> float:
    """Of a script step that carries the field a on as b: less than removing and adding, the less the more records agree, and the more of the place is kept."""
    (pa, _, la), (pb, _, lb) = a.rpartition("."), b.rpartition(".")
    return 0.2 + 2.0 * (1.0 - share) + 0.05 * (la != lb) + 0.04 * (pa != pb) + 0.01 * retyped


def _cost(a, b, share):
    """Of mapping node a of the old tree to node b of the new one."""
    if (a.kind is None) != (b.kind is None):
        return FORBIDDEN
    if a.kind is None:
        return 0.0 if a.label == b.label else 0.3
    if a.path == b.path:
        return 0.0 if a.kind == b.kind else 0.1
    s = share.get((a.path, b.path), 0.0)
    return FORBIDDEN if not s else carry_cost(a.path, b.path, s, a.kind != b.kind)


def mapping(old: _Node, new: _Node, share: dict[tuple[str, str], float]) -> list[tuple[_Node, _Node]]:
    """The node pairs of a cheapest order- and ancestor-preserving mapping."""
    na, la, ka = _postorder(old)
    nb, lb, kb = _postorder(new)
    dist = [[0.0] * len(nb) for _ in na]

    def forest(i, j):
        ai, bj = la[i], lb[j]
        f = [[0.0] * (j - bj + 2) for _ in range(i - ai + 2)]
        for x in range(1, i - ai + 2):
            f[x][0] = f[x - 1][0] + DELETE
        for y in range(1, j - bj + 2):
            f[0][y] = f[0][y - 1] + ADD
        for x in range(1, i - ai + 2):
            for y in range(1, j - bj + 2):
                p, q = ai + x - 1, bj + y - 1
                both = f[x - 1][y - 1] + _cost(na[p], nb[q], share) if la[p] == ai and lb[q] == bj else f[la[p] - ai][lb[q] - bj] + dist[p][q]
                f[x][y] = min(f[x - 1][y] + DELETE, f[x][y - 1] + ADD, both)
                if la[p] == ai and lb[q] == bj:
                    dist[p][q] = f[x][y]
        return f

    for i in ka:
        for j in kb:
            forest(i, j)
    pairs, todo = [], [(len(na) - 1, len(nb) - 1)]
    while todo:
        i, j = todo.pop()
        f = forest(i, j)
        ai, bj = la[i], lb[j]
        x, y = i - ai + 1, j - bj + 1
        while x and y:
            p, q = ai + x - 1, bj + y - 1
            if abs(f[x][y] - f[x - 1][y] - DELETE) < 1e-9:
                x -= 1
            elif abs(f[x][y] - f[x][y - 1] - ADD) < 1e-9:
                y -= 1
            elif la[p] == ai and lb[q] == bj:
                pairs.append((na[p], nb[q]))
                x, y = x - 1, y - 1
            else:
                todo.append((p, q))
                x, y = la[p] - ai, lb[q] - bj
    return pairs


def _augmented(held: dict[str, str], cost: dict[tuple[str, str], float]) -> dict[str, str]:
    """The matching held (old -> new) grown to as many pairs as there can be, each time along the cheapest alternating path."""
    old_of = {b: a for a, b in held.items()}
    for start in sorted({a for a, _ in cost} - held.keys()):
        best, way = {start: 0.0}, {}
        for _ in range(len({a for a, _ in cost}) + 1):  # Bellman and Ford over the old fields
            moved = False
            for (a, b), c in sorted(cost.items()):
                if a not in best or held.get(a) == b:
                    continue
                nxt = old_of.get(b)
                d = best[a] + c - (cost[nxt, b] if nxt else 0.0)
                key = nxt if nxt else ("end", b)
                if d < best.get(key, FORBIDDEN) - 1e-12:
                    best[key], way[key], moved = d, (a, b), True
            if not moved:
                break
        ends = sorted((d, k[1]) for k, d in best.items() if isinstance(k, tuple))
        if not ends:
            continue
        a, b = way["end", ends[0][1]]
        while True:
            held[a], old_of[b] = b, a
            if a == start:
                break
            a, b = way[a]
    return held


def edit_script(old: dict[str, str], new: dict[str, str], share: dict[tuple[str, str], float]) -> list[tuple[str, str, str]]:
    """(kind, old path, new path) with kind in added, removed, renamed, moved, retyped.

    share: evidence for (old path, new path), only pairs that may be one field. A renamed or moved field whose type
    differs has a retyped row too. Each path takes part in at most one rename or move. The script is the one of least cost
    (`carry_cost`): the tree mapping's pairs, then as many more as fields that cross allow.
    """
    gone, fresh = old.keys() - new.keys(), new.keys() - old.keys()
    may = {k: v for k, v in share.items() if k[0] in gone and k[1] in fresh}
    parent = lambda p: p.rpartition(".")[0]
    pairs: dict[str, str] = {}
    if may:
        cost = {(a, b): carry_cost(a, b, v, old[a] != new[b]) for (a, b), v in may.items()}
        place = {b: min((cost[k], k[0]) for k in may if k[1] == b)[1] for b in {k[1] for k in may}}
        pairs = {a.path: b.path for a, b in mapping(tree(old), tree(new, place), may) if a.kind and (a.path, b.path) in may}
        pairs = _augmented(pairs, cost)
    out = []
    for a, b in sorted(pairs.items()):
        out.append(("renamed" if parent(a) == parent(b) else "moved", a, b))
        if old[a] != new[b]:
            out.append(("retyped", a, b))
    out += [("removed", a, a) for a in sorted(gone - pairs.keys())] + [("added", b, b) for b in sorted(fresh - set(pairs.values()))]
    out += [("retyped", p, p) for p in sorted(old.keys() & new.keys()) if old[p] != new[p]]
    return out
