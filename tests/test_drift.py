"""Schema drift: edit scripts, the rules of presence and renaming, dirty lines and the unified table."""

import datetime as dt
import itertools
import json
import random

from geolathe.functions import treedit
from geolathe.functions.treedit import carry_cost, edit_script
from geolathe.operators.drift import changes, flatten, unified, written

S = "file_name string, feed string, release string, line_no int, payload string, ingested_at timestamp, path string, kind string"
T0 = dt.datetime(2026, 1, 1)


def lines(feed, release, records):
    return [(f"{feed}/{release}", feed, release, i, json.dumps(r) if isinstance(r, dict) else r, T0, "clash", "clash") for i, r in enumerate(records)]


def test_values_have_one_written_form():
    assert written([" a", "b"]) == written("a > b") == written("a>b ")
    assert written("0.50") == written(0.5) and written("7") == written(7) != written("7a")
    assert written(True) == written("TRUE") and written("x") == written(["x"])
    assert dict(flatten({"a": {"b": 1, "c": None}, "d": [1]})) == {"a.b": 1, "d": [1]}


def test_scripts_are_cheapest():
    old = {"lat": "number", "lon": "number", "name": "string", "cat": "string"}
    new = {"pos.y": "number", "pos.x": "number", "title": "string", "cat": "array"}
    share = {("lat", "pos.y"): 1.0, ("lon", "pos.x"): 1.0, ("name", "title"): 0.9}
    assert set(edit_script(old, new, share)) == {("moved", "lat", "pos.y"), ("moved", "lon", "pos.x"), ("renamed", "name", "title"), ("retyped", "cat", "cat")}
    assert set(edit_script({"a": "string"}, {"b": "string"}, {})) == {("removed", "a", "a"), ("added", "b", "b")}
    # Two candidates for one path: the better evidence wins, the other is an add.
    assert set(edit_script({"a": "string"}, {"b": "string", "c": "string"}, {("a", "b"): 0.8, ("a", "c"): 1.0})) == {("renamed", "a", "c"), ("added", "b", "b")}
    assert edit_script({}, {}, {}) == []


def brute(old, new, share):
    """Least cost over all ways to pair gone with fresh fields of which a tree mapping is not asked."""
    may = [k for k in share if k[0] not in new and k[1] not in old]
    best = (1e9, None)
    for n in range(len(may) + 1):
        for some in itertools.combinations(may, n):
            if len({a for a, _ in some}) == n == len({b for _, b in some}):
                cost = sum(carry_cost(a, b, share[a, b], old[a] != new[b]) for a, b in some) + len(old.keys() - new.keys()) + len(new.keys() - old.keys()) - 2 * n
                best = min(best, (cost, sorted(some)))
    return best


def script_cost(old, new, share, script):
    pairs = [(a, b) for k, a, b in script if k in ("renamed", "moved")]
    return sum(carry_cost(a, b, share[a, b], old[a] != new[b]) for a, b in pairs) + sum(k in ("added", "removed") for k, _, _ in script)


def test_scripts_cost_no_more_than_any_pairing():
    r = random.Random(1)
    more = 0
    for _ in range(200):
        old = {p: "string" for p in r.sample(["a", "b", "c.x", "c.y", "d", "e.f.g"], r.randint(1, 4))}
        new = {p: "string" for p in r.sample(["q", "r", "s.x", "s.y", "t", "u.f.g"], r.randint(1, 4))}
        share = {(a, b): r.choice([0.8, 0.9, 1.0]) for a in old for b in new if r.random() < 0.5}
        script = edit_script(old, new, share)
        cost, _ = brute(old, new, share)
        # The tree also pays for objects it adds and takes away, so among pairings of as many fields it may prefer another place.
        assert len([k for k, _, _ in script if k in ("renamed", "moved")]) == len(brute(old, new, share)[1])
        more += script_cost(old, new, share, script) > cost + 0.5
    assert more <= 4


def test_one_field_of_two_that_could_be_both_is_left_for_the_other():
    # The best single pair (a, q) would leave b without a counterpart.
    share = {("a", "q"): 1.0, ("a", "r"): 0.95, ("b", "q"): 0.95}
    got = edit_script({"a": "string", "b": "string"}, {"q": "string", "r": "string"}, share)
    assert set(got) == {("renamed", "a", "r"), ("renamed", "b", "q")}


def test_equal_evidence_is_decided_by_the_tree(monkeypatch):
    # Both objects may carry on the old one's fields; the mapping keeps the fields of one object together.
    old = {"p.v": "string", "p.w": "string"}
    new = {"q.v1": "string", "q.w1": "string", "r.v1": "string", "r.w1": "string"}
    share = {("p.v", "q.v1"): 1.0, ("p.v", "r.v1"): 1.0, ("p.w", "q.w1"): 0.99, ("p.w", "r.w1"): 1.0}
    want = {("moved", "p.v", "r.v1"), ("moved", "p.w", "r.w1"), ("added", "q.v1", "q.v1"), ("added", "q.w1", "q.w1")}
    assert set(edit_script(old, new, share)) == want
    monkeypatch.setattr(treedit, "mapping", lambda *a: [])
    assert set(edit_script(old, new, share)) != want


def test_moves_that_cross():
    old = {"a.x": "string", "b.y": "string"}
    new = {"c.d": "string", "e": "string"}
    share = {("a.x", "e"): 1.0, ("b.y", "c.d"): 1.0}
    assert set(edit_script(old, new, share)) == {("moved", "a.x", "e"), ("moved", "b.y", "c.d")}


def test_projections_follow_the_feed(spark):
    # In feed f the path "label" is the name, in feed g the category; each file is read by its own feed's scripts.
    rec = lambda i, **k: {"id": i, "confidence": 0.5, **k}
    f = [[rec(i, name=f"n{i}", category="c") for i in range(8)], [rec(i, label=f"n{i}", category="c") for i in range(8)]]
    g = [[rec(i, name=f"m{i}", category=f"k{i}") for i in range(8)], [rec(i, name=f"m{i}", label=f"k{i}") for i in range(8)]]
    data = [x for feed, files in (("f", f), ("g", g)) for k, r in enumerate(files) for x in lines(feed, f"r{k}", r)]
    out = {(r["feed"], r["id"]): (r["name"], r["category"]) for r in unified(spark.createDataFrame(data, S)).where("release = 'r1'").collect()}
    assert out["f", "3"] == ("n3", "c") and out["g", "3"] == ("m3", "k3")


def test_changes_between_files(spark, rows):
    a = [{"id": i, "name": f"n{i}", "path": f"x > y{i}", "score": i / 10, "old": i} for i in range(10)]
    b = [{"id": i, "names": {"common": f"n{i}"}, "path": ["x", f"y{i}"], "rank": str(i / 10), "new": i % 2} for i in range(10)]
    b[3]["stray"] = 1
    b[4]["path"] = 5
    data = lines("f", "2026-01-01.0", a) + lines("f", "2026-02-01.0", b) + lines("g", "2026-01-01.0", a)
    got = rows(changes(spark.createDataFrame(data, S)), "field_path", "change_kind")
    assert got == [("names.common", "renamed"), ("new", "added"), ("old", "removed"), ("path", "retyped"), ("rank", "renamed"), ("rank", "retyped")]


def test_releases_order_by_number_and_not_by_arrival(spark, rows):
    data = lines("f", "2026-01-01.9", [{"id": 1, "a": 1}]) + lines("f", "2026-01-01.10", [{"id": 1, "a": 1, "b": 2}])
    assert rows(changes(spark.createDataFrame(data, S))) == [("f/2026-01-01.10", "b", "added")]


def test_presence_needs_a_fifth(spark, rows):
    a = [{"id": i, "k": 1} for i in range(10)]
    b = [{"id": i, "k": 1, **({"two": i} if i < 2 else {}), **({"one": i} if i < 1 else {})} for i in range(10)]
    assert rows(changes(spark.createDataFrame(lines("f", "r1", a) + lines("f", "r2", b), S)), "field_path", "change_kind") == [("two", "added")]


def test_dirty_payloads_and_repeated_lines(spark, rows):
    a = [{"id": 1, "k": 1}, None, "", '{"id": 2, "k"', "[1]", "7"]
    b = lines("f", "r2", [{"id": 1, "k": "x"}])
    data = lines("f", "r1", a) + b + b + [(None, "f", "r3", 1, "{}", T0, "", "")]
    assert rows(changes(spark.createDataFrame(data, S)), "field_path", "change_kind") == [("k", "retyped")]
    assert rows(changes(spark.createDataFrame([], S))) == []


def test_one_table(spark):
    a = [{"id": i, "name": f"n{i}", "category": "c", "hierarchy": "a > b", "confidence": 0.5, "lon": 1.5, "lat": i} for i in range(8)]
    b = [{"id": i, "names": {"common": f"n{i}"}, "category": ["c"], "hierarchy": ["a", "b"], "confidence": "n/a", "lon": "1.5", "position": {"y": i}} for i in range(8)]
    out = unified(spark.createDataFrame(lines("f", "r1", a) + lines("f", "r2", b), S)).where("release = 'r2'").orderBy("line_no").collect()
    assert len(out) == 8
    r = out[3]
    assert (r["id"], r["name"], r["category"], r["hierarchy"], r["confidence"], r["lon"], r["lat"]) == ("3", "n3", "c", "a > b", None, 1.5, 3.0)
