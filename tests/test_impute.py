"""Filled values: masks, known values, other releases, held-out accuracy and dirty rows."""

import datetime as dt

import numpy as np

from geolathe.operators.impute import fill_buildings, filled_cases

S = "id string, site string, release string, height double, num_floors double, class string, geom array<array<struct<x:double,y:double>>>, updated_at timestamp, ingested_at timestamp, cls string, lh double"
T0 = dt.datetime(2026, 1, 1)


def row(i, site="s", rel="r1", h=None, f=None, cls=None, side=10.0, at=T0):
    g = [[(0.0, 0.0), (side, 0.0), (side, side), (0.0, side)]]
    return (i, site, rel, h, f, cls, g, at, at, "clash", 1.0)


def test_masks_and_known_values(spark, rows):
    nan = float("nan")
    data = [row(f"k{i}", h=6.0 + i % 3, f=2.0, cls="house") for i in range(30)]
    data += [row("a", h=None, f=2.0, cls="house"), row("b", h=nan, f=99.0, cls="house"), row("c", h=-9999.0, f=0.0, cls=None), row("d", h=7.0, f=3.0), row("d", h=7.0, f=3.0)]
    df = spark.createDataFrame(data, S)
    out = {(r["id"]): r for r in fill_buildings(df).collect()}
    assert len(out) == 34
    assert rows(filled_cases(fill_buildings(df))) == [("a", "r1", "height"), ("b", "r1", "height"), ("b", "r1", "num_floors"), ("c", "r1", "height"), ("c", "r1", "num_floors")]
    assert out["k0"]["height"] == 6.0 and not out["k0"]["is_height_filled"]
    assert 5 <= out["a"]["height"] <= 9 and out["a"]["is_height_filled"] and not out["a"]["is_num_floors_filled"]
    assert out["c"]["class"] == "house" and out["c"]["is_class_filled"] and not out["k0"]["is_class_filled"]


def test_same_building_at_another_time(spark):
    rng = np.random.default_rng(1)
    data = []
    for i in range(60):
        h = float(np.exp(rng.normal(2, 0.6)))
        data += [row(f"b{i}", rel="r1", h=h, f=float(max(1, round(h / 3))), cls="office"), row(f"b{i}", rel="r2", h=h, f=float(max(1, round(h / 3))), cls="office")]
    data += [row("x", rel="r1", h=40.0, f=13.0, cls="office"), row("x", rel="r2", cls="office")]
    r = next(r for r in fill_buildings(spark.createDataFrame(data, S)).collect() if r["id"] == "x" and r["release"] == "r2")
    assert abs(r["height"] - 40) < 3 and abs(r["num_floors"] - 13) <= 1


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(2)
    kinds = {"house": 6.0, "office": 20.0, "tower": 80.0}
    truth, data = {}, []
    for i in range(900):
        k = list(kinds)[i % 3]
        site = f"s{i % 9}"
        h = kinds[k] * (1 + 0.05 * (i % 9)) * float(np.exp(rng.normal(0, 0.1)))
        f = float(max(1, round(h / 3.2)))
        hide = i % 5 == 0
        truth[f"b{i}"] = (h, k)
        data.append(row(f"b{i}", site=site, rel=f"r{i % 4}", h=None if hide else h, f=None if hide and i % 2 else f, cls=None if i % 7 == 0 else k, side={"house": 8.0, "office": 25.0, "tower": 30.0}[k]))
    out = fill_buildings(spark.createDataFrame(data, S)).collect()
    rel = [abs(r["height"] - truth[r["id"]][0]) / truth[r["id"]][0] for r in out if r["is_height_filled"]]
    assert len(rel) == 180 and np.mean(rel) < 0.2
    cls = [r["class"] == truth[r["id"]][1] for r in out if r["is_class_filled"]]
    assert np.mean(cls) > 0.9


def test_nothing_known_and_empty(spark, rows):
    out = fill_buildings(spark.createDataFrame([row("a"), row(None), row("b", site=None)], S)).collect()
    assert len(out) == 3 and all(r["height"] is None and not r["is_height_filled"] for r in out)
    assert rows(filled_cases(fill_buildings(spark.createDataFrame([], S)))) == []


def test_null_release(spark):
    data = [row(f"k{i}", h=6.0 + i % 3, f=2.0, cls="house") for i in range(30)] + [row("x", rel="r1", h=40.0, f=13.0, cls="house"), row("x", rel=None, cls="house"), row("y", rel=None, f=2.0, cls="house")]
    out = {(r["id"], r["release"]): r for r in fill_buildings(spark.createDataFrame(data, S)).collect()}
    x, y = out["x", None], out["y", None]
    assert x["is_height_filled"] and x["is_num_floors_filled"] and x["height"] > 15 and y["is_height_filled"] and 4 <= y["height"] <= 9


def test_effects_are_fitted_jointly(spark):
    """Sites hold very different classes, so a fit of one factor after the other would mix them; the joint one finds both."""
    from geolathe.operators.impute import cell_effects

    rng = np.random.default_rng(5)
    site, cls, rel = {f"s{i}": rng.normal(0, 0.5) for i in range(12)}, {"a": 0.0, "b": 1.0, "c": -1.0}, {"r1": 0.0, "r2": 0.2}
    data = []
    for i, s in enumerate(site):
        for c in cls:
            for r in rel:
                n = 40 if (i % 3 == "abc".index(c)) else 2
                data += [(s, c, r, float(2 + site[s] + cls[c] + rel[r] + rng.normal(0, 0.05)), None, None) for _ in range(n)]
    data.append(("new", "a", "r1", None, None, None))
    pred, known = cell_effects(spark.createDataFrame(data, "site string, cls string, release string, lh double, lf double, lr double"))
    got = {(r["site"], r["cls"], r["release"]): r["p_lh"] for r in pred.collect()}
    assert known == {"lh": len(data) - 1, "lf": 0, "lr": 0} and len(got) == 12 * 6 + 1
    assert max(abs(got[s, c, r] - 2 - site[s] - cls[c] - rel[r]) for s in site for c in cls for r in rel) < 0.12
    assert abs(got["new", "a", "r1"] - 2 - np.mean(list(site.values()))) < 0.1


def test_logit_is_at_its_maximum():
    from geolathe.operators.impute import _steps, fit_logit

    rng = np.random.default_rng(6)
    area = np.exp(rng.normal(5, 1, 400))
    y = (np.log(area) + rng.normal(0, 0.5, 400) > 5).astype(int)
    x, off = _steps(area, np.full(400, np.nan), np.full(400, np.nan)), np.zeros((400, 2))
    w = fit_logit(x, y, off, rounds=3000)
    s = np.exp(w[x].sum(1))
    g = np.eye(2)[y] - s / s.sum(1, keepdims=True)
    grad = np.zeros_like(w)
    for j in range(3):
        np.add.at(grad, x[:, j], g)
    assert np.abs(grad - w).max() < 1e-3 and (w[x].sum(1).argmax(1) == y).mean() > 0.8
