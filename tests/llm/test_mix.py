"""Mixing: shares, caps, the rounding's expectation and its conserved mass."""

import numpy as np

from geolathe.llm.mix import mix, pivot, token_counts

D = "doc_id bigint, source string, tokens bigint, plan_name string"
T = "plan_name string, source string, target_share double, max_repeats int, total_ratio double, tokens int"


def test_pivot_keeps_mass_and_leaves_one_open():
    rng = np.random.default_rng(1)
    p, w = rng.uniform(0.01, 0.99, 200), rng.integers(1, 500, 200).astype(float)
    out, k = pivot(p, w, rng)
    assert abs((p * w).sum() - (out * w).sum()) < 1e-6
    assert ((out == 0) | (out == 1)).sum() >= 199 and (k < 0 or 0 < out[k] < 1)


def test_pivot_keeps_expectations():
    rng = np.random.default_rng(2)
    p, w = np.array([0.2, 0.5, 0.7, 0.9]), np.array([10.0, 20.0, 5.0, 40.0])
    mean = np.mean([pivot(p, w, rng)[0] for _ in range(6000)], axis=0)
    assert np.abs(mean - p).max() < 0.02


def test_shares_and_caps(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "big", int(n), "x") for i, n in enumerate(rng.integers(50, 150, 3000))]
    rows += [(10_000 + i, "small", 100, "x") for i in range(40)] + [(20_000, None, 500, "x"), (20_001, "big", 0, "x"), (20_002, "tiny", 100, "x")]
    t = [("a", "big", 0.5, 1, 0.4, 0), ("a", "small", 0.1, 8, 0.4, 0), ("a", "tiny", 0.2, 3, 0.4, 0), ("a", "none", 0.2, 2, 0.4, 0), ("b", "big", 1.0, 0, 0.4, 0)]
    chosen, shares = mix(spark.createDataFrame(rows, D), spark.createDataFrame(t, T), bucket_rows=300)
    c, s = chosen.collect(), {(r["plan_name"], r["source"]): r for r in shares.collect()}
    assert len({(r["plan_name"], r["doc_id"]) for r in c}) == len(c)
    cap = {(p, so): m for p, so, _, m, _, _ in t}
    assert all(1 <= r["uses"] <= cap[r["plan_name"], r["source"]] for r in c)
    assert all(r["tokens"] > 0 and r["source"] for r in c)
    for src in ("big", "small"):
        r = s["a", src]
        assert abs(r["reached_tokens"] - r["wanted_tokens"]) <= 150, r
    assert s["a", "tiny"]["uses"] == 3 and s["a", "none"]["reached_tokens"] == 0 and s["b", "big"]["uses"] == 0
    assert abs(sum(r["reached_share"] for k, r in s.items() if k[0] == "a") - 1) < 1e-9


def test_same_result_in_any_layout(spark):
    rows = [(i, "s", 10 + i % 7, "x") for i in range(500)]
    df, t = spark.createDataFrame(rows, D), spark.createDataFrame([("a", "s", 0.5, 2, 0.7, 0)], T)
    a, b = (sorted(map(tuple, mix(x, t, bucket_rows=50)[0].collect())) for x in (df.repartition(1), df.repartition(7)))
    assert a == b


def test_empty(spark):
    e, t = spark.createDataFrame([], D), spark.createDataFrame([("a", "s", 0.5, 2, 0.7, 0)], T)
    chosen, shares = mix(e, t)
    assert chosen.collect() == [] and [r["reached_share"] for r in shares.collect()] == [0.0]
    assert mix(e, t.limit(0))[1].collect() == []


def test_counts(spark):
    df = spark.createDataFrame([(1, "s", "Hello world"), (2, None, None), (3, "s", "")], "doc_id bigint, source string, text string")
    assert sorted(map(tuple, token_counts(df).collect()), key=repr) == [(1, "s", 2), (2, None, 0), (3, "s", 0)]
