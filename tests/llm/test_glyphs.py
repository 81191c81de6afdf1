"""Glyph forms: what looks alike becomes equal, and nothing else."""

import pytest

from geolathe.llm.glyphs import look_alikes, with_forms

SAME = [
    ("Ｃａｆé　Ｒｏｓｅ", "Café Rose"), ("Café", "Café"), ("a​b­﻿", "ab"), ("a  \tb ", "a b"), ("oﬃce ﬁne", "office fine"), ("Сafе", "Cafe"), ("Ροst", "Post"),
    ("ｶﾞｽ", "ガス"), ("İ", "İ"), ("ѐ", "è"), ("Fedӓvim", "Fedävim"), ("Ðổ", "Đổ"), ("a‑b", "a-b"), ("ệ", "ệ"), (" x ", "x"), ("ﾊﾟ", "パ"), ("Ｉ̈", "Ï"),
]
OTHER = [("Cafe", "Café"), ("cafe", "Cafe"), ("x²", "x2"), ("①", "1"), ("a!", "a"), ("ab", "a b"), ("ñ", "n"), ("и", "й"), ("a–b", "a-b"), ("Σ", "E")]


@pytest.fixture(scope="module")
def form(spark):
    texts = sorted({t for p in SAME + OTHER for t in p})
    out = with_forms(spark.createDataFrame([(t,) for t in texts], "t string"), f="t").collect()
    return {r["t"]: r["f"] for r in out}


@pytest.mark.parametrize("a,b", SAME)
def test_look_alikes_are_equal(form, a, b):
    assert form[a] == form[b]


@pytest.mark.parametrize("a,b", OTHER)
def test_others_are_not(form, a, b):
    assert form[a] != form[b]


def test_forms_are_stable_and_keep_nulls(spark):
    long = "Ａ​ " * 50_000
    df = spark.createDataFrame([(None, 1), ("", 2), (" ​ ", 3), (long, 4), ("x", 5), ("x", 5)], "name string, form2 int")
    got = {(r["form2"], r["f"]) for r in with_forms(df, f="name").collect()}
    assert got == {(1, None), (2, ""), (3, ""), (4, " ".join("A" * 50_000)), (5, "x")}
    once = with_forms(with_forms(df, f="name"), g="f").where("f is not null").collect()
    assert all(r["f"] == r["g"] for r in once)


def test_found(spark, rows):
    r = spark.createDataFrame([(1, "a", "Ｃａｆｅ"), (1, "a", "Ｃａｆｅ"), (2, "a", "Cafe"), (3, "a", "cafe"), (4, "gone", "Сafe"), (5, "a", None), (6, "b", "x"), (7, "a", "Сafe ")], "review_seq bigint, id string, name string")
    p = spark.createDataFrame([("a", "Cafe"), ("a", "Cafe"), ("b", None)], "id string, name string")
    assert rows(look_alikes(r, p)) == [(1, "a"), (7, "a")]
    assert rows(look_alikes(r.limit(0), p.limit(0))) == []


def test_plain_ascii_is_its_own_form(spark):
    import duckdb

    from geolathe.llm.glyphs import form_sql

    texts = [a + b for a in map(chr, range(33, 127)) for b in ("", "x", " a")]
    con = duckdb.connect()
    con.execute("CREATE TABLE src (v VARCHAR)")
    con.executemany("INSERT INTO src VALUES (?)", [(t,) for t in texts])
    assert con.sql(f"SELECT v FROM src WHERE ({form_sql('v')}) <> v").fetchall() == []
