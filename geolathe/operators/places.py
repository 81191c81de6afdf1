"""Points of interest: lookup by category, fallback by hierarchy, typing by rules on the name, and corrections by id.

Lookups, rule lists and maps are the caller's data; nothing is built in.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolathe.session import numbered, ship

Rule = tuple[str, str, Sequence[str], Sequence[str]]  # type, group, patterns, patterns that rule it out


def fold_ascii(c: Column) -> Column:
    """Lower case, accents off, everything but letters and digits to single blanks; NULL stays NULL. Accents go by an Arrow function, the rest in the JVM."""

    @F.pandas_udf("string")
    def bare(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v.replace("đ", "d").replace("Đ", "D")).encode("ascii", "ignore").decode())

    return F.trim(F.regexp_replace(F.lower(bare(c)), "[^a-z0-9]+", " "))


def lower_words(c: Column) -> Column:
    """Lower case with accents, punctuation to single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\w]+", " "))


def slug(c: Column) -> Column:
    """Lower-case ASCII words joined by underscores; letters without an ASCII base are dropped."""

    @F.pandas_udf("string")
    def bare(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode())

    return F.regexp_replace(F.regexp_replace(F.lower(bare(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def steps(path: Column) -> Column:
    """The trimmed steps of "a > b > c"; NULL for a blank path."""
    return F.when(F.length(F.trim(path)) > 0, F.transform(F.split(path, ">"), lambda s: F.trim(s)))


def group_of(path: Column, second: dict[str, str], first: dict[str, str]) -> Column:
    """Group of a path: by its second step, else by its first, else NULL."""
    s = steps(path)
    look = lambda m, k: F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), k) if m else F.lit(None).cast("string")
    return F.coalesce(look(second, F.try_element_at(s, F.lit(2))), look(first, F.try_element_at(s, F.lit(1))))


def classify(places: DataFrame, lookup: DataFrame, fallback: Column, other: str = "Other") -> tuple[DataFrame, DataFrame]:
    """(classified, missing): places with a category joined to lookup (category, group, activities, score), and the categories it lacks with their counts.

    A category the lookup lacks takes its group from `fallback`, else `other`, and the activities ["Unclassified"].
    """
    p = places.where(F.col("category").isNotNull())
    j = p.join(lookup, "category", "left").withColumn("group", F.coalesce("group", fallback, F.lit(other))).withColumn("activities", F.coalesce("activities", F.array(F.lit("Unclassified"))))
    missing = p.join(lookup, "category", "left_anti").groupBy("category").agg(F.count("*").alias("n"))
    return j, missing


def flags(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """is_<name> by membership in `activities`, is_full by a score of exactly 1, and the list as one text."""
    out = df.withColumns({f"is_{n.lower()}": F.coalesce(F.array_contains("activities", n), F.lit(False)) for n in names})
    return out.withColumn("is_full", F.coalesce(F.col("score") == 1.0, F.lit(False))).withColumn("activities", F.array_join("activities", "|"))


def _match(folded: Column, accented: Column, patterns: Sequence[str]) -> Column:
    """Whole-word match; patterns in ASCII look at the folded text, others at the accented one."""
    hit = F.lit(False)
    for text, ps in ((folded, [p for p in patterns if p.isascii()]), (accented, [p for p in patterns if not p.isascii()])):
        if ps:
            hit = hit | text.rlike(r"(?U)(?<!\w)(" + "|".join(ps) + r")(?!\w)")
    return hit


def type_by_name(df: DataFrame, rules: Sequence[Rule], leave_out: Sequence[str] = (), elsewhere: Sequence[str] = (), bound: Sequence[str] = (), name: str = "name") -> DataFrame:
    """Adds type, type_group, note and keep: the first rule whose patterns match and whose exclusions do not.

    Names that match `leave_out` get no type; names that match `elsewhere` are flagged unless their type is in `bound`.
    """
    df = df.withColumns({"_f": F.coalesce(fold_ascii(F.col(name)), F.lit("")), "_a": F.coalesce(lower_words(F.col(name)), F.lit(""))})
    t = g = F.lit(None).cast("string")
    for typ, grp, inc, exc in reversed(list(rules)):
        hit = _match(F.col("_f"), F.col("_a"), inc) & ~_match(F.col("_f"), F.col("_a"), exc)
        t, g = F.when(hit, typ).otherwise(t), F.when(hit, grp).otherwise(g)
    out_ = _match(F.col("_f"), F.col("_a"), leave_out)
    empty = F.col("_f") == ""
    df = df.withColumns({"type": F.when(~empty & ~out_, t), "type_group": F.when(~empty & ~out_, g)})
    away = _match(F.col("_f"), F.col("_a"), elsewhere) & ~(F.col("type").isin(*bound) if bound else F.lit(False))
    note = F.when(empty, "no name").when(out_, "organisation").when(F.col("type").isNull(), "no rule").when(away, "elsewhere").otherwise("")
    return df.withColumn("note", note).withColumn("keep", F.col("type").isNotNull() & (F.col("note") == "")).drop("_f", "_a")


def corrected(df: DataFrame, review: DataFrame, key: str, fields: dict[str, str], order: str) -> DataFrame:
    """df with the values of a review where they were changed: of each key the first row by `order`; a field counts as changed if it
    differs from its recorded automatic value, empty text and NULL being the same. fields: {column: automatic column}. Adds `edited`."""
    w = Window.partitionBy(key).orderBy(order)
    r = review.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    norm = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    changed = F.lit(False)
    for new, auto in fields.items():
        changed = changed | ~norm(new).eqNullSafe(norm(auto))
    r = r.where(changed).select(key, *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_hit"))
    j = df.join(r, key, "left").withColumn("edited", F.coalesce("_hit", F.lit(False)))
    return j.withColumns({c: F.when(F.col("edited"), F.nullif(F.col(f"_{c}"), F.lit("")) if dict(df.dtypes).get(c) == "string" else F.col(f"_{c}")).otherwise(F.col(c)) for c in fields}).drop("_hit", *[f"_{c}" for c in fields])


def chosen(df: DataFrame, entries: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, unknown): kept rows for each entry that is a group or a type, once for each; entries without a row."""
    e = df.sparkSession.createDataFrame([(x,) for x in entries], "entry string")
    hit = df.where("keep").join(F.broadcast(e), (F.col("type_group") == F.col("entry")) | (F.col("type") == F.col("entry")))
    return hit, e.join(hit.select("entry").distinct(), "entry", "left_anti")


def summary(df: DataFrame) -> DataFrame:
    """type_group, type, kept, total for typed rows."""
    return df.where(F.col("type").isNotNull()).groupBy(F.coalesce("type_group", F.lit("Other")).alias("type_group"), "type").agg(F.sum(F.col("keep").cast("long")).alias("kept"), F.count("*").alias("total")).orderBy("type_group", F.desc("kept"))


def first_tag(tags: Column, keys: Sequence[str], default: str = "unknown") -> Column:
    """"key:value" of the first key that a map of tags has."""
    return F.coalesce(*[F.concat(F.lit(f"{k}:"), F.try_element_at(tags, F.lit(k))) for k in keys], F.lit(default))


def problems(df: DataFrame, key: str, order: str, checks: dict[str, Column]) -> DataFrame:
    """key, line, problem: one row for each check that fails, and for each repeated key from its second row on. Lines count from 2, below a header."""
    w = Window.partitionBy(key).orderBy(order)
    d = numbered(df.withColumn("_rep", F.row_number().over(w)), "line", order).withColumn("line", F.col("line") + 1)
    all_ = F.array_compact(F.array(F.when(F.col("_rep") > 1, F.lit("duplicate")), *[F.when(bad, F.lit(msg)) for msg, bad in checks.items()]))
    return d.select(key, "line", F.explode(all_).alias("problem"))
