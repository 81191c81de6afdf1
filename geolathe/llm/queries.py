"""Queries of the text problems, with their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from geolathe.llm import encode, glyphs, mix, names, residue
from geolathe.session import table


def p4_found(spark, d):
    return names.variants(table(spark, d, "places"))


def p5_found(spark, d):
    return glyphs.look_alikes(table(spark, d, "pois_review"), table(spark, d, "places"))


def p5_forms(spark, d):
    """One form of every distinct name of places and reviews."""
    both = table(spark, d, "places").select("name").union(table(spark, d, "pois_review").select("name")).where(F.col("name").isNotNull()).distinct()
    return glyphs.with_forms(both, form="name")


def p6_ids(spark, d):
    return encode.token_ids(table(spark, d, "documents"))


def _mixed(spark, d):
    return mix.mix(mix.token_counts(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p7_mix(spark, d):
    return _mixed(spark, d)[0]


def p7_shares(spark, d):
    return _mixed(spark, d)[1]


def p8_found(spark, d):
    return residue.residue(table(spark, d, "documents")).select("doc_id")


def p8_kinds(spark, d):
    """The documents to leave out, a row for each kind of evidence."""
    return residue.residue(table(spark, d, "documents")).select("doc_id", F.explode("kinds").alias("kind"))


QUERIES = {f.__name__: f for f in (p4_found, p5_found, p5_forms, p6_ids, p7_mix, p7_shares, p8_found, p8_kinds)}

SQL = {
    "p5_forms": f"""
        SELECT name, {glyphs.form_sql("name")} AS form
        FROM (SELECT name FROM places UNION SELECT name FROM pois_review) WHERE name IS NOT NULL""",
    "p5_found": f"""
        WITH both_ AS (
          SELECT DISTINCT r.review_seq, r.id, r.name AS a, p.name AS b FROM pois_review r JOIN places p ON r.id = p.id
          WHERE r.name IS NOT NULL AND p.name IS NOT NULL AND r.name <> p.name)
        SELECT DISTINCT review_seq, id FROM both_ WHERE ({glyphs.form_sql("a")}) = ({glyphs.form_sql("b")})""",
}
