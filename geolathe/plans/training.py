"""Queries of the general training-data problems, with their SQL."""

from __future__ import annotations

from pathlib import Path

from geolathe.operators import drift, impute, nearby
from geolathe.session import table

HERE = Path(__file__).parent


def p1_found(spark, d):
    return nearby.near_or_inside(table(spark, d, "places"), table(spark, d, "nodes"), table(spark, d, "zones"))


def p2_found(spark, d):
    return impute.filled_cases(impute.fill_buildings(table(spark, d, "buildings")))


def p2_filled(spark, d):
    return impute.fill_buildings(table(spark, d, "buildings"))


def p3_found(spark, d):
    return drift.changes(table(spark, d, "places_raw"))


def p3_table(spark, d):
    return drift.unified(table(spark, d, "places_raw"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_filled, p3_found, p3_table)}

SQL = {
    "p1_found": (HERE / "p1.sql").read_text(),
    "p2_found": """
        WITH one AS (SELECT DISTINCT id, "release", height, num_floors FROM buildings),
        bad AS (
          SELECT id, "release", 'height' AS field FROM one WHERE height IS NULL OR isnan(height) OR height < 1 OR height > 300
          UNION ALL
          SELECT id, "release", 'num_floors' FROM one WHERE num_floors IS NULL OR isnan(num_floors) OR num_floors < 1 OR num_floors > 60)
        SELECT DISTINCT id, "release", field FROM bad""",
}
