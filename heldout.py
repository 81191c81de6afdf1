"""How well `fill_buildings` fills values that are known: a tenth of each kind is hidden, filled and compared. Usage: python heldout.py [folder]."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from geolathe.operators.impute import FLOORS, HEIGHT, clean, fill_buildings, real_value
from geolathe.session import build, table


def main(folder: str) -> None:
    spark = build(app="heldout")
    b = table(spark, folder, "buildings")
    hide = lambda c, k: F.when(F.pmod(F.xxhash64("id", "release", F.lit(k)), F.lit(10)) > 0, F.col(c)).alias(c)
    cut = b.select(*[hide(c, c) if c in ("height", "num_floors", "class") else F.col(c) for c in b.columns])
    was = clean(b).select("id", "release", real_value(F.col("height"), HEIGHT).alias("h"), real_value(F.col("num_floors"), FLOORS).alias("f"), F.col("class").alias("c"))
    j = fill_buildings(cut).join(was, ["id", "release"])
    hidden = lambda m, v: F.col(m) & F.col(v).isNotNull()
    mid = was.agg(F.median("h").alias("mh"), F.mode("c").alias("mc")).first()
    r = j.agg(
        F.count(F.when(hidden("is_height_filled", "h"), 1)).alias("heights"), F.avg(F.when(hidden("is_height_filled", "h"), F.abs(F.col("height") - F.col("h")))).alias("height error, m"), F.avg(F.when(hidden("is_height_filled", "h"), F.abs(F.lit(mid["mh"]) - F.col("h")))).alias("by the median, m"),
        F.avg(F.when(hidden("is_num_floors_filled", "f"), (F.col("num_floors") == F.col("f")).cast("double"))).alias("floors equal"), F.avg(F.when(hidden("is_class_filled", "c"), (F.col("class") == F.col("c")).cast("double"))).alias("classes equal"), F.avg(F.when(hidden("is_class_filled", "c"), (F.col("c") == F.lit(mid["mc"])).cast("double"))).alias("by the most frequent"),
    ).first()
    print({k: round(v, 3) for k, v in r.asDict().items()})


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
