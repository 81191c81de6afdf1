"""Access on foot: bands, rings, catchments, gaps and summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolathe.session import materialize


def gini(df: DataFrame, col: str, *keys: str) -> DataFrame:
    """keys, gini: NULL below two values. Ranks come from counts of equal values, summed along a sorted range per key."""
    v = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("c"))
    part = list(keys)
    if not keys:
        # Without keys the values are sorted into ranges, each shifted by the counts of the ranges before it.
        part = ["_part"]
        v = materialize(v.repartitionByRange(col).withColumn("_part", F.spark_partition_id()), "ranges")
        size = v.groupBy("_part").agg(F.sum("c").alias("n"))  # one row a range
        shift = size.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
        v = v.join(F.broadcast(shift), "_part")
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*part).orderBy(col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    v = v.withColumn("before", before if keys else before + F.col("_shift"))
    # Equal values hold the ranks before + 1 .. before + c.
    rank_sum = F.col("c") * F.col("before") + F.col("c") * (F.col("c") + 1) / 2
    g = v.groupBy(*keys) if keys else v.groupBy()
    a = g.agg(F.sum(2 * rank_sum * F.col(col)).alias("s"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col(col)).alias("t"))
    return a.select(*keys, F.when((F.col("n") >= 2) & (F.col("t") != 0), (F.col("s") - F.col("n") * F.col("t") - F.col("t")) / (F.col("n") * F.col("t"))).when(F.col("n") >= 2, 0.0).alias("gini"))


def minutes(df: DataFrame, seconds: str) -> Column:
    """Minutes; not reached is infinite."""
    return F.coalesce(F.col(seconds) / 60.0, F.lit(math.inf))


def access_summary(grid: DataFrame, time: str, limit: float, *, median_within: bool = False) -> DataFrame:
    """One row: pct_within of all cells, median_min over reached cells (or those within the limit)."""
    t = F.col(time)
    pool = (t <= limit) if median_within else (t < 999)
    return grid.agg((100.0 * F.avg((F.coalesce(t <= limit, F.lit(False))).cast("double"))).alias("pct_within"), F.median(F.when(pool, t)).alias("median_min"))


def gap_class(first: Column, second: Column, limit: float) -> Column:
    """both, second_only, first_only or none, by times up to the limit; NULL and infinite are not reached."""
    a, b = F.coalesce(first <= limit, F.lit(False)), F.coalesce(second <= limit, F.lit(False))
    return F.when(a & b, "both").when(b, "second_only").when(a, "first_only").otherwise("none")


def bands(reach: DataFrame, limits: list[float]) -> DataFrame:
    """source, node, band: every band whose limit holds the distance."""
    b = F.explode(F.array(*[F.lit(float(v)) for v in limits])).alias("band")
    return reach.select("*", b).where(F.col("dist") <= F.col("band"))


def dissolved(banded: DataFrame, group: str) -> DataFrame:
    """group, band, nodes: the nodes within a band of any source of the group, each with all smaller bands; distinct by construction."""
    first = banded.groupBy(group, "node").agg(F.min("band").alias("first"))
    all_ = banded.select(group, "band").distinct()
    return first.join(all_, group).where(F.col("band") >= F.col("first")).groupBy(group, "band").agg(F.count("*").alias("nodes"))


def rings(banded: DataFrame, group: str) -> DataFrame:
    """group, band, label, nodes: what a band adds to the one before it."""
    first = banded.groupBy(group, "node").agg(F.min("band").alias("band"))
    r = first.groupBy(group, "band").agg(F.count("*").alias("nodes"))
    w = Window.partitionBy(group).orderBy("band")
    lo = F.coalesce(F.lag("band").over(w), F.lit(0.0))
    return r.withColumn("label", F.concat(lo.cast("int").cast("string"), F.lit("-"), F.col("band").cast("int").cast("string"), F.lit(" min")))


def what_if(existing: DataFrame, candidate: DataFrame) -> DataFrame:
    """node, before, after, gain: the nearest distance with one more facility."""
    j = existing.select("node", F.col("dist").alias("before")).join(candidate.select("node", F.col("dist").alias("d2")), "node", "full")
    after = F.least("before", "d2")
    return j.select("node", "before", after.alias("after"), (F.coalesce("before", F.lit(math.inf)) - after).alias("gain"))
