"""Exact order statistics by counting: no sort, no group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.sources.scratch import written

#: Bins that each round cuts a group's range into.
BINS = 1_024


def nth(rows: DataFrame, group: str, value: str, place: Column, bins: int = BINS) -> DataFrame:
    """``(group, n, least, nth, most)``: of each group's doubles in order the one at ``place``, from 0, of its count ``n``.

    Nulls don't count; groups are few.  Each round counts the values in bins of
    the range that still holds the wanted one, and goes on with that bin, from
    its least to its greatest value, until these are equal.
    """
    held = written(rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null"), "order-statistics")
    whole = held.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    whole = written(whole.withColumn("left", place.cast("long")).where("left >= 0 and left < n"), "order-bounds")
    now, done = whole.select("g", F.col("least").alias("lo"), F.col("most").alias("hi"), "left"), []
    while True:
        done.append(now.where("lo = hi").select("g", F.col("lo").alias("nth")))
        now = now.where("lo < hi")
        if now.isEmpty():
            break
        bounds = F.broadcast(now.withColumnRenamed("g", "k"))
        inside = held.join(bounds, F.col("g").eqNullSafe(F.col("k")) & F.col("v").between(F.col("lo"), F.col("hi")))
        # halves first, as the range itself may be beyond a double; where they are equal, nothing lies between the two ends
        width = F.col("hi") / 2 - F.col("lo") / 2
        at = F.when(width > 0, F.floor((F.col("v") / 2 - F.col("lo") / 2) / F.nullif(width, F.lit(0.0)) * bins)).otherwise(0)
        edge = F.when(F.col("v") == F.col("hi"), bins).otherwise(F.least(at, F.lit(bins - 1)))  # the greatest alone, so that every round gets on
        counted = inside.groupBy("g", "left", edge.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        now = counted.withColumn("b", before).where("left >= b and left < b + c").select("g", "lo", "hi", (F.col("left") - F.col("b")).alias("left"))
        now = written(now, "order-bounds")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    out = whole.join(found.withColumnRenamed("g", "k"), F.col("g").eqNullSafe(F.col("k")))
    return out.select(F.col("g").alias(group), "n", "least", "nth", "most")
