"""As-of lookups without a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_before(left: DataFrame, right: DataFrame, key: str, ts: str, out: str) -> DataFrame:
    """left with the greatest right timestamp of the same key at or before its own, null if none.

    Both sides are cut into days, so that a key with a third of all rows is spread: within a day a running maximum over
    the union, across days one carried value per key and day.
    """
    day = F.to_date(F.col(ts))
    marks = right.select(F.col(key), F.col(ts).alias("_m")).where(F.col("_m").isNotNull())
    both = left.withColumn("_m", F.lit(None).cast("timestamp_ntz")).withColumn("_side", F.lit(1)).unionByName(marks.withColumn(ts, F.col("_m")).withColumn("_side", F.lit(0)), allowMissingColumns=True).withColumn("_d", day)
    within = both.withColumn("_w", F.max("_m").over(W.partitionBy(key, "_d").orderBy(ts, "_side").rowsBetween(W.unboundedPreceding, 0))).where("_side = 1")
    days = both.groupBy(key, "_d").agg(F.max("_m").alias("_x"))
    carried = days.withColumn("_c", F.max("_x").over(W.partitionBy(key).orderBy("_d").rowsBetween(W.unboundedPreceding, -1))).select(key, "_d", "_c")
    return within.join(carried, [key, "_d"], "left").withColumn(out, F.coalesce("_w", "_c")).drop("_m", "_side", "_d", "_w", "_c")
