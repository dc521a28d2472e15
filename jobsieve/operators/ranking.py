"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobsieve.session import write_once


def rank_within(df: DataFrame, group: str, order: list[Column], out: str = "rank_no") -> DataFrame:
    """df with the rank of every row in its group by order, from 1; order must tell all rows of a group apart.

    Rows are range-partitioned by group and order, so that a group with a third of all rows is spread over many tasks. Each
    task ranks its own rows; what stands in the ranges before is added from the counts of ranges, of which there are few.
    """
    keys = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    named = [F.col(f"_o{i}") for i in range(len(order))]
    ranged = df.select("*", *keys).repartitionByRange(F.col(group), *named).withColumn("_range", F.spark_partition_id())
    kept = write_once(ranged)  # ranges must not move between the two uses
    local = kept.withColumn("_local", F.row_number().over(W.partitionBy(group, "_range").orderBy(*named)))
    counts = kept.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = counts.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    joined = local.join(before, local[group].eqNullSafe(before["_g"]) & (local["_range"] == before["_r"]))
    return joined.select(*df.columns, (F.col("_local") + F.col("_before")).cast("long").alias(out))
