"""Queries of the general training-data problem (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsieve.operators.timestamps import VERSION, dictionary, feed_zones, normalise_timestamps, value_counts
from jobsieve.session import kept_folder
from jobsieve.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Through the dictionary that is kept in the shared folder: values seen by an earlier run are not parsed again."""
    return normalise_timestamps(table(spark, d, "jobs"), table(spark, d, "feeds"), path=f"{kept_folder(spark)}/jobsieve-timestamps-{VERSION}")


def p4_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """How many distinct values each source writes in each kind of notation, the unreadable ones included."""
    parsed = dictionary(value_counts(table(spark, d, "jobs"), "posted_date", "source"), feed_zones(table(spark, d, "feeds")))
    return parsed.groupBy("source", F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("distinct_values"))


def queries() -> dict:
    return {"p4_found": p4_found, "p4_dictionary": p4_dictionary}


def oracle_sql() -> dict[str, str]:
    return {}
