"""Table changes as pure functions from the old frame and the change to the new frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, update: list[str], keep: list[str]) -> DataFrame:
    """Rows of new replace `update` columns of old rows with the same key; `keep` columns stay as first seen."""
    n = new.select(key, *[F.col(c).alias(f"n_{c}") for c in update + keep], F.lit(True).alias("incoming"))
    joined = old.select(key, *update, *keep, F.lit(True).alias("stored")).join(n, key, "full_outer")
    incoming, stored = F.coalesce("incoming", F.lit(False)), F.coalesce("stored", F.lit(False))
    return joined.select(key, *[F.when(incoming, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in update], *[F.when(stored, F.col(c)).otherwise(F.col(f"n_{c}")).alias(c) for c in keep])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def soft_delete(df: DataFrame, condition: Column, flag: str = "is_active") -> DataFrame:
    return df.withColumn(flag, F.when(F.coalesce(condition, F.lit(False)), F.lit(0)).otherwise(F.col(flag)))


def delete_with_orphans(parents: DataFrame, children: DataFrame, condition: Column, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents without the deleted ones, children without orphans."""
    kept = parents.where(~F.coalesce(condition, F.lit(False)))
    return kept, children.join(kept.select(key), key, "left_semi")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def cap_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; the limit is applied in each partition before the shuffle, so hot groups stay small."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The primary rows, or the fallback rows if there are no primary ones, in one lazy plan."""
    both = primary.withColumn("_p", F.lit(0)).unionByName(fallback.withColumn("_p", F.lit(1)))
    return both.join(F.broadcast(both.agg(F.min("_p").alias("_p"))), "_p").drop("_p")


def change_status(df: DataFrame, condition: Column, status: str, now: Column, applied: str = "applied") -> DataFrame:
    """Rows that meet the condition get the status and the time of the change; applied_at is set with the status `applied` only."""
    hit = F.coalesce(condition, F.lit(False))
    applied_at = F.when(hit, now).otherwise(F.col("applied_at")) if status == applied else F.col("applied_at")
    return df.withColumns({"status": F.when(hit, F.lit(status)).otherwise(F.col("status")), "applied_at": applied_at, "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})


def replace_group(old: DataFrame, new: DataFrame, group: str, values: list) -> DataFrame:
    """old without the rows of these groups, and the new rows in their place."""
    return old.where(~F.coalesce(F.col(group).isin(*values), F.lit(False))).unionByName(new)


def merge_columns(old: DataFrame, change: DataFrame, key: str) -> DataFrame:
    """old with the columns that the change has set for its keys, and rows for keys that old lacks."""
    given = [c for c in change.columns if c != key]
    c = change.select(key, *[F.col(x).alias(f"n_{x}") for x in given], F.lit(True).alias("_new"))
    both = old.join(c, key, "full_outer")
    return both.select(key, *[F.when(F.col("_new"), F.col(f"n_{x}")).otherwise(F.col(x)).alias(x) if x in given else F.col(x) for x in old.columns if x != key])


def seen_again(old: DataFrame, new: DataFrame, key: str, update: list[str], now: Column) -> DataFrame:
    """The stored rows after a new sight of some: those are active, updated and seen now; first_seen_at stays as it was."""
    n = new.select(key, *[F.col(c).alias(f"n_{c}") for c in update], F.lit(True).alias("_new"))
    hit = F.coalesce("_new", F.lit(False))
    both = old.join(n, key, "full_outer")
    return both.select(key, *[F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in update], F.coalesce("first_seen_at", now).alias("first_seen_at"), F.when(hit, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"), (hit | F.coalesce("active", F.lit(False))).alias("active"))


def renamed(df: DataFrame, keep: list[str], names: dict[str, str]) -> DataFrame:
    """The kept columns and those of the list under their new names; columns that df lacks are left out."""
    return df.select(*keep, *[F.col(old).alias(new) for old, new in names.items() if old in df.columns])


def as_list(text: Column) -> Column:
    """A list written as a JSON array or with commas, trimmed, without empty items; empty for null."""
    plain = F.coalesce(text, F.lit(""))
    items = F.coalesce(F.from_json(F.when(plain.rlike(r"^\s*\["), plain), "array<string>"), F.split(plain, ","))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def changed(now: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys (a name and a digest of the content) the cache does not have."""
    return now.join(cache.select(*keys).distinct(), keys, "left_anti")


def still_valid(stored_at: Column, now: Column, hours: int) -> Column:
    """Whether a cache of this age may be used; false without a time."""
    return F.coalesce(now - stored_at < F.expr(f"INTERVAL {hours} HOURS"), F.lit(False))


def contained(texts: DataFrame, text: str, names: DataFrame, name: str, size: int = 3) -> DataFrame:
    """The pairs of rows of which the text holds the name: an equality join over pieces of `size` letters, then the exact test.

    Each name is looked for by one piece, its first letters; names shorter than a piece by all they have.
    """
    begun = names.withColumn("_k", F.substring(name, 1, size))
    sizes = F.array(*[F.lit(k) for k in range(1, size + 1)])
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text)))
    pieces = F.array_distinct(F.flatten(F.transform(sizes, lambda k: F.transform(starts, lambda i: F.substring(F.col(text), i, k)))))
    lengths = begun.select(F.length("_k").alias("l")).distinct()
    asked = texts.withColumn("_k", F.explode(pieces)).join(F.broadcast(lengths), F.length("_k") == F.col("l"), "left_semi")
    return asked.join(begun, "_k").where(F.contains(text, name)).drop("_k")
