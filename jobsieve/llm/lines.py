"""Lines of same-host pages as nodes: normal form, keys, counts and the look-up of a counted node from every page."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from jobsieve.session import write_once

#: A table of nodes is sent to all workers up to so many rows (24 bytes each); beyond, pages and nodes are joined.
SENT_ROWS = 2_000_000
#: Nodes with at least this share of all occurrences are joined apart; there are at most 1 / HOT of them.
HOT = 1e-4

TAG = re.compile(r"</?(?:p|li|ul|ol|br|div|b|i|em|strong|h\d)\b[^<>]*>", re.I)
_NUMBER = re.compile(r"\d[\da-f]*")


def host(url: Column) -> Column:
    """The host of a URL in lower case without www; empty for null or odd values."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:\s]+)", 1)), r"^www\.", "")


def normalised(line: str) -> str:
    """Tags dropped, blanks squeezed, lower case, numbers folded."""
    if "<" in line:
        line = TAG.sub(" ", line)
    return _NUMBER.sub("0", " ".join(line.split()).lower())


def key(host_: str, content: str = "") -> int:
    """The node of a line of a host; without a line the host itself."""
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{host_}\n{content}".encode("utf-8", "surrogatepass")) - 2**63


def counted(batch_keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a batch and how often each occurs, so that less is shuffled."""
    return np.unique(np.array(batch_keys, dtype=np.int64), return_counts=True)


def _from_sent(pages: DataFrame, lists: list[str], table: DataFrame, values: list[str]) -> DataFrame:
    nodes = table.toPandas()
    nodes = nodes.sort_values("key")
    shared = pages.sparkSession.sparkContext.broadcast((nodes["key"].to_numpy(np.int64), [nodes[v].to_numpy(np.float64) for v in values]))
    names = [f"{c}_{v}" for c in lists for v in values]
    schema = StructType([*pages.schema.fields, *[StructField(n, ArrayType(DoubleType())) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, columns = shared.value
        for batch in batches:
            arrays = list(batch.columns)
            for c in lists:
                own = batch.column(batch.schema.get_field_index(c))
                offsets = own.offsets
                flat = own.values.to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(keys, flat), max(0, len(keys) - 1))
                hit = keys[at] == flat if len(keys) else np.zeros(len(flat), dtype=bool)
                for v in columns:
                    arrays.append(pa.ListArray.from_arrays(offsets, pa.array(np.where(hit, v[at] if len(v) else 0.0, np.nan), pa.float64())))
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, *names])

    return pages.mapInArrow(run, schema)


def _from_join(pages: DataFrame, lists: list[str], table: DataFrame, values: list[str]) -> DataFrame:
    """The same by joins: nodes that many lines share are few and go to all workers, so that no key of the shuffled join is hot."""
    pages = write_once(pages.withColumn("_page", F.expr("uuid()")))
    out = pages
    for c in lists:
        cells = pages.select("_page", F.posexplode(c).alias("_at", "key"))
        total = cells.count()
        hot = cells.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") >= max(2.0, HOT * total)).select("key")
        hot = write_once(hot)
        # At most 1 / HOT keys are hot, whatever the size of the corpus.
        far = table.join(F.broadcast(hot), "key", "left_anti")
        near = table.join(F.broadcast(hot), "key", "left_semi")
        warm = cells.join(F.broadcast(hot), "key", "left_semi").join(F.broadcast(near), "key", "left")
        cold = cells.join(F.broadcast(hot), "key", "left_anti").join(far, "key", "left")
        rows = warm.unionByName(cold).groupBy("_page").agg(F.array_sort(F.collect_list(F.struct("_at", *[F.coalesce(F.col(v).cast("double"), F.lit(float("nan"))).alias(v) for v in values]))).alias("_cells"))
        out = out.join(rows.select("_page", *[F.col(f"_cells.{v}").alias(f"{c}_{v}") for v in values]), "_page")
    return out.drop("_page")


def looked_up(pages: DataFrame, lists: list[str], table: DataFrame, values: list[str], sent_rows: int = SENT_ROWS) -> DataFrame:
    """pages with columns <list>_<value>: for each key in the list columns its values in table (key, values...), NaN where it has none.

    The table is sent to all workers if it is no longer than sent_rows, and joined if it is.
    """
    return (_from_sent if table.count() <= sent_rows else _from_join)(pages, lists, table, values)
