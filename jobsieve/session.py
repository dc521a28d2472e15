"""Session factory and the checkpoint folder rule."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession


def session(app: str = "jobsieve", cores: str = "8", **conf: str) -> SparkSession:
    """A local session with the settings that every query assumes (UTC, AQE, Arrow).

    On a cluster the caller's session is used as it is; this factory serves tests and the bench.
    """
    settings = {
        "spark.sql.shuffle.partitions": cores,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of spark.checkpoint.dir; a folder of our own only where it is unset on one machine (tests)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        folder = tempfile.mkdtemp(prefix="jobsieve-checkpoint-")
    context.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def kept_folder(spark: SparkSession) -> str:
    """The shared folder itself, for what later runs use again; Spark gives each application a folder of its own below it."""
    return spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark)


def cut_lineage(df):
    """Write df to the checkpoint folder once, so that it is computed once and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _written(df, path: str):
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_once(df):
    """Write df as a table in the checkpoint folder and read it back: like cut_lineage, with columns, sizes and a fresh plan."""
    return _written(df, f"{shared_folder(df.sparkSession)}/jobsieve-{uuid4().hex}")


class Scratch:
    """Tables written while a result is built; they are removed at the end, so that the result must be written by then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_folder(spark)}/scratch-{uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def write(self, df):
        return _written(df, f"{self.path}/{uuid4().hex}")

    def __exit__(self, *_) -> None:
        remove(self.spark, self.path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def finished(spark: SparkSession, path: str) -> list[str]:
    """The folders below a path whose write has ended."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    where = Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    return sorted(s.getPath().toString() for s in files.listStatus(where) if s.isDirectory() and files.exists(Path(s.getPath(), "_SUCCESS")))
