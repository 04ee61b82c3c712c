"""Cutting lineage so that lost executors cost nothing twice."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, label: str) -> str:
    """The path of a new folder under ``spark.checkpoint.dir``, which is to stay; temporary on a local master without such."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def _own_folder(spark: SparkSession) -> str:
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="tavola-")
    atexit.register(shutil.rmtree, own, True)
    return f"file://{own}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint in the folder of ``spark.checkpoint.dir``.

    Where that is unset, in a temporary one on a local master; on a cluster
    executors would not share it, so it must be set there.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark)
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within, what a query has shuffled is deleted when it ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, had)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` from Parquet in the folder of ``cut``: smaller than a checkpoint, which keeps rows as they are in memory.  Deleted at the end of the session's Python."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, keys: DataFrame, how: str, on: str = "row", most: int = 1_000_000) -> DataFrame:
    """Semi or anti join of ``df``, whose rows are large, with the stored table ``keys``: up to ``most`` keys go to all executors, so that ``df`` is not shuffled for them."""
    return df.join(F.broadcast(keys) if keys.count() <= most else keys, on, how)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone
        pass
