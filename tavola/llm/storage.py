"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Where that is unset, a temporary one on a local master; on a cluster executors would not share it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="tavola-")
    return _OWN["dir"]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, label: str, rows: int | None = None, per_file: int = 250_000) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a scan of it: a lost executor loses nothing.

    ``rows``, where known: it has no more than so many rows, and is written
    by no more tasks than they need, so that small tables are not many files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tavola/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    out = df if rows is None else df.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-rows // per_file)))
    out.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tavola_path = path
    _MADE.append(path)
    if "exit" not in _OWN:
        _OWN["exit"] = "set"
        atexit.register(_forget, spark)
    return out


def release(*frames: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_tavola_path", None)
        if path:
            _delete(df.sparkSession, path)


def tables_made() -> int:
    """How many tables there are so far, for ``release_since``."""
    return len(_MADE)


def release_since(mark: int, keep: DataFrame) -> None:
    """Delete all tables made since ``mark`` but ``keep``: what it was made of is read no more."""
    for path in _MADE[mark:]:
        if path != keep._tavola_path:
            _delete(keep.sparkSession, path)
    _MADE[mark:] = [keep._tavola_path]


def _forget(spark: SparkSession) -> None:
    """Leave nothing of this application behind."""
    try:
        _delete(spark, f"{shared_dir(spark)}/tavola/{spark.sparkContext.applicationId}")
    except Exception:  # the JVM may be gone
        pass


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(docs: DataFrame, size: str = "4m") -> DataFrame:
    """``docs``, whose session now sends rows to Python in batches of ``size``, unless it has set a bound of its own.

    By default they may be 64 MB, which the JVM and each worker hold at once.
    """
    conf = docs.sparkSession.conf
    if conf.get(_BATCH) in ("67108864b", "64m", "64MB"):
        conf.set(_BATCH, size)
    return docs


def fits_broadcast(df: DataFrame, limit: int = 64 << 20) -> bool:
    """Whether the optimizer's size estimate of ``df`` (a scan or a filter of one) is proven under ``limit`` bytes."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes())) <= limit
