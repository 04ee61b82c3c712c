"""Files that tasks write themselves, in the folder that the driver and all executors share.

Paths are plain or of a scheme that pyarrow knows (``file``, ``hdfs``, ``s3``,
``gs``).  A file gets its name only once it is whole: a task writes beside it,
under a name that no other attempt has, and moves it.  So a task that runs
again, or two at once, leave one whole file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import shared_dir


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; it stays."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    make_folder(path)
    return path


def make_folder(path: str) -> None:
    store, at = place(path)
    store.create_dir(at, recursive=True)


def remove_folder(path: str) -> None:
    store, at = place(path)
    if store.get_file_info(at).type != fs.FileType.NotFound:
        store.delete_dir(at)


@contextmanager
def whole_file(path: str, work: str) -> Iterator:
    """A stream whose bytes become the file ``path`` at the end; until then they are in the folder ``work``."""
    store, at = place(path)
    _, own = place(f"{work}/{uuid.uuid4().hex}")
    with store.open_output_stream(own) as out:
        yield out
    store.move(own, at)


def one_task_each(rows: DataFrame, number: str, n: int) -> DataFrame:
    """``rows``, each number from 0 to ``n - 1`` in a task of its own."""
    return rows.repartitionById(max(n, 1), F.col(number).cast("int"))


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m", records: int | None = None) -> Iterator[None]:
    """Within, rows go to Python in batches of ``size`` bytes; afterwards as before.  For jobs that run within."""
    want = {"spark.sql.execution.arrow.maxBytesPerBatch": size} | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(records)} if records else {})
    had = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def running_totals(parts: DataFrame, key: str, count: str, before: str, total: str) -> DataFrame:
    """``parts``, a row per partition or file, with the sum of ``count`` over all rows of lesser ``key`` and over all rows."""
    from pyspark.sql import Window

    up = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumns({before: F.coalesce(F.sum(count).over(up), F.lit(0)), total: F.sum(count).over(Window.partitionBy())})
