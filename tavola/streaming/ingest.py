"""Pages as they arrive: the batch operators over file streams.

An extension of the batch engine: page folders grow by a week at a time, and a
stream reads what is new.  Parsing and line rules are row-wise and shared with
the batch path; sections and prices need whole pages, so they run per
micro-batch, which holds whole files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.operators.menus import daily_menus
from tavola.sources.pages import date_of, page_elements


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    """``path, date, content`` of every HTML file that appears in the folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.html").load(folder)
    return files.select("path", date_of(F.col("path")).alias("date"), "content").where("date <> ''")


def ingest(pages: DataFrame, table: str, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None):
    """Start a query that turns arriving pages into menu rows under ``table``, one folder per batch, and stops when nothing is left.

    A batch that is run again after a failure overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = daily_menus(page_elements(batch))
        if sink is not None:
            sink(rows, number)
        else:
            rows.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monthly_stream(rows: DataFrame, ts: str = "ts", key: str = "event_type", late: str = "7 days") -> DataFrame:
    """``key, month, n``: tumbling counts per 30 days of a stream with late data."""
    w = F.window(F.col(ts), "30 days")
    return rows.withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("month"), "n")
