"""When each name was first and last seen and how often per month, kept as a stream goes.

The clock of the stream is when rows arrive, so rows about days long past
count, too, and the totals equal those of a batch over all rows.  A timer per
name tells when none has arrived for a while: the name is then gone, until it
comes again.  Tasks sum up their rows per name and month before these are
dealt out, so a name that a third of all rows has sends few.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tavola.operators.seasonal import MONTHS

_KEPT = T.StructType([T.StructField("seq", T.LongType()), T.StructField("total", T.LongType()), *[T.StructField(m, T.LongType()) for m in MONTHS], T.StructField("first_seen", T.StringType()), T.StructField("last_seen", T.StringType()), T.StructField("arrived", T.LongType()), T.StructField("timer", T.LongType())])
SEEN = "canonical_name string, seq long, total long, " + ", ".join(f"{m} long" for m in MONTHS) + ", first_seen string, last_seen string, gone boolean"
_PART = pa.schema([("canonical_name", pa.string()), ("month", pa.int32()), ("n", pa.int64()), ("first_seen", pa.string()), ("last_seen", pa.string()), ("arrived", pa.timestamp("us", "UTC"))])
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


_ROW = Row("canonical_name", "seq", "total", *MONTHS, "first_seen", "last_seen", "gone")


class _Seen(StatefulProcessor):
    """Totals of a name in one value; its timer stands at the last arrival plus the time after which it is gone."""

    def __init__(self, quiet_ms: int):
        self.quiet = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("seen", _KEPT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        had = self.kept.get() if self.kept.exists() else None
        seq, total, months = (had[0], had[1], list(had[2:14])) if had else (0, 0, [0] * 12)
        first, last, arrived, timer = had[14:18] if had else (None, None, 0, None)
        for r in rows:
            total += r.n
            if 1 <= r.month <= 12:
                months[r.month - 1] += r.n
            first = r.first_seen if first is None else min(first, r.first_seen)
            last = r.last_seen if last is None else max(last, r.last_seen)
            arrived = max(arrived, int(r.arrived.timestamp() * 1000))
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(arrived + self.quiet)
        self.kept.update((seq + 1, total, *months, first, last, arrived, arrived + self.quiet))
        yield _ROW(key[0], seq + 1, total, *months, first, last, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seq, total, *rest = self.kept.get()
        self.kept.update((seq + 1, total, *rest[:-1], None))
        yield _ROW(key[0], seq + 1, total, *rest[:14], True)

    def close(self) -> None:
        pass


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per name and month of what a task reads, or of as much as it may hold."""
    held: dict = {}

    def flush() -> pa.RecordBatch:
        cols = list(zip(*((*k, *v) for k, v in held.items()), strict=True)) or [()] * len(_PART)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PART, strict=True)], schema=_PART)

    for b in batches:
        for name, month, date, arrived in zip(*(c.to_pylist() for c in b.columns), strict=True):
            n, first, last, late = held.get((name, month), (0, date, date, arrived))
            held[name, month] = (n + 1, min(first, date), max(last, date), max(late, arrived))
        if len(held) > 100_000:
            yield flush()
            held = {}
    yield flush()


def seen_rows(rows: DataFrame, quiet: str = "30 days", late: str = "0 seconds") -> DataFrame:
    """Of a stream ``rows (canonical_name, date, month, arrived)``: a row per change of a name, with ``seq`` rising, its totals so far, and whether it is ``gone``.

    ``arrived`` (a timestamp) is the stream's clock.  Rows that arrive more
    than ``late`` behind it are lost, as with any watermark; how old their
    dates are does not matter.  Rows without name, month or arrival are left
    out.  ``quiet``: gone is what nothing arrived of for so long.
    """
    spark = rows.sparkSession
    quiet_ms = spark.sql(f"SELECT unix_millis(TIMESTAMP '2001-01-01' + INTERVAL {quiet}) - unix_millis(TIMESTAMP '2001-01-01') AS q").first().q
    own = rows.select("canonical_name", F.col("month").cast("int").alias("month"), F.col("date").cast("string").alias("date"), F.col("arrived").cast("timestamp").alias("arrived"))
    own = own.where("canonical_name is not null and month is not null and arrived is not null and date is not null")
    parts = own.mapInArrow(_summed, "canonical_name string, month int, n long, first_seen string, last_seen string, arrived timestamp")
    return parts.withWatermark("arrived", late).groupBy("canonical_name").transformWithState(_Seen(quiet_ms), SEEN, "update", "eventTime")


def keep_seen(rows: DataFrame, table: str, checkpoint: str, quiet: str = "30 days", late: str = "0 seconds"):
    """Start the stream into ``table``, a folder per batch, and stop when nothing is left.  Started again on the same checkpoint it goes on; a batch that runs again replaces its folder."""
    spark = rows.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    had = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the one that timers need; the query keeps it
    try:
        return seen_rows(rows, quiet, late).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(_PROVIDER) if had is None else spark.conf.set(_PROVIDER, had)


def latest_seen(spark: SparkSession, table: str) -> DataFrame:
    """The last row of each name."""
    rows = spark.read.schema(SEEN).parquet(f"{table}/batch=*")
    cols = [c for c in rows.columns if c != "canonical_name"]
    return rows.groupBy("canonical_name").agg(F.max_by(F.struct(*cols), "seq").alias("x")).select("canonical_name", "x.*").drop("seq")
