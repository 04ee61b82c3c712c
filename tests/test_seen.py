"""A stream of names against a batch over the same rows."""

import datetime
import random

from pyspark.sql import functions as F

from tavola.operators import seasonal as T
from tavola.streaming.seen import keep_seen, latest_seen

SCHEMA = "canonical_name string, date string, arrived timestamp"


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(folder).withColumn("month", F.split("date", "-")[1].cast("int"))


def drop(spark, folder, rows, n):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}")


def test_restarted_stream_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(900):  # arrivals go on; dates are days or months behind them
        at = start + datetime.timedelta(hours=3 * i)
        day = at - datetime.timedelta(days=rng.choice([0, 0, 1, 5, 90, 400]))
        name = "hot" if rng.random() < 0.4 else f"n{rng.randrange(6)}" if i < 500 else "new"
        rows.append((name, str(day.date()), at))
    rows[7] = (None, *rows[7][1:])
    folder, table, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    seen = []
    for k in range(0, 900, 300):  # the query ends and starts anew on its checkpoint for each part
        for j in range(k, k + 300, 100):
            drop(spark, folder, rows[j : j + 100], j)
        seen += rows[k : k + 300]
        keep_seen(stream(spark, folder), table, check).awaitTermination()
        batch = spark.createDataFrame(seen, SCHEMA).where("canonical_name is not null").withColumn("month", F.split("date", "-")[1].cast("int"))
        want = {r.canonical_name: r.asDict() for r in T.monthly_counts(batch, 1).collect()}
        got = {r.canonical_name: r.asDict() for r in latest_seen(spark, table).collect()}
        gone = {n: g.pop("gone") for n, g in got.items()}
        assert got == want
        now = max(r[2] for r in seen)
        assert gone == {n: max(r[2] for r in seen if r[0] == n) + datetime.timedelta(days=30) < now for n in want}
    assert gone["n1"] and not gone["hot"]
    keep_seen(stream(spark, folder), table, check).awaitTermination()  # nothing new
    assert {r.canonical_name: r.total for r in latest_seen(spark, table).collect()} == {n: w["total"] for n, w in want.items()}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
