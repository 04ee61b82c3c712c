"""Monthly partials: merged they are the counts of all rows, whatever came again."""

import datetime
import glob
import random

from pyspark.sql import functions as F

from tavola.operators import partials as P
from tavola.operators import seasonal as T


def menu(rng, n, first="2024-01-01"):
    day = datetime.date.fromisoformat(first)
    return [(f"n{rng.randrange(8)}", str(day + datetime.timedelta(days=rng.randrange(120)))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "canonical_name string, date string").withColumn("month", F.split("date", "-")[1].cast("int"))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("canonical_name", "total", *T.MONTHS, "first_seen", "last_seen").collect())


def test_weeks_replace_themselves(spark, tmp_path):
    rng = random.Random(2)
    table = f"{tmp_path}/p"
    rows = [*menu(rng, 300), ("n1", "2024-05"), ("n1", "2024-07-99"), ("n2", "2024-12-31"), ("n2", "2025-01-01")]
    full = T.monthly_counts(frame(spark, rows), 5)
    P.replace_weeks(frame(spark, rows), table)
    assert rows_of(P.merged(P.read_partials(spark, table), 5)) == rows_of(full)
    # a week that comes again, with other rows; all other weeks stay as they are
    monday = datetime.date(2024, 2, 5)
    week = {str(monday + datetime.timedelta(days=i)) for i in range(7)}
    again = [("n3", "2024-02-06"), ("new", "2024-02-11"), ("new", "2024-02-05")]
    files = set(glob.glob(f"{table}/*/*.parquet"))
    for _ in range(2):
        P.replace_weeks(frame(spark, again), table)
    left = [r for r in rows if r[1] not in week] + again
    assert rows_of(P.merged(P.read_partials(spark, table), 1)) == rows_of(T.monthly_counts(frame(spark, left), 1))
    assert all("week=2024-02-05" in f for f in files - set(glob.glob(f"{table}/*/*.parquet")))
    # a week named without rows goes
    P.replace_weeks(frame(spark, []), table, ["2024-02-05"])
    left = [r for r in rows if r[1] not in week]
    assert rows_of(P.merged(P.read_partials(spark, table), 1)) == rows_of(T.monthly_counts(frame(spark, left), 1))
    a, b = (T.seasonal_summary(x).orderBy("canonical_name").collect() for x in (P.merged(P.read_partials(spark, table), 1), T.monthly_counts(frame(spark, left), 1)))
    assert a == b


def test_nothing_yet(spark, tmp_path):
    assert P.merged(P.read_partials(spark, f"{tmp_path}/none")).count() == 0
    P.replace_weeks(frame(spark, []), f"{tmp_path}/e")
    assert P.merged(P.read_partials(spark, f"{tmp_path}/e")).count() == 0
