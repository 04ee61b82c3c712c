"""Monthly counts kept as partials per week, so that a week that comes again replaces itself.

A partial is a row per week, name and month: how often, first and last date.
Sums, minima and maxima of partials are those of the rows, so counts by month,
first and last dates and all that the seasonal summary makes of them come from
the partials, which are far fewer than the rows.  Partials are Parquet,
partitioned by the week; a write replaces just the weeks that it has rows of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.operators.seasonal import MONTHS

_SCHEMA = "canonical_name string, month int, n long, first_seen string, last_seen string, week string"


def week_of(date: Column) -> Column:
    """The Monday of a date's week, as text; of what is no date, the year and month that it has."""
    day = F.try_to_date(F.substring(date, 1, 10), "yyyy-MM-dd")
    return F.coalesce(F.date_format(F.date_trunc("week", day), "yyyy-MM-dd"), F.concat(F.substring_index(date, "-", 2), F.lit("-xx")))


def partials(rows: DataFrame) -> DataFrame:
    """``canonical_name, month, n, first_seen, last_seen, week`` of ``rows (canonical_name, date, month)``."""
    found = rows.groupBy(week_of(F.col("date")).alias("week"), "canonical_name", F.col("month").cast("int").alias("month"))
    out = found.agg(F.count("*").alias("n"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"))
    return out.select("canonical_name", "month", "n", "first_seen", "last_seen", "week")


def replace_weeks(rows: DataFrame, table: str, weeks: list[str] | None = None) -> None:
    """Put the weeks that ``rows (canonical_name, date, month)`` has in place of those that ``table`` has of them; others stay.

    ``weeks``: take the rows of these only, and let those of them go that have
    no row any more.
    """
    spark = rows.sparkSession
    found = partials(rows)
    if weeks is not None:
        found = found.where(F.col("week").isin(weeks))
        for week in set(weeks) - {r.week for r in found.select("week").distinct().collect()}:  # as many as were named
            _drop(spark, table, week)
    # a week goes to the tasks of its own, so each leaves few files
    found.repartition("week").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week").parquet(table)


def _drop(spark: SparkSession, table: str, week: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/week={week}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_partials(spark: SparkSession, table: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).parquet(table)


def merged(found: DataFrame, min_count: int = 10) -> DataFrame:
    """What ``seasonal.monthly_counts`` makes of the rows, from their partials."""
    months = [F.coalesce(F.sum(F.when(F.col("month") == m, F.col("n"))), F.lit(0)).alias(c) for m, c in enumerate(MONTHS, 1)]
    out = found.groupBy("canonical_name").agg(F.sum("n").alias("total"), *months, F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return out.where(F.col("total") >= min_count)
