"""Menus laid out for joins that come again and again.

Every week's run joins the menus with the names that are known by then.  A
table bucketed and sorted by the stripped name meets them without being
shuffled or sorted anew: only the names, the small side, are dealt out into
the same buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.functions.text import month_of, strip


def write_menus(menus: DataFrame, table: str, folder: str, buckets: int = 64) -> None:
    """``menus (date, dish_name, ...)`` as the catalogue's ``table`` in ``folder``, bucketed by stripped name; blank names and dates are left out.

    ``buckets``: so many that one fits into a task's memory.  A name with more
    rows than that is still one bucket, whose tasks can be split by none; use
    ``seasonal.matched`` for such.
    """
    rows = menus.withColumn("dish_name", strip(F.col("dish_name"))).where("dish_name <> '' and date <> ''")
    dealt = rows.repartition(buckets, "dish_name")  # one file per bucket
    dealt.write.mode("overwrite").option("path", folder).bucketBy(buckets, "dish_name").sortBy("dish_name").saveAsTable(table)


def matched_again(spark: SparkSession, table: str, names: DataFrame) -> DataFrame:
    """``seasonal.matched`` of the laid out menus; no exchange on their side."""
    return spark.table(table).join(names.hint("merge"), "dish_name").select("canonical_name", "date", month_of(F.col("date")).alias("month")).where("month is not null")
