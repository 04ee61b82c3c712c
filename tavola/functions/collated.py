"""Comparison without case and accents by Spark's collations.

A collated column groups, joins, sorts and compares by the letters beneath
case and accents, and shows its text as it is.  ``fold`` and ``strip_accents``
make keys in place of that; where they differ is told by ``test_collated``:
``fold`` takes punctuation and spaces out as well, ``strip_accents`` keeps
case and knows its table's letters only, and the collation also takes letters
apart that no table lists, and ligatures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLLATION = "UNICODE_CI_AI"


def collated(col: Column | str) -> Column:
    """The text as one that equals all spellings that differ in case and accents alone."""
    return F.collate(F.col(col) if isinstance(col, str) else col, COLLATION)


def spellings(names: DataFrame, name: str = "dish_name", count: str | None = "count") -> DataFrame:
    """``name, count, spellings``: names that are one but for case and accents, under the most frequent spelling, the least of equals; one shuffle.

    ``count``: the column that is added up, or None to count rows.
    """
    n = F.lit(1) if count is None else F.col(count)
    each = names.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("one")).agg(F.sum(n).cast("long").alias("n"))
    groups = each.groupBy(collated("one").alias("key"))
    best = F.min(F.struct(-F.col("n"), F.col("one")))
    return groups.agg(best.alias("best"), F.sum("n").alias("count"), F.count("*").alias("spellings")).select(F.col("best.one").alias("name"), "count", "spellings")


def same_name_join(left: DataFrame, right: DataFrame, name: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``name``, case and accents aside; the left spelling stays."""
    key = right.withColumn("_key", collated(name)).drop(name)
    return left.withColumn("_key", collated(name)).join(key, "_key", how).drop("_key")
