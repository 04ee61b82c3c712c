"""Reports over resolved dishes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.operators.lemmas import ranked

#: Tier -> least number of occurrences.
TIERS = ((1, 200), (2, 50), (3, 10))


def corpus_totals(menus: DataFrame) -> DataFrame:
    """One row: menu rows, distinct names, first and last date."""
    return menus.agg(F.count("*").alias("menu_rows"), F.count_distinct("dish_name").alias("dishes"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def top_dishes(resolved: DataFrame, k: int | None = None, course: str | None = None) -> DataFrame:
    """``canonical_name, occurrences``, most frequent first; of one course, if given."""
    rows = resolved if course is None else resolved.where(F.col("course") == course)
    out = rows.groupBy("canonical_name").agg(F.sum("count").alias("occurrences")).orderBy(F.desc("occurrences"), "canonical_name")
    return out if k is None else out.limit(k)


def tier_of(n: Column) -> Column:
    """Number of the tier; the next after the last for names below all."""
    return F.coalesce(*[F.when(n >= least, F.lit(t)) for t, least in TIERS], F.lit(len(TIERS) + 1))


def tiers(resolved: DataFrame) -> DataFrame:
    """``tier, dishes, occurrences``."""
    return top_dishes(resolved).groupBy(tier_of(F.col("occurrences")).alias("tier")).agg(F.count("*").alias("dishes"), F.sum("occurrences").alias("occurrences"))


def tier_ranks(resolved: DataFrame, k: int | None = None) -> DataFrame:
    """``tier, rank, canonical_name, occurrences``: all of each tier, or the first ``k``.

    Tiers follow each other in the order of all names, so a rank is the place
    in it less the names of the tiers before; no task has to hold a tier.
    """
    out = ranked(top_dishes(resolved), "occurrences", "canonical_name").withColumn("tier", tier_of(F.col("occurrences")))
    before = out.groupBy("tier").agg((F.min("rank") - 1).alias("before"))  # a row per tier
    out = out.join(F.broadcast(before), "tier").select("tier", (F.col("rank") - F.col("before")).alias("rank"), "canonical_name", "occurrences")
    return out if k is None else out.where(F.col("rank") <= k)


def tier_profile(resolved: DataFrame) -> DataFrame:
    """``tier, dimension, label, occurrences``: what the dishes of each tier are made of."""
    names = top_dishes(resolved).select("canonical_name", tier_of(F.col("occurrences")).alias("tier"))
    pairs = F.flatten(F.array(F.array(F.struct(F.lit("course").alias("dimension"), F.col("course").alias("label"))), F.transform("protein", lambda x: F.struct(F.lit("protein").alias("dimension"), x.alias("label"))), F.transform("cooking_method", lambda x: F.struct(F.lit("cooking_method").alias("dimension"), x.alias("label")))))
    rows = resolved.join(names, "canonical_name").select("tier", "count", F.explode(pairs).alias("x")).select("tier", "count", "x.*")
    return rows.groupBy("tier", "dimension", "label").agg(F.sum("count").alias("occurrences"))
