"""Counting, cleaning and merging of dish names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.functions import values as V
from tavola.functions.rules import is_dish, is_noise, noise_reason
from tavola.functions.text import clean_name, fold


def dish_count(menus: DataFrame, name: str = "dish_name") -> DataFrame:
    """``dish_name, count``: how often each name occurs; null names do not count."""
    return menus.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("dish_name")).agg(F.count("*").alias("count"))


def without_noise(counts: DataFrame, rules=V.NOISE) -> DataFrame:
    return counts.where(~is_noise(F.col("dish_name"), rules))


def noise_reasons(counts: DataFrame, rules=V.NOISE) -> DataFrame:
    """``reason, names, occurrences`` of what the noise rules take away."""
    rows = counts.select("count", noise_reason(F.col("dish_name"), rules).alias("reason"))
    # counted, not filtered: a filter on the key would be pushed down and have the rules evaluated twice
    return rows.groupBy("reason").agg(F.count("reason").alias("names"), F.sum("count").alias("occurrences")).where("names > 0")


def cleaned(counts: DataFrame, rules=V.NOISE) -> DataFrame:
    """``dish_name, count``: clean names of dishes with their counts summed, before spellings are merged."""
    rows = without_noise(counts, rules).select(clean_name(F.col("dish_name")).alias("dish_name"), "count")
    rows = rows.where((F.length("dish_name") > 3) & is_dish(F.col("dish_name")))
    return rows.groupBy("dish_name").agg(F.sum("count").alias("count"))


def step_counts(counts: DataFrame, rules=V.NOISE) -> DataFrame:
    """One row on what ``clean_dishes`` does: names that came in, that are no noise, that are long enough once clean, that are dishes, and how many names are left before and after merging."""
    d = counts.select(is_noise(F.col("dish_name"), rules).alias("noise"), clean_name(F.col("dish_name")).alias("c"))
    d = d.withColumn("long", ~F.col("noise") & (F.length("c") > 3)).withColumn("dish", F.col("long") & is_dish(F.col("c")))
    name = F.when(F.col("dish"), F.col("c"))
    return d.agg(F.count("*").alias("names"), F.count_if(~F.col("noise")).alias("without_noise"), F.count_if("long").alias("cleaned"), F.count_if("dish").alias("dishes"), F.count_distinct(name).alias("distinct_names"), F.count_distinct(fold(name)).alias("merged"))


def merge_spellings(counts: DataFrame) -> DataFrame:
    """``dish_name, count``: of names that fold to one key the most frequent stands for all; the longer one if tied, then the lesser."""
    rows = counts.where(F.length("dish_name") >= 4)
    best = F.min(F.struct(-F.col("count"), -F.length("dish_name"), F.col("dish_name").alias("name")))
    return rows.groupBy(fold(F.col("dish_name")).alias("key")).agg(best.alias("best"), F.sum("count").alias("count")).select(F.col("best.name").alias("dish_name"), "count")


def clean_dishes(counts: DataFrame, rules=V.NOISE) -> DataFrame:
    """All steps from counted raw names to merged clean ones, most frequent first."""
    return merge_spellings(cleaned(counts, rules)).orderBy(F.desc("count"), "dish_name")


def case_collisions(names: DataFrame, name: str = "canonical_name") -> DataFrame:
    """``low, spellings``: names that differ in case alone."""
    return names.groupBy(F.lower(name).alias("low")).agg(F.count_distinct(name).alias("spellings")).where("spellings > 1")
