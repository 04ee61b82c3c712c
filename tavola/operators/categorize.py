"""Course, protein and cooking method of dishes, and their distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.functions import values as V
from tavola.functions.rules import all_labels, first_label, labels_or


def categorize(dishes: DataFrame, courses=V.COURSES, default=V.DEFAULT_COURSE, proteins=V.PROTEINS, vegetarian=V.VEGETARIAN, methods=V.METHODS) -> DataFrame:
    """``dish_name, count, lemmas, course, protein, cooking_method`` of ``dishes (dish_name, score, lemmas)``; labels as arrays.

    Words are looked for in the name, a space, and the lemmas.  Rows with a
    blank name go.
    """
    lemmas = F.array_join("lemmas", " ") if dict(dishes.dtypes)["lemmas"].startswith("array") else F.coalesce("lemmas", F.lit(""))
    text = F.concat(F.col("dish_name"), F.lit(" "), lemmas)
    d = dishes.where(F.col("dish_name").isNotNull() & (F.trim("dish_name") != ""))
    return d.select(
        "dish_name",
        F.col("score").alias("count"),
        "lemmas",
        first_label(text, courses, default).alias("course"),
        labels_or(text, proteins, vegetarian).alias("protein"),
        all_labels(text, methods).alias("cooking_method"),
    )


def side_dishes(dishes: DataFrame, sides: list[str] = V.SIDES) -> DataFrame:
    """``dish_name, sides``: all side dishes that the name or its lemmas mention, in the order of the list."""
    lemmas = F.array_join("lemmas", " ") if dict(dishes.dtypes)["lemmas"].startswith("array") else F.coalesce("lemmas", F.lit(""))
    text = F.concat(F.col("dish_name"), F.lit(" "), lemmas)
    return dishes.where(F.col("dish_name").isNotNull()).select("dish_name", all_labels(text, [(s, [s]) for s in sides]).alias("sides"))


def counts(dishes: DataFrame) -> DataFrame:
    """One row on what ``categorize`` does: all rows, those ``skipped`` for a blank name, and those that are left."""
    blank = F.coalesce(F.trim("dish_name"), F.lit("")) == ""
    return dishes.agg(F.count("*").alias("rows"), F.count_if(blank).alias("skipped"), F.count_if(~blank).alias("categorized"))


def joined(categorized: DataFrame) -> DataFrame:
    """Label arrays as comma-joined text, for CSV."""
    return categorized.withColumns({c: F.array_join(c, ",") for c in ("protein", "cooking_method")})


def distribution(categorized: DataFrame) -> DataFrame:
    """``dimension, label, n``: dishes per course, protein and cooking method, in one pass."""
    pairs = F.flatten(
        F.array(
            F.array(F.struct(F.lit("course").alias("dimension"), F.col("course").alias("label"))),
            F.transform("protein", lambda x: F.struct(F.lit("protein").alias("dimension"), x.alias("label"))),
            F.transform("cooking_method", lambda x: F.struct(F.lit("cooking_method").alias("dimension"), x.alias("label"))),
        )
    )
    return categorized.select(F.explode(pairs).alias("x")).select("x.*").where(F.col("label") != "").groupBy("dimension", "label").agg(F.count("*").alias("n"))


def category_stats(categorized: DataFrame) -> DataFrame:
    """One row: total_dishes and a label -> n map per dimension."""
    dist = distribution(categorized)
    maps = [F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("dimension") == d, F.struct("label", "n"))), lambda a, b: F.when(a["n"] != b["n"], b["n"] - a["n"]).otherwise(F.when(a["label"] < b["label"], -1).otherwise(1)).cast("int"))).alias(f"{d}_distribution") for d in ("course", "protein", "cooking_method")]
    total = dist.agg(F.sum(F.when(F.col("dimension") == "course", F.col("n"))).alias("total_dishes"), *maps)
    return total


def label_share(categorized: DataFrame) -> DataFrame:
    """``dimension, label, n, share``: share of all dishes, in percent."""
    dist = distribution(categorized)
    total = dist.where("dimension = 'course'").agg(F.sum("n").alias("total"))
    return dist.crossJoin(F.broadcast(total)).select("dimension", "label", "n", (100.0 * F.col("n") / F.col("total")).alias("share"))
