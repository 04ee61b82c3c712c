"""Figures on a run, taken from the running plan itself.

The functions return what ``seasonal.matched`` and ``dishes.clean_dishes``
return, unsorted, with observations on the way.  Whatever action the result
meets fills these in; no second scan, join or pass over the rules counts
anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tavola.functions import values as V
from tavola.functions.rules import is_dish, is_noise
from tavola.functions.text import clean_name, month_of, strip
from tavola.operators.dishes import merge_spellings


def matched(menus: DataFrame, names: DataFrame) -> tuple[DataFrame, Observation]:
    """``seasonal.matched`` and, once it has run, the figures of ``seasonal.run_metrics``."""
    seen = Observation("matched")
    rows = menus.select(strip(F.coalesce("dish_name", F.lit(""))).alias("dish_name"), F.coalesce("date", F.lit("")).alias("date"))
    known = names.select("dish_name", "canonical_name", F.lit(True).alias("_known"))
    d = rows.join(known, "dish_name", "left").withColumn("month", month_of(F.col("date")))
    blank = (F.col("dish_name") == "") | (F.col("date") == "")
    found = F.coalesce("_known", F.lit(False))
    fits = ~blank & found & F.col("month").isNotNull()
    d = d.observe(
        seen,
        F.count(F.lit(1)).alias("menu_rows"),
        F.count_if(blank).alias("blank"),
        F.count_if(~blank & ~found).alias("unmatched"),
        F.count_if(~blank & found & F.col("month").isNull()).alias("bad_dates"),
        F.count_if(fits).alias("matched"),
    )
    return d.where(fits).select("canonical_name", "date", "month"), seen


def clean_dishes(counts: DataFrame, rules=V.NOISE) -> tuple[DataFrame, list[Observation]]:
    """``dishes.clean_dishes`` without its order and, once it has run, the figures of ``dishes.step_counts`` (see ``figures``)."""
    steps = [Observation(x) for x in ("cleaning", "names", "merging")]
    d = counts.select("count", is_noise(F.col("dish_name"), rules).alias("noise"), clean_name(F.col("dish_name")).alias("dish_name"))
    d = d.withColumn("long", ~F.col("noise") & (F.length("dish_name") > 3)).withColumn("dish", F.col("long") & is_dish(F.col("dish_name")))
    d = d.observe(steps[0], F.count(F.lit(1)).alias("names"), F.count_if(~F.col("noise")).alias("without_noise"), F.count_if("long").alias("cleaned"), F.count_if("dish").alias("dishes"))
    d = d.where("dish").groupBy("dish_name").agg(F.sum("count").alias("count"))
    d = d.observe(steps[1], F.count(F.lit(1)).alias("distinct_names"))
    return merge_spellings(d).observe(steps[2], F.count(F.lit(1)).alias("merged")), steps


def figures(*observations: Observation) -> dict:
    """All figures by name; waits for the action that fills them in."""
    return {k: v for o in observations for k, v in o.get.items()}
