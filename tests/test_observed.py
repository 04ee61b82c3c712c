"""Figures from the running plan equal those of a scan of their own."""

from pyspark.sql import functions as F

from tavola.operators import dishes as D
from tavola.operators import observed as O
from tavola.operators import seasonal as T


def test_matching(spark):
    menus = spark.createDataFrame([(" a ", "2024-01-02"), ("a", "2024-13-02"), ("a", "2025"), ("z", "2024-01-01"), ("", "2024-01-01"), (None, "x"), ("b", None), ("b", "2024-02-03")], "dish_name string, date string")
    names = T.canonical_map(spark.createDataFrame([("a", "A"), ("b", "B")], "dish_name string, canonical_name string"))
    rows, seen = O.matched(menus, names)
    got = sorted(tuple(r) for r in rows.collect())
    assert got == sorted(tuple(r) for r in T.matched(menus, names).collect())
    assert O.figures(seen) == T.run_metrics(menus, names).first().asDict()
    rows, seen = O.matched(menus.limit(0), names)
    assert rows.count() == 0 and O.figures(seen)["menu_rows"] == 0


def test_cleaning(spark):
    lines = ["Rántott hús", "rántott hús!", "rantott hus", "www.x.hu", "12:30-14:00", "abc", "Gulyás leves", "gulyás leves 990 ft", "Kellemes ünnepeket", "xyz"]
    counts = spark.createDataFrame([(x, i + 1) for i, x in enumerate(lines)], "dish_name string, count long")
    rows, seen = O.clean_dishes(counts)
    assert sorted(tuple(r) for r in rows.collect()) == sorted(tuple(r) for r in D.clean_dishes(counts).collect())
    want = D.step_counts(counts).first().asDict()
    want["merged"] = rows.count()  # names of under four characters are left out of merging
    assert O.figures(*seen) == want


def test_one_scan(spark, tmp_path):
    """The table is read once for the result and all figures."""
    spark.range(200).select(F.concat(F.lit("leves "), F.col("id") % 9).alias("dish_name"), F.lit(1).alias("count")).write.parquet(f"{tmp_path}/t")
    rows, _ = O.clean_dishes(spark.read.parquet(f"{tmp_path}/t"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("CollectMetrics") == 3
