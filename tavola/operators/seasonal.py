"""Monthly counts, seasonality and reports by season."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.functions import values as V
from tavola.functions.text import month_of, strip

MONTHS = [f"month_{m:02d}" for m in range(1, 13)]


def canonical_map(resolved: DataFrame) -> DataFrame:
    """``dish_name, canonical_name``, one row per name; without a canonical column names stand for themselves."""
    if "canonical_name" not in resolved.columns:
        return resolved.select("dish_name", F.col("dish_name").alias("canonical_name")).distinct()
    return resolved.groupBy("dish_name").agg(F.max(F.coalesce("canonical_name", "dish_name")).alias("canonical_name"))


def matched(menus: DataFrame, names: DataFrame) -> DataFrame:
    """``canonical_name, date, month`` of menu rows whose stripped name is in ``names`` and whose date has a month."""
    rows = menus.select(strip(F.col("dish_name")).alias("dish_name"), "date").where("dish_name <> '' and date <> ''")
    return rows.join(names, "dish_name").select("canonical_name", "date", month_of(F.col("date")).alias("month")).where("month is not null")


def unmatched(menus: DataFrame, names: DataFrame) -> DataFrame:
    """Menu rows whose name is in no row of ``names``."""
    rows = menus.where((F.coalesce("dish_name", F.lit("")) != "") & (F.coalesce("date", F.lit("")) != ""))
    return rows.withColumn("dish_name", strip(F.col("dish_name"))).join(names.select("dish_name"), "dish_name", "left_anti")


def run_metrics(menus: DataFrame, names: DataFrame) -> DataFrame:
    """One row on what ``matched`` does: all rows, blank ones, those of unknown names, those with bad dates, and those that are matched."""
    rows = menus.select(strip(F.coalesce("dish_name", F.lit(""))).alias("dish_name"), F.coalesce("date", F.lit("")).alias("date"))
    known = names.select("dish_name", F.lit(True).alias("_known"))
    d = rows.join(known, "dish_name", "left")
    blank = (F.col("dish_name") == "") | (F.col("date") == "")
    found, month = F.col("_known").isNotNull(), month_of(F.col("date")).isNotNull()
    return d.agg(F.count("*").alias("menu_rows"), F.count_if(blank).alias("blank"), F.count_if(~blank & ~found).alias("unmatched"), F.count_if(~blank & found & ~month).alias("bad_dates"), F.count_if(~blank & found & month).alias("matched"))


def monthly_counts(rows: DataFrame, min_count: int = 10) -> DataFrame:
    """``canonical_name, total, month_01 .. month_12, first_seen, last_seen`` of ``rows (canonical_name, date, month)``; one shuffle."""
    months = [F.count_if(F.col("month") == m).alias(c) for m, c in enumerate(MONTHS, 1)]
    out = rows.groupBy("canonical_name").agg(F.count("*").alias("total"), *months, F.min("date").alias("first_seen"), F.max("date").alias("last_seen"))
    return out.where(F.col("total") >= min_count)


def season_of(month: Column) -> Column:
    return F.coalesce(*[F.when(month.isin(ms), F.lit(s)) for s, ms in V.SEASONS])


def season_totals(counts: DataFrame) -> list[Column]:
    return [sum((F.col(MONTHS[m - 1]) for m in ms[1:]), F.col(MONTHS[ms[0] - 1])).alias(s) for s, ms in V.SEASONS]


def seasonal_summary(counts: DataFrame) -> DataFrame:
    """``canonical_name, total_count, peak_month, peak_season, seasonality_index, first_seen, last_seen`` and a column per season.

    The index is the population deviation of the months over their mean, 0 if
    nothing was counted; the first of equal months is the peak.
    """
    arr = F.array(*MONTHS)
    mean = F.aggregate(arr, F.lit(0).cast("long"), lambda a, x: a + x) / 12
    var = F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))) / 12
    peak = F.array_position(arr, F.array_max(arr)).cast("int")
    seen = [F.col(c) if c in counts.columns else F.lit(None).cast("string").alias(c) for c in ("first_seen", "last_seen")]
    d = counts.withColumn("_mean", mean)
    return d.select(
        "canonical_name",
        F.col("total").alias("total_count"),
        peak.alias("peak_month"),
        season_of(peak).alias("peak_season"),
        F.when(F.col("_mean") > 0, F.round(F.sqrt(var) / F.col("_mean"), 3)).otherwise(0.0).alias("seasonality_index"),
        *seen,
        *season_totals(counts),
    )


def top_per_season(summary: DataFrame, k: int = 20, order: list[str] | None = None) -> DataFrame:
    """``season, rank, dish, count, seasonality``: the ``k`` most counted of each season; ties by ``order`` (total, then name).

    The best of each season and slice of names come first, so no task sorts a
    season's names as a whole.
    """
    tie = [F.desc("total_count"), F.asc("canonical_name")] if order is None else [F.asc(c) for c in order]
    long = summary.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.lit(s).alias("season"), F.col(s).alias("n")) for i, (s, _) in enumerate(V.SEASONS)])).alias("x")).select("*", "x.*")
    slice_ = Window.partitionBy("season", F.pmod(F.xxhash64("canonical_name"), F.lit(64))).orderBy(F.desc("n"), *tie)
    few = long.withColumn("_r", F.row_number().over(slice_)).where(F.col("_r") <= k)
    best = Window.partitionBy("season").orderBy(F.desc("n"), *tie)
    out = few.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("season", "rank", F.col("canonical_name").alias("dish"), F.col("n").alias("count"), F.col("seasonality_index").alias("seasonality"))


def most_seasonal(summary: DataFrame, min_count: int = 10, k: int = 30, order: list[str] | None = None) -> DataFrame:
    """The ``k`` of greatest index among those counted twice ``min_count`` times or more; ties by ``order`` (total, then name)."""
    tie = [F.desc("total_count"), F.asc("canonical_name")] if order is None else [F.asc(c) for c in order]
    rows = summary.where(F.col("total_count") >= 2 * min_count).orderBy(F.desc("seasonality_index"), *tie).limit(k)
    return rows.select(F.col("canonical_name").alias("dish"), "peak_season", "peak_month", "seasonality_index", F.col("total_count").alias("total"))


def seasonal_report(summary: DataFrame, min_count: int = 10, order: list[str] | None = None) -> DataFrame:
    """One row: ``top_per_season`` (season -> list) and ``most_seasonal`` (list)."""
    item = F.struct("rank", "dish", "count", "seasonality")
    tops = top_per_season(summary, order=order).groupBy("season").agg(F.array_sort(F.collect_list(item)).alias("l"))
    tops = tops.select("season", F.transform("l", lambda x: F.struct(x["dish"].alias("dish"), x["count"].alias("count"), x["seasonality"].alias("seasonality"))).alias("l"))
    one = tops.agg(F.map_from_entries(F.collect_list(F.struct("season", "l"))).alias("top_per_season"))
    most = most_seasonal(summary, min_count, order=order).agg(F.collect_list(F.struct("dish", "peak_season", "peak_month", "seasonality_index", "total")).alias("most_seasonal"))
    return one.crossJoin(most)  # one row each


def season_peakers(summary: DataFrame, min_total: int = 50, k: int = 5) -> DataFrame:
    """``peak_season, rank, dish, total, seasonality_index``: of names that peak in a season the ``k`` of greatest index."""
    w = Window.partitionBy("peak_season").orderBy(F.desc("seasonality_index"), F.desc("total_count"), F.asc("canonical_name"))
    out = summary.where(F.col("total_count") >= min_total).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select("peak_season", "rank", F.col("canonical_name").alias("dish"), F.col("total_count").alias("total"), "seasonality_index")
