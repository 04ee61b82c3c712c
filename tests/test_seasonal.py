import csv
import json
import os

import pytest
from pyspark.sql import functions as F

from tavola.operators import reports as P
from tavola.operators import seasonal as T
from tavola.operators import sinks

GOLDEN = os.environ.get("TAVOLA_GOLDEN", "")


def counts(spark, rows):
    cols = ["canonical_name", "total", *T.MONTHS]
    return spark.createDataFrame(rows, "canonical_name string, total long, " + ", ".join(f"{c} long" for c in cols[2:]))


def test_index_and_peak(spark):
    rows = [("flat", 12, *[1] * 12), ("one", 7, *[0] * 4, 7, *[0] * 7), ("tie", 8, 0, 4, 0, 0, 0, 0, 0, 4, 0, 0, 0, 0)]
    got = {r.canonical_name: r for r in T.seasonal_summary(counts(spark, rows)).collect()}
    assert (got["flat"].seasonality_index, got["flat"].peak_month) == (0.0, 1)
    assert (got["one"].seasonality_index, got["one"].peak_season) == (3.317, "tavasz")
    assert got["tie"].peak_month == 2 and got["tie"]["nyár"] == 4


def test_matching_and_min_count(spark):
    menus = spark.createDataFrame([(" a ", "2024-01-02")] * 10 + [("b", "2024-01-02")] * 9 + [("a", "2025"), ("z", "2024-01-01"), ("", "2024-01-01")], "dish_name string, date string")
    names = T.canonical_map(spark.createDataFrame([("a", "A"), ("b", "B")], "dish_name string, canonical_name string"))
    out = T.monthly_counts(T.matched(menus, names)).collect()
    assert [(r.canonical_name, r.total, r.month_01) for r in out] == [("A", 10, 10)]
    assert [r.dish_name for r in T.unmatched(menus, names).collect()] == ["z"]


@pytest.mark.skipif(not GOLDEN, reason="TAVOLA_GOLDEN names a folder with published tables")
def test_published_tables(spark):
    with open(f"{GOLDEN}/dish_monthly_counts.csv", encoding="utf-8", newline="") as f:
        monthly = list(csv.DictReader(f))
    with open(f"{GOLDEN}/dish_seasonal_summary.csv", encoding="utf-8", newline="") as f:
        want = list(csv.DictReader(f))
    with open(f"{GOLDEN}/seasonal_dishes.json", encoding="utf-8") as f:
        report = json.load(f)
    rows = counts(spark, [(r["canonical_name"], int(r["total"]), *[int(r[c]) for c in T.MONTHS]) for r in monthly])
    summary = T.seasonal_summary(rows)
    got = {r.canonical_name: r for r in summary.collect()}
    for w in want:
        g = got[w["canonical_name"]]
        assert (g.total_count, g.peak_month, g.peak_season, g.seasonality_index) == (int(w["total_count"]), int(w["peak_month"]), w["peak_season"], float(w["seasonality_index"]))
    place = spark.createDataFrame([(r["canonical_name"], i) for i, r in enumerate(monthly)], "canonical_name string, place int")
    made = T.seasonal_report(summary.join(place, "canonical_name"), order=["place"]).select(F.to_json(F.struct("*")).alias("j")).first().j
    assert json.loads(made) == report


def test_report_written(spark, tmp_path):
    rows = counts(spark, [("x", 24, *[2] * 12)])
    sinks.write_report(T.seasonal_report(T.seasonal_summary(rows)), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["most_seasonal"][0]["dish"] == "x"


def test_tiers(spark):
    rows = spark.createDataFrame([("a", 150, "leves", ["hal"], []), ("a", 60, "főétel", [], ["sült"]), ("b", 9, "leves", [], [])], "canonical_name string, count long, course string, protein array<string>, cooking_method array<string>")
    assert {tuple(r) for r in P.tiers(rows).collect()} == {(1, 1, 210), (4, 1, 9)}
    assert (1, "protein", "hal", 150) in {tuple(r) for r in P.tier_profile(rows).collect()}
    assert [tuple(r) for r in P.top_dishes(rows, 1, "leves").collect()] == [("a", 150)]
