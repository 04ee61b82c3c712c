"""Hand-made and published rows, written out here and not taken from the tables of the library."""

import pytest

from tavola.operators import categorize as C
from tavola.operators import partials as P
from tavola.operators import seasonal as T

# Published counts by month, and the summary made of them.
MONTHS = {
    "roston csirkemell": [99, 89, 93, 68, 72, 68, 72, 71, 73, 69, 92, 96],
    "rizibizi": [78, 57, 72, 60, 48, 70, 76, 55, 49, 39, 64, 43],
    "gyümölcsleves": [44, 55, 62, 46, 59, 50, 56, 55, 53, 44, 45, 54],
}
SUMMARY = {
    "roston csirkemell": (962, 1, "tél", 0.147, 284, 233, 211, 234),
    "rizibizi": (711, 1, "tél", 0.21, 178, 180, 201, 152),
    "gyümölcsleves": (623, 3, "tavasz", 0.112, 153, 167, 161, 142),
}


@pytest.mark.parametrize("weekly", [False, True])
def test_published_seasons(spark, tmp_path, weekly):
    rows = [(name, f"2024-{m:02}-{1 + i % 28:02}") for name, counts in MONTHS.items() for m, n in enumerate(counts, 1) for i in range(n)]
    menus = spark.createDataFrame([*rows, ("unknown", "2024-01-01"), ("rizibizi", "2024")], "dish_name string, date string")
    names = T.canonical_map(spark.createDataFrame([(n, n) for n in MONTHS], "dish_name string, canonical_name string"))
    found = T.matched(menus, names)
    if weekly:
        P.replace_weeks(found, f"{tmp_path}/p")
        counts = P.merged(P.read_partials(spark, f"{tmp_path}/p"))
    else:
        counts = T.monthly_counts(found)
    got = {r.canonical_name: (r.total_count, r.peak_month, r.peak_season, r.seasonality_index, r["tél"], r["tavasz"], r["nyár"], r["ősz"]) for r in T.seasonal_summary(counts).collect()}
    assert got == SUMMARY


def test_labels(spark):
    want = {
        "Gulyásleves marhahússal": ("leves", ["marha"], []),
        "Tejfölös lebbencs": ("leves", None, []),
        "Sült hal": ("főétel", ["hal"], ["sült"]),
        "Halászlé": ("főétel", ["hal"], []),
        "Grillezett csirkemell": ("főétel", ["csirke"], ["grillezett"]),
        "Roston pulyka rizzsel": ("főétel", ["csirke"], ["grillezett"]),
        "Bécsi szelet sertéskarajból": ("főétel", ["sertés"], ["bécsi"]),
        "Töltött csirkecomb, sonka": ("főétel", ["csirke", "sertés"], ["töltött"]),
        "Almás rétes": ("desszert", None, []),
        "Tökfőzelék fasírttal": ("főzelék", None, ["fasírozott"]),
        "Salátás tál rántott sajttal": ("saláta", None, ["rántott"]),
    }
    rows = spark.createDataFrame([(n, 1, []) for n in want], "dish_name string, score long, lemmas array<string>")
    for r in C.categorize(rows).collect():
        course, protein, method = want[r.dish_name]
        assert r.course == course and r.cooking_method == method and (protein is None or r.protein == protein), r


def test_repeated_names_and_rivals(spark):
    from tavola.operators import resolve as S

    repeated = spark.createDataFrame([("a", "A"), ("a", "B"), ("a", None), ("b", None)], "dish_name string, canonical_name string")
    assert {r.dish_name: r.canonical_name for r in T.canonical_map(repeated).collect()} == {"a": "a" if "a" > "B" else "B", "b": "b"}
    rows = spark.createDataFrame([("alma körte szilva", 9), ("szilva körte alma", 5), ("körte szilva alma leves", 1), ("rántott szilva alma körte", 1)], "dish_name string, count long")
    out = {r.dish_name: (r.canonical_name, r.match_type) for r in S.resolve(rows, [("rántott szilva", "RS")]).collect()}
    assert out == {"alma körte szilva": ("alma körte szilva", None), "szilva körte alma": ("alma körte szilva", "auto"), "körte szilva alma leves": ("körte szilva alma leves", None), "rántott szilva alma körte": ("RS", "curated")}
