"""Registered queries over small tables: they read all rows."""

import datetime

import __spark_entry__ as entry
from tavola.operators import reports as P


def test_words_that_occur_once(spark, tmp_path):
    spark.createDataFrame([(1, "a a b"), (2, "a\nc ...")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = entry.queries()["lemma_dictionary"](spark, str(tmp_path)).collect()
    assert sorted((r["rank"], r.lemma, r.frequency) for r in rows) == [(1, "a", 3), (2, "b", 1), (3, "c", 1)]
    s = entry.queries()["lemma_stats"](spark, str(tmp_path)).first()
    assert (s.unique_lemmas, s.occurrences, s.hapaxes, s.most_frequent, s.least_frequent) == (3, 5, 2, "a", "c")
    assert abs(s.hapax_percent - 200 / 3) < 1e-9


def test_seasons_of_all_dishes(spark, tmp_path):
    day = datetime.date(2024, 7, 1)
    spark.createDataFrame([(1, 1, day)] * 50 + [(2, 1, day)] * 60, "l_partkey long, l_suppkey long, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "apple"), (2, "zucchini")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, "s")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    got = lambda name, dish: {r[dish]: r for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    for name, dish, n in [("monthly_counts", "canonical_name", "total"), ("seasonal_summary", "canonical_name", "total_count"), ("most_seasonal", "dish", "total"), ("season_peakers", "dish", "total")]:
        assert {k: r[n] for k, r in got(name, dish).items()} == {"apple": 50, "zucchini": 60}, name
    assert set(got("top_per_season", "dish")) == {"apple", "zucchini"}
    assert set(got("unmatched_rows", "dish_name")) == {"zucchini"}  # its dimension stays a part of the names


def test_ranks_of_whole_tiers(spark):
    rows = [(f"n{i:03}", 10 + i % 7) for i in range(130)] + [(f"r{i:03}", 1 + i % 3) for i in range(120)] + [("top", 500)]
    got = [tuple(r) for r in P.tier_ranks(spark.createDataFrame(rows, "canonical_name string, count long")).collect()]
    want = []
    for tier, low, high in [(1, 200, 1 << 30), (3, 10, 50), (4, 0, 10)]:
        own = sorted((x for x in rows if low <= x[1] < high), key=lambda x: (-x[1], x[0]))
        want += [(tier, i, name, n) for i, (name, n) in enumerate(own, 1)]
    assert sorted(got) == want
    few = [tuple(r) for r in P.tier_ranks(spark.createDataFrame(rows, "canonical_name string, count long"), 2).collect()]
    assert sorted(few) == [r for r in want if r[1] <= 2]
