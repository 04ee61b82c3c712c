"""Pairs of token sets that may be similar: none is lost, and those that meet by chance end before the shuffle."""

import random

import pytest

import __spark_entry__ as entry
from tavola.operators import resolve as S
from tavola.operators.nearsets import bands, near_pairs


def alike(sets, num):
    return {(i, j) for i, s in sets.items() for j, t in sets.items() if i < j and s != t and 1000 * len(s & t) >= num * len(s | t)}


def frame(spark, sets, fresh=lambda i: True):
    return spark.createDataFrame([(i, sorted(s), fresh(i)) for i, s in sets.items()], "id long, tokens array<string>, fresh boolean").repartition(3)


@pytest.mark.parametrize("num", [500, 850, 950])
def test_no_pair_is_lost(spark, num):
    rng, words, sets = random.Random(num), [f"w{i}" for i in range(4000)], {}
    for size in [1, 2, 5, 6, 7, 8, 11, 12, 16, 17, 33, 34, 60, 61, 128, 129, 180, 400, 1500]:
        own = rng.sample(words, size)
        for _ in range(8):
            gone = rng.randint(0, max(1, size * (1000 - num) // 1000))
            sets[len(sets)] = frozenset(own[gone:]) | set(rng.sample(words, rng.randint(0, max(1, size * (1000 - num) // 2000))))
    want = alike(sets, num)
    got = {tuple(r) for r in near_pairs(frame(spark, sets), num).collect()}
    assert want and want <= got
    later = lambda i: i % 4 == 3
    some = {tuple(r) for r in near_pairs(frame(spark, sets, later), num).collect()}
    assert {p for p in want if later(p[0]) or later(p[1])} <= some and all(later(a) or later(b) for a, b in some)


def test_sets_that_meet_by_chance_are_few(spark):
    """Texts of common words share tokens of their prefixes with nearly all others."""
    rng, words = random.Random(3), [f"w{i}" for i in range(900)]
    sets = {i: frozenset(rng.sample(words, rng.randint(150, 260))) for i in range(600)}
    for i in range(40):
        sets[600 + i] = sets[i] - {next(iter(sets[i]))}
    want = alike(sets, 850)
    got = near_pairs(frame(spark, sets), 850).count()
    assert len(want) == 40 <= got < 120
    assert {tuple(r) for r in S.similar_pairs(frame(spark, sets)).collect()} == want


def test_bands_follow_each_other():
    found = bands(5000)
    assert found[0][0] == 1 and all(a[1] + 1 == b[0] for a, b in zip(found, found[1:], strict=False)) and found[-1][1] >= 5000


def test_copies_are_one_class(spark, tmp_path):
    text = "alma körte szilva barack meggy cseresznye dió mogyoró mák rizs"
    rows = [(7, text), (3, " ".join(reversed(text.split()))), (9, text), (5, f"{text} leves"), (1, None), (2, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in entry.queries()["jaccard_pairs"](spark, str(tmp_path)).collect()] == [(3, 5)]


def test_names_in_several_rows(spark):
    """Counts of a name add up, and only names that have others like them are sorted."""
    a, b, c = ("alma körte szilva barack meggy cseresznye dió mogyoró", "dió alma körte szilva barack meggy cseresznye mogyoró", "alma körte szilva barack meggy cseresznye dió mogyoró mák")
    rows = [(a, 1), (b, 2), (a, 2), (c, 1), ("más", 5), (None, 4), ("!", 9), (c, 3)]
    df = spark.createDataFrame(rows, "dish_name string, count long").repartition(3)
    assert sorted(tuple(r) for r in S.auto_groups(df, lemmas=None).collect()) == sorted([(a, c), (b, c)])
