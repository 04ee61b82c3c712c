"""Collated comparison, and where keys made of letters differ from it."""

from pyspark.sql import functions as F

from tavola.functions import text as X
from tavola.functions.collated import collated, same_name_join, spellings

HUNGARIAN = "aábcdeéfghiíjklmnoóöőpqrstuúüűvwxyz"


def equal(spark, pairs, key):
    rows = spark.createDataFrame(pairs, "a string, b string")
    return [r.e for r in rows.select((key(F.col("a")) == key(F.col("b"))).alias("e")).collect()]


def test_all_hungarian_letters(spark):
    """Of any two letters, in either case, fold and the collation say the same; strip_accents does so once lower-cased."""
    letters = HUNGARIAN + HUNGARIAN.upper()
    pairs = [(a, b) for a in letters for b in letters]
    by = equal(spark, pairs, collated)
    assert by == equal(spark, pairs, X.fold) == equal(spark, pairs, lambda c: X.strip_accents(F.lower(c)))
    base = dict(zip("áéíóöőúüű", "aeiooouuu", strict=True))
    assert by == [base.get(a.lower(), a.lower()) == base.get(b.lower(), b.lower()) for a, b in pairs]


def test_differences(spark):
    pairs = [("Hús, leves", "hus leves"), ("a  b", "a b"), ("hús", "HUS"), ("ß", "ss"), ("ﬁ", "fi"), ("ģ", "g"), ("ø", "o"), ("é", "é")]
    told = {name: dict(zip(pairs, equal(spark, pairs, key), strict=True)) for name, key in (("fold", X.fold), ("strip", X.strip_accents), ("collated", collated))}
    assert [p for p in pairs if told["fold"][p]] == [("Hús, leves", "hus leves"), ("a  b", "a b"), ("hús", "HUS")]
    assert [p for p in pairs if told["strip"][p]] == []
    assert [p for p in pairs if told["collated"][p]] == pairs[2:]


def test_grouping_and_joining(spark):
    rows = spark.createDataFrame([("Gulyás", 2), ("gulyas", 5), ("GULYÁS", 5), ("Hal", 1), (None, 9)], "dish_name string, count long")
    assert sorted(map(tuple, spellings(rows).collect())) == [("GULYÁS", 12, 3), ("Hal", 1, 1)]
    right = spark.createDataFrame([("gúlyás", "soup"), ("hus", "meat")], "dish_name string, kind string")
    assert sorted(tuple(r) for r in same_name_join(rows, right, "dish_name").collect()) == [("GULYÁS", 5, "soup"), ("Gulyás", 2, "soup"), ("gulyas", 5, "soup")]
    assert spellings(rows.limit(0)).count() == 0
