import pytest
from pyspark.sql import functions as F

from tavola.functions import rules as R
from tavola.functions import text as X
from tavola.functions import values as V


def one(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("t"))).collect()]


SCRUB = [
    (None, ""),
    ("  Húsleves  tésztával ", "Húsleves tésztával"),
    ("Rántott sajt + 100 Ft doboz", "Rántott sajt"),
    ("Pörkölt (990 Ft)", "Pörkölt"),
    ("Pörkölt 990 Ft, jó", "Pörkölt"),
    ("Gulyás Tel: 06-30 123 4567", "Gulyás"),
    ("Gulyás Kiszállítás ingyen ma", "Gulyás"),
    ("Gulyás 11:30-14:00", "Gulyás"),
    ("Gulyás!!", "Gulyás"),
    ("Székelykáposzta (1, 7)", "Székelykáposzta 1, 7"),
    ("Leves ÉTLAP szerint", "Leves"),
    ("ab", ""),
]
CLEAN = [
    ('"Rántott sajt"', "Rántott sajt"),
    ("- • Rántott sajt", "Rántott sajt"),
    ("Rántott sajt 2.370,-", "Rántott sajt"),
    ("Rántott sajt 30dkg rizs", "Rántott sajt rizs"),
    ("Rántott sajt (1, 7) rizs", "Rántott sajt rizs"),
    ("Székelykáposzta 1, 7", "Székelykáposzta"),
    ("Leves desszert: torta", "Leves"),
    ("Leves + Sütemény ma", "Leves"),
    ("A: Rakott karfiol", "Rakott karfiol"),
    ("Leves -", "Leves"),
    ("RÁNTOTT SZELET BAKONYI MÓDRA", "Rántott szelet Bakonyi módra"),
    ("leves (debrecenivel)", "Leves (Debrecenivel)"),
]


def test_scrub(spark):
    assert one(spark, [a for a, _ in SCRUB], X.scrub) == [b for _, b in SCRUB]


def test_clean(spark):
    assert one(spark, [a for a, _ in CLEAN], X.clean_name) == [b for _, b in CLEAN]


@pytest.mark.parametrize("text,reason", [("990 ft", "price token"), ("Levesek:", "greeting"), ("Köret:", "label"), ("12", "time"), ("www.x.hu", "contact"), ("Rántott sajt", None), ("Mai menü", "administrative"), ("x" * 101 + " vagy", "long description")])
def test_noise(spark, text, reason):
    assert one(spark, [text], R.noise_reason) == [reason]


def test_is_dish(spark):
    cases = {"abc": False, "a vagy b vagy c leves": False, "Rántott sajt rizzsel és körettel": True, "Valami finom": True, "Valami egészen más dolog": False, "Valami: más": False, "Rizs minden nap": False}
    assert one(spark, list(cases), R.is_dish) == list(cases.values())


def test_fold_tokens_jaccard(spark):
    assert one(spark, ["Rántott  sajt, tűz!", "TÖRT_űő"], X.fold) == ["rantott sajt tuz", "tort_uo"]
    assert one(spark, ["A rántott és sajt x sajt"], X.tokens) == [["rántott", "sajt"]]
    assert one(spark, ["árvíztűrő"], X.strip_accents) == ["arvizturo"]
    row = spark.range(1).select(X.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))), X.jaccard(F.array().cast("array<string>"), F.array(F.lit("b")))).first()
    assert tuple(row) == (0.5, 0.0)


def test_price_month(spark):
    assert one(spark, ["Mai menü ára: 2400Ft", "2.200FT", "2.200Ft", None], X.price_of) == [2400, None, 200, None]
    assert one(spark, ["2024-05-01", "2025", "2025-xx-01", "2025-13-01"], X.month_of) == [5, None, None, None]


def test_labels(spark):
    assert one(spark, ["Meggyleves gombóccal ", "Valami "], lambda c: R.first_label(c, V.COURSES, V.DEFAULT_COURSE)) == ["leves", "főétel"]
    assert one(spark, ["Csirke sonka ", "Rántott sajt ", "hal", "Semmi"], lambda c: R.labels_or(F.concat(c, F.lit(" ")), V.PROTEINS, V.VEGETARIAN)) == [["csirke", "sertés"], ["vegetáriánus"], ["hal"], []]
