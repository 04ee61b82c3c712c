"""Keys of a table in texts, against loops over all keys."""

import random

import pytest
from pyspark.sql import functions as F

from tavola.operators import resolve as S
from tavola.operators.keymatch import best_keys


def plain(texts, keys):
    out = {}
    for t in texts:
        if t is None:
            continue
        hits = [(k != t, i, k, c) for i, k, c in keys if k is not None and k in t]
        if hits:
            out[t] = min(hits)[3]
    return out


@pytest.mark.parametrize("shard_chars", [5, 200, 1_000_000])
def test_as_loops(spark, shard_chars):
    rng = random.Random(shard_chars)
    word = lambda n: "".join(rng.choices("abcőé ", k=rng.randrange(n)))
    keys = [(i, word(5) or "x", f"C{i}") for i in rng.sample(range(1000), 60)]
    keys += [(2000, "abab", "LATE"), (1, "abab", "EARLY"), (3, None, "NULL")]
    texts = [word(14) for _ in range(300)] + [k for _, k, _ in keys] + [None, "", "abab", "xababx", "日本"]
    got = best_keys(spark.createDataFrame([(t,) for t in texts], "low string"), spark.createDataFrame(keys, "ordinal long, key string, canonical string"), shard_chars, 6)
    assert {r.low: r.canonical for r in got.collect()} == plain(texts, keys)


def test_empty_key_and_tables(spark):
    texts = spark.createDataFrame([("ab",), ("",), ("b",)], "low string")
    of = lambda rows: {r.low: r.canonical for r in best_keys(texts, spark.createDataFrame(rows, "ordinal long, key string, canonical string")).collect()}
    assert of([(5, "", "any"), (1, "a", "A"), (9, "b", "B")]) == {"ab": "A", "": "any", "b": "B"}
    assert of([]) == {}
    assert best_keys(texts.limit(0), spark.createDataFrame([(1, "a", "A")], "ordinal long, key string, canonical string")).count() == 0


def test_names_keep_their_columns(spark):
    names = spark.createDataFrame([("Rántott Hús", 1), ("rántott hús", 2), ("Hal", 3), (None, 4)], "dish_name string, low int")
    keys = spark.createDataFrame([(0, "hús", "HÚS"), (1, "rántott hús", "RH")], "ordinal long, key string, canonical string")
    assert sorted((r.low, r.curated) for r in S.curated_join(names, keys).collect()) == [(1, "RH"), (2, "RH"), (3, None), (4, None)]


def test_a_million_keys(spark):
    """A table that no expression and no single automaton of a task would take: each text has one key, some an earlier one."""
    n = 1_000_000
    keys = spark.range(n).select(F.col("id").alias("ordinal"), F.concat(F.lit("k"), F.conv(F.col("id") * 2654435761 % 4294967296, 10, 36), F.lit(".")).alias("key"), F.concat(F.lit("C"), "id").alias("canonical"))
    own = lambda i: F.concat(F.lit("k"), F.conv(i * 2654435761 % 4294967296, 10, 36), F.lit("."))
    texts = spark.range(3_000).select(F.concat(F.lit("say "), own(F.col("id") * 331), F.lit(" or "), own(F.col("id") * 17 + 1), F.lit(" end")).alias("low"), F.concat(F.lit("C"), F.least(F.col("id") * 331, F.col("id") * 17 + 1)).alias("want"))
    got = texts.join(best_keys(texts, keys, 2_000_000), "low", "left")
    assert got.where("canonical = want").count() == 3_000
