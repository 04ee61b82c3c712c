"""Groups of names that come in batches equal those of one run over all of them."""

import random

import pytest
from pyspark.sql import functions as F

from tavola.operators import resolve as S
from tavola.operators.nameindex import NameIndex

WORDS = "rántott hús leves sajt rizs hal tészta gomba bab csirke sertés tejföl kapor krumpli".split()


def batch(rng, n):
    out = []
    for _ in range(n):
        words = rng.sample(WORDS, rng.randrange(1, 12))
        out.append((" ".join(words), rng.randrange(1, 40)))
    return [*out, (None, 3), ("", 2), ("és a", 1), ("  !", 5)]


def full(spark, batches):
    rows = spark.createDataFrame([x for b in batches for x in b], "dish_name string, count long")
    named = rows.where("dish_name is not null").groupBy("dish_name").agg(F.sum("count").alias("count"))
    return {r.dish_name: r.canonical_name for r in S.auto_groups(named, lemmas=None).collect()}


def test_every_batch_equals_a_full_run(spark, tmp_path):
    rng = random.Random(4)
    index, seen, some = NameIndex(spark, f"{tmp_path}/i"), [], 0
    for k in range(3):
        seen.append(batch(rng, 90))
        if k == 2:  # an old name comes to lead by its count
            seen[k] += [(seen[0][5][0], 500)]
        index.add(spark.createDataFrame(seen[k], "dish_name string, count long"), k)
        got = {r.dish_name: r.canonical_name for r in index.groups().collect()}
        assert got == full(spark, seen)
        some += len(got)
    assert some > 20 and index.batches() == [0, 1, 2]


def test_a_batch_given_again_replaces_itself(spark, tmp_path):
    rng = random.Random(6)
    a, b, c = (batch(rng, 50) for _ in range(3))
    index = NameIndex(spark, f"{tmp_path}/i")
    frame = lambda x: spark.createDataFrame(x, "dish_name string, count long")
    index.add(frame(a), 1)
    index.add(frame(b), 5)
    index.add(frame(c), 5)
    assert {r.dish_name: r.canonical_name for r in index.groups().collect()} == full(spark, [a, c])
    with pytest.raises(ValueError, match="paired"):
        index.add(frame(b), 1)


def test_old_names_are_not_paired_again(spark, tmp_path):
    """A batch without new names leaves no new set, prefix or edge."""
    rng = random.Random(7)
    a = batch(rng, 60)
    index = NameIndex(spark, f"{tmp_path}/i")
    index.add(spark.createDataFrame(a, "dish_name string, count long"), 0)
    index.add(spark.createDataFrame(a, "dish_name string, count long"), 1)
    index.add(spark.createDataFrame([], "dish_name string, count long"), 2)
    assert [(r.sets, r.edges) for r in index._read("commits").orderBy("names").collect()][:1] == [(0, 0)]
    assert spark.read.parquet(f"{tmp_path}/i/prefix/batch=1").count() == 0
    assert {r.dish_name: r.canonical_name for r in index.groups().collect()} == full(spark, [a, a])


def test_no_names(spark, tmp_path):
    assert NameIndex(spark, f"{tmp_path}/none").groups().count() == 0


def test_bands_lose_no_pair(spark):
    rows = [(i, [f"t{j}" for j in range(n)] + [f"u{i}_{j}" for j in range(extra)]) for i, (n, extra) in enumerate([(n, e) for n in range(1, 60, 3) for e in range(3)])]
    sets = spark.createDataFrame(rows, "id long, tokens array<string>")
    want = {(a, b) for a, s in rows for b, t in rows if a < b and s != t and 1000 * len(set(s) & set(t)) >= 850 * len(set(s) | set(t))}
    distinct = {tuple(t): i for i, t in reversed(rows)}
    keep = set(distinct.values())
    got = {tuple(r) for r in S.similar_pairs(sets.where(F.col("id").isin(*keep))).collect()}
    assert got == {(a, b) for a, b in want if a in keep and b in keep} and got
