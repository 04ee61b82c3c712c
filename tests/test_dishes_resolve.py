import random

from pyspark.sql import functions as F

from tavola.operators import categorize as C
from tavola.operators import dishes as D
from tavola.operators import lemmas as L
from tavola.operators import resolve as S


def test_merge_spellings(spark):
    rows = spark.createDataFrame([("Rántott sajt", 5), ("Rantott sajt", 2), ("Leves, x", 3), ("Leves x!!", 3), ("abc", 9)], "dish_name string, count long")
    assert {(r[0], r[1]) for r in D.merge_spellings(rows).collect()} == {("Rántott sajt", 7), ("Leves x!!", 6)}


def test_clean_dishes_keeps_counts(spark):
    rows = spark.createDataFrame([("RÁNTOTT SAJT", 2), ("rántott sajt (1,7)", 3), ("990 ft", 4), ("Levesek:", 1)], "dish_name string, count long")
    assert [tuple(r) for r in D.clean_dishes(rows).collect()] == [("Rántott sajt", 5)]


def test_lemma_dictionary(spark):
    rows = spark.createDataFrame([("b a , a",), ("c b",), (None,)], "lemmas string")
    assert [tuple(r) for r in L.lemma_dictionary(rows, filter_punctuation=True).orderBy("rank").collect()] == [("a", 2, 1), ("b", 2, 2), ("c", 1, 3)]
    s = L.lemma_stats(L.lemma_dictionary(rows)).first()
    assert (s.unique_lemmas, s.occurrences, s.hapaxes) == (4, 6, 2)


def test_lookup_backend(spark):
    dishes = spark.createDataFrame([("Leveseket kérek", 1)], "dish_name string, count long")
    table = spark.createDataFrame([("leveseket", "leves")], "word string, lemma string")
    assert L.lemmatize(dishes, "lookup", table=table).first().lemmas == ["leves", "kérek"]


def test_category_stats(spark):
    rows = spark.createDataFrame([("Meggyleves", 1, ["meggyleves"]), ("Csirke sonka", 2, ["csirke"]), (" ", 1, [])], "dish_name string, score long, lemmas array<string>")
    stats = C.category_stats(C.categorize(rows)).first()
    assert stats.total_dishes == 2 and stats.course_distribution == {"leves": 1, "főétel": 1} and stats.protein_distribution == {"csirke": 1, "sertés": 1}


def test_curated(spark):
    names = ["Rizi bizi", "Gyros, sültburgonya, friss saláta", "Semmi", None]
    rows = spark.createDataFrame([(n,) for n in names], "dish_name string")
    pairs = S.curated_pairs()
    got = [r[0] for r in rows.select(S.curated_match(F.col("dish_name"), pairs)).collect()]
    assert got == ["rizibizi", "hasábburgonya", None, None]
    keys = spark.createDataFrame([(i, k, c) for i, (k, c) in enumerate(pairs)], "ordinal long, key string, canonical string")
    assert {r.dish_name: r.curated for r in S.curated_join(rows, keys).collect()} == dict(zip(names, got, strict=True))


def greedy(items, threshold):
    heads, out = [], {}
    for name, s in items:
        for h, t in heads:
            if len(s & t) * 1000 >= round(threshold * 1000) * len(s | t):
                out[name] = h
                break
        else:
            heads.append((name, s))
    return out


def test_auto_groups_against_greedy(spark):
    rng = random.Random(5)
    words = [a + b for a in "bcdfg" for b in ("aa", "ee", "oo")]
    rows = list({" ".join(rng.choices(words, k=rng.randint(1, 5))): rng.randint(1, 4) for _ in range(120)}.items()) + [("és a", 9)]
    for threshold in (0.5, 0.85):
        df = spark.createDataFrame(rows, "dish_name string, count long").repartition(3)
        got = {r[0]: r[1] for r in S.auto_groups(df, threshold, lemmas=None).collect()}
        order = sorted((r for r in rows if r[0] != "és a"), key=lambda r: (-r[1], r[0]))
        assert got == greedy([(n, set(n.split())) for n, _ in order], threshold)


def test_similar_pairs_against_all_pairs(spark):
    rng = random.Random(6)
    words = [a + b for a in "bcdfghkl" for b in ("aa", "ee", "oo", "uu")]
    sets = {}
    for i in range(60):
        own = rng.sample(words, rng.randint(1, 24))
        for j in range(4):
            sets[4 * i + j] = frozenset(own) - set(rng.sample(own, min(len(own) - 1, rng.randint(0, 2)))) | set(rng.sample(words, rng.randint(0, 1)))
    one = {}
    for i, s in sets.items():
        one.setdefault(s, i)
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, tokens array<string>").repartition(5)
    assert {r.id: r.class_id for r in S.token_classes(df).collect()} == {i: one[s] for i, s in sets.items()}
    classes = df.join(S.token_classes(df).where("id = class_id"), "id", "left_semi")
    for threshold in (0.5, 0.7, 0.85, 0.95):
        num = round(threshold * 1000)
        want = {(i, j) for s, i in one.items() for t, j in one.items() if i < j and 1000 * len(s & t) >= num * len(s | t)}
        assert {(r.a, r.b) for r in S.similar_pairs(classes, threshold).collect()} == want


def test_leaders_in_rounds(spark):
    edges = [(i, i + 1) for i in range(9)] + [(20, 22), (21, 22), (21, 23), (30, 31), (30, 32), (31, 32)]
    got = {r.id: r.leader for r in S.leaders(spark.createDataFrame(edges, "a long, b long")).collect()}
    lead, want = set(), {}
    low = {}
    for a, b in edges:
        low.setdefault(b, []).append(a)
    for x in sorted({x for e in edges for x in e}):
        own = [a for a in low.get(x, []) if a in lead]
        if own:
            want[x] = min(own)
        else:
            lead.add(x)
    assert got == want
    assert S.leaders(spark.createDataFrame([], "a long, b long")).count() == 0


def test_side_dishes_and_counts(spark):
    rows = spark.createDataFrame([("Rántott hús, rizs és burgonya", 1, ["burgonya"]), ("Leves", 2, []), (None, 1, []), (" ", 1, [])], "dish_name string, score long, lemmas array<string>")
    assert {r.dish_name: r.sides for r in C.side_dishes(rows).collect()} == {"Rántott hús, rizs és burgonya": ["burgonya", "rizs"], "Leves": [], " ": []}
    assert tuple(C.counts(rows).first()) == (4, 2, 2)


def test_case_collisions(spark):
    rows = spark.createDataFrame([("Ab",), ("ab",), ("c",)], "canonical_name string")
    assert [tuple(r) for r in D.case_collisions(rows).collect()] == [("ab", 2)]
