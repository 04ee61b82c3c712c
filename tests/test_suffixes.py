"""Rules on word ends against plain loops, and held-out words."""

import collections
import random

from pyspark.sql import functions as F

from tavola.operators import lemmas as L
from tavola.operators import suffixes as S


def steps(word, lemma):
    p = 0
    while p < min(len(word), len(lemma)) and word[p] == lemma[p]:
        p += 1
    return len(word) - p, lemma[p:]


def plain_rules(pairs, longest, support, share):
    counts = collections.defaultdict(collections.Counter)
    for w, m in set(pairs):
        cut, add = steps(w, m)
        for k in range(max(cut, 1), min(len(w), longest) + 1):
            counts[w[-k:]][cut, add] += 1
    kept = {}
    for s, c in counts.items():
        step, n = min(c.items(), key=lambda x: (-x[1], x[0]))
        if n >= support and n >= share * sum(c.values()):
            kept[s] = (*step, n, sum(c.values()))
    return {s: r for s, r in kept.items() if s[1:] not in kept or kept[s[1:]][:2] != r[:2]}


def plain_lemma(word, rules, longest):
    for k in range(min(len(word), longest), 0, -1):
        r = rules.get(word[-k:])
        if r and (len(word) > r[0] or r[1]):
            return word[: len(word) - r[0]] + r[1]
    return word


# Hungarian nouns and how their forms are made: enough of the rules to have changes of the stem, and both vowel classes.
STEMS = "leves rántott gulyás csirke marha sertés pörkölt saláta körte alma répa káposzta gomba paprika tészta galuska nokedli rizs köret mártás szósz torta pite rétes palacsinta lecsó fasírt szelet comb mell máj hal ponty harcsa pisztráng süllő kolbász sonka szalonna tojás sajt túró tejföl vaj olaj bors kapor torma hagyma borsó bab lencse kukorica spenót sóska tök padlizsán burgonya krumpli kenyér zsemle kifli lángos pogácsa fánk derelye gombóc nudli metélt csusza ragu krém puding fagylalt gyümölcs szilva meggy cseresznye barack szőlő málna eper dió mák méz csoki vanília fahéj".split()
BACK = set("aáoóuú")


def forms(stem):
    back = any(c in BACK for c in stem)
    a, o = ("a", "o") if back else ("e", "e")
    base = stem[:-1] + {"a": "á", "e": "é"}[stem[-1]] if stem[-1] in "ae" else stem
    link = "" if stem[-1] in "aeáéióöőuúüű" else o
    for end in (f"{link}t", f"{link}k", f"{link}kat" if back else f"{link}ket", f"b{a}n", "ból" if back else "ből", f"n{a}k", "val" if back and base != stem else "", f"h{'o' if back else 'e'}z", "ról" if back else "ről", "s" if base != stem else ""):
        if end:
            yield base + end, stem
    yield stem, stem


def test_rules_as_loops(spark):
    pairs = [p for s in STEMS for p in forms(s)] + [("x", "x"), ("ment", "megy"), ("jobb", "jó")]
    frame = spark.createDataFrame([*pairs, pairs[0], (None, "a"), ("a", None), ("", "b")], "word string, lemma string")
    for longest, support, share in ((6, 3, 0.5), (4, 1, 0.9), (2, 2, 0.3)):
        rules = S.learn(frame, longest, support, share)
        want = plain_rules(pairs, longest, support, share)
        assert {r.suffix: (r.cut, r["add"], r.n, r.of) for r in rules.collect()} == want
        words = [w for w, _ in pairs] + ["asztalokat", "kutyának", "t", "é", "", "ok"]
        got = {r.word: r.lemma for r in S.lemmas_of(spark.createDataFrame([(w,) for w in [*words, None]], "word string"), rules, None, longest).collect()}
        assert got == {w: plain_lemma(w, want, longest) for w in words}


def test_held_out_stems(spark):
    """Forms of stems that no rule was learnt from."""
    rng = random.Random(1)
    stems = sorted(STEMS)
    rng.shuffle(stems)
    cut = len(stems) * 3 // 4
    frame = lambda part: spark.createDataFrame([p for s in part for p in forms(s)], "word string, lemma string")
    found = S.accuracy(frame(stems[cut:]), S.learn(frame(stems[:cut]))).first()
    alone = sum(w == m for s in stems[cut:] for w, m in forms(s)) / found.words
    assert found.right / found.words >= 0.8 > 0.3 > alone, (found, alone)


def test_backend(spark):
    pairs = [p for s in STEMS for p in forms(s)] + [("sültek", "sül")]
    dishes = spark.createDataFrame([("Sültek, lámpában!", 3), ("", 1), (None, 2), ("!", 1)], "dish_name string, count long")
    out = L.lemmatize(dishes, "learned", pairs=spark.createDataFrame(pairs, "word string, lemma string"))
    assert {r.dish_name: r.lemmas for r in out.collect()} == {"Sültek, lámpában!": ["sül", "lámpa"], "!": []}


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "word string, lemma string")
    words = spark.createDataFrame([("ab",)], "word string")
    assert S.learn(none).count() == 0 and [tuple(r) for r in S.lemmas_of(words, S.learn(none), none).collect()] == [("ab", "ab", None)]
    assert S.lemmas_of(words.where(F.lit(False)), S.learn(none)).count() == 0
