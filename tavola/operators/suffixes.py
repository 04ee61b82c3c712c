"""A lemmatiser learnt from pairs of words and lemmas: rules on word ends, the longest that fits.

A pair says: cut so many letters, add these.  Every end of the word that holds
what is cut is evidence for that step, so the rules are a trie of ends in
which each has the step that most pairs take.  Learning is one aggregation
over the ends of all pairs, and applying a join of the ends of all words, so
neither needs a model in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _common(a: Column, b: Column) -> Column:
    """How many letters two words begin with alike."""
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    same = F.zip_with(letters(a), letters(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")


def _ends(rows: DataFrame, least: Column, longest: int) -> DataFrame:
    """A row per end of ``word``, of ``least`` letters and one at least, up to ``longest``."""
    n = F.least(F.length("word"), F.lit(longest))
    lengths = F.when(n >= F.greatest(least, F.lit(1)), F.sequence(F.greatest(least, F.lit(1)), n))
    return rows.select("*", F.explode(lengths).alias("k")).withColumn("suffix", F.expr("right(word, k)"))


def learn(pairs: DataFrame, longest: int = 6, support: int = 3, share: float = 0.5) -> DataFrame:
    """``suffix, cut, add, n, of``: rules learnt from the distinct ``pairs (word, lemma)``.

    A rule has ``support`` pairs at least and ``share`` of all pairs whose word
    ends so; of steps with equally many pairs the one that cuts less counts,
    then the lesser ``add``.  Where a shorter end by one letter has the same
    step, the longer one is left out: it says nothing new.  Pairs whose cut is
    over ``longest`` letters have no rule.  Nulls and empty words are left out.
    """
    known = pairs.where("word is not null and lemma is not null and word <> ''").select("word", "lemma").distinct()
    same = _common(F.col("word"), F.col("lemma"))
    steps = known.withColumn("_p", same).select("word", (F.length("word") - F.col("_p")).alias("cut"), F.expr("substr(lemma, _p + 1)").alias("add"))
    counted = _ends(steps, F.col("cut"), longest).groupBy("suffix", "cut", "add").agg(F.count("*").alias("n"))
    order = F.struct(-F.col("n"), "cut", "add")
    best = counted.groupBy("suffix").agg(F.min(order).alias("b"), F.sum("n").alias("of")).select("suffix", "b.cut", "b.add", (-F.col("b.col1")).alias("n"), "of")
    kept = best.where((F.col("n") >= support) & (F.col("n") >= share * F.col("of")))
    shorter = kept.select(F.col("suffix").alias("_up"), F.col("cut").alias("_cut"), F.col("add").alias("_add"))
    kept = kept.withColumn("_up", F.expr("substr(suffix, 2)")).join(shorter, "_up", "left")
    told = (F.col("cut") == F.col("_cut")) & (F.col("add") == F.col("_add"))
    return kept.where(~F.coalesce(told, F.lit(False))).select("suffix", "cut", "add", "n", "of")


def lemmas_of(words: DataFrame, rules: DataFrame, known: DataFrame | None = None, longest: int = 6) -> DataFrame:
    """``word, lemma, suffix`` of the distinct ``words (word)``.

    A word of ``known (word, lemma)`` has the least lemma given there.  Any
    other one takes the rule of its longest end that has one and leaves a
    letter (``suffix`` tells which), else stands for itself.
    """
    distinct = words.where("word is not null").select("word").distinct()
    fits = _ends(distinct, F.lit(1), longest).join(rules.select("suffix", "cut", "add"), "suffix").where((F.length("word") > F.col("cut")) | (F.col("add") != ""))
    best = fits.groupBy("word").agg(F.max_by(F.struct("suffix", "cut", "add"), "k").alias("r"))
    out = distinct.join(best, "word", "left")
    by_rule = F.when(F.col("r").isNotNull(), F.concat(F.expr("left(word, length(word) - r.cut)"), F.col("r.add"))).otherwise(F.col("word"))
    if known is None:
        return out.select("word", by_rule.alias("lemma"), F.col("r.suffix").alias("suffix"))
    table = known.where("word is not null and lemma is not null").groupBy("word").agg(F.min("lemma").alias("_known"))
    return out.join(table, "word", "left").select("word", F.coalesce("_known", by_rule).alias("lemma"), F.when(F.col("_known").isNull(), F.col("r.suffix")).alias("suffix"))


def accuracy(pairs: DataFrame, rules: DataFrame, longest: int = 6) -> DataFrame:
    """One row: ``words, right, by_rule`` of ``pairs`` that no rule was learnt from."""
    got = pairs.select("word", F.col("lemma").alias("want")).distinct().join(lemmas_of(pairs, rules, None, longest), "word")
    return got.agg(F.count("*").alias("words"), F.count_if(F.col("lemma") == F.col("want")).alias("right"), F.count("suffix").alias("by_rule"))
