"""Lemmas and their dictionary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tavola.functions.text import split_words
from tavola.operators.lineage import cut
from tavola.operators.suffixes import learn, lemmas_of


def _identity(dishes: DataFrame, **_) -> DataFrame:
    words = F.filter(F.split(F.regexp_replace(F.lower("dish_name"), r"(?U)[^\w\s]", " "), r"(?U)\s+", -1), lambda w: w != "")
    return dishes.withColumn("lemmas", words)


def _lookup(dishes: DataFrame, table: DataFrame, **_) -> DataFrame:
    """``table (word, lemma)``; words it lacks stand for themselves.  A shuffled join, as the table may grow."""
    words = _identity(dishes).select("dish_name", F.posexplode("lemmas").alias("i", "word"))
    one = table.groupBy("word").agg(F.min("lemma").alias("lemma"))
    found = words.join(one, "word", "left").groupBy("dish_name").agg(F.array_sort(F.collect_set(F.struct("i", F.coalesce("lemma", "word").alias("l")))).alias("x"))
    return dishes.join(found.select("dish_name", F.col("x.l").alias("lemmas")), "dish_name", "left").withColumn("lemmas", F.coalesce("lemmas", F.array().cast("array<string>")))


def load_model(model: str, load: Callable, blank: Callable):
    """The first that there is: the model; a blank Hungarian pipeline, if the model's name is Hungarian.  Else the error of loading."""
    try:
        return load(model)
    except OSError:
        if "hu" not in model.lower():
            raise
        return blank("hu")


def _spacy(dishes: DataFrame, model: str = "hu_core_news_lg", **_) -> DataFrame:
    """A model loaded once per worker."""

    @F.pandas_udf("array<string>")
    def lemmas(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import spacy

        nlp = load_model(model, spacy.load, spacy.blank)
        for names in batches:
            yield pd.Series([[t.lemma_ or t.lower_ for t in doc] for doc in nlp.pipe(names.fillna(""))])

    return dishes.withColumn("lemmas", lemmas("dish_name"))


def _learned(dishes: DataFrame, pairs: DataFrame, **_) -> DataFrame:
    """By rules learnt from ``pairs (word, lemma)``; words of the pairs have the lemma given there."""
    words = _identity(dishes).select(F.explode("lemmas").alias("word"))
    return _lookup(dishes, lemmas_of(words, learn(pairs), pairs).select("word", "lemma"))


BACKENDS: dict[str, Callable[..., DataFrame]] = {"identity": _identity, "lookup": _lookup, "learned": _learned, "spacy": _spacy}


def lemmatize(dishes: DataFrame, backend: str = "identity", **options) -> DataFrame:
    """``dish_name, score, lemmas`` of ``dishes (dish_name, count)``, by one of ``BACKENDS``.  Each name is asked for once."""
    named = dishes.where(F.col("dish_name").isNotNull() & (F.trim("dish_name") != "")).select("dish_name", F.col("count").cast("long").alias("score"))
    return BACKENDS[backend](named, **options).select("dish_name", "score", "lemmas")


def lemma_tokens(rows: DataFrame, lemmas: str = "lemmas", filter_punctuation: bool = False) -> DataFrame:
    """``lemma``: one row per lemma of an array, or of a text that white space divides."""
    col = F.col(lemmas) if dict(rows.dtypes)[lemmas].startswith("array") else split_words(F.col(lemmas))
    out = rows.select(F.explode(col).alias("lemma")).where(F.col("lemma") != "")
    return out.where(~F.col("lemma").rlike(r"^[\p{Punct}\s]*$")) if filter_punctuation else out


def lemma_counts(rows: DataFrame, lemmas: str = "lemmas") -> DataFrame:
    """One row: ``rows``, ``tokens``, how many of these are ``punctuation``, and how many are ``remaining``."""
    mark = F.col("lemma").rlike(r"^[\p{Punct}\s]*$")
    found = lemma_tokens(rows, lemmas).agg(F.count("*").alias("tokens"), F.count_if(mark).alias("punctuation"), F.count_if(~mark).alias("remaining"))
    return rows.agg(F.count("*").alias("rows")).crossJoin(found)  # one row each


def lemma_dictionary(rows: DataFrame, lemmas: str = "lemmas", min_frequency: int = 1, filter_punctuation: bool = False) -> DataFrame:
    """``lemma, frequency, rank``: most frequent first, ties by lemma.

    Ranks are row numbers inside of each frequency plus the number of lemmas
    of greater frequency, so no task has to hold the whole vocabulary.
    """
    freq = lemma_tokens(rows, lemmas, filter_punctuation).groupBy("lemma").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= min_frequency)
    return ranked(freq, "frequency", "lemma")


def ranked(rows: DataFrame, by: str, tie: str, kind: str = "int") -> DataFrame:
    """``rows`` with ``rank`` from 1 by falling ``by`` and rising ``tie``: sorted by range, numbered per partition, shifted by the partitions before."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = cut(rows.repartitionByRange(n, F.desc(by), F.asc(tie)).withColumn("_p", F.spark_partition_id()))
    sizes = part.groupBy("_p").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))  # a row per partition
    own = F.row_number().over(Window.partitionBy("_p").orderBy(F.desc(by), F.asc(tie)))
    out = part.withColumn("_i", own).join(sizes.select("_p", F.coalesce("before", F.lit(0)).alias("before")), "_p")
    return out.select(*rows.columns, (F.col("_i") + F.col("before")).cast(kind).alias("rank"))


def lemma_stats(dictionary: DataFrame) -> DataFrame:
    """One row: lemmas, occurrences, mean frequency, hapaxes and their share in percent, most and least frequent lemma."""
    return dictionary.agg(
        F.count("*").alias("unique_lemmas"),
        F.sum("frequency").alias("occurrences"),
        F.avg("frequency").alias("mean_frequency"),
        F.count_if(F.col("frequency") == 1).alias("hapaxes"),
        (100.0 * F.count_if(F.col("frequency") == 1) / F.count("*")).alias("hapax_percent"),
        F.min_by("lemma", "rank").alias("most_frequent"),
        F.max_by("lemma", "rank").alias("least_frequent"),
    )
