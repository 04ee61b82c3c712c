"""Rule tables compiled to column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .text import any_of, split_words, strip


def fits(col: Column, kind: str, words: list[str]) -> Column:
    """Whether a name fits a rule of this kind; null for a null name."""
    low = F.lower(col)
    if kind == "contains":
        return any_of(low, words)
    if kind == "regex":
        return reduce(lambda a, b: a | b, [low.rlike("(?U)" + w) for w in words])
    if kind == "raw_regex":
        return reduce(lambda a, b: a | b, [col.rlike("(?U)" + w) for w in words])
    if kind == "suffix":
        return reduce(lambda a, b: a | b, [strip(col).endswith(w) for w in words])
    if kind == "exact":
        return col.isin(words)
    if kind == "exact_trimmed":
        return strip(col).isin(words)
    if kind == "all_of":
        return reduce(lambda a, b: a & b, [low.contains(w) for w in words])
    if kind == "long_any":
        return (F.length(col) > 100) & any_of(low, words)
    raise ValueError(f"no rule of kind {kind}")


def noise_reason(col: Column, rules=V.NOISE) -> Column:
    """Name of the first noise rule that fits; null if none does."""
    return F.coalesce(*[F.when(fits(col, kind, words), F.lit(name)) for name, kind, words in rules])


def is_noise(col: Column, rules=V.NOISE) -> Column:
    return noise_reason(col, rules).isNotNull()


def is_dish(col: Column) -> Column:
    """Whether a cleaned name is a dish: long enough, one option at most, no menu text, and food by its words or simple."""
    low = F.lower(col)
    options = F.size(F.split(low, V.OPTION_WORD, -1)) - 1
    simple = (F.size(split_words(col)) <= 3) & ~any_of(col, V.NOT_SIMPLE)
    return (F.length(col) >= 4) & (options <= 1) & ~any_of(low, V.NOT_A_DISH) & (any_of(low, V.FOOD_WORDS) | simple)


def first_label(text: Column, classes: list[tuple[str, list[str]]], default: str | None) -> Column:
    """Label of the first class of which the text contains a word; else ``default``."""
    low = F.lower(text)
    cases = [F.when(any_of(low, words), F.lit(label)) for label, words in classes if words]
    return F.coalesce(*cases, F.lit(default))


def all_labels(text: Column, classes: list[tuple[str, list[str]]]) -> Column:
    """Labels of all classes of which the text contains a word, in the order of the classes."""
    low = F.lower(text)
    return F.filter(F.array(*[F.when(any_of(low, words), F.lit(label)) for label, words in classes]), lambda x: x.isNotNull())


def labels_or(text: Column, classes: list[tuple[str, list[str]]], fallback: tuple[str, list[str]] | None) -> Column:
    """As ``all_labels``; without any, the fallback's label if the text contains a word of it."""
    found = all_labels(text, classes)
    if fallback is None:
        return found
    return F.when(F.size(found) > 0, found).otherwise(all_labels(text, [fallback]))


def first_contained(col: Column, pairs: list[tuple[str, str]], default: str | None = None) -> Column:
    """Value of the first key that the text contains."""
    return F.coalesce(*[F.when(col.contains(k), F.lit(v)) for k, v in pairs], F.lit(default))
