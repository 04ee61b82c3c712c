"""Text functions as column expressions.

Java's classes are ASCII only unless told otherwise, so patterns get ``(?U)``,
and ``(?iu)`` where case does not matter.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

_BLANK = r"(?U)[\s\x1c-\x1f]+"


def sub(col: Column, pattern: str, to: str = "", ignore_case: bool = False) -> Column:
    return F.regexp_replace(col, ("(?iuU)" if ignore_case else "(?U)") + pattern, to)


def strip(col: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def squeeze(col: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(col, _BLANK, " "))


def scrub(col: Column) -> Column:
    """A menu line without prices, contacts, hours and service phrases; empty if two characters or fewer are left.  Null gives empty."""
    t = squeeze(F.coalesce(col, F.lit("")))
    for pattern, to in V.SCRUB:
        t = sub(t, pattern, to)
    t = sub(t, "(?:" + "|".join(V.SCRUB_TAILS) + ").*$", "", ignore_case=True)
    t = strip(t)
    return F.when(F.length(t) > 2, t).otherwise("")


def normalize_case(col: Column, stems: list[str] = V.PROPER_STEMS) -> Column:
    """Lower case but for the first letter and for words that begin with a stem of a proper noun."""
    words = F.filter(F.split(squeeze(F.lower(col)), " ", -1), lambda w: w != "")
    proper = "^(?:" + "|".join(stems) + ")"
    edge = r"^[,:;.!?+()\-\"']+"

    def cased(w: Column, i: Column) -> Column:
        lead = F.regexp_extract(w, edge, 0)
        rest = F.substr(w, F.length(lead) + 1)
        first = F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
        named = F.concat(lead, F.upper(F.substring(rest, 1, 1)), F.substr(rest, F.lit(2)))
        return F.when(i == 0, first).when(rest.rlike(proper), named).otherwise(w)

    return F.array_join(F.transform(words, cased), " ")


def clean_name(col: Column) -> Column:
    """A dish name without quotes, bullets, prices, weights, allergens, tails and option letters, in sentence case."""
    t = col
    for pattern, to, ignore_case in V.CLEAN:
        t = sub(t, pattern, to, ignore_case)
    return normalize_case(squeeze(t))


def fold(col: Column) -> Column:
    """The key under which spellings of a name meet: lower case, base vowels, no punctuation, single spaces."""
    return squeeze(sub(F.translate(F.lower(col), V.FOLD_FROM, V.FOLD_TO), r"[^\w\s]", " "))


def strip_accents(col: Column) -> Column:
    """Without diacritics, for comparison."""
    accented = "áàâäãåçéèêëíìîïñóòôöõőúùûüűýÿÁÀÂÄÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕŐÚÙÛÜŰÝ"
    plain = "aaaaaaceeeeiiiinoooooouuuuuyyAAAAAACEEEEIIIINOOOOOOUUUUUY"
    return F.translate(col, accented, plain)


def tokens(col: Column, token: str = V.TOKEN, stopwords: list[str] = V.STOPWORDS) -> Column:
    """Distinct tokens of two letters or more, without stopwords."""
    found = F.regexp_extract_all(F.lower(col), F.lit(token), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(stopwords)))


def split_words(col: Column) -> Column:
    return F.filter(F.split(squeeze(col), " ", -1), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token sets; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def price_of(col: Column) -> Column:
    """The first number that ``Ft`` or ``ft`` follows; null if there is none."""
    return F.regexp_extract(col, r"(?U)(\d+)\s*(?:Ft|ft)", 1).try_cast("int")


def month_of(date: Column) -> Column:
    """The second part of an ISO date as a month; null if it is no number from 1 to 12."""
    m = F.try_element_at(F.split(date, "-", -1), F.lit(2)).try_cast("int")
    return F.when(m.between(1, 12), m)


def any_of(col: Column, words: list[str]) -> Column:
    """Whether one of the words is contained.  Long lists become one pattern, which keeps generated code small."""
    if len(words) > 3:
        return col.rlike("|".join(map(re.escape, words)))
    return reduce(lambda a, b: a | b, [col.contains(w) for w in words], F.lit(False))
