"""Quality rules whose cutoffs are set by risk control on labelled rows.

Labelled rows are split in two by a hash of the id.  On the first part a path
is laid for each stratum (language): it begins without any rule and tightens
one rule at a time, always the step that costs fewest good rows for the bad
rows that it rejects.  On the second part, the holdout, the settings along the
path are tested in that order, from the safest on: a setting, all its rules
together, is admitted if the exact binomial test refutes that it rejects more
than ``risk`` of the good rows, at the level ``delta`` over the number of
strata; the first that is not ends the sequence.  A fixed sequence needs no
other correction, so with probability 1 - ``delta`` no stratum gets a setting
that breaks the bound.  The last admitted setting is taken.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import in_small_batches, materialize
from .tables import free, table

_SYMBOL = re.compile(r"[#*$%&|<>]")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rule -> (expression over the counts, cutoffs); a row is rejected above the cutoff.
RULES = {
    "symbols_per_word": ("n_symbols / greatest(n_words, 1)", (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.0, 1.5, 2.0)),
    "dup_lines_per_100_words": ("100.0 * n_dup_lines / greatest(n_words, 1)", (0.5, 1, 2, 3, 5, 8, 12, 20)),
    "repeat_share": ("n_repeat_words / greatest(n_words, 1)", (0.01, 0.02, 0.05, 0.08, 0.1, 0.13, 0.16)),
    "long_words": ("word_chars / greatest(n_words, 1)", (6.5, 7, 7.5, 8, 9, 10, 12, 15)),
    "short_words": ("-1.0 * word_chars / greatest(n_words, 1)", (-4.5, -4, -3.5, -3, -2.5, -2)),
    "few_words": ("-1.0 * n_words", (-60, -50, -40, -30, -20, -15)),
}


def _repeats(words: list[bytes], window: int = 5) -> int:
    """Words inside windows that are found twice or more, the first ones included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    name = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    top = len(known)
    have = 1
    block = name
    while have < window:  # names of runs of ``have`` words; exact, as each step names pairs of names
        step = min(have, window - have)
        pair = block[: len(block) - step] * top + block[step:]
        if 2 * have >= window:
            _, back, count = np.unique(pair, return_inverse=True, return_counts=True)
        else:
            u, back = np.unique(pair, return_inverse=True)
            top = len(u)
        block, have = back, have + step
    twice = count[block] > 1
    if not twice.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """``BASE`` of one text."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(" \t\x0b\x0c\r"):
            seen.add(line)
    return len(words), chars, len(_SYMBOL.findall(text)), dup, _repeats(words)


def measure(docs: DataFrame, text_col: str = "text", keep: Iterable[str] = ("doc_id", "lang")) -> DataFrame:
    """``keep`` and the counts ``BASE`` of each row; a null text has no words."""
    keep = list(keep)

    def run(batches):
        for b in batches:
            got = [counts(t.as_py()) for t in b.column(0)]
            cols = [pa.array(x, pa.int64()) for x in zip(*got, strict=True)] if got else [pa.array([], pa.int64())] * len(BASE)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], names=[*b.schema.names[1:], *BASE])

    own = free("text", keep)
    d = docs.select(F.col(text_col).cast("string").alias(own), *keep)
    schema = d.drop(own).schema
    for name in BASE:
        schema = schema.add(name, "long")
    return in_small_batches(d).mapInArrow(run, schema)


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial X of ``n`` trials of probability ``p``."""
    if k >= n:
        return 1.0
    i = np.arange(1, k + 1)
    logs = n * math.log1p(-p) + np.r_[0.0, np.cumsum(np.log((n - i + 1) / i) + math.log(p) - math.log1p(-p))]
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def _rejected(levels: np.ndarray, setting: tuple[int, ...]) -> np.ndarray:
    """Which patterns a setting rejects: of each rule the number of its cutoffs, from the loosest on, that are in use."""
    need = np.array([len(grid) - k + 1 for (_, grid), k in zip(RULES.values(), setting, strict=True)])
    return (levels >= need).any(1) if len(levels) else np.zeros(0, bool)


def path(levels: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list[tuple[int, ...]]:
    """Settings, each with one rule tighter than the one before: always the step of fewest good rows, and a half, for a bad one; of equals the one of more bad rows, then of the first rule."""
    setting, out = [0] * len(RULES), []
    sizes = [len(grid) for _, grid in RULES.values()]
    while True:
        left = ~_rejected(levels, tuple(setting))
        best = None
        for r, n in enumerate(sizes):
            new_good = np.bincount(levels[left, r], good[left], n + 1)[::-1].cumsum()  # of rows at so many cutoffs or more
            new_bad = np.bincount(levels[left, r], bad[left], n + 1)[::-1].cumsum()
            for k in range(setting[r] + 1, n + 1):
                if new_bad[k - 1] > 0:
                    cost = ((new_good[k - 1] + 0.5) / new_bad[k - 1], -new_bad[k - 1], r, k)
                    best = min(best or cost, cost)
        if best is None:
            return out
        setting[best[2]] = best[3]
        out.append(tuple(setting))


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, stratum: str = "lang", good: str = "quality") -> list[tuple[str, str, float]]:
    """``(stratum, rule, cutoff)`` admitted on ``labels (doc_id, quality)``: 1 is good, 0 bad, others are left out; of repeated labels the least counts.

    Only rows that pass the base rules and have a stratum count, one per id
    and kind of row.  What comes to the driver is how many rows exceed how many
    cutoffs of each rule, a table that the grids bound for each stratum; strata
    whose holdout is too small for any admission are left out before.
    """
    lab = labels.where(F.col(good).isin(0, 1)).groupBy("doc_id").agg(F.min(good).alias("y"))
    level = [sum((F.expr(expr) > F.lit(float(c))).cast("int") for c in grid).alias(f"l{i}") for i, (expr, grid) in enumerate(RULES.values())]
    part = F.pmod(F.xxhash64(F.lit("holdout"), "doc_id"), F.lit(2)).cast("int")
    rows = measured.where(~base_failed() & F.col(stratum).isNotNull()).join(lab, "doc_id")
    rows = rows.select("doc_id", F.col(stratum).cast("string").alias("s"), part.alias("part"), *level, "y").distinct()  # of labelled rows alone
    names = [f"l{i}" for i in range(len(RULES))]
    found = rows.groupBy("s", "part", *names).agg(F.count_if(F.col("y") == 1).alias("good"), F.count_if(F.col("y") == 0).alias("bad"))
    least = math.log(delta) / math.log1p(-risk)
    strata = sorted(r.s for r in rows.where("part = 1 and y = 1").groupBy("s").count().where(F.col("count") >= least).collect())
    got = found.where(F.col("s").isin(strata)).collect()
    out = []
    for s in strata:
        parts = []
        for k in (0, 1):
            own = [r for r in got if r.s == s and r.part == k]
            parts.append((np.array([[r[n] for n in names] for r in own], np.int64).reshape(-1, len(names)), np.array([r.good for r in own], float), np.array([r.bad for r in own], float)))
        levels, n_good, _ = parts[1]
        chosen = None
        for setting in path(*parts[0]):
            if tail(int(n_good[_rejected(levels, setting)].sum()), int(n_good.sum()), risk) > delta / len(strata):
                break
            chosen = setting
        if chosen:
            out += [(s, rule, float(sorted(grid, reverse=True)[k - 1])) for (rule, (_, grid)), k in zip(RULES.items(), chosen, strict=True) if k]
    return out


def judge(measured: DataFrame, chosen: list[tuple[str, str, float]], stratum: str = "lang") -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``; strata without a cutoff are kept if the base rules pass."""
    bad = F.lit(False)
    for s, rule, c in chosen:
        bad = bad | ((F.col(stratum).cast("string") == s) & (F.expr(RULES[rule][0]) > F.lit(c)))
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(bad, F.lit(False)))


def apply_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """``doc_id, lang``, the counts, ``base_failed`` and ``kept`` per row of ``docs (doc_id, text, lang)``.

    Rows without language, and languages with too few labels, are judged by
    the base rules.  Without usable labels only the base rules decide.  Null and empty texts
    have no words and fail them.  Repeated rows are judged alike.
    """
    measured = materialize(measure(docs), "measured")
    return judge(measured, cutoffs(measured, labels, risk, delta))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, the five counts, ``base_failed`` and ``kept`` of all documents."""
    out = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *BASE, "base_failed", "kept")


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLE: dict[str, str] = {}
