"""Quality classifier: cumulative-link regression on graded ratings.

A rating is one of ordered grades.  One weight per hashed feature is shared by
all grades; ordered thresholds cut the line of its sums, and the probability of
more than grade ``j`` is the logistic function of sum minus threshold ``j``.
The thresholds are a first one and positive steps, so they cannot cross.
Fitted by Adam on the log likelihood in numpy, on at most ``rows`` rated texts,
those with the least hash of their id; a fifth of all ids is never fitted on.

Features of a text are shares of its words: hashed words, hashed shapes of
words (letters, digits and marks squeezed), and bins of simple ratios.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import in_small_batches
from .tables import free, table

_SHAPE = ((re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "0"))


@dataclass
class Ordinal:
    """``weights`` per bucket, ``cuts`` in ascending order, one fewer than there are grades."""

    weights: np.ndarray
    cuts: np.ndarray


def shape_of(word: str) -> str:
    for pattern, to in _SHAPE:
        word = pattern.sub(to, word)
    return word if len(word) < 8 else word[:4] + "~" + word[-3:]


class Features:
    """Buckets of a text's features; remembers those of at most ``most`` distinct words."""

    def __init__(self, n: int, most: int = 400_000):
        self.n, self.most = n, most
        self.known: dict[str, tuple[int, int]] = {}

    def _word(self, w: str) -> tuple[int, int]:
        got = self.known.get(w)
        if got is None:
            if len(self.known) >= self.most:
                self.known.clear()
            got = self.known[w] = (zlib.crc32(b"w" + w.lower().encode("utf-8", "replace")) % self.n, zlib.crc32(b"s" + shape_of(w).encode("utf-8", "replace")) % self.n)
        return got

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets and their values."""
        words = (text or "").split()
        total: Counter[int] = Counter()
        for w, c in Counter(words).items():
            a, b = self._word(w)
            total[a] += c
            total[b] += 2 * c
        n = max(1, len(words))
        lines = [x for x in (text or "").split("\n") if x.strip()]
        bins = (
            ("n", min(12, len(words).bit_length())),
            ("u", round(10 * len(set(words)) / n)),
            ("r", round(20 * sum(map(str.__eq__, words, words[1:])) / n)),
            ("d", round(10 * (1 - len(set(lines)) / max(1, len(lines))))),
            ("c", min(15, len(text or "") // n)),
        )
        ids = np.fromiter([*total, *(zlib.crc32(f"b{k}{v}".encode()) % self.n for k, v in bins)], np.int64, len(total) + len(bins))
        values = np.fromiter([*(x / n for x in total.values()), *[0.5] * len(bins)], np.float64, len(total) + len(bins))
        return ids, np.sqrt(values)


def _cuts(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[raw[0], np.exp(raw[1:])])


def _sig(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(texts: list[str | None], grades: list[int], n_grades: int = 3, n_buckets: int = 1 << 16, epochs: int = 12, rate: float = 0.05, batch: int = 64, seed: int = 3) -> Ordinal:
    """Grades are 0 to ``n_grades`` - 1.  Without texts all grades are alike; grades that never occur get almost no probability."""
    y = np.array(grades, np.int64)
    weights = np.zeros(n_buckets)
    share = np.array([(np.sum(y > j) + 0.5) / (len(y) + 1.0) for j in range(n_grades - 1)])
    start = -np.log(share / (1 - share))
    raw = np.r_[start[0], np.log(np.maximum(np.diff(start), 1e-2))]
    if not len(y):
        return Ordinal(weights, _cuts(raw))
    make = Features(n_buckets)
    rows = [make(t) for t in texts]
    rng = np.random.default_rng(seed)
    m, v, mc, vc, t = np.zeros(n_buckets), np.zeros(n_buckets), np.zeros_like(raw), np.zeros_like(raw), 0
    for epoch in range(epochs):
        lr = rate * (1 - 0.9 * epoch / epochs)
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            t += 1
            pick = order[lo : lo + batch]
            ids = np.concatenate([rows[i][0] for i in pick])
            val = np.concatenate([rows[i][1] for i in pick])
            own = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
            s = np.bincount(own, val * weights[ids], len(pick))
            cuts, g = _cuts(raw), y[pick]
            above = np.hstack([np.ones((len(pick), 1)), _sig(s[:, None] - cuts), np.zeros((len(pick), 1))])
            k = np.arange(len(pick))
            hi, low = above[k, g], above[k, g + 1]
            p = np.maximum(hi - low, 1e-9)
            dhi, dlow = hi * (1 - hi), low * (1 - low)
            ds = -(dhi - dlow) / p / len(pick)
            dc = np.zeros(len(cuts))
            np.add.at(dc, g[g > 0] - 1, (dhi / p)[g > 0] / len(pick))
            np.add.at(dc, g[g < len(cuts)], (-dlow / p)[g < len(cuts)] / len(pick))
            dr = np.cumsum(dc[::-1])[::-1] * np.r_[1.0, np.exp(raw[1:])]
            u, back = np.unique(ids, return_inverse=True)
            gw = np.bincount(back, val * ds[own], len(u)) + 1e-5 * weights[u]
            m[u] += 0.1 * (gw - m[u])
            v[u] += 0.01 * (gw * gw - v[u])
            mc += 0.1 * (dr - mc)
            vc += 0.01 * (dr * dr - vc)
            scale = lr * (1 - 0.99**t) ** 0.5 / (1 - 0.9**t)
            weights[u] -= scale * m[u] / (np.sqrt(v[u]) + 1e-8)
            raw -= scale * mc / (np.sqrt(vc) + 1e-8)
    return Ordinal(weights, _cuts(raw))


def tails(model: Ordinal, texts: list[str | None], make: Features | None = None) -> np.ndarray:
    """Probability of more than grade 0, 1, ... of each text."""
    make = make or Features(len(model.weights))
    out = np.zeros((len(texts), len(model.cuts)))
    for i, t in enumerate(texts):
        ids, val = make(t)
        out[i] = _sig(float(model.weights[ids] @ val) - model.cuts)
    return out


def graded(labels: DataFrame) -> DataFrame:
    """``doc_id, grade`` of ``labels (doc_id, quality, toxic)``: 0 bad, 1 good but toxic, 2 good and clean; the least grade of repeated ids."""
    q, t = F.col("quality"), F.coalesce("toxic", F.lit(0))
    return labels.where(q.isin(0, 1)).groupBy("doc_id").agg(F.min(F.when(q == 0, 0).when(t == 1, 1).otherwise(2)).alias("grade"))


def held_out(id_col: str = "doc_id"):
    """Rows that are never fitted on: those whose crc32 of the id, as text, modulo 5 is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, ratings: DataFrame, rows: int = 4000, n_grades: int = 3, max_chars: int = 50_000) -> Ordinal:
    """Fit on at most ``rows`` of ``ratings (doc_id, grade)``, in the order of a hash of the id, less texts of over ``max_chars`` characters.

    Held-out ids, null ids and grades beyond the range are left out; of an id
    that repeats the least grade and the text of the least hash count.
    Without a usable rating all texts get the same grade.
    """
    rated = ratings.where(F.col("grade").between(0, n_grades - 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("grade").alias("grade"))
    chosen = rated.orderBy(F.xxhash64(F.lit("ordinal"), "_id"), "_id").limit(rows)
    d = docs.select("doc_id", F.col("text").cast("string").alias("t")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).where(F.coalesce(F.length("t"), F.lit(0)) <= max_chars)
    got = d.groupBy("_id").agg(F.min_by(F.struct("t", "grade"), F.xxhash64("t")).alias("x")).select("_id", "x.*").collect()
    got.sort(key=lambda r: (str(r._id), r.t or ""))
    return fit([r.t for r in got], [r.grade for r in got], n_grades)


def grade(docs: DataFrame, model: Ordinal, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the text, with ``expected_grade``, ``p_above`` (per grade but the last) and ``selected``.

    Selected: more than grade 0 has probability ``least`` or more.  Null and
    empty texts are graded by the features of no words.  Repeated rows stay;
    columns of these names are replaced.
    """
    keep = [c for c in docs.columns if c not in (text_col, "expected_grade", "p_above", "selected")]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        make = Features(len(sent.value.weights))
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                p = tails(sent.value, part.column(0).to_pylist(), make)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(p.sum(1)), pa.array(list(p), pa.list_(pa.float64())), pa.array(p[:, 0] >= least)], names=[*part.schema.names[1:], "expected_grade", "p_above", "selected"])

    own = free("text", keep)
    d = docs.select(F.col(text_col).cast("string").alias(own), *keep)
    return in_small_batches(d).mapInArrow(run, d.drop(own).schema.add("expected_grade", "double").add("p_above", T.ArrayType(T.DoubleType())).add("selected", "boolean"))


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, expected_grade, p_above_0, p_above_1, selected`` of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = grade(docs, train(docs, graded(table(spark, sf_dir, "labels"))))
    return out.select("doc_id", held_out().alias("held_out"), "expected_grade", F.get("p_above", F.lit(0)).alias("p_above_0"), F.get("p_above", F.lit(1)).alias("p_above_1"), "selected")


QUERIES = {"op6_ordinal_quality": op6_ordinal_quality}
ORACLE: dict[str, str] = {}
