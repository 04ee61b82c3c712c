"""Toxicity: a convolutional text classifier in numpy.

A word's vector is the sum of hashed embeddings: of the whole word and of its
byte n-grams, so that inflected and compound forms share weights.  Filters of
several widths slide over the whole text, and over no other; the maximum of
each over all positions, and 0, goes to a logistic layer.  As the filters are linear before the
maximum, what a word adds at each place of each filter is computed once per
distinct word, and a text is scored by adding rows of a table.

Fitting uses at most ``per_class`` labelled texts of each label, those with
the least hash of their id, less those of over ``max_chars`` characters;
scoring reads every text whole.  Thresholds per
language come from a part of that sample which is not fitted on; they decide
``rejected`` and never enter the score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import in_small_batches
from .tables import free, table

_WORD = re.compile(r"\w+")
_GRAMS = (3, 4, 5)


@dataclass
class Net:
    """Weights; ``emb`` has a row per bucket, ``conv[w]`` is (w, dim, filters)."""

    emb: np.ndarray
    conv: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    @property
    def widths(self) -> list[int]:
        return sorted(self.conv)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def buckets(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the words and their n-grams, word after word, and where each word's begin."""
    raw = [b"<" + w.encode("utf-8", "replace") + b">" for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), size)
    place = np.arange(len(b)) - at[:-1][owner]
    own, got = [], []
    one = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        power = (b + np.uint64(1)) * _mix(place.astype(np.uint64) * one + np.uint64(7))  # of whole words
        total = np.add.reduceat(power, at[:-1]) if len(raw) else power
        own.append(np.arange(len(raw)))
        got.append(_mix(total) % np.uint64(n))
        for g in _GRAMS:
            if len(b) < g:
                continue
            h = np.full(len(b) - g + 1, np.uint64(g), np.uint64)
            for i in range(g):
                h = h * one + b[i : len(b) - g + 1 + i] + np.uint64(1)
            ok = owner[: len(h)] == owner[g - 1 :]
            own.append(owner[: len(h)][ok])
            got.append(_mix(h[ok]) % np.uint64(n))
    own, got = np.concatenate(own), np.concatenate(got).astype(np.int64)
    order = np.argsort(own, kind="stable")
    starts = np.searchsorted(own[order], np.arange(len(raw)))
    return got[order], starts


def vectors(words: list[str], emb: np.ndarray, step: int = 20_000) -> np.ndarray:
    out = np.zeros((len(words), emb.shape[1]), np.float32)
    for i in range(0, len(words), step):
        part = words[i : i + step]
        ids, starts = buckets(part, len(emb))
        n = np.diff(np.r_[starts, len(ids)]).astype(np.float32)
        out[i : i + len(part)] = np.add.reduceat(emb[ids], starts, axis=0) / np.sqrt(n)[:, None]
    return out


def _layout(ids: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, each followed by ``pad`` rows of padding (row 0); where each begins, and where its first row of padding ends.

    With ``pad`` the greatest width, no filter that starts before that end reads the next text.
    """
    n = np.array([len(x) for x in ids])
    starts = np.r_[0, np.cumsum(n + pad)[:-1]]
    flat = np.zeros(int((n + pad).sum()), np.int64)
    for s, x in zip(starts, ids, strict=True):
        flat[s : s + len(x)] = x
    return flat, starts, starts + n + 1


def _maxima(z: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Of the rows from each start to its stop; after the last stop there is only padding."""
    return np.maximum.reduceat(z, np.c_[starts, stops].ravel()[:-1], axis=0)[::2]


def fit(texts: list[str], labels: list[int], *, dim: int = 12, filters: int = 10, widths=(1, 2, 3), n_buckets: int = 1 << 16, epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 7, drop: float = 0.3) -> Net:
    """Adam on the logistic loss; both labels weigh the same; at each step a share ``drop`` of the words is blank.  One label only, or no text, gives a net of constant score."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    k = filters * len(widths)
    net = Net(
        rng.normal(0, 0.3, (n_buckets, dim)).astype(np.float32),
        {w: rng.normal(0, (1 / (w * dim)) ** 0.5, (w, dim, filters)).astype(np.float32) for w in widths},
        np.zeros(k, np.float32), rng.normal(0, 0.3, k).astype(np.float32), 0.0,
    )
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        net.out_bias = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return net
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    vocab: dict[str, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab) + 1) for w in words_of(t)], np.int32) for t in texts]
    names = list(vocab)
    parts = [buckets(names[i : i + 20_000], n_buckets) for i in range(0, len(names), 20_000)] or [buckets([], n_buckets)]
    ids = np.concatenate([x.astype(np.int32) for x, _ in parts])
    starts = np.concatenate([s + at for (_, s), at in zip(parts, np.cumsum([0, *(len(x) for x, _ in parts[:-1])]), strict=True)])
    ends = np.r_[starts[1:], len(ids)]
    del parts, vocab, names
    params = {"bias": net.bias, "out": net.out, "ob": np.zeros(1, np.float32)} | {f"c{w}": net.conv[w] for w in widths}
    m = {p: np.zeros_like(v) for p, v in params.items()}
    v2 = {p: np.zeros_like(v) for p, v in params.items()}
    em, ev = np.zeros_like(net.emb), np.zeros_like(net.emb)
    t = 0
    for epoch in range(epochs):
        lr = rate * (1 - 0.9 * epoch / epochs)
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), batch):
            t += 1
            pick = order[lo : lo + batch]
            flat, begin, stop = _layout([np.where(rng.random(len(docs[i])) < drop, 0, docs[i]) for i in pick], max(widths))
            used, local = np.unique(flat, return_inverse=True)
            real = used[used > 0] - 1
            span = ends[real] - starts[real]
            first = np.r_[0, np.cumsum(span)[:-1]] if len(real) else span
            rows = ids[np.repeat(starts[real] - first, span) + np.arange(int(span.sum()))]
            vec = np.zeros((len(used), dim), np.float32)
            norm = np.sqrt(span.astype(np.float32))[:, None]
            if len(real):
                vec[used > 0] = np.add.reduceat(net.emb[rows], first, axis=0) / norm
            x = vec[local]
            pooled, where = [], []
            for w in widths:
                z = x @ net.conv[w][0]
                for j in range(1, w):
                    z[:-j] += x[j:] @ net.conv[w][j]
                top = _maxima(z, begin, stop)
                at = np.empty(top.shape, np.int64)
                for d in range(len(pick)):
                    at[d] = begin[d] + z[begin[d] : stop[d]].argmax(0)
                pooled.append(top)
                where.append(at)
            a = np.concatenate(pooled, 1) + net.bias
            r = np.maximum(a, 0)
            p = 1 / (1 + np.exp(-(r @ net.out + params["ob"][0])))
            dz = (p - y[pick]) * weight[pick] / len(pick)
            grads = {"out": r.T @ dz + 1e-4 * net.out, "ob": np.array([dz.sum()], np.float32)}
            da = np.outer(dz, net.out).astype(np.float32) * (a > 0)
            grads["bias"] = da.sum(0)
            gx = np.zeros_like(vec)
            for n, w in enumerate(widths):
                d, at = da[:, n * filters : (n + 1) * filters], where[n]
                gc = np.zeros_like(net.conv[w])
                for j in range(w):
                    pos = np.minimum(at + j, len(x) - 1)
                    live = (at + j < len(x))[..., None]
                    gc[j] = np.einsum("df,dfe->ef", d, x[pos] * live)
                    np.add.at(gx, local[pos], d[..., None] * net.conv[w][j].T[None] * live)
                grads[f"c{w}"] = gc
            scale = lr * (1 - 0.999**t) ** 0.5 / (1 - 0.9**t)
            for q, g in grads.items():
                m[q] += 0.1 * (g - m[q])
                v2[q] += 0.001 * (g * g - v2[q])
                params[q] -= scale * m[q] / (np.sqrt(v2[q]) + 1e-8)
            if len(real):
                hot = np.abs(gx[used > 0]).sum(1) > 0  # words that some filter took its maximum from
                g = np.repeat((gx[used > 0] / norm)[hot], span[hot], axis=0)
                touched = rows[np.repeat(hot, span)]
                u, back = np.unique(touched, return_inverse=True)
                ge = np.zeros((len(u), dim), np.float32)
                np.add.at(ge, back, g)
                em[u] += 0.1 * (ge - em[u])
                ev[u] += 0.001 * (ge * ge - ev[u])
                net.emb[u] -= scale * em[u] / (np.sqrt(ev[u]) + 1e-8)
    net.out_bias = float(params["ob"][0])
    return net


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` summed in one order: BLAS rounds a row by how many others there are."""
    out = np.zeros((len(a), b.shape[1]), np.float32)
    for i in range(len(b)):
        out += a[:, i, None] * b[i]
    return out


class Scorer:
    """Scores of texts; keeps what at most ``most`` distinct words add to the filters."""

    def __init__(self, net: Net, most: int = 200_000):
        self.net, self.most = net, most
        # one column block per width and place
        self.flat = np.concatenate([net.conv[w][j] for w in net.widths for j in range(w)], axis=1)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1, self.flat.shape[1]), np.float32)

    def _ids(self, words: list[str]) -> np.ndarray:
        new = list(set(words).difference(self.known))
        if new:
            if len(new) + len(self.known) > self.most and self.known:
                self._clear()
                new = list(set(words))
            at = len(self.rows)
            self.known.update(zip(new, range(at, at + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, _product(vectors(new, self.net.emb), self.flat)])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _raw(self, words: list[list[str]], goes_on: bool = False) -> np.ndarray:
        """Filter maxima of the words of a few texts.  ``goes_on``: of one slice before the last, where a filter that its end cuts off does not count."""
        known = self._ids([w for x in words for w in x])
        ids, starts, stops = _layout(np.split(known, np.cumsum([len(x) for x in words])[:-1]), max(self.net.widths))
        f, col, out = self.net.bias.size // len(self.net.conv), 0, []
        for w in self.net.widths:
            z = self.rows[ids, col : col + f]
            for j in range(1, w):
                c = col + j * f
                z[:-j] += self.rows[ids[j:], c : c + f]
            col += w * f
            out.append(np.max(z[: max(len(words[0]) - w + 1, 0)], axis=0, initial=0)[None] if goes_on else _maxima(z, starts, stops))
        return np.concatenate(out, axis=1)

    def scores(self, texts: list[str | None], most_chars: int = 1 << 20) -> np.ndarray:
        pooled, i = [], 0
        while i < len(texts):
            j, n = i, 0
            while j < len(texts) and (j == i or n + len(texts[j] or "") <= most_chars):
                n += len(texts[j] or "")
                j += 1
            if j == i + 1 and n > 4 * most_chars:
                pooled.append(self._long(texts[i], most_chars))
            else:
                pooled.append(self._raw([words_of(t) for t in texts[i:j]]))
            i = j
        a = np.maximum(np.concatenate(pooled) + self.net.bias, 0)
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-(_product(a, self.net.out[:, None])[:, 0] + self.net.out_bias).astype(np.float64)))

    def _long(self, text: str, step: int) -> np.ndarray:
        """One very long text in slices that overlap by a filter's width; what one cuts off is whole in the next."""
        out, at, over = None, 0, max(self.net.widths) - 1
        words = words_of(text)
        per = step // 8
        while at == 0 or at < len(words):
            part = self._raw([words[max(0, at - over) : at + per]], at + per < len(words))
            out = part if out is None else np.maximum(out, part)
            at += per
        return out


def best_threshold(scores: np.ndarray, labels: np.ndarray, default: float = 0.5) -> float:
    """Between the two scores where F1 is greatest, but from 0.2 to 0.8; ``default`` if a label is missing or there are under 20 rows."""
    if len(labels) < 20 or labels.min() == labels.max():
        return default
    order = np.argsort(-scores, kind="stable")
    y = labels[order]
    tp = np.cumsum(y)
    f1 = 2 * tp / (np.arange(len(y)) + 1 + y.sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    i = int(best[np.argmin(np.abs(scores[order][best] - default))])
    low = scores[order][i + 1] if i + 1 < len(y) else 0.0
    mid = float((scores[order][i] + low) / 2)
    return float(np.clip(mid, 0.2, 0.8))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", max_chars: int = 50_000) -> Net:
    """A net for ``labels (doc_id, toxic)``, without rows whose crc32 of the id modulo 5 is 0.

    At most ``per_class`` texts of each label, of ``max_chars`` characters at
    most, are collected, ordered by a hash of the id: one per id, that of the
    least hash where an id repeats.  An id with both labels counts as toxic;
    other labels and null ids are left out.  One eighth sets thresholds per
    language and is not fitted on; a language with under 20 rows there, or
    with one label only, takes the common threshold, and all are kept between
    0.2 and 0.8, as few rows tell little of the ends of the scale.
    """
    lab = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    lab = lab.where(F.crc32(F.col("_id").cast("string").cast("binary")) % 5 != 0)
    chosen = [lab.where(F.col("toxic") == y).orderBy(F.xxhash64(F.lit("toxicity"), "_id"), "_id").limit(per_class) for y in (0, 1)]
    lang = F.col(lang_col) if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    d = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("t"), lang.cast("string").alias("l"))
    d = d.join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col("_doc") == F.col("_id")).where(F.coalesce(F.length("t"), F.lit(0)) <= max_chars)
    rows = d.groupBy("_id").agg(F.min_by(F.struct("t", "l", "toxic"), F.struct(F.xxhash64("t").alias("h"), "l")).alias("x")).select("_id", "x.*").collect()
    rows.sort(key=lambda r: (str(r._id), r.t or ""))
    held = [i % 8 == 3 for i in range(len(rows))]
    net = fit([r.t for r, h in zip(rows, held, strict=True) if not h], [r.toxic for r, h in zip(rows, held, strict=True) if not h])
    tune = [r for r, h in zip(rows, held, strict=True) if h]
    s, y = Scorer(net).scores([r.t for r in tune]) if tune else np.zeros(0), np.array([r.toxic for r in tune])
    net.thresholds = {"": best_threshold(s, y)}
    for name in sorted({r.l for r in tune if r.l}):
        own = np.array([r.l == name for r in tune])
        net.thresholds[name] = best_threshold(s[own], y[own], net.thresholds[""])
    return net


def score(docs: DataFrame, net: Net, text_col: str = "text", lang_col: str | None = "lang", out_cols: tuple[str, str] = ("score", "rejected")) -> DataFrame:
    """``docs`` with ``out_cols``: the score (double), and whether it reaches the threshold of the row's language.

    Null and empty texts have the score of a text without words.  Unknown and
    null languages take the common threshold.  Columns of these two names are
    replaced.
    """
    keep = [c for c in docs.columns if c not in out_cols]
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        scorer = Scorer(sent.value)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                s = scorer.scores(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(s, pa.float64())], names=[*part.schema.names[1:], out_cols[0]])

    own = free("t", keep)
    d = docs.select(F.col(text_col).cast("string").alias(own), *keep)
    schema = d.drop(own).schema.add(out_cols[0], "double")
    out = in_small_batches(d).mapInArrow(run, schema)
    limit = F.lit(net.thresholds.get("", 0.5))
    if lang_col and lang_col in keep and net.thresholds:
        limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in net.thresholds.items() for x in kv]), F.col(lang_col).cast("string")), limit)
    return out.withColumn(out_cols[1], F.col(out_cols[0]) >= limit)


def without_toxic(docs: DataFrame, net: Net) -> DataFrame:
    """``docs`` without rejected rows."""
    names = free("score", docs.columns), free("rejected", docs.columns)
    return score(docs, net, out_cols=names).where(~F.col(names[1])).select(*docs.columns)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, score, predicted, rejected`` of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = train(docs, table(spark, sf_dir, "labels"))
    thin = score(docs.select("doc_id", "lang", F.col("text").alias("t")).select("doc_id", "lang", "t"), net, "t").select("doc_id", "score", "rejected")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return thin.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "rejected")


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLE: dict[str, str] = {}
